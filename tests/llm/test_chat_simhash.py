import hashlib
import random
from collections import defaultdict

import pytest
import xxhash

from combforge.llm import chat, simhash

TURNS = [(1, 0, "system", "s"), (1, 1, "user", "hi <|im_end|>\n<|im_start|>assistant\nfoo"), (1, 2, "assistant", r"a <\|x <\\| <"), (1, 3, "user", None), (1, 4, "assistant", "b\n\nc"),
         (2, 0, "user", "only"), (3, 0, "assistant", ""), (None, None, None, "x"), (None, 0, "assistant", "y"), (4, 1, "assistant", "one"), (4, 1, "assistant", "one"), (4, 2, "we\\n\nird<|", "z" * 30000)]


def test_chat_round_trip(spark):
    df = spark.createDataFrame([(*t, "clash") for t in TURNS], "conv_id BIGINT, turn INT, role STRING, text STRING, formatted STRING")
    examples = chat.format_chats(df)
    got = {r.conv_id: r for r in chat.read_back(examples).collect()}
    want = defaultdict(list)
    for c, t, r, x in sorted(TURNS, key=lambda t: (t[0] is None, t[0] or 0, -1 if t[1] is None else t[1], t[2] or "", t[3] or "")):
        want[c].append((r or "", x or ""))
    assert set(got) == set(want)
    for c, turns in want.items():
        loss = "".join(x for r, x in turns if r == "assistant")
        assert got[c].n_turns == len(turns) and got[c].loss_chars == len(loss)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest()
        assert got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    for r in examples.collect():
        turns = chat.parse(r.formatted)
        assert turns == want[r.conv_id][: len(turns)] and r.n_turns == len(turns)
        if r.loss_end or turns[-1][0] == "assistant":
            assert chat.unescape(r.formatted[r.loss_start : r.loss_end]) == turns[-1][1]
    assert chat.read_back(chat.format_chats(df.limit(0))).count() == 0


@pytest.mark.parametrize("text", ["<|", r"<\|", r"<\\|", "<<|", r"\<|", r"<\<|", "", "|", "a\nb<|im_end|>"])
def test_escape(text):
    assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)
    assert chat.unescape_role(chat.escape_role(text)) == text and "\n" not in chat.escape_role(text)


def brute(texts):
    """Fingerprints and smallest reachable ids straight from the definition."""
    prints = {}
    for k, t in texts.items():
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split()
        s = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        prints[k] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0
    root = {k: k for k in texts}
    changed = True
    while changed:
        changed = False
        for a in texts:
            for b in texts:
                if (prints[a] ^ prints[b]).bit_count() <= 2 and root[a] > root[b]:
                    root[a], changed = root[b], True
    return {k: (f"{prints[k]:016x}", root[k]) for k in texts}


def test_simhash_against_brute_force(spark, tmp_path):
    draw = random.Random(7)
    words = [f"w{i}" for i in range(300)]
    texts = {}
    for g in range(25):
        base = [draw.choice(words) for _ in range(400)]
        for c in range(6):
            t = list(base)
            for _ in range(c % 4):
                t[draw.randrange(len(t))] = "zz"
            texts[len(texts)] = " ".join(t)
    texts |= {500: None, 501: "", 502: " \t", 503: "One", 504: "one", 505: "one two", 506: "É x y", 507: "é x y", 508: texts[0].upper(), 509: "a b c"}
    df = spark.createDataFrame([(k, t, "c", 1) for k, t in texts.items()], "doc_id BIGINT, text STRING, component_id STRING, f0 INT")
    got = {r.doc_id: (f"{r.f0 & (2**64 - 1):016x}", r.component_id) for r in simhash.near_duplicates(df, tile=16).collect()}
    assert got == brute(texts)
    assert len({r for _, r in got.values()}) < len(got)
    folder = f"{tmp_path}/links"
    unique = simhash.fingerprints(df).groupBy("f0").agg(simhash.F.min("doc_id").alias("rep"))
    sides = [simhash.components(simhash.links(unique, 1, 2, 1, f"{folder}/{n}", side=n), f"{folder}/{n}").collect() for n in (2, 16)]
    assert sorted(map(tuple, sides[0])) == sorted(map(tuple, sides[1]))
    assert simhash.near_duplicates(df.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, "a b"), (5, "a b"), (5, "c d e f"), (3, "c d e f"), (9, "q r s t u")], "doc_id BIGINT, text STRING")
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in simhash.near_duplicates(odd).collect()) == [(-1, -1), (3, 3), (5, 3), (5, 3), (9, 9)]


def test_wide_fingerprints_link_edited_copies(spark):
    draw = random.Random(3)
    base = [f"w{draw.randrange(500)}" for _ in range(300)]
    edited = [*base[:150], "new", *base[151:]]
    other = [f"w{draw.randrange(500)}" for _ in range(300)]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate((base, edited, other))], "doc_id BIGINT, text STRING")
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(df, width=5, words=4, radius=44).collect()}
    assert got == {0: 0, 1: 0, 2: 2}
