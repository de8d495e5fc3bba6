import random

import numpy as np
import pytest

from combforge.llm import suffixes


def test_equal_strings():
    s, gram = [b"xxabcdefyy", b"abcdef", b"zabcdefyq", bytes([255]) * 8, b""], [4, 2, 3, 0, 0]
    number, start, cls = suffixes.equal_strings(s, np.array(gram), 4)
    got = {}
    for i, p, c in zip(number, start, cls):
        got.setdefault(c, []).append((s[i][p : p + 4], p - gram[i]))
    assert sum(map(len, got.values())) == sum(max(0, len(x) - 3) for x in s)
    assert all(len(set(v)) == 1 for v in got.values()) and len({v[0] for v in got.values()}) == len(got)


def brute(texts, width):
    seen, out = set(), {}
    for k in sorted(texts):
        b = (texts[k] or "").encode()
        gone = [False] * len(b)
        for p in range(len(b) - width + 1):
            if b[p : p + width] in seen:
                gone[p : p + width] = [True] * width
            seen.add(b[p : p + width])
        cuts = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out[k] = (len(b), sum(gone), cuts, bytes(c for c, g in zip(b, gone) if not g))
    return out


@pytest.mark.parametrize("hot", [5000, 3])
def test_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(suffixes, "HOT", hot)
    monkeypatch.setattr(suffixes, "COLLECTION", 20)
    draw = random.Random(2)
    word = lambda: "".join(draw.choice("abcdeé ") for _ in range(draw.randrange(3, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, near = text(40), text(100)
    texts = {i: text(draw.randrange(5, 60)) for i in range(30)}
    for i in range(30, 60):
        texts[i] = text(5) + passage + text(5)
    for i in range(60, 70):
        at = draw.randrange(len(near))
        texts[i] = near[:at] + "#" + near[at + 1 :]
    texts |= {70: "a" * 500, 71: None, 72: "", 73: "x" * 99, 74: texts[0], 75: "ab" * 300, 76: near[:100], 77: near[:99]}
    df = spark.createDataFrame([(k, t, "n") for k, t in texts.items()], "doc_id BIGINT, text STRING, body STRING")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffixes.remove_repeats(df).collect()}
    assert got == brute(texts, 100)


def test_edges(spark):
    t = "".join(chr(97 + i % 23) + str(i) for i in range(60))
    df = spark.createDataFrame([(None, t), (1, t), (1, t), (2, "q" + t), (2, "r" + t)], "doc_id BIGINT, text STRING")
    got = sorted((r.doc_id or -1, r.n_removed, r.n_bytes) for r in suffixes.remove_repeats(df).collect())
    n = len(t)
    assert got == [(-1, 0, n), (1, n, n), (1, n, n), (2, n, n + 1), (2, n, n + 1)]
    assert suffixes.remove_repeats(df.limit(0)).count() == 0
