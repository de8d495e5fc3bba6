import math
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

import corpus_pipeline
from combforge.llm import decontaminate, language, mixing, sharding

EN = "the cat and the dog went to the house with their friends because they were hungry"
DE = "der hund und die katze gingen mit ihren freunden nach hause weil sie hunger hatten"


def model():
    return language.fit([("en", EN), ("de", DE)], language.read_pieces())


def test_forward_sums_all_segmentations():
    m = model()
    word = "▁the"
    total = np.zeros(2)
    for r in range(len(word)):
        for cuts in combinations(range(1, len(word)), r):
            ends = [0, *cuts, len(word)]
            p = np.ones(2)
            for a, b in zip(ends, ends[1:]):
                p = p * m.probability[m.pieces.get(word[a:b], 1 if b - a == 1 else 0)]
            total += p
    assert np.allclose(m.forward([word])[0], np.log(total))
    assert np.allclose(m.probability.sum(0), 1, atol=1e-3)
    assert all(math.isfinite(x) for x in m.forward(["▁" + "q" * 23, "ж", "▁" + "the" * 2000]).ravel())


def test_words_of_any_length_are_summed_whole():
    m = language.fit([("a", "ab abc cab"), ("b", "ba bca")], ["▁", "▁a", "▁ab", "a", "ab", "abc", "b", "bc", "abcabcabcabca"])
    word = "▁" + "abcab" * 12
    total = [[1.0] + [0.0] * len(word) for _ in m.languages]
    for c in range(2):
        for j in range(1, len(word) + 1):
            total[c][j] = math.fsum(total[c][i] * m.probability[m.pieces.get(word[i:j], 1 if j - i == 1 else 0), c] for i in range(j))
    assert len(word) == 61 and np.allclose(m.forward([word])[0], np.log([t[-1] for t in total]))


def test_identify(spark):
    rows = [(1, "The dogs and the house", "x"), (2, "die katzen nach hause", None), (3, None, "x"), (4, "", "x"), (5, "12 34 _ !", "x"), (None, EN, "x"), (7, "the house " * 20000, "x"), (7, "the house " * 20000, "x")]
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, score STRING")
    got = [(r.doc_id, r.lang_pred, r.score) for r in language.identify(df, model()).collect()]
    assert language.identify(spark.createDataFrame([("²the dog",), ("²",)], "text STRING"), model()).select("lang_pred").collect() == [("en",), ("und",)]
    assert [g[1] for g in got] == ["en", "de", "und", "und", "und", "en", "en", "en"] and all(0 <= g[2] <= 1 for g in got)
    assert {r.lang_pred for r in language.identify(df, None).collect()} == {"und"}
    assert language.identify(df.limit(0), model()).count() == 0


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = language.op2_language(spark, "/root/testdata/sf0.001").join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(got) > 20 and sum(r.lang == r.lang_pred for r in got) >= 0.95 * len(got)


ITEM = "A train leaves Boston at 9 and travels 300 km before it meets Alice who walked 9 km to the old bridge"
SAME = "Earlier text. so A train leaves Madrid at 7 and travels 420 km before it meets Bob who walked 7 km to the old bridge and more"
BROKEN = "Earlier text. so A train leaves Madrid at 7 and travels 420 km before it meets Bob who walked 8 km to the old bridge and more"


def test_leaks(spark):
    docs = spark.createDataFrame([(1, ITEM, 0), (2, SAME, 0), (3, "nothing of the kind to see here at all", 0), (4, None, 0), (5, "", 0), (None, ITEM, 0), (6, "x " * 30000 + ITEM, 0), (7, "short one", 0)], "doc_id BIGINT, text STRING, item_id INT")
    bench = spark.createDataFrame([(10, ITEM), (11, "short one"), (12, None), (13, ""), (10, ITEM)], "item_id INT, text STRING")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.find_leaks(docs, bench).collect()}
    assert set(got) == {(1, 10), (2, 10), (None, 10), (6, 10), (7, 11)}
    assert got[2, 10].reparameterised and not got[1, 10].reparameterised and got[6, 10].start_word == 30000
    assert [r.doc_id for r in decontaminate.clean(docs, bench).collect()] == [3, 4, 5]
    assert decontaminate.find_leaks(docs, bench.limit(0)).count() == 0 and decontaminate.clean(docs.limit(0), bench).count() == 0


def found(spark, texts, items):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id BIGINT, text STRING")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id BIGINT, text STRING")
    return {(r.doc_id, r.item_id): r for r in decontaminate.find_leaks(docs, bench).collect()}


def canon(text):
    """Symbols of a text and the value of each placeholder, word by word."""
    words = text.split()
    strip = [w.strip(decontaminate._OUTER) or w for w in words]
    starts = [i == 0 or words[i - 1][-1] in ".!?:…" for i in range(len(words))]
    number = [any(c.isdigit() for c in w) for w in strip]
    unit = [i > 0 and number[i - 1] and not number[i] and w.lower() in decontaminate.UNITS for i, w in enumerate(strip)]
    capital = [w[0].isupper() and not number[i] and not unit[i] for i, w in enumerate(strip)]
    inside = {w.lower() for i, w in enumerate(strip) if capital[i] and not starts[i]}
    low = {w.lower() for w in strip if not w[0].isupper()}
    name = [capital[i] and (not starts[i] or (w.lower() in inside and w.lower() not in low)) for i, w in enumerate(strip)]
    out = []
    for i, w in enumerate(strip):
        if unit[i] or (i and name[i] and name[i - 1] and not starts[i]):
            out[-1][1] += "" if unit[i] else " " + w.lower()
        else:
            out.append(["#" if number[i] else "@" if name[i] else w.lower(), w.lower() if number[i] or name[i] else ""])
    return [x[0] for x in out], [x[1] for x in out], [w.lower() for w in strip]


def longest(hits):
    best = {}
    for p, a in sorted(hits):
        best[p, a] = 1 + max((n for (q, b), n in best.items() if q < p and b < a and abs(p - a - q + b) <= 3), default=0)
    return max(best.values(), default=0)


def brute(text, item):
    """Matched windows of the better form, as far as slots agree; None: not found."""
    (h, value, plain), (g, mine, whole) = canon(text), canon(item)
    out = []
    for own, other, form in ((h, g, 0), (plain, whole, 1)):
        w = min(5, len(other))
        ats = [a for a in range(len(other) - w + 1) if form or set(other[a : a + w]) - {"#", "@"}]
        hits = [(p, a) for p in range(len(own) - w + 1) for a in ats if own[p : p + w] == other[a : a + w]]
        if not form:
            pairs = {(a + k, p + k) for p, a in hits for k in range(w) if other[a + k] in "#@"}
            for m in set(mine) - {""}:
                values = {value[q] for a, q in pairs if mine[a] == m}
                assert len(values) <= 1  # slots that disagree are tested apart
        run = max((sum((p + k, a + k) in hits for k in range(16)) for p, a in hits), default=0)
        n = longest(hits)
        if n and (n >= 0.5 * len(ats) or (form and run == 16)):
            out.append((n / len(ats), n))
    return max(out)[1] if out else None


def test_leaks_against_brute_force(spark):
    draw = np.random.default_rng(8)
    word = lambda: "".join(draw.choice(list("abcdefgh"), 5))
    items = ["Once Tom Ray bought 88 kg of " + " ".join(word() for _ in range(n)) + f" and Ann sold {n} of them to Tom Ray for 7 euros" for n in (3, 12, 45)] + ["one two", "4 5 6 7 8 9", "Zed"]
    texts = []
    for i in items:
        w = i.split()
        noise = lambda: " ".join(word() for _ in range(6))
        texts += [f"{noise()}. {x} {noise()}" for x in (i, i.lower(), i.upper(), i.replace("Tom Ray", "Jim").replace("88 kg", "9").replace("Ann", "Mary Lou"), " ".join(w[: len(w) // 2] + ["xx", "yy"] + w[len(w) // 2 :]), " ".join(w[: len(w) * 2 // 5]), " ".join(w[5:27]))]
    texts += ["1 2 3 4 5 6 7 8 9 " * 50, "nothing at all of the kind", f"{items[0]}. {items[3]}. Zed"]
    got = {k: r.n_matched for k, r in found(spark, texts, items).items()}
    want = {(d, i): brute(t, x) for d, t in enumerate(texts) for i, x in enumerate(items)}
    assert got == {k: n for k, n in want.items() if n} and len(got) > 15


def test_slot_consistency(spark):
    got = found(spark, [SAME, BROKEN], [ITEM])
    assert (1, 0) not in got or got[1, 0].n_matched < got[0, 0].n_matched


def test_slots_of_another_length_insertions_and_verbatim_runs(spark):
    other = ITEM.replace("Boston", "New York").replace("Alice", "Mary Ann").replace("9", "12").replace("300", "410")
    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("abcdef"), 7)) for _ in range(59)]
    long = " ".join(words)
    inserted = " ".join([*words[:20], "one", "two", *words[20:40], "three", "four", *words[40:]])
    got = found(spark, ["before. " + other, inserted, "x y " + " ".join(words[10:31]) + " z", " ".join(words[10:26])], [ITEM, long])
    assert set(got) == {(0, 0), (1, 1), (2, 1)} and got[0, 0].reparameterised


def test_names_at_sentence_starts_and_copies_in_other_case(spark):
    names = "Tom has 5 apples. Ann has 3 apples. Tom gives Ann 2 apples. How many apples has Tom now?"
    other = "Bob has 8 apples. Eve has 4 apples. Bob gives Eve 1 apples. How many apples has Bob now?"
    german = "Der Bauer bringt seine Milch mit dem Wagen zum Markt und kauft dort Brot und Käse für die Kinder"
    texts = [other, german.lower(), german.upper(), ITEM.upper(), "before. " + SAME, german.replace("Milch", "Butter").replace("Brot", "Salz")]
    assert set(found(spark, texts, ["", ITEM, names, german])) == {(0, 2), (1, 3), (2, 3), (3, 1), (4, 1), (5, 3)}


@pytest.mark.parametrize("n", [0, 60])
def test_pipeline_decisions(spark, tmp_path, n):
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    item = " ".join(word() for _ in range(20))
    texts = [" ".join(word() for _ in range(80)) for _ in range(n)]
    rows = [(i, t, "en", f"s{i % 2}", len(t)) for i, t in enumerate(texts)]
    if n:
        rows += [(100, texts[0], "en", "s0", 1), (101, texts[1] + " end", "en", None, 1), (102, texts[2] + " " + item, None, "s1", 1), (103, "12 34", "en", "s1", 1), (104, None, None, None, None), (0, texts[0], "en", "s0", 1)]
    schema = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars INT"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id BIGINT, text STRING").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(0, 1, 0)], "doc_id BIGINT, quality INT, toxic INT").write.parquet(str(tmp_path / "labels.parquet"))
    docs, left = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        left.append(sorted(r.doc_id for r in docs.collect()))
    if n:
        assert left[0] == sorted([0, *range(n), 100, 101, 102])
        sets = [set(zip(*(t.split()[k:] for k in range(5)))) for t in (texts[2], texts[2] + " " + item)]
        assert len(sets[0] & sets[1]) < 0.8 * len(sets[0] | sets[1])  # so 102 is no near copy
        assert left[1] == [*range(n), 102]
        assert left[2] == [*range(n)]
    taken = corpus_pipeline.mix_sources(spark, docs, str(tmp_path)).collect()
    decided = mixing.mix(docs, mixing.quality_weights(spark, str(tmp_path))).select("row.doc_id", "copies").collect()
    assert Counter(r.doc_id for r in taken) == +Counter({r.doc_id: r.copies for r in decided})
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == [*docs.columns, "shard", "slot"]
    out = out.collect()
    assert Counter((r.doc_id, r.text) for r in out) == Counter((r.doc_id, r.text) for r in taken)
    order = [r.doc_id for r in sorted(out, key=lambda r: (r.shard, r.slot))]
    sizes = Counter(r.shard for r in out)
    assert not out or max(sizes.values()) - min(sizes[s] for s in range(24)) <= 1
    assert order == [r.doc_id for r in sharding.interleave(spark.createDataFrame(taken, docs.schema)).select("row.doc_id", "shard", "slot").orderBy("shard", "slot").collect()]
    clash = corpus_pipeline.cut_shards(spark, docs.withColumn("SHARD", corpus_pipeline.F.lit("x")), str(tmp_path))
    assert clash.columns == [*docs.columns, "SHARD", "shard_", "slot"] and clash.count() == n
