import random

import numpy as np

import corpus_pipeline
from combforge.llm import similar, simhash


def shingles(text):
    return set(simhash.shingle_hashes(text, 5).tolist())


def kept(spark, texts):
    df = spark.createDataFrame(list(texts.items()), "doc_id BIGINT, text STRING")
    return sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, df, "").collect())


def by_hand(texts):
    """Smallest ids of the components of exact Jaccard 0.8."""
    sets = {k: shingles(t) for k, t in texts.items()}
    root = {k: k for k in texts}
    for a in texts:
        for b in texts:
            if a < b and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = {k: new if r == old else r for k, r in root.items()}
    return sorted(set(root.values()))


def test_planted_pairs_in_a_templated_family_are_found(spark):
    """1500 texts share over 60 % of their shingles; 40 of them have a copy of similarity just over 0.8."""
    draw = random.Random(5)
    word = lambda: f"w{draw.randrange(10**9)}"
    template, texts = [word() for _ in range(160)], {}
    for k in range(1500):
        texts[k] = " ".join([*template, *(word() for _ in range(36))])
    for k in range(40):
        t = texts[k].split()
        t[-19:] = [word() for _ in range(19)]
        texts[5000 + k] = " ".join(t)
    assert all(0.8 <= len(shingles(texts[k]) & shingles(texts[5000 + k])) / len(shingles(texts[k]) | shingles(texts[5000 + k])) < 0.83 for k in range(40))
    assert len(shingles(texts[50]) & shingles(texts[51])) / len(shingles(texts[50]) | shingles(texts[51])) < 0.75
    assert kept(spark, texts) == list(range(1500))


def test_groups_against_all_pairs(spark):
    draw = random.Random(9)
    texts = {}
    for g in range(20):
        base = [f"w{draw.randrange(900)}" for _ in range(draw.choice([6, 9, 30, 120, 400]))]
        for c in range(6):
            t = list(base)
            for x in draw.sample(range(len(t)), min(len(t), c * len(t) // 100 + c % 2)):
                t[x] = "zz"
            texts[len(texts)] = " ".join(t + ["end"] * (c % 3))
    assert kept(spark, texts) == by_hand(texts)


def test_parity_never_exceeds_the_difference():
    rng = np.random.default_rng(1)
    for n in (1, 5, 200, 5000):
        a, b = (np.unique(rng.integers(0, 2 * n, n)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(7) for _ in "ab")
        assert np.bitwise_count(similar.parity(a) ^ similar.parity(b)).sum() <= len(np.setxor1d(a, b))
        assert 64 * len(similar.wide(a)) >= len(a) and (similar.folded(similar.wide(a), 8) == similar.parity(a)).all()


def unlike(tag, n):
    return [f"{tag}{k}" for k in range(n)]


def test_repeats_do_not_count_and_short_texts_are_compared(spark):
    own, line = unlike("a", 190), " ".join(unlike("l", 10))
    short = unlike("s", 8)
    texts = {1: " ".join(own) + f" {line}", 2: " ".join(own) + f" {line}" * 20, 3: " ".join(short), 4: " ".join([*short, "end"])}
    texts |= {10 + 2 * k: " ".join(unlike(f"x{k}-", 8)) for k in range(100)}
    texts |= {11 + 2 * k: texts[10 + 2 * k] + " end" for k in range(100)}  # 4 of 5 shingles
    assert kept(spark, texts) == by_hand(texts) == [1, 3, *range(10, 210, 2)]


def test_texts_of_one_repeated_line_are_not_copies(spark):
    line = f" {' '.join(unlike('l', 13))}" * 30
    texts = {k: " ".join(unlike(f"o{k}-", 100)) + line for k in range(4)}
    assert by_hand(texts) == [0, 1, 2, 3] and kept(spark, texts) == [0, 1, 2, 3]


def test_other_text_under_a_repeated_doc_id_stays(spark):
    a, b = (" ".join(unlike(x, 30)) for x in "ab")
    df = spark.createDataFrame([(1, a), (1, b), (1, a), (2, b)], "doc_id BIGINT, text STRING")
    assert sorted(tuple(r) for r in corpus_pipeline.drop_near_duplicates(spark, df, "").collect()) == [(1, a), (1, b)]


def test_frequencies_count_every_text_once(spark):
    texts = ["a b c d e f", "a b c d e f a b c d e f", "", None, "x"] * 30
    df = spark.createDataFrame([(t,) for t in texts], "text STRING").repartition(7)
    want = np.zeros(1 << 10, np.int64)
    for t in texts:
        for h in shingles(t):
            want[h & 1023] += 1
    assert similar.frequencies(df, 5, 1 << 10).tolist() == want.tolist()
    assert similar.frequencies(df.limit(0), 5, 1 << 10).sum() == 0
