"""Small inputs with results worked out by hand."""

import pytest

from combforge import MiningConfig, PartitionedPlan, from_dict, mine_motifs
from combforge.functions import memory
from combforge.operators.partition import bucket_ranges
from combforge.operators.sketch import CountMinSketch
from combforge.sources import CONVOLUTION, ORDINARY, normalise


def conv(spark, sequences):
    return from_dict(spark, {i: [(f, 1.0, p) for f, p in s] for i, s in enumerate(sequences, 1)}, CONVOLUTION)


def mined(spark, sequences, k, least=1, **more):
    return sorted(tuple(r) for r in mine_motifs(conv(spark, sequences), k, 8, least, **more).collect())


TRIPLE = [(22, 8), (8, 20), (39, 35)]


def test_two_of_three(spark):
    five = [[(2, 5), (2, 10), (3, 15)], [(1, 15), (3, 25)], [(2, 1), (2, 6), (3, 12)], [(1, 3), (2, 8), (4, 20)], [(3, 7), (4, 14)]]
    keys = [(r[0], r[1], r[2], r[5]) for r in mined(spark, five, 2)]
    assert keys == [(1, 3, 2, 2), (1, 4, 9, 4), (2, 3, 2, 1), (2, 3, 3, 3), (2, 4, 4, 4)]
    assert len(mined(spark, five, 2, overlap="allow")) == 11 and memory.batch_layout(5, 2)[0] == 3


@pytest.mark.parametrize("times,least", [(1, 1), (2, 1), (20, 5)])
def test_one_motif(spark, times, least):
    assert mined(spark, [TRIPLE] * times, 3, least) == [(22, 8, 39, 4, 7, 8, 42, i, 3.0, times) for i in range(1, times + 1)]


def test_higher_orders(spark):
    assert mined(spark, [[*TRIPLE, (15, 50)]], 4) == [(22, 8, 39, 15, 4, 7, 7, 8, 57, 1, 4.0, 1)]
    assert mined(spark, [[(1, 40), (2, 10), (3, 30), (4, 20), (5, 50)]], 5) == [(2, 4, 3, 1, 5, 2, 2, 2, 2, 10, 57, 1, 5.0, 1)]


def test_overlap(spark):
    close = [[(22, 8), (8, 20), (39, 25)]]
    assert mined(spark, close, 3) == []
    assert mined(spark, close, 3, overlap="allow") == [(22, 8, 39, 4, -3, 8, 32, 1, 3.0, 1)]


def test_planted_pair_among_noise(spark):
    noise = [[(k, 3)] for k in range(1, 11)]
    assert mined(spark, [[(5, 10), (10, 30)]] * 20 + noise, 2, 10) == [(5, 10, 12, 10, 37, i, 2.0, 20) for i in range(1, 21)]


def test_distances(spark):
    places = [(10, 25, 40), (8, 20, 35), (5, 15, 25), (1, 10, 20)]
    rows = mined(spark, [list(zip((22, 8, 39), p)) for p in places for _ in range(2)], 3)
    assert sorted(r[3:5] for r in rows) == sorted([(7, 7), (4, 7), (2, 2), (1, 2)] * 2) and {r[-1] for r in rows} == {2}


def test_far_apart_features_are_counted(spark):
    df = conv(spark, [[(1, 10), (2, 100), (3, 1000)]])
    for method in ("exact", "cms", "cms_verified"):
        assert mine_motifs(df, 3, 8, method=method).count() == 1


def test_hundred_equal_sequences(spark):
    df = conv(spark, [[(1, 10), (2, 20), (3, 35), (4, 50)]] * 100)
    rows = mine_motifs(df, 3, 8).collect()
    assert len(rows) == 400 and {r["count"] for r in rows} == {100}
    found = memory.auto_configure(df, 3)
    assert (found["batch_size"], found["memory_per_point_kb"], found["fixed_memory_mb"]) == (100, 68 / 1024, 2_174_888 / 1024**2)
    assert found["memory_per_batch_mb"] == (2_174_888 + 6800) / 1024**2 and found["estimated_peak_memory_gb"] == (2_174_888 + 6800) / 1024**3
    assert memory.batch_layout(100, 25) == (4, 25)
    one = memory.auto_configure(conv(spark, [[(1, 5)]]), 1)
    assert (one["batch_size"], one["num_batches"]) == (10, 1)
    assert CountMinSketch.build([f"k{i}" for i in range(5)], 1e-3, 1e-4).size == (7, 27183)


def test_report_names_every_figure(spark):
    lines = memory.memory_report(conv(spark, [[(1, 10), (2, 20), (3, 35), (4, 50)]] * 100), 3, MiningConfig(batch_size=25)).split("\n")
    assert [x.split()[-1] for x in lines] == ["100", "4", "3", "25", "4", "2.07", "0.07", "2.08"]


def of_lengths(spark, lengths):
    return from_dict(spark, {i: [(k + 1, 1.0) for k in range(n)] for i, n in enumerate(lengths)}, ORDINARY)


@pytest.mark.parametrize(
    "lengths,width,ranges",
    [
        ((2, 3, 15, 25, 28), 10, [(2, 11, 2), (12, 21, 1), (22, 28, 2)]),
        ((), 10, []),
        ((1,), 10, [(1, 1, 1)]),
        ((5,) * 10, 10, [(5, 5, 10)]),
        (range(1, 31), 5, [(a, a + 4, 5) for a in range(1, 31, 5)]),
        (range(1, 31), 15, [(1, 15, 15), (16, 30, 15)]),
        ((5,) * 20 + (50,) * 20, 10, [(5, 14, 20), (45, 50, 20)]),
    ],
)
def test_bucket_ranges(spark, lengths, width, ranges):
    found = bucket_ranges(normalise(of_lengths(spark, lengths)), width).orderBy("bucket").collect()
    assert [(r.lo, r.hi, r.n_sequences) for r in found] == ranges


def test_partitioned_statistics(spark):
    plan = PartitionedPlan(of_lengths(spark, (2, 3, 15)), MiningConfig(motif_size=2, count_scope="prefix"))
    assert plan.statistics() == "case OrdinaryFeatures, motif size 2, filter length None, batch size 500\nsketch 10 x 54366 counters over m1, m2\nbucket 0: lengths 2 to 11, 2 sequences\nbucket 1: lengths 12 to 15, 1 sequences"


def test_partitioned_runs(spark):
    ordinary = from_dict(spark, {i: [(j % 5 + 1, 1.0) for j in range(3 + i % 15)] for i in range(50)}, ORDINARY)
    assert mine_motifs(ordinary, 2, count_scope="prefix", partition_width=5).columns == ["m1", "m2", "data_index", "contribution", "count"]
    places = conv(spark, [[(j % 5 + 1, j) for j in range(10 + i % 15)] for i in range(40)])
    assert {"d12", "start", "end"} <= set(mine_motifs(places, 2, 5, 2, count_scope="partition", partition_width=5).columns)
    plain = from_dict(spark, {i: [(j % 8 + 1, 1.0) for j in range(5 + i % 8)] for i in range(30)}, ORDINARY)
    rows = [sorted(tuple(r)[:4] for r in mine_motifs(plain, 2, count_scope=s, partition_width=3).collect()) for s in ("global", "prefix", "partition")]
    assert rows[0] == rows[1] == rows[2]
