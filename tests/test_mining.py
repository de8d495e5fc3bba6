"""The engine against brute force in Python, and the stated edge cases."""

from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from combforge import EmptyInputError, InvalidConfigurationError, MiningConfig, MiningPlan, PartitionedPlan, SchemaError, from_dict, mine_motifs
from combforge.errors import EnumerationTooLargeError
from combforge.operators import combine
from combforge.operators.partition import bucket_ranges
from combforge.sources import CONVOLUTION, ORDINARY, normalise, validate

ORD = {1: [(5, 1.0), (2, 2.0), (2, 1.5), (9, 0.5)], 2: [(2, 1.0), (5, 3.0)], 3: [], 4: [(0, 9.0), (5, 1.0), (2, 4.0)], 5: [(7, 1.0)]}
CONV = {1: [(3, 1.0, 10), (4, 2.0, 0), (3, 0.5, 20)], 2: [(4, 1.0, 5), (3, 1.0, 15)], 3: [(4, 1.0, 0), (3, 1.0, 2)]}


def brute(data, k, case, filter_len=0, overlap="reject", min_count=1):
    rows = []
    for index, items in data.items():
        items = [x for x in items if x[0] != 0]
        items = sorted(items) if case == ORDINARY else sorted(items, key=lambda x: x[2])
        for c in combinations(items, k):
            key, place = tuple(x[0] for x in c), ()
            if case == CONVOLUTION:
                if overlap == "reject" and any(b[2] - a[2] < filter_len for a, b in zip(c, c[1:])):
                    continue
                key += tuple(b[2] - a[2] - filter_len for a, b in zip(c, c[1:]))
                place = (c[0][2], c[-1][2] + filter_len - 1)
            total = np.float32(0)
            for x in c:
                total += np.float32(x[1])
            rows.append((key, place, index, float(total)))
    n = Counter(r[0] for r in rows)
    return sorted((*k_, *p, i, t, n[k_]) for k_, p, i, t in rows if n[k_] >= min_count)


def got(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("k", [1, 2, 3])
@pytest.mark.parametrize("min_count", [1, 2])
def test_ordinary(spark, k, min_count):
    assert got(mine_motifs(from_dict(spark, ORD, ORDINARY), k, min_count=min_count)) == brute(ORD, k, ORDINARY, min_count=min_count)


@pytest.mark.parametrize("overlap", ["reject", "allow"])
@pytest.mark.parametrize("k", [1, 2, 3])
def test_positional(spark, k, overlap):
    assert got(mine_motifs(from_dict(spark, CONV, CONVOLUTION), k, filter_len=5, overlap=overlap)) == brute(CONV, k, CONVOLUTION, 5, overlap)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.dictionaries(st.integers(0, 9), st.lists(st.tuples(st.integers(0, 4), st.integers(0, 8).map(float)), max_size=6), min_size=1, max_size=5))
def test_random_inputs(spark, data):
    assert got(mine_motifs(from_dict(spark, data, ORDINARY), 2, min_count=2)) == brute(data, 2, ORDINARY, min_count=2)


def test_join_plan_gives_the_same_rows(spark):
    for data, case, f in ((ORD, ORDINARY, None), (CONV, CONVOLUTION, 5)):
        s = normalise(from_dict(spark, data, case), case)
        assert got(combine.enumerate_by_join(s, 2, case, f)) == got(combine.enumerate_combinations(s, 2, case, f))
        df = from_dict(spark, data, case)
        assert got(mine_motifs(df, 2, f, 2, plan="join")) == got(mine_motifs(df, 2, f, 2))
        assert got(mine_motifs(df, 2, f, count_scope="prefix", plan="join")) == got(mine_motifs(df, 2, f, count_scope="prefix"))


def test_sketch_never_undercounts(spark):
    data = {i: [(j % 7 + 1, 1.0) for j in range(i % 9)] for i in range(40)}
    plan = MiningPlan(from_dict(spark, data, ORDINARY), MiningConfig(motif_size=2, delta=0.2, epsilon=0.3, min_count=20))
    exact = {(r.m1, r.m2): r["count"] for r in plan.count().collect()}
    least = {(r.m1, r.m2): r.est for r in plan.estimates().collect()}
    assert set(exact) == set(least) and all(least[k] >= exact[k] for k in exact)
    first = MiningPlan(plan._df, plan.config.with_(cms_rows_used="first")).estimates().collect()
    assert all(r.est >= least[r.m1, r.m2] for r in first)
    sketch, cells = plan.sketch(), plan.cells()
    whole = cells.collect()
    assert sketch.describe() == f"{sketch.rows} x {sketch.cols} counters over m1, m2"
    assert {sketch.lookup(cells, r.row, r.col) - r.cnt for r in whole[:3]} == {0} and sum(r.cnt for r in whole) == sketch.rows * sum(exact.values())
    assert got(sketch.update(plan.count())) == got(cells)
    with pytest.raises(InvalidConfigurationError):
        sketch.lookup(cells, sketch.rows, 0)
    keys = plan.count().select("m1", "m2")
    assert got(sketch.estimate(keys, cells)) == got(sketch.probe(keys, cells))
    verified = MiningPlan(plan._df, plan.config.with_(method="cms_verified")).extract()
    assert got(verified) == got(plan.extract())


def test_scopes(spark):
    data = {1: [(1, 1.0), (2, 1.0)], 2: [(1, 1.0), (2, 1.0), (3, 1.0)], 3: [(1, 1.0), (2, 1.0), (3, 1.0)]}
    df = from_dict(spark, data, ORDINARY)
    n = {s: mine_motifs(df, 2, min_count=3, count_scope=s, partition_width=1).count() for s in ("global", "prefix", "partition")}
    assert n == {"global": 3, "prefix": 2, "partition": 0}
    assert [tuple(r)[:4] for r in bucket_ranges(normalise(df), 1).orderBy("bucket").collect()] == [(0, 2, 2, 1), (1, 3, 3, 2)]


def test_empty_short_and_null(spark):
    df = spark.createDataFrame([(1, 5, None, "x"), (None, 5, 1.0, "x"), (1, None, 1.0, "x"), (1, 6, 2.0, "x")], "data_index BIGINT, feature INT, contribution FLOAT, count STRING")
    assert got(mine_motifs(df, 2)) == [(5, 6, 1, 2.0, 1)]
    none = mine_motifs(df, 4)
    assert none.count() == 0 and none.columns == ["m1", "m2", "m3", "m4", "data_index", "contribution", "count"]
    for call in (validate, mine_motifs, lambda d: PartitionedPlan(d, MiningConfig())):
        with pytest.raises(EmptyInputError):
            call(df.limit(0))


def test_errors(spark):
    with pytest.raises(InvalidConfigurationError):
        MiningConfig(delta=1.0)
    with pytest.raises(InvalidConfigurationError):
        mine_motifs(from_dict(spark, CONV, CONVOLUTION), 2)
    with pytest.raises(SchemaError):
        mine_motifs(spark.createDataFrame([(1, 2)], "data_index INT, thing INT"), 2)
    with pytest.raises(EnumerationTooLargeError):
        mine_motifs(from_dict(spark, ORD, ORDINARY), 2, max_combinations=1)


def test_streaming_counts(spark, tmp_path):
    from combforge.streaming import streaming_cells, streaming_counts

    df = from_dict(spark, ORD, ORDINARY)
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    config = MiningConfig(motif_size=2)
    for name, build, batch in (("counts", streaming_counts, MiningPlan(df, config).count()), ("cells", streaming_cells, MiningPlan(df, config).cells())):
        q = build(stream, config).writeStream.outputMode("complete").format("memory").queryName(f"out_{name}").start()
        q.processAllAvailable()
        q.stop()
        assert got(spark.table(f"out_{name}")) == got(batch)
