import numpy as np

from combforge.llm import neighbours


def test_hilbert_is_a_curve():
    grid = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    keys = neighbours.hilbert_key(grid, bits=3)
    assert sorted(keys.tolist()) == list(range(512))
    steps = np.abs(np.diff(grid[np.argsort(keys)], axis=0)).sum(1)
    assert (steps == 1).all()


def test_nearest_against_brute_force(spark):
    draw = np.random.default_rng(1)
    x = draw.normal(size=(700, 8)).astype(np.float32)
    x[100:300] = x[100]  # a hot vector, with ties
    rows = [(i, v.tolist(), "x") for i, v in enumerate(x)]
    rows += [(1000, None, "x"), (1020, [0.0] * 8, "x"), (1040, [float("nan")] * 8, "x"), (1060, [1.0, None] + [1.0] * 6, "x"), (1080, [1.0], "x"), (None, [1.0] * 8, "x"), (0, rows_0(x), "x")]
    df = spark.createDataFrame(rows, "vec_id BIGINT, embedding ARRAY<FLOAT>, rank STRING")
    got = {}
    for r in neighbours.nearest(df, lambda i: i % 20 == 0, k=10).collect():  # one window: exact
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    y = x.astype(float)
    assert set(got) == set(range(0, 700, 20))
    for q, ranks in got.items():
        s = np.add.accumulate(y * y[q], axis=1)[:, -1]
        order = [i for i in np.lexsort((np.arange(700), -s)) if i != q][:10]
        assert [ranks[k + 1][0] for k in range(10)] == order
        assert np.allclose([ranks[k + 1][1] for k in range(10)], s[order], rtol=0, atol=0)
    assert neighbours.nearest(df.limit(0), lambda i: i % 20 == 0).count() == 0
    few = neighbours.nearest(df.filter("vec_id < 3"), lambda i: i % 20 == 0)
    assert [(r.query_id, r.rank) for r in few.orderBy("rank").collect()] == [(0, 1), (0, 2)]
    assert neighbours.nearest(df.filter("vec_id % 20 <> 0"), lambda i: i % 20 == 0).count() == 0
    tied = {}
    for r in neighbours.nearest(df, lambda i: i % 20 == 0, k=10, window=32).collect():  # 16 windows, equal vectors in many of them
        tied.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    for q in range(100, 300, 20):
        assert [i for _, i in sorted(tied[q])] == [i for i in range(100, 111) if i != q][:10]


def test_recall_of_many_small_windows(spark):
    draw = np.random.default_rng(3)
    x = draw.normal(size=(2400, 24))
    x /= np.sqrt((x * x).sum(1))[:, None]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id BIGINT, embedding ARRAY<DOUBLE>")
    got = neighbours.nearest(df, lambda i: i % 20 == 0, window=75).collect()  # 32 windows
    hits = 0
    for q in range(0, 2400, 20):
        s = x @ x[q]
        s[q] = -9
        hits += len(set(np.argsort(-s)[:20].tolist()) & {r.vec_id for r in got if r.query_id == q})
    assert hits >= 0.9 * 120 * 20
    assert all(abs(r.score - float(x[r.vec_id] @ x[r.query_id])) < 1e-12 for r in got)


def rows_0(x):
    return x[0].tolist()
