import pytest

from combforge import from_dict
from combforge.config import MiningConfig
from combforge.errors import InsufficientMemoryError
from combforge.functions import memory, post
from combforge.functions.misc import format_duration
from combforge.operators.sketch import CountMinSketch, hash_width
from combforge.plans.mine import mine_motifs
from combforge.sources import CONVOLUTION, ORDINARY


def test_default_sketch_dimensions():
    assert CountMinSketch.build(["m1"]).size == (10, 54366)
    assert CountMinSketch.build(["m1"], 1e-3, 1e-4).size == (7, 27183)
    assert hash_width(3, ORDINARY) == 3 and hash_width(3, CONVOLUTION) == 5


def test_memory_formulas():
    assert memory.per_point_bytes(4, 3, CONVOLUTION) == 68
    assert memory.fixed_bytes(4, 3, CONVOLUTION) == 2_174_888
    assert memory.optimal_batch_size(100, 50, 3, ORDINARY) == 100
    assert memory.batch_layout(7, 3) == (3, 1)
    with pytest.raises(InsufficientMemoryError):
        memory.optimal_batch_size(100, 50, 3, ORDINARY, target_memory_gb=0.001)


def test_report(spark):
    df = from_dict(spark, {1: [(1, 1.0), (2, 1.0), (3, 1.0)]}, ORDINARY)
    assert "longest sequence  3" in memory.memory_report(df, 2, MiningConfig(batch_size="auto"))


def test_post(spark):
    df = from_dict(spark, {1: [(1, 1.0), (2, 1.0)], 2: [(1, 2.0), (2, 1.0), (3, 1.0)]}, ORDINARY)
    mined = mine_motifs(df, 2)
    assert post.filter_count(mined, 2).count() == 2
    assert [tuple(r) for r in post.top_motifs(post.motif_stats(mined), 1).collect()] == [(1, 2, 2, 2.5)]
    assert post.containing_set(mined, [2, 1]).count() == 2
    counts = post.distinct_set_counts(df, 2)
    assert {r.threshold: r.n_keys for r in post.count_histogram(counts, [1, 2]).collect()} == {1: 3, 2: 1}


@pytest.mark.parametrize("s,text", [(0.0123, "12.3 ms"), (2.5, "2.50 s"), (75.25, "1 min 15.2 s")])
def test_format_duration(s, text):
    assert format_duration(s) == text
