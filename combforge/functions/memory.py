"""Memory planning: closed formulas on the longest sequence. Advisory only."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from combforge.config import DEFAULT_DELTA, DEFAULT_EPSILON, MiningConfig, require
from combforge.errors import InsufficientMemoryError
from combforge.operators.sketch import hash_width, sketch_cols, sketch_counters, sketch_rows
from combforge.sources import CONVOLUTION, infer_case, normalise

INT_BYTES = FLOAT_BYTES = 4
DEFAULT_TARGET_BYTES = 4 * 1024**3


def per_point_bytes(max_len: int, k: int, case: str) -> int:
    columns = 3 if case == CONVOLUTION else 2
    return max_len * (columns * INT_BYTES + FLOAT_BYTES) + math.comb(max_len, k)


def fixed_bytes(max_len: int, k: int, case: str, delta: float = DEFAULT_DELTA, epsilon: float = DEFAULT_EPSILON) -> int:
    rows = sketch_rows(delta)
    counters = rows * sketch_cols(sketch_counters(rows, epsilon), rows)
    return INT_BYTES * (k * math.comb(max_len, k) + counters + rows * hash_width(k, case))


def optimal_batch_size(total: int, max_len: int, k: int, case: str, target_memory_gb: float | None = None, safety_factor: float = 0.8, delta: float = DEFAULT_DELTA, epsilon: float = DEFAULT_EPSILON, min_batch_size: int = 10, max_batch_size: int = 10_000) -> int:
    """An explicit target is taken as it is, without the safety factor."""
    require(0 < safety_factor <= 1, "safety_factor must be in (0, 1]")
    require(k <= max_len, "motif_size exceeds the longest sequence")
    budget = math.floor(DEFAULT_TARGET_BYTES * safety_factor if target_memory_gb is None else target_memory_gb * 1024**3)
    left = budget - fixed_bytes(max_len, k, case, delta, epsilon)
    if left <= 0:
        raise InsufficientMemoryError(f"fixed structures need {(budget - left) / 1024**3:.3f} GB, the target is {budget / 1024**3:.3f} GB")
    return max(min_batch_size, min(left // per_point_bytes(max_len, k, case), max_batch_size, total))


def auto_configure(df: DataFrame, k: int, **options) -> dict:
    """Plan for a whole input; one aggregate row reaches the driver."""
    case = infer_case(df)
    found = normalise(df, case, contributions=False).agg(F.count(F.lit(1)).alias("n"), F.max(F.size("features")).alias("longest")).first()
    total, longest = found["n"], found["longest"] or 0
    batch = optimal_batch_size(total, longest, k, case, **options)
    point, fixed = per_point_bytes(longest, k, case), fixed_bytes(longest, k, case)
    peak = fixed + point * batch
    return {
        "batch_size": batch,
        "num_batches": -(-total // batch),
        "total_data_points": total,
        "max_active_len": longest,
        "memory_per_point_kb": point / 1024,
        "memory_per_batch_mb": peak / 1024**2,
        "fixed_memory_mb": fixed / 1024**2,
        "estimated_peak_memory_gb": peak / 1024**3,
    }


def batch_layout(total: int, batch_size: int) -> tuple[int, int]:
    """Number of batches and the size of the last one."""
    n = -(-total // batch_size)
    return n, total - (n - 1) * batch_size if n else 0


def memory_report(df: DataFrame, k: int, config: MiningConfig) -> str:
    plan = auto_configure(df, k, delta=config.delta, epsilon=config.epsilon)
    batch = plan["batch_size"] if config.batch_size == "auto" else config.batch_size
    case = infer_case(df)
    point, fixed = per_point_bytes(plan["max_active_len"], k, case), fixed_bytes(plan["max_active_len"], k, case, config.delta, config.epsilon)
    rows = {
        "sequences": plan["total_data_points"],
        "longest sequence": plan["max_active_len"],
        "motif size": k,
        "batch size": batch,
        "batches": batch_layout(plan["total_data_points"], batch)[0],
        "fixed MB": f"{fixed / 1024**2:.2f}",
        "KB per sequence": f"{point / 1024:.2f}",
        "MB per batch": f"{(fixed + point * batch) / 1024**2:.2f}",
    }
    return "\n".join(f"{name:<18}{value}" for name, value in rows.items())
