"""Validated, immutable run configuration."""

from __future__ import annotations

from dataclasses import dataclass, replace

from combforge.errors import InvalidConfigurationError

# Defaults of the sketch and of batch planning.
DEFAULT_DELTA = 1e-4
DEFAULT_EPSILON = 5e-5
DEFAULT_BATCH_SIZE = 500

METHODS = ("exact", "cms", "cms_verified")
OVERLAPS = ("reject", "allow")
SCOPES = ("global", "prefix", "partition")
PLANS = ("explode", "join")


def require(condition: bool, message: str) -> None:
    if not condition:
        raise InvalidConfigurationError(message)


@dataclass(frozen=True)
class MiningConfig:
    """All knobs of a mining run.

    ``batch_size`` is accepted for API compatibility and only feeds the memory
    report: Spark partitions take the place of batches. ``plan`` "join" suits
    sequences of very many items, whose rest every exploded row would carry.
    """

    delta: float = DEFAULT_DELTA
    epsilon: float = DEFAULT_EPSILON
    min_count: int = 1
    batch_size: int | str = DEFAULT_BATCH_SIZE
    seed: int = 1
    motif_size: int = 3
    filter_len: int | None = None
    method: str = "exact"
    cms_rows_used: str = "all"
    overlap: str = "reject"
    count_scope: str = "global"
    partition_width: int = 10
    max_combinations: int | None = None
    plan: str = "explode"

    def __post_init__(self) -> None:
        require(0 < self.delta < 1, "delta must be in (0, 1)")
        require(0 < self.epsilon < 1, "epsilon must be in (0, 1)")
        require(self.min_count > 0, "min_count must be positive")
        require(self.motif_size > 0, "motif_size must be positive")
        require(self.partition_width > 0, "partition_width must be positive")
        require(self.batch_size == "auto" or (isinstance(self.batch_size, int) and self.batch_size > 0), "batch_size must be positive or 'auto'")
        require(self.method in METHODS, f"method must be one of {METHODS}")
        require(self.overlap in OVERLAPS, f"overlap must be one of {OVERLAPS}")
        require(self.count_scope in SCOPES, f"count_scope must be one of {SCOPES}")
        require(self.plan in PLANS, f"plan must be one of {PLANS}")
        require(self.cms_rows_used in ("all", "first"), "cms_rows_used must be 'all' or 'first'")
        require(self.filter_len is None or self.filter_len >= 0, "filter_len must not be negative")

    def with_(self, **changes) -> MiningConfig:
        return replace(self, **{k: v for k, v in changes.items() if v is not None})
