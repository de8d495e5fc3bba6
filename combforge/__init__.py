"""Frequent K-item combination mining over feature sequences, on Spark."""

from combforge.config import MiningConfig
from combforge.errors import CombForgeError, EmptyInputError, InvalidConfigurationError, SchemaError
from combforge.operators.sketch import CountMinSketch
from combforge.plans.mine import MiningPlan, PartitionedPlan, mine_motifs, mine_motifs_partitioned
from combforge.sources import from_dict, infer_case, make_conv_feature, normalise

__all__ = ["CombForgeError", "CountMinSketch", "EmptyInputError", "InvalidConfigurationError", "MiningConfig", "MiningPlan", "PartitionedPlan", "SchemaError", "from_dict", "infer_case", "make_conv_feature", "mine_motifs", "mine_motifs_partitioned", "normalise"]
