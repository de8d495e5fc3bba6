"""Ingestion: schema inference, validation and normalisation."""

from combforge.sources.ingest import (
    CONVOLUTION,
    ORDINARY,
    from_dict,
    infer_case,
    length_stats,
    make_conv_feature,
    max_active_len,
    merge_duplicates,
    nest,
    normalise,
    validate,
)

__all__ = ["CONVOLUTION", "ORDINARY", "from_dict", "infer_case", "length_stats", "make_conv_feature", "max_active_len", "merge_duplicates", "nest", "normalise", "validate"]
