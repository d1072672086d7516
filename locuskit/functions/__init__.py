"""Column functions; all are built from Spark's own expressions."""

from locuskit.functions.columns import columns_matching, renamed_by_pattern
from locuskit.functions.names import motif_name, region_id, text_or_null
from locuskit.functions.numeric import (hash_unit, ln_to_log2, log10_floored, lognormal_cdf,
                                        log2_or_null, ratio, row_mean, row_min)
from locuskit.functions.sequence import revcomp, single_base

__all__ = ["columns_matching", "hash_unit", "ln_to_log2", "log10_floored", "log2_or_null",
           "lognormal_cdf", "motif_name", "ratio", "region_id", "renamed_by_pattern", "revcomp",
           "row_mean", "row_min", "single_base", "text_or_null"]
