"""All queries of this subpackage."""

from locuskit.llm import centroids_query, decontaminate_query, hard_negatives_query, lattice_query, licenses_query, near_dedup_query, packing_query, pii_query, quality_query, rendering_query, sharding_query, simhash_query, toxicity_query  # noqa: F401
from locuskit.llm.registry import ORACLE, QUERIES  # noqa: F401
