"""Every query of this package: QUERIES and ORACLES."""

from codecensus.llm import corpus_queries, dedup_queries, scan_queries, text_queries, training_queries  # noqa: F401
from codecensus.llm.common import ORACLES, QUERIES  # noqa: F401
