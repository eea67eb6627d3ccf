"""Import every query module, so that the registry is complete."""

from codecensus.plans import extract_queries, graph_queries, infra_queries, relation_queries, rule_queries, text_queries  # noqa: F401
from codecensus.plans.registry import ORACLES, QUERIES  # noqa: F401
