"""All registered queries."""

from workload import stage_queries, table_queries, text_queries, vector_queries  # noqa: F401
from workload.registry import ORACLES, QUERIES  # noqa: F401
