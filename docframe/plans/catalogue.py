"""All registered queries and their DuckDB counterparts."""

from docframe.plans import array_queries, group_queries, join_queries, row_queries, shape_queries, text_queries  # noqa: F401
from docframe.plans.registry import ORACLES, QUERIES  # noqa: F401
