"""All queries and their SQL, gathered from the modules that register them."""

from tidemark.plans import queries_forecast, queries_more, queries_quality, queries_reports, queries_text, queries_vintage  # noqa: F401
from tidemark.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401
