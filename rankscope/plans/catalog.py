"""All named queries; importing the query modules registers them."""

from rankscope.plans import (  # noqa: F401
    queries_files, queries_live, queries_rules, queries_runs, queries_scalar, queries_traffic, queries_views)
from rankscope.plans.registry import ORACLE, QUERIES  # noqa: F401
