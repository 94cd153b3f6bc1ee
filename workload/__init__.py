"""Queries over the test tables, each beside the SQL that must give the same rows."""

from workload import profiles, checks, scores, reports, storage  # noqa: F401
from workload.registry import QUERIES, SQL  # noqa: F401
