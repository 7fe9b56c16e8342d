"""Importing this module fills the query table."""

from dielens.plans import (  # noqa: F401
    clean_queries,
    dq_queries,
    ingest_queries,
    rule_queries,
    source_queries,
    spatial_queries,
    stat_queries,
    surface_queries,
    unit_queries,
    version_queries,
)
from dielens.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
