"""All registered queries and their SQL counterparts."""

from cohortlens.plans import queries_checked, queries_clean, queries_exact, queries_models, queries_prep, queries_stats, queries_trees
from cohortlens.plans.standins import ORACLES, QUERIES

__all__ = [
    "ORACLES",
    "QUERIES",
    "queries_checked",
    "queries_clean",
    "queries_exact",
    "queries_models",
    "queries_prep",
    "queries_stats",
    "queries_trees",
]
