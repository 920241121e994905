"""Names and orders shared by findings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Finding categories; the last one is internal to external pages.
CATEGORIES = (
    "database_size", "positioning", "free_claim", "language_count", "region_count",
    "regulation_count", "feature_claim", "faq", "other_mismatch", "external_mismatch",
)
INTERNAL = CATEGORIES[:-1]
SEVERITIES = ("critical", "high", "medium", "low")


def severity_rank(c: Column) -> Column:
    """critical 0, high 1, medium 2, everything else 3."""
    return F.when(c == "critical", 0).when(c == "high", 1).when(c == "medium", 2).otherwise(3)


def at_least_medium(c: Column) -> Column:
    """The severity floor: low and unknown become medium."""
    return F.when(c.isin("critical", "high"), c).otherwise("medium")
