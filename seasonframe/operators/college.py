"""College statistics: long rows to one row per player and season."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seasonframe.constants import COLLEGE_STAT_TYPES

IDENTITY = ("season", "category", "playerId", "player", "position", "team", "conference")


def pivot_college(
    rows: DataFrame, stat_types: Sequence[str], keys: Sequence[str] = IDENTITY
) -> DataFrame:
    """One numeric column per stat type; text that is not a number becomes NULL.

    The value list is given, so Spark needs no extra pass to find it and the pivot is a
    single aggregate with a map-side combine.
    """
    number = F.expr("try_cast(stat AS DOUBLE)")
    return rows.groupBy(*keys).pivot("statType", list(stat_types)).agg(F.max(number))


def pivot_category(rows: DataFrame, category: str) -> DataFrame:
    return pivot_college(rows.filter(F.col("category") == category), COLLEGE_STAT_TYPES[category])
