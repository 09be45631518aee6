"""First-seen deduplication that honours the input order."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_seen(df: DataFrame, keys: Sequence[str], order: str | Column) -> DataFrame:
    """Keep the row with the least ``order`` per key; orders of one key differ.

    The least order is found on narrow rows by a hash aggregate with a map-side combine.
    Whole rows are picked by key and order together, which keeps hot keys spread.
    """
    columns = df.columns
    if isinstance(order, Column):
        df, order = df.withColumn("_order", order), "_order"
    both = [*keys, order]
    least = df.groupBy(*keys).agg(F.min(order).alias(order))
    # Rows without an order come first of all if no row of their key has one.
    same = functools.reduce(Column.__and__, [df[c].eqNullSafe(least[c]) for c in both])
    return df.join(least, same, "left_semi").select(columns)


def later_copies(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The rows ``first_seen`` drops.

    The order column is part of the anti-join key, which keeps hot keys spread.
    """
    kept = df.groupBy(*keys).agg(F.min(order).alias(order))
    same = [df[c].eqNullSafe(kept[c]) for c in (*keys, order)]
    condition = same[0]
    for term in same[1:]:
        condition = condition & term
    return df.join(kept, condition, "left_anti")


def duplicate_counts(df: DataFrame, keys: Sequence[str], report_by: Sequence[str]) -> DataFrame:
    """Number of dropped copies per report group; groups without copies are left out."""
    per_key = df.groupBy(*keys).agg((F.count(F.lit(1)) - 1).alias("copies"))
    return (
        per_key.filter("copies > 0").groupBy(*report_by).agg(F.sum("copies").alias("n_dupes"))
    )
