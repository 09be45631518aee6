"""Number helpers, all native column expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_cents(x: Column) -> Column:
    """Two decimals, ties towards plus infinity (``round`` sends negative ties away from zero)."""
    scaled = x * F.lit(100.0)
    whole = F.floor(scaled)
    return (whole + F.when(scaled - whole >= 0.5, 1).otherwise(0)) / F.lit(100.0)


def ordered_sum(values: Column) -> Column:
    """Left-to-right double sum of an array, so the result does not depend on task order."""
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def weighted_sum(stats: Column, weights: Mapping[str, float] | Column) -> Column:
    """Sum of stat times weight over the keys of a stats map, in key order; no weight counts 0."""
    if not isinstance(weights, Column):
        pairs = [F.lit(part) for key, w in weights.items() for part in (key, float(w))]
        weights = F.create_map(*pairs) if pairs else F.expr("CAST(map() AS MAP<STRING, DOUBLE>)")
    return ordered_sum(
        F.transform(
            F.array_sort(F.map_entries(stats)),
            lambda e: F.coalesce(e["value"], F.lit(0.0)) * F.coalesce(weights[e["key"]], F.lit(0.0)),
        )
    )


def prefix_int(text: Column) -> Column:
    """Leading integer of a text without thousands commas; NULL when there is none."""
    digits = F.regexp_extract(F.regexp_replace(text, ",", ""), r"^\s*([+-]?\d+)", 1)
    return digits.try_cast("int")
