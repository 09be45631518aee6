"""Canonical JSON and content digests."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_json(fields: Mapping[str, Column]) -> Column:
    """JSON object text with sorted keys, no blanks and without the keys that are NULL."""
    ordered = [fields[name].alias(name) for name in sorted(fields, key=str.lower)]
    return F.to_json(F.struct(*ordered))


def entry_digest(json_text: Column) -> Column:
    """First six hex digits of the SHA-1."""
    return F.substring(F.sha1(json_text), 1, 6)


def multiset_fingerprint(row_text: Column) -> list[Column]:
    """Aggregates that identify a bag of rows whatever their order.

    Row count plus two sums of 60-bit slices of the SHA-1. Sums merge, so a huge
    snapshot is folded on the map side and no task has to hold or sort it.
    """

    def slice_sum(start: int) -> Column:
        part = F.conv(F.substring(F.sha1(row_text), start, 15), 16, 10)
        return F.sum(part.cast("decimal(20,0)")).cast("decimal(38,0)")

    return [
        F.count(F.lit(1)).alias("n"),
        slice_sum(1).alias("hash_lo"),
        slice_sum(16).alias("hash_hi"),
    ]
