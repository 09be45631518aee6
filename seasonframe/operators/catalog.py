"""Manifest of data sets: record counts, upsert and the schema version gate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seasonframe.constants import SUPPORTED_SCHEMA_VERSION


def record_counts(df: DataFrame, path: Column) -> DataFrame:
    """``path, recordCount`` per data set path."""
    return df.groupBy(path.alias("path")).agg(F.count(F.lit(1)).alias("recordCount"))


UPDATED = ("recordCount", "inProgress", "schemaVersion", "lastModified")


def manifest_upsert(manifest: DataFrame, updates: DataFrame) -> DataFrame:
    """Manifest after a run: updated paths take four new fields and keep all others.

    One batch covers all data sets of a run. ``updates`` is unique per path.
    """
    new = updates.select("path", *[F.col(c).alias(f"_{c}") for c in UPDATED], F.lit(True).alias("_hit"))
    joined = manifest.join(new, "path", "full")
    cols = [
        F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in UPDATED else F.col(c)
        for c in manifest.columns
    ]
    return joined.select(*cols)


def is_recorded(manifest: DataFrame, stored_n: Column) -> Column:
    """Whether a looked-up entry exists and tells the stored count, if it tells any.

    To be used on the rows of ``manifest_lookup`` with ``listed``.
    """
    listed = F.col("listed").isNotNull()
    return listed & F.col("recordCount").eqNullSafe(stored_n) if "recordCount" in manifest.columns else listed


def listed(manifest: DataFrame, *columns: str) -> DataFrame:
    """The entries' columns that plans look up, with ``listed`` set."""
    kept = [c for c in (*columns, "recordCount") if c in manifest.columns]
    return manifest.select("path", *kept, F.lit(True).alias("listed"))


def reconcile(stored: DataFrame, manifest: DataFrame) -> DataFrame:
    """``path, storedCount, recordCount, state`` of all that is stored or listed.

    ``stored`` has ``path, storedCount``. An entry is ``ok``, ``stale`` (another count), ``missing``
    (stored but not listed) or an ``orphan`` (listed but not stored).
    """
    have, told = F.col("storedCount").isNotNull(), F.col("listed").isNotNull()
    state = (
        F.when(have & ~told, "missing")
        .when(told & ~have, "orphan")
        .when(F.col("recordCount").eqNullSafe(F.col("storedCount")), "ok")
        .otherwise("stale")
    )
    both = stored.select("path", "storedCount").join(listed(manifest), "path", "full")
    return both.select("path", "storedCount", "recordCount", state.alias("state"))


def manifest_lookup(partitions: DataFrame, manifest: DataFrame, columns: Sequence[str] = ("inProgress",)) -> DataFrame:
    """Partitions with a ``path`` column, joined to their manifest fields (NULL without entry)."""
    return partitions.join(manifest.select("path", *columns), "path", "left")


def supported(manifest: DataFrame, max_version: int = SUPPORTED_SCHEMA_VERSION) -> DataFrame:
    return manifest.filter(F.col("schemaVersion") <= max_version)
