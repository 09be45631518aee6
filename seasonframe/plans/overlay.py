"""Publish overlay changes: batches of proposals and of removals."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seasonframe import schemas as S
from seasonframe.constants import OVERLAY_TYPES
from seasonframe.operators import overlay as O
from seasonframe.operators.quality import enforce, overlay_entry_violations, overlay_violations
from seasonframe.plans.versions import publish_version
from seasonframe.plans.warehouse import Warehouse, index, materialize, read_version
from seasonframe.sources.tables import read_or_empty


def stored_overlay(spark: SparkSession, wh: Warehouse, kind: str) -> DataFrame:
    """Entries of a type; none before its first write."""
    return read_version(spark, wh.overlay(kind), _schema(kind))


def _schema(kind: str) -> str:
    return "ord LONG, " + S.ddl(S.OVERLAY_ENTRIES[kind])


def _publish(spark: SparkSession, wh: Warehouse, kind: str, change: Callable[[DataFrame], DataFrame | None], run_time: datetime) -> None:
    """Change the newest version of a type, and tell the manifest its count."""
    if publish_version(spark, wh.overlay(kind), _schema(kind), change, run_time) is None:
        return

    def counted() -> DataFrame:
        rows = stored_overlay(spark, wh, kind).agg(F.count(F.lit(1)).alias("recordCount"))
        return rows.select(F.lit(f"overlay/{kind}").alias("path"), "recordCount", F.lit(False).alias("inProgress"))

    index(spark, wh, counted, run_time)


def upsert_entries(
    spark: SparkSession,
    kind: str,
    fields: DataFrame,
    wh: Warehouse,
    run_time: datetime,
    *,
    current_year: int,
    force: bool = False,
    dry_run: bool = False,
    totals: DataFrame | None = None,
    players: DataFrame | None = None,
) -> DataFrame:
    """Add a batch of entries given by their fields and ``ord``; returns the action per entry.

    Invalid proposals raise before anything is written. Conflicts keep the stored entry.
    Injuries are looked up in the stored season totals unless ``totals`` gives others.
    """
    proposed = O.with_ids(fields, kind)
    if totals is None:
        totals = read_or_empty(spark, wh.season_totals, S.SEASON_TOTALS)
    enforce(
        overlay_entry_violations(proposed, kind, current_year, totals=totals, players=players)
    )
    if dry_run:
        return materialize(O.upsert_plan(stored_overlay(spark, wh, kind), proposed, kind, force))
    made = []

    def change(existing: DataFrame) -> DataFrame | None:
        made.append(materialize(O.upsert_plan(existing, proposed, kind, force)))
        if made[-1].filter("action IN ('added', 'updated')").isEmpty():
            return None
        return O.upsert_result(existing, proposed, kind, force)

    _publish(spark, wh, kind, change, run_time)
    return made[-1]


def validate_overlays(
    spark: SparkSession,
    wh: Warehouse,
    *,
    current_year: int,
    players: DataFrame | None = None,
    documents: DataFrame | None = None,
) -> DataFrame:
    """All rules on all stored overlays, as rows; ``enforce`` raises on the first error."""
    overlays = {kind: stored_overlay(spark, wh, kind) for kind in OVERLAY_TYPES}
    totals = read_or_empty(spark, wh.season_totals, S.SEASON_TOTALS)
    return overlay_violations(overlays, current_year, totals=totals, players=players, documents=documents)


def remove_by_id(
    spark: SparkSession, ids: DataFrame, wh: Warehouse, run_time: datetime, *, dry_run: bool = False
) -> DataFrame:
    """Remove entries by id; returns ``id, overlay, found``. Only affected types are rewritten."""
    overlays = {kind: stored_overlay(spark, wh, kind) for kind in OVERLAY_TYPES}
    targets = materialize(O.removal_targets(O.all_overlays(overlays), ids))
    if dry_run:
        return targets
    affected = [r.overlay for r in targets.filter("found").select("overlay").distinct().collect()]
    for kind in affected:  # at most the four types
        gone = targets.filter(F.col("overlay") == kind).select("id")
        _publish(spark, wh, kind, lambda entries, gone=gone: entries.join(gone, "id", "left_anti"), run_time)
    return targets
