"""Publish season totals of any number of seasons in one run."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seasonframe import constants as K
from seasonframe import schemas as S
from seasonframe.functions import player_key
from seasonframe.operators.catalog import is_recorded, listed
from seasonframe.operators.diff import diff_counts, publish_action, season_diff
from seasonframe.operators.quality import default_sentinels, enforce, season_rules
from seasonframe.operators.totals import season_totals
from seasonframe.plans.buckets import BucketedTable
from seasonframe.plans.warehouse import (
    Warehouse, index_counted, materialize, stored_manifest,
)


def season_table(spark: SparkSession, wh: Warehouse) -> BucketedTable:
    """Stored totals, in buckets of player and season: the side of a comparison that stays where it is."""
    schema = f"{S.SEASON_TOTALS}, player_key STRING"
    return BucketedTable(spark, wh.season_totals, schema, ["season"], "player_key", wh.buckets)


def season_plan(
    totals: DataFrame,
    stored: DataFrame,
    manifest: DataFrame,
    current_season: int,
    *,
    force: bool = False,
    compare: str = "points",
) -> DataFrame:
    """One row per season of ``totals``: counts, ``inProgress`` and the ``action`` to take."""
    new = totals.groupBy("season").agg(F.count(F.lit(1)).alias("new_n"))
    old = stored.groupBy("season").agg(F.count(F.lit(1)).alias("old_n"))
    changes = diff_counts(season_diff(stored, totals, compare=compare)).drop("unchanged")
    rows = new.join(old, "season", "left").join(changes, "season", "left")
    path = F.concat(F.lit("season_totals/"), F.col("season").cast("string"))
    entries = listed(manifest, "inProgress").withColumnRenamed("inProgress", "was_in_progress")
    keyed = rows.withColumn("path", path).join(entries, "path", "left")
    action = publish_action(
        F.col("old_n").isNotNull(), F.col("identical"), F.col("was_in_progress"), force,
        is_recorded(entries, F.col("old_n")),
    )
    return keyed.select(
        "season", "path", "old_n", "new_n", "added", "removed", "changed",
        (F.col("season") >= current_season).alias("inProgress"), action.alias("action"),
    )


def publish_seasons(
    spark: SparkSession,
    entries: DataFrame,
    wh: Warehouse,
    seasons: Sequence[int],
    current_season: int,
    run_time: datetime,
    *,
    force: bool = False,
    dry_run: bool = False,
    compare: str = "points",
    sentinels: DataFrame | None = None,
    **limits: int,
) -> DataFrame:
    """Build, check, compare and write; returns the plan that was carried out.

    ``seasons`` are the ones the run is for; one without any player fails. The regulars
    looked for are the fixed list unless ``sentinels`` gives another. A failed check raises before anything is written. Completed seasons that would
    change are refused without ``force``. Totals are materialized once because the
    checks, the comparison and the write all read them; the plan is materialized
    before the write because the write changes what it was made from. A run that dies
    half-way can simply be repeated: unchanged seasons are skipped, or only indexed where the
    manifest doesn't tell what is stored.
    """
    totals = materialize(season_totals(entries))
    expected = spark.createDataFrame([(s,) for s in seasons], "season INT")
    regulars = default_sentinels(spark) if sentinels is None else sentinels
    enforce(season_rules(totals, regulars, expected, **limits))
    table = season_table(spark, wh)
    at_hand = {*seasons, *(r[0] for r in totals.select("season").distinct().collect())}
    stored = table.read().filter(F.col("season").isin(*sorted(at_hand)))
    plan = materialize(
        season_plan(
            totals, stored, stored_manifest(spark, wh), current_season, force=force, compare=compare
        )
    )
    if dry_run:
        return plan
    chosen = plan.filter("action = 'write'").select("season").collect()  # as many as the run is for
    counts = {}
    if chosen:
        rows = totals.join(plan.filter("action = 'write'").select("season"), "season", "left_semi")
        counts = table.write(rows.withColumn("player_key", player_key("season", "player_id")), chosen)
    index_counted(spark, wh, plan, counts, run_time, K.SEASON_SCHEMA_VERSION)
    return plan
