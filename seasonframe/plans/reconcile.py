"""Compare the manifest with what is stored, and mend it."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seasonframe import constants as K
from seasonframe import schemas as S
from seasonframe.constants import OVERLAY_TYPES
from seasonframe.operators.catalog import reconcile
from seasonframe.plans.overlay import stored_overlay
from seasonframe.plans.warehouse import Warehouse, index, materialize, stored_manifest
from seasonframe.sources.tables import read_or_empty


def _counted(df: DataFrame, path: Column, in_progress: Column, version: int) -> DataFrame:
    """Counts of stored partitions; only partition columns are read."""
    rows = df.groupBy(path.alias("path"), in_progress.alias("inProgress"))
    return rows.agg(F.count(F.lit(1)).alias("storedCount")).withColumn("schemaVersion", F.lit(version))


def stored_partitions(spark: SparkSession, wh: Warehouse, current_season: int) -> DataFrame:
    """``path, inProgress, storedCount, schemaVersion`` of everything in the warehouse."""
    season, day = F.col("season"), F.col("snapshot_date")
    parts = [
        _counted(
            read_or_empty(spark, wh.season_totals, S.SEASON_TOTALS),
            F.concat(F.lit("season_totals/"), season.cast("string")), season >= current_season, K.SEASON_SCHEMA_VERSION,
        ),
        _counted(
            read_or_empty(spark, wh.college, S.COLLEGE_STATS),
            F.concat_ws("/", F.lit("college"), "category", season.cast("string")), F.lit(False), 1,
        ),
        _counted(
            read_or_empty(spark, wh.market, S.MARKET_VALUES),
            F.concat(F.lit("market/snapshot-"), F.date_format(day, "yyyy-MM-dd")), F.lit(True), 1,
        ),
    ]
    parts += [_counted(stored_overlay(spark, wh, kind), F.lit(f"overlay/{kind}"), F.lit(False), 1) for kind in OVERLAY_TYPES]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def repair_manifest(
    spark: SparkSession, wh: Warehouse, current_season: int, run_time: datetime, *, dry_run: bool = False
) -> DataFrame:
    """``path, storedCount, recordCount, state`` of everything stored or listed.

    Missing and stale entries are then indexed with the stored count, all in one version.
    Orphans are only reported: a partition that is not there may be on its way.
    """
    stored = materialize(stored_partitions(spark, wh, current_season))
    found = materialize(reconcile(stored, stored_manifest(spark, wh)))
    wrong = found.filter("state IN ('missing', 'stale')").select("path")
    if not dry_run:
        rows = stored.join(wrong, "path", "left_semi").withColumnRenamed("storedCount", "recordCount")
        for version in [r[0] for r in rows.select("schemaVersion").distinct().collect()]:  # there are two
            index(spark, wh, rows.filter(F.col("schemaVersion") == version), run_time, version)
    return found
