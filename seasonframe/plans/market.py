"""Publish a market snapshot."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from seasonframe import constants as K
from seasonframe import schemas as S
from seasonframe.functions import age_days
from seasonframe.operators.market import change_ratio, fingerprints
from seasonframe.operators.quality import enforce, market_delta_rules, market_rules
from seasonframe.plans.landing import refuse_quarantined
from seasonframe.plans.warehouse import Warehouse, index, materialize, stored_manifest, write_partitions
from seasonframe.sources.tables import read_or_empty


def _print_of(rows: DataFrame) -> tuple | None:
    """Fingerprint of a single snapshot as one small row on the driver."""
    row = fingerprints(rows).first()
    return None if row is None else (row.n, row.hash_lo, row.hash_hi)


def _day_rows(spark: SparkSession, rows: list[tuple], schema: str, path: str) -> None:
    """Replace the days that ``rows`` are about."""
    table = spark.createDataFrame(rows, schema).coalesce(1)
    table.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("snapshot_date").parquet(path)


def publish_snapshot(
    spark: SparkSession,
    rows: DataFrame,
    wh: Warehouse,
    snapshot_date: date,
    run_time: datetime,
    *,
    dry_run: bool = False,
) -> str:
    """Check, guard, compare with what is stored and write if different.

    ``rows`` has ``ord, name, team, value, position``. Returns ``write``, ``skip``, or ``index``
    where the day is stored as it is but the manifest doesn't tell so; a
    failed rule raises, and no rows at all fail the size rule. The baseline is the newest
    stored day before the snapshot's own, so late and repeated snapshots meet the same one
    as in their turn. A day that is stored already is compared with itself. Each run
    leaves a check marker, which replaces the day's last one.
    """
    day = F.lit(snapshot_date)
    rows = materialize(
        rows.withColumn("snapshot_date", day).select("snapshot_date", "ord", "name", "team", "value", "position")
    )
    refuse_quarantined(spark, wh, "market", [snapshot_date.isoformat()])
    enforce(market_rules(rows, spark.range(1).select(day.alias("snapshot_date"))))
    stored = read_or_empty(spark, wh.market, S.MARKET_VALUES)
    # Days are partitions, so only one of each kind is read.
    before = stored.filter(F.col("snapshot_date") < day).agg(F.max("snapshot_date")).first()[0]
    own = stored.filter(F.col("snapshot_date") == day)
    previous = stored.filter(F.col("snapshot_date") == F.lit(before)) if before else stored.limit(0)
    mine, again = _print_of(rows), _print_of(own)
    identical = mine == again if again else before is not None and mine == _print_of(previous)
    checks = read_or_empty(spark, wh.market_checks, S.MARKET_CHECKS)
    ran_before = not checks.filter(F.col("snapshot_date") < day).isEmpty()
    path = f"market/snapshot-{snapshot_date.isoformat()}"
    action = "skip" if identical else "write"
    if again and identical:
        entry = stored_manifest(spark, wh).filter(F.col("path") == path).select("recordCount").first()
        action = "skip" if entry and entry.recordCount == again[0] else "index"
    if dry_run:
        return action
    age = spark.range(1).select(age_days(F.lit(run_time), F.lit(before).cast("date"))).first()[0]
    if ran_before and age is not None and 0 <= age <= K.MARKET_MAX_AGE_DAYS:
        enforce(market_delta_rules(change_ratio(previous.withColumn("snapshot_date", day), rows)))

    if action != "skip":
        count = again and again[0]
        if action == "write":
            own = Row(snapshot_date=snapshot_date)
            count = write_partitions(rows, wh.market, ["snapshot_date"], ["ord"], [own])[own]
        written = spark.createDataFrame([(path, count, True)], "path STRING, recordCount LONG, inProgress BOOLEAN")
        index(spark, wh, written, run_time)
    same = identical and again is None
    marker = [(run_time, same, None if same else path, snapshot_date)]
    _day_rows(spark, marker, S.MARKET_CHECKS, wh.market_checks)
    return action


def reject_snapshot(spark: SparkSession, wh: Warehouse, file: str, day: date, message: str, run_time: datetime) -> None:
    """Note that a file was refused; a repeated run replaces the day's note."""
    _day_rows(spark, [(file, message, run_time, day)], S.MARKET_REJECTS, wh.market_rejects)
