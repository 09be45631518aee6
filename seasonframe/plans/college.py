"""Publish college rows by category and season."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seasonframe import schemas as S
from seasonframe.functions import canonical_json, multiset_fingerprint
from seasonframe.operators.catalog import is_recorded, listed
from seasonframe.operators.diff import count_plan_input, publish_action
from seasonframe.operators.quality import college_rules, enforce
from seasonframe.plans.landing import refuse_quarantined
from seasonframe.plans.warehouse import (
    Warehouse, index_counted, materialize, stored_manifest, write_partitions,
)
from seasonframe.sources.tables import read_or_empty

PART = ["category", "season"]


def _fingerprint_input(old: DataFrame, new: DataFrame) -> DataFrame:
    names = [c for c in new.columns if c not in PART]
    row = canonical_json({c: F.col(c) for c in names})

    def prints(df: DataFrame, prefix: str) -> DataFrame:
        sums = df.groupBy(*PART).agg(*multiset_fingerprint(row))
        return sums.select(*PART, *[F.col(c).alias(f"{prefix}_{c}") for c in ("n", "hash_lo", "hash_hi")])

    same = F.lit(True)
    for c in ("n", "hash_lo", "hash_hi"):
        same = same & F.col(f"new_{c}").eqNullSafe(F.col(f"old_{c}"))
    return prints(new, "new").join(prints(old, "old"), PART, "left").select(
        *PART, "old_n", "new_n", same.alias("identical")
    )


def college_plan(
    rows: DataFrame, stored: DataFrame, manifest: DataFrame, *, force: bool = False, compare: str = "count"
) -> DataFrame:
    """One row per category and season with the ``action`` to take.

    Equal row counts count as unchanged; ``compare='fingerprint'`` looks at the content.
    """
    if compare == "count":
        base = count_plan_input(stored, rows, PART)
    else:
        base = _fingerprint_input(stored, rows)
    path = F.concat_ws("/", F.lit("college"), "category", F.col("season").cast("string"))
    entries = listed(manifest, "inProgress").withColumnRenamed("inProgress", "was_in_progress")
    keyed = base.withColumn("path", path).join(entries, "path", "left")
    action = publish_action(
        F.col("old_n").isNotNull(), F.col("identical"), F.col("was_in_progress"), force, is_recorded(entries, F.col("old_n"))
    )
    return keyed.select(*PART, "path", "old_n", "new_n", F.lit(False).alias("inProgress"), action.alias("action"))


def publish_college(
    spark: SparkSession,
    rows: DataFrame,
    wh: Warehouse,
    partitions: Sequence[tuple[str, int]],
    run_time: datetime,
    *,
    force: bool = False,
    dry_run: bool = False,
    compare: str = "count",
    **limits: int,
) -> DataFrame:
    """Check, compare and write; returns the plan that was carried out.

    ``partitions`` are the categories and seasons the run is for; one without rows fails, and one
    of which a document or a record was put aside when it was landed.
    """
    rows = materialize(rows)
    expected = spark.createDataFrame([(f"{c}/{s}",) for c, s in partitions], "partition STRING")
    refuse_quarantined(spark, wh, "college", [f"{c}/{s}" for c, s in partitions])
    enforce(college_rules(rows, partitions=expected, **limits))
    stored = read_or_empty(spark, wh.college, S.COLLEGE_STATS)
    plan = materialize(
        college_plan(rows, stored, stored_manifest(spark, wh), force=force, compare=compare)
    )
    if dry_run:
        return plan
    chosen = plan.filter("action = 'write'").select(*PART).collect()  # as many as the run is for
    counts = {}
    if chosen:
        kept = rows.join(plan.filter("action = 'write'").select(*PART), PART, "left_semi")
        counts = write_partitions(kept, wh.college, PART, ["playerId", "statType"], chosen)
    index_counted(spark, wh, plan, counts, run_time)
    return plan
