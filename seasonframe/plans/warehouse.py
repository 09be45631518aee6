"""Stored tables: layout, stable writes, versions and materialized intermediates."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F

from seasonframe import schemas as S
from seasonframe.operators.catalog import manifest_upsert
from seasonframe.sources.tables import read_or_empty
from seasonframe.plans.versions import publish_version, read_version
from seasonframe.storage import materialize, shared_folder

__all__ = ["Warehouse", "materialize", "read_version", "shared_folder"]


@dataclass(frozen=True)
class Warehouse:
    """Paths below one root on shared storage, and the number of buckets of its season totals.

    A bucket should be a few hundred MB of a season; the number can't change once rows are stored.
    """

    root: str
    buckets: int = 16

    def path(self, *parts: str) -> str:
        return "/".join([self.root.rstrip("/"), *parts])

    @property
    def season_totals(self) -> str:
        return self.path("season_totals")

    @property
    def college(self) -> str:
        return self.path("college")

    @property
    def market(self) -> str:
        return self.path("market")

    @property
    def market_checks(self) -> str:
        return self.path("market_checks")

    @property
    def market_rejects(self) -> str:
        return self.path("market_rejects")

    @property
    def manifest(self) -> str:
        return self.path("manifest")

    def overlay(self, kind: str) -> str:
        return self.path("overlay", kind)


def counting(df: DataFrame, by: Sequence[str], parts: Sequence[Row]) -> tuple[DataFrame, Callable[[str], dict[Row, int]]]:
    """The rows with a count of each partition taken along, and what tells the counts once they are written."""
    if not parts:
        return df, lambda path: {}
    seen = Observation()
    own = [reduce(Column.__and__, [F.col(c).eqNullSafe(F.lit(part[c])) for c in by]) for part in parts]
    rows = df.observe(seen, F.count(F.lit(1)).alias("all"), *[F.count_if(p).alias(f"n{i}") for i, p in enumerate(own)])

    def counts(path: str) -> dict[Row, int]:
        metrics = seen.get
        found = {part: metrics.get(f"n{i}", 0) for i, part in enumerate(parts)}
        if sum(found.values()) != metrics.get("all", 0):
            raise ValueError(f"{path}: rows outside the partitions {list(parts)}")
        return found

    return rows, counts


def write_partitions(
    df: DataFrame, path: str, by: Sequence[str], sort: Sequence[str], counted: Sequence[Row] = ()
) -> dict[Row, int]:
    """Replace exactly the partitions that ``df`` has rows for.

    Rows are range-partitioned by partition and sort columns, so a large partition is
    written by many tasks, a small one by few, and a rerun writes the same order. The rows of the
    partitions named in ``counted`` (rows with the ``by`` columns) are counted by the tasks that
    write them; the table is not read again. A row of no named partition raises, if any are.
    """
    keys = [*by, *sort]
    ordered, counts = counting(df.repartitionByRange(*keys).sortWithinPartitions(*keys), by, counted)
    (
        ordered.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*by)
        .parquet(path)
    )
    return counts(path)


def export_json(df: DataFrame, path: str, by: Sequence[str], sort: Sequence[str]) -> None:
    """JSON lines per partition in a fixed order; NULL fields are left out.

    Only partitions that ``df`` has rows for are replaced.
    """
    keys = [*by, *sort]
    ordered = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    ordered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).json(path)


def stored_manifest(spark: SparkSession, wh: Warehouse) -> DataFrame:
    return read_version(spark, wh.manifest, S.MANIFEST)


def index(
    spark: SparkSession, wh: Warehouse, written: Callable[[], DataFrame] | DataFrame, run_time: datetime, schema_version: int = 1
) -> None:
    """Upsert manifest entries: ``written`` is ``path, recordCount, inProgress``, or makes them.

    Runs that index at the same time all get their entries in, one version after the other. What
    counts a table that others may replace is to be given as a function: it is called anew for
    each attempt.
    """
    fixed = materialize(written) if isinstance(written, DataFrame) else None

    def change(stored: DataFrame) -> DataFrame:
        updates = (written() if fixed is None else fixed).select(
            "path",
            "recordCount",
            "inProgress",
            F.lit(schema_version).alias("schemaVersion"),
            F.lit(run_time).cast("timestamp").alias("lastModified"),
        )
        return manifest_upsert(stored, updates)

    publish_version(spark, wh.manifest, S.MANIFEST, change, run_time)


def index_counted(
    spark: SparkSession, wh: Warehouse, plan: DataFrame, counts: dict[Row, int], run_time: datetime, schema_version: int = 1
) -> None:
    """Index what a run wrote, by the counts its tasks took, and what it found not recorded.

    ``plan`` has ``path, old_n, inProgress, action`` and the columns of the rows in ``counts``.
    """
    rows = plan.filter("action = 'index'").select("path", F.col("old_n").alias("recordCount"), "inProgress")
    if counts:
        by = list(next(iter(counts)).asDict())
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plan.schema.fields if f.name in by)
        names = [f.name for f in plan.schema.fields if f.name in by]
        seen = spark.createDataFrame([(*[part[c] for c in names], n) for part, n in counts.items()], f"{schema}, recordCount LONG")
        rows = rows.unionByName(plan.join(seen, by).select("path", "recordCount", "inProgress"))
    if not rows.isEmpty():
        index(spark, wh, rows, run_time, schema_version)
