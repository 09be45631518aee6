"""Stored tables in buckets of a key, so that what is compared with them is all that moves.

A bucketed table is a folder as any other, partitioned and written with dynamic overwrite.
The session's catalog only holds what Spark has to know of it: key, number of buckets and
order. It is told again in each session, from the folder's path alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, Row, SparkSession

from seasonframe.plans.warehouse import counting
from seasonframe.sources.tables import read_or_empty


class BucketedTable:
    """A table in ``path``: ``schema`` (its partition columns last), buckets of ``key`` in its order."""

    def __init__(self, spark: SparkSession, path: str, schema: str, by: Sequence[str], key: str, buckets: int) -> None:
        self.spark, self.path, self.by, self.key, self.buckets = spark, path, list(by), key, buckets
        digest = hashlib.sha256(f"{path} {buckets}".encode()).hexdigest()[:16]
        self.name = f"bucketed_{digest}"
        place = path.replace("\\", "\\\\").replace("'", "\\'")
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} ({schema}) USING parquet PARTITIONED BY ({', '.join(self.by)}) "
            f"CLUSTERED BY ({key}) SORTED BY ({key}) INTO {buckets} BUCKETS LOCATION '{place}'"
        )
        self.refresh()

    def refresh(self) -> None:
        """Look for partitions that other sessions wrote."""
        if read_or_empty(self.spark, self.path, "season INT").inputFiles():
            self.spark.catalog.recoverPartitions(self.name)
        self.spark.catalog.refreshTable(self.name)

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def write(self, df: DataFrame, counted: Sequence[Row] = ()) -> dict[Row, int]:
        """Replace the partitions that ``df`` has rows for, one file for each of their buckets.

        Returns the rows written of the partitions in ``counted``, as ``write_partitions`` does.
        """
        rows = df.select(*self.read().columns).repartition(self.buckets, self.key)
        rows, counts = counting(rows, self.by, counted)
        mode = "spark.sql.sources.partitionOverwriteMode"
        before = self.spark.conf.get(mode)
        self.spark.conf.set(mode, "dynamic")
        try:
            rows.write.mode("overwrite").insertInto(self.name)
        finally:
            self.spark.conf.set(mode, before)
        self.refresh()
        return counts(self.path)
