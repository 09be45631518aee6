"""Queries over the manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seasonframe.analog import views as V
from seasonframe.analog.registry import query
from seasonframe.operators import catalog


@query("""SELECT 'orders/' || year(o_orderdate) AS path, count(*) AS "recordCount" FROM orders GROUP BY 1""")
def q_manifest_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Record count per data path."""
    path = F.concat(F.lit("orders/"), F.year("o_orderdate").cast("string"))
    return catalog.record_counts(V.table(spark, sf, "orders"), path)


_MANIFEST = """
o AS (SELECT 'y/' || year(o_orderdate) || '/' || o_orderstatus AS path, 'key-' || o_orderstatus AS "originalKey",
             count(*) AS "recordCount", true AS "inProgress", 1 AS "schemaVersion",
             max(o_orderdate) AS "lastModified" FROM orders GROUP BY ALL),
n AS (SELECT 'y/' || year(l_shipdate) || '/' || l_linestatus AS path, count(*) AS "recordCount",
             false AS "inProgress", 2 AS "schemaVersion", max(l_shipdate) AS "lastModified" FROM lineitem GROUP BY ALL),
m AS (SELECT coalesce(n.path, o.path) AS path, o."originalKey",
             CASE WHEN n.path IS NULL THEN o."recordCount" ELSE n."recordCount" END AS "recordCount",
             coalesce(n."inProgress", o."inProgress") AS "inProgress",
             CAST(coalesce(n."schemaVersion", o."schemaVersion") AS INTEGER) AS "schemaVersion",
             strftime(coalesce(n."lastModified", o."lastModified"), '%Y-%m-%d') AS "lastModified"
      FROM n FULL JOIN o ON n.path = o.path)"""


def _manifest(spark: SparkSession, sf: str) -> DataFrame:
    """Orders per year and status as the stored manifest, line items as the run."""

    def path(date: str, status: str):
        return F.concat(F.lit("y/"), F.year(date).cast("string"), F.lit("/"), F.col(status)).alias("path")

    def counted(rows: DataFrame, date: str, in_progress: bool, version: int) -> DataFrame:
        return rows.agg(
            F.count(F.lit(1)).alias("recordCount"),
            F.lit(in_progress).alias("inProgress"),
            F.lit(version).alias("schemaVersion"),
            F.max(date).alias("lastModified"),
        )

    orders = V.table(spark, sf, "orders")
    key = F.concat(F.lit("key-"), "o_orderstatus").alias("originalKey")
    stored = counted(orders.groupBy(path("o_orderdate", "o_orderstatus"), key), "o_orderdate", True, 1)
    lines = V.table(spark, sf, "lineitem")
    run = counted(lines.groupBy(path("l_shipdate", "l_linestatus")), "l_shipdate", False, 2)
    merged = catalog.manifest_upsert(stored, run)
    return merged.withColumn("lastModified", F.date_format("lastModified", "yyyy-MM-dd"))


@query(f"WITH {_MANIFEST} SELECT * FROM m")
def q_manifest_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Manifest after a run: updated paths keep their other fields."""
    return _manifest(spark, sf)


@query(f"""WITH {_MANIFEST} SELECT * FROM m WHERE "schemaVersion" <= 1""")
def q_manifest_supported(spark: SparkSession, sf: str) -> DataFrame:
    """Data sets a reader of schema version 1 may open."""
    return catalog.supported(_manifest(spark, sf), 1)
