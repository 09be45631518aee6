"""Queries over documents that are cut into records and checked."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seasonframe.analog import views as V
from seasonframe.analog.registry import query
from seasonframe.functions import snapshot_date_of
from seasonframe.sources import checked as C

_BROKEN = f"""{V.MARKET},
el AS (SELECT snapshot_date AS day, ord // 100 AS m, ord, name, value, row_number() OVER (PARTITION BY snapshot_date, ord // 100 ORDER BY ord) - 1 AS position FROM mk),
ck AS (SELECT *, 'm' || m || '/snapshot-' || day || CASE WHEN m % 7 = 3 THEN '.bak' ELSE '.json' END AS file,
              CASE WHEN m % 7 = 3 THEN NULL ELSE CAST(day AS VARCHAR) END AS partition,
              CASE WHEN m % 5 = 1 THEN 'document' WHEN ord % 13 = 0 THEN 'record' WHEN ord % 11 = 0 THEN 'type'
                   WHEN m % 7 = 3 THEN 'place' END AS reason FROM el)"""


def _checked(spark: SparkSession, sf: str) -> DataFrame:
    """Market documents of a hundred customers and a year, as text with faults, through the checks.

    Some are cut off, some have a file name without a date; some elements are numbers, some have
    a word for a value.
    """
    rows = V.market(spark, sf)
    number, order = F.floor(F.col("ord") / 100), F.col("ord")
    good = F.to_json(F.struct("name", "team", "value", "position"))
    wrong = F.to_json(F.struct("name", F.lit("much").alias("value")))
    element = F.when(order % 13 == 0, order.cast("string")).when(order % 11 == 0, wrong).otherwise(good)
    docs = rows.groupBy(number.alias("m"), "snapshot_date").agg(F.array_sort(F.collect_list(F.struct("ord", element.alias("text")))).alias("e"))
    text = F.concat(F.lit("["), F.array_join(F.transform("e", lambda x: x["text"]), ",\n "), F.when(F.col("m") % 5 == 1, "").otherwise("]"))
    day = F.col("snapshot_date").cast("string")
    ending = F.when(F.col("m") % 7 == 3, ".bak").otherwise(".json")
    docs = docs.select(F.concat(F.lit("m"), F.col("m").cast("string"), F.lit("/snapshot-"), day, ending).alias("file"), text.alias("value"))
    docs = docs.select(snapshot_date_of(F.col("file")).cast("string").alias("partition"), "file", "value")
    return C.checked_records(C.split_array(docs), C.MARKET, F.col("partition").isNull())


@query(f"""WITH {_BROKEN}
SELECT file, any_value(partition) AS partition, reason, CASE WHEN reason = 'document' THEN 1 ELSE count(*) END AS n,
       CASE WHEN reason = 'document' THEN NULL ELSE min(position) END AS first_position
FROM ck WHERE reason IS NOT NULL GROUP BY file, reason""")
def q_quarantine(spark: SparkSession, sf: str) -> DataFrame:
    """What can't be used of the market documents, by file and reason."""
    aside = C.quarantine(_checked(spark, sf), "market")
    return aside.groupBy("file", "partition", "reason").agg(F.count(F.lit(1)).alias("n"), F.min("position").alias("first_position"))


@query(f"WITH {_BROKEN} SELECT partition, position AS ord, name, value FROM ck WHERE reason IS NULL")
def q_source_checked(spark: SparkSession, sf: str) -> DataFrame:
    """The rows of the same documents that pass the checks, at their places."""
    return C.sound(_checked(spark, sf)).select("partition", "ord", "name", "value")


@query("""SELECT CAST(o_custkey // 50 AS VARCHAR) AS partition, CAST(o_custkey AS VARCHAR) AS player_id,
       CAST(count(*) AS INTEGER) AS games, CAST(year(min(o_orderdate)) AS INTEGER) AS first_season
FROM orders GROUP BY o_custkey""")
def q_source_records(spark: SparkSession, sf: str) -> DataFrame:
    """Objects keyed by customer, fifty to a document, cut into records that are spread and parsed."""
    per = V.table(spark, sf, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.year(F.min("o_orderdate")).alias("y"))
    record = F.struct(F.col("n").alias("gamesPlayed"), F.create_map(F.lit("first"), F.col("y").cast("double")).alias("stats"))
    entry = F.struct(F.col("o_custkey").cast("string").alias("k"), record.alias("v"))
    docs = per.groupBy(F.floor(F.col("o_custkey") / 50).cast("string").alias("partition")).agg(F.map_from_entries(F.collect_list(entry)).alias("m"))
    docs = docs.select("partition", F.concat("partition", F.lit(".json")).alias("file"), F.to_json("m").alias("value"))
    records = C.split_keyed(docs).repartition(F.xxhash64("partition", "file", "position"))
    rows = C.sound(C.checked_records(records, C.SEASON))
    return rows.select(
        "partition", F.col("key").alias("player_id"), F.col("gamesPlayed").alias("games"), F.col("stats")["first"].cast("int").alias("first_season")
    )
