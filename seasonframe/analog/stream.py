"""A query that runs a stream over the test tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seasonframe.analog import views as V
from seasonframe.analog.registry import query
from seasonframe.plans.warehouse import Warehouse, shared_folder
from seasonframe.streaming.decisions import Limits, publish_decisions

SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
LIMITS = Limits(
    rows=(40, 90), positions=SEGMENTS, per_position=4, values=(1, 5), known=(), known_in_top=0, max_changed=0.75, max_age_days=400
)

DOCS = f"""{V.MARKET},
yr AS (SELECT *, CAST(year(snapshot_date) AS INTEGER) AS y, ord // 100 AS m FROM mk),
doc_rows AS (
  SELECT 'm' || m AS market, make_date(y + s, 1, 1) AS day, ord, name, team, tier AS value, position
  FROM yr, (SELECT unnest([0, 1]) AS s)
  WHERE CASE WHEN m % 3 = 0 AND y % 2 = 1 THEN true WHEN m % 3 = 0 THEN false ELSE s = 0 END),
facts AS (
  SELECT market, day, count(*) AS n, string_agg(concat_ws('|', name, team, value, position), ';' ORDER BY ord) AS content,
         CASE WHEN count(*) NOT BETWEEN 40 AND 90 THEN 'DQ-17'
              WHEN {" OR ".join(f"count(*) FILTER (position = '{p}') < 4" for p in SEGMENTS)} THEN 'DQ-18'
              WHEN bool_or(value NOT BETWEEN 1 AND 5) THEN 'DQ-19' END AS failed
  FROM doc_rows GROUP BY market, day),
dk AS (SELECT *, row_number() OVER (PARTITION BY market ORDER BY year(day) % 4 = 1, day) AS i FROM facts),
chg AS (
  SELECT a.market, a.i, b.i AS old_i, count(*) FILTER (o.name IS NULL OR o.value <> r.value) AS changed
  FROM dk a JOIN dk b USING (market) JOIN doc_rows r ON r.market = a.market AND r.day = a.day
  LEFT JOIN doc_rows o ON o.market = b.market AND o.day = b.day AND o.name = r.name
  GROUP BY a.market, a.i, b.i)"""


@query(f"""WITH RECURSIVE {DOCS},
walk AS (
  SELECT DISTINCT market, 0::BIGINT AS i, NULL::BIGINT AS last, NULL::VARCHAR AS decision, NULL::VARCHAR AS rule, NULL::BIGINT AS before, NULL::BIGINT AS changed FROM dk
  UNION ALL
  SELECT market, i, CASE WHEN decision = 'write' THEN i ELSE last END, decision, rule, last, changed
  FROM (
    SELECT d.market, d.i, w.last,
           CASE WHEN d.failed IS NOT NULL THEN 'reject' WHEN l.i IS NULL THEN 'write'
                WHEN d.content = l.content AND d.day >= l.day THEN 'skip' WHEN d.day <= l.day THEN 'late'
                WHEN d.day - l.day + 1 <= 400 AND c.changed > 0.75 * l.n THEN 'reject' ELSE 'write' END AS decision,
           CASE WHEN d.failed IS NOT NULL THEN d.failed
                WHEN d.content <> l.content AND d.day > l.day AND d.day - l.day + 1 <= 400 AND c.changed > 0.75 * l.n THEN 'DQ-21' END AS rule,
           CASE WHEN d.failed IS NULL AND d.content <> l.content AND d.day > l.day THEN c.changed END AS changed
    FROM walk w JOIN dk d ON d.market = w.market AND d.i = w.i + 1
    LEFT JOIN dk l ON l.market = w.market AND l.i = w.last
    LEFT JOIN chg c ON c.market = d.market AND c.i = d.i AND c.old_i = w.last))
SELECT w.market, CAST(d.day AS VARCHAR) AS snapshot_date, w.decision, w.rule,
       CASE WHEN d.failed IS NULL THEN CAST(b.day AS VARCHAR) END AS baseline, CAST(w.changed AS INTEGER) AS changed_n,
       CAST(CASE WHEN w.changed IS NOT NULL THEN b.n END AS INTEGER) AS prev_n
FROM walk w JOIN dk d USING (market, i) LEFT JOIN dk b ON b.market = w.market AND b.i = w.before""")
def q_stream_decisions(spark: SparkSession, sf: str) -> DataFrame:
    """Yearly market documents of a hundred customers each through the stream, in two runs.

    Every third market shows each odd year's rows again in the year after. The second run brings
    the years that leave a remainder of 1 by 4: late where a later year was accepted.
    """
    rows = V.market(spark, sf)
    number = F.floor(F.col("ord") / 100)
    year = F.year("snapshot_date")
    repeated = number % 3 == 0
    days = F.when(repeated & (year % 2 == 1), F.array(year, year + 1)).when(~repeated, F.array(year))
    rows = rows.select(
        F.concat(F.lit("m"), number.cast("string")).alias("market"), F.explode(days).alias("year"), "ord",
        "name", "team", F.col("tier").alias("value"), "position",
    )
    item = F.struct("name", "team", "value", "position")
    docs = rows.groupBy("market", "year").agg(F.array_sort(F.collect_list(F.struct("ord", item.alias("item")))).alias("items"))
    day = F.make_date("year", F.lit(1), F.lit(1))
    docs = docs.select(
        "market", day.alias("snapshot_date"), F.concat(F.lit("snapshot-"), day.cast("string"), F.lit(".json")).alias("file"),
        F.to_json(F.transform("items", lambda i: i["item"])).alias("value"),
    )
    root = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    wh = Warehouse(f"{root}/warehouse")
    for second in (False, True):
        docs.filter((F.year("snapshot_date") % 4 == 1) == second).write.mode("append").parquet(f"{root}/landing")
        landed = spark.readStream.schema(docs.schema).parquet(f"{root}/landing")
        publish_decisions(landed, wh, f"{root}/checkpoint", LIMITS).awaitTermination()
    made = spark.read.parquet(wh.path("market_decisions"))
    return made.select(
        "market", F.col("snapshot_date").cast("string"), "decision", "rule", F.col("baseline").cast("string"), "changed_n", "prev_n"
    )
