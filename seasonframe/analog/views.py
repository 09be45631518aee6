"""Views that give the test tables the shape of the library's inputs.

Each view is written twice, as a DataFrame and as the text of a SQL common table
expression. Every row of the source tables takes part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from seasonframe.constants import POINTS_KEY, TEAMS


_SCHEMAS: dict[str, StructType] = {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A test table. Its schema is read from the file once, not by a job per query."""
    path = f"{sf}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


# Weekly entries from events: a day is a week, 18 days are a season. ----------------------


def _day(ts: str) -> Column:
    return F.date_diff(F.to_date(ts), F.lit("2024-01-01").cast("date"))


def season_of(ts: str) -> Column:
    return (2024 + F.floor(_day(ts) / 18)).cast("int")


def week_of(ts: str) -> Column:
    return (_day(ts) % 18 + 1).cast("int")


def entries(spark: SparkSession, sf: str) -> DataFrame:
    bought = F.col("event_type") == "purchase"
    gp = bought.cast("double")
    gs = (bought & (F.col("value") >= 20)).cast("double")
    stat_key = F.concat(F.lit("k"), (F.get_json_object("props", "$.k").cast("int") % 5).cast("string"))
    return table(spark, sf, "events").select(
        season_of("ts").alias("season"),
        week_of("ts").alias("week"),
        F.col("event_id").alias("ord"),
        F.col("user_id").cast("string").alias("player_id"),
        F.when(
            F.col("event_type") != "signup",
            F.concat(F.lit("T"), (F.col("user_id") % 32).cast("string")),
        ).alias("team"),
        F.create_map(
            F.lit("gp"), gp, F.lit("gs"), gs, F.lit(POINTS_KEY), F.col("value"), stat_key, F.col("value")
        ).alias("stats"),
    )


_DAY = "date_diff('day', DATE '2024-01-01', CAST(ts AS DATE))"
SEASON = f"CAST(2024 + {_DAY} // 18 AS INTEGER)"
WEEK = f"CAST({_DAY} % 18 + 1 AS INTEGER)"

ENTRIES = f"""
en AS (
  SELECT {SEASON} AS season, {WEEK} AS week, event_id AS ord,
         CAST(user_id AS VARCHAR) AS player_id,
         CASE WHEN event_type <> 'signup' THEN 'T' || (user_id % 32) END AS team,
         CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS gp,
         CASE WHEN event_type = 'purchase' AND value >= 20 THEN 1 ELSE 0 END AS gs,
         value AS pts,
         'k' || (CAST(json_extract_string(props, '$.k') AS INTEGER) % 5) AS stat_key
  FROM events),
u AS (
  SELECT * FROM en
  QUALIFY row_number() OVER (PARTITION BY season, week, player_id ORDER BY ord) = 1),
playing AS (SELECT DISTINCT season, week, team FROM u WHERE gp = 1 AND team IS NOT NULL),
st AS (
  SELECT u.*, CASE WHEN u.gp = 1 THEN 'P'
                   WHEN u.team IS NOT NULL AND p.team IS NULL THEN 'B'
                   ELSE 'D' END AS status
  FROM u LEFT JOIN playing p ON u.season = p.season AND u.week = p.week AND u.team = p.team)
"""

TOTALS = ENTRIES + """,
per AS (
  SELECT season, player_id,
         CAST(count(*) FILTER (status = 'P') AS INTEGER) AS games_played,
         CAST(count(*) FILTER (status = 'P' AND gs = 1) AS INTEGER) AS games_started,
         CAST(count(*) FILTER (status = 'B') AS INTEGER) AS bye_weeks,
         CAST(count(*) FILTER (status = 'D') AS INTEGER) AS dnp_weeks,
         min(week) FILTER (status = 'P') AS first_week,
         max(week) FILTER (status = 'P') AS last_week,
         coalesce(list_reduce(list_prepend(0.0::DOUBLE, list(pts ORDER BY week) FILTER (status = 'P')),
                              lambda a, b: a + b), 0.0) AS raw_points
  FROM st GROUP BY season, player_id),
seg AS (
  SELECT season, player_id, min(week) AS seg_start, max(week) AS seg_end,
         CAST(count(*) AS INTEGER) AS seg_len
  FROM (SELECT st.season, st.player_id, st.week,
               st.week - row_number() OVER (PARTITION BY st.season, st.player_id ORDER BY st.week) AS run
        FROM st JOIN per USING (season, player_id)
        WHERE st.status = 'D' AND st.week > per.first_week AND st.week < per.last_week)
  GROUP BY season, player_id, run),
avail AS (
  SELECT per.season, per.player_id, per.first_week, per.last_week,
         coalesce(max(seg_len), 0) AS longest,
         CAST(count(seg_len) AS INTEGER) AS n_segments,
         coalesce(bool_or(seg_end < per.last_week), false) AS returned,
         coalesce(string_agg(seg_start || '-' || seg_end, ',' ORDER BY seg_start), '') AS segments
  FROM per LEFT JOIN seg USING (season, player_id)
  GROUP BY per.season, per.player_id, per.first_week, per.last_week),
shown AS (
  SELECT per.season, per.player_id, string_agg(coalesce(st.status, 'X'), '' ORDER BY w.week) AS status
  FROM per CROSS JOIN (SELECT CAST(unnest(range(1, 19)) AS INTEGER) AS week) w
  LEFT JOIN st ON st.season = per.season AND st.player_id = per.player_id AND st.week = w.week
  GROUP BY per.season, per.player_id)
"""


# Season totals from orders: a year is a season, a customer a player. ----------------------


def order_totals(spark: SparkSession, sf: str) -> DataFrame:
    return (
        table(spark, sf, "orders")
        .groupBy(F.year("o_orderdate").alias("season"), F.col("o_custkey").cast("string").alias("player_id"))
        .agg(F.count(F.lit(1)).cast("double").alias("fantasyPoints"))
    )


def carried_over(totals: DataFrame) -> DataFrame:
    """Last season's totals as the stored version of this season."""
    return totals.withColumn("season", F.col("season") + 1)


ORDER_DIFF = """
tot AS (
  SELECT CAST(year(o_orderdate) AS INTEGER) AS season, CAST(o_custkey AS VARCHAR) AS player_id,
         CAST(count(*) AS DOUBLE) AS points
  FROM orders GROUP BY 1, 2),
dif AS (
  SELECT coalesce(n.season, o.season + 1) AS season, coalesce(n.player_id, o.player_id) AS player_id,
         CASE WHEN o.player_id IS NULL THEN 'added' WHEN n.player_id IS NULL THEN 'removed'
              WHEN abs(n.points - o.points) > 0.01 THEN 'changed' ELSE 'unchanged' END AS status,
         o.points AS old_points, n.points AS new_points, abs(n.points - o.points) AS delta
  FROM tot n FULL JOIN tot o ON n.season = o.season + 1 AND n.player_id = o.player_id)
"""


# Market values from orders: a year is a snapshot, a customer a listed name. ---------------


def market(spark: SparkSession, sf: str) -> DataFrame:
    """``value`` is a money amount, ``tier`` the order count; customers give the order."""
    yearly = (
        table(spark, sf, "orders")
        .groupBy(F.year("o_orderdate").alias("year"), "o_custkey")
        .agg(
            F.sum(F.col("o_totalprice").cast("decimal(12,2)")).alias("money"),
            F.count(F.lit(1)).cast("int").alias("tier"),
        )
    )
    customer = table(spark, sf, "customer")
    nation = table(spark, sf, "nation").select("n_nationkey", "n_name")
    return (
        yearly.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            F.make_date("year", F.lit(1), F.lit(1)).alias("snapshot_date"),
            F.col("c_custkey").alias("ord"),
            F.col("c_name").alias("name"),
            F.col("n_name").alias("team"),
            F.floor(F.col("money") / 200).cast("int").alias("value"),
            F.col("c_mktsegment").alias("position"),
            "tier",
        )
    )


MARKET = """
mk AS (
  SELECT make_date(year(o_orderdate), 1, 1) AS snapshot_date, c_custkey AS ord, c_name AS name,
         n_name AS team, CAST(floor(sum(CAST(o_totalprice AS DECIMAL(12, 2))) / 200) AS INTEGER) AS value,
         c_mktsegment AS position, CAST(count(*) AS INTEGER) AS tier
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  GROUP BY ALL)
"""


# College rows from events: a day of the month is a category. -------------------------------


def college(spark: SparkSession, sf: str) -> DataFrame:
    """``stat`` is a count as text, missing where the values add up to less than 5."""
    cents = F.sum((F.col("value") * 100).cast("decimal(20,0)"))
    count = F.count(F.lit(1)).cast("string")
    rows = table(spark, sf, "events").groupBy(
        F.year("ts").alias("season"),
        F.concat(F.lit("d"), F.dayofmonth("ts").cast("string")).alias("category"),
        F.col("user_id").cast("string").alias("playerId"),
        F.col("event_type").alias("statType"),
    )
    return rows.agg(F.when(cents >= 500, count).alias("stat"))


COLLEGE = """
co AS (
  SELECT CAST(year(ts) AS INTEGER) AS season, 'd' || day(ts) AS category,
         CAST(user_id AS VARCHAR) AS "playerId", event_type AS "statType",
         CASE WHEN sum(CAST(value * 100 AS DECIMAL(20, 0))) >= 500 THEN CAST(count(*) AS VARCHAR) END AS stat
  FROM events GROUP BY ALL)
"""


# Overlay entries. ----------------------------------------------------------------------------


def coaching(spark: SparkSession, sf: str) -> DataFrame:
    """One entry per year, order priority (team) and order status (role)."""
    n = F.count(F.lit(1))
    return (
        table(spark, sf, "orders")
        .groupBy(
            F.year("o_orderdate").alias("year"),
            F.col("o_orderpriority").alias("team"),
            F.col("o_orderstatus").alias("role"),
        )
        .agg(
            F.concat(F.lit("C"), F.floor(n / 25).cast("string")).alias("name"),
            F.when(F.max("o_totalprice") >= 480000, n.cast("int")).alias("tenureStart"),
            F.max("o_orderkey").alias("ord"),
        )
    )


def proposals(spark: SparkSession, sf: str) -> DataFrame:
    """Two proposals per slot: the staff of last year, then the staff of the year before."""
    base = coaching(spark, sf)
    shifts = F.explode(F.array(F.lit(1), F.lit(2)))
    return base.withColumn("shift", shifts).select(
        (F.col("year") + F.col("shift")).alias("year"), "team", "role", "name", "tenureStart",
        (F.col("ord") * 2 + F.col("shift")).alias("ord"),
    )


_COACH_JSON = """'{"name":"' || name || '","role":"' || role || '","team":"' || team || '"'
    || CASE WHEN "tenureStart" IS NULL THEN '' ELSE ',"tenureStart":' || "tenureStart" END
    || ',"year":' || year || '}'"""

COACHING = f"""
co0 AS (
  SELECT CAST(year(o_orderdate) AS INTEGER) AS year, o_orderpriority AS team, o_orderstatus AS role,
         'C' || CAST(floor(count(*) / 25) AS INTEGER) AS name,
         CASE WHEN max(o_totalprice) >= 480000 THEN CAST(count(*) AS INTEGER) END AS "tenureStart",
         max(o_orderkey) AS ord
  FROM orders GROUP BY 1, 2, 3),
pr0 AS (
  SELECT CAST(year + shift AS INTEGER) AS year, team, role, name, "tenureStart", ord * 2 + shift AS ord
  FROM co0 CROSS JOIN (SELECT unnest([1, 2]) AS shift)),
ex AS (
  SELECT *, 'coach-' || year || '-' || team || '-' || role || '-'
            || substr(sha1({_COACH_JSON}), 1, 6) AS id,
         year || '|' || team || '|' || role AS key,
         {_COACH_JSON} AS content
  FROM co0),
pr AS (
  SELECT *, 'coach-' || year || '-' || team || '-' || role || '-'
            || substr(sha1({_COACH_JSON}), 1, 6) AS id,
         year || '|' || team || '|' || role AS key,
         {_COACH_JSON} AS content
  FROM pr0)
"""


def injuries(spark: SparkSession, sf: str) -> DataFrame:
    """One entry per error day of a user; afternoon errors are filed under the next season."""
    late = F.when(F.hour("ts") >= 12, 1).otherwise(0)
    start = F.col("segmentStartWeek")
    return (
        table(spark, sf, "events")
        .filter("event_type = 'error'")
        .groupBy(
            (season_of("ts") + late).cast("int").alias("year"),
            F.col("user_id").cast("string").alias("playerId"),
            week_of("ts").alias("segmentStartWeek"),
        )
        .agg(F.min("value").alias("low"), F.min("event_id").alias("first_event"))
        .select(
            F.concat_ws("-", F.lit("inj"), "year", "playerId", F.concat(F.lit("w"), start.cast("string"))).alias("id"),
            "playerId", "year", "segmentStartWeek",
            F.when(F.col("low") >= 20, start).alias("segmentEndWeek"),
            F.lit("error").alias("type"),
            F.lit(None).cast("string").alias("bodyPart"),
            F.when(F.col("low") >= 20, "single-game").otherwise("multi-week").alias("severity"),
            "first_event",
        )
    )


INJURIES = f"""
inj AS (
  SELECT CAST({SEASON} + CASE WHEN hour(ts) >= 12 THEN 1 ELSE 0 END AS INTEGER) AS season,
         CAST(user_id AS VARCHAR) AS player_id, {WEEK} AS week,
         min(value) >= 20 AS short, min(event_id) AS first_event
  FROM events WHERE event_type = 'error' GROUP BY 1, 2, 3)
"""


def notes(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as notes: labelled ones name a player, foreign ones a team."""
    labels = table(spark, sf, "labels").select("doc_id").distinct().withColumn("labelled", F.lit(True))
    return (
        table(spark, sf, "documents")
        .join(labels, "doc_id", "left")
        .select(
            F.concat(F.lit("n"), F.col("doc_id").cast("string")).alias("id"),
            F.when(F.col("labelled"), F.col("doc_id").cast("string")).alias("playerId"),
            F.when(F.col("lang") != "en", F.upper("lang")).alias("team"),
            F.when(F.col("n_chars") >= 200, (F.col("n_chars") % 20 + 2010).cast("int")).alias("year"),
            F.col("source").alias("tag"),
            F.col("text").alias("body"),
            "doc_id",
        )
    )


NOTES = """
nt AS (
  SELECT 'n' || d.doc_id AS id, CASE WHEN l.doc_id IS NOT NULL THEN CAST(d.doc_id AS VARCHAR) END AS player_id,
         CASE WHEN d.lang <> 'en' THEN upper(d.lang) END AS team,
         CASE WHEN d.n_chars >= 200 THEN CAST(d.n_chars % 20 + 2010 AS INTEGER) END AS year,
         d.text AS body, d.doc_id
  FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id)
"""


def staff(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as coaching entries, some with an unknown team, role or year."""
    nation = table(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey")
    customer = table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey")
    codes = F.array(*[F.lit(t) for t in TEAMS])
    return (
        table(spark, sf, "orders")
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("o_orderkey").cast("string").alias("id"),
            (F.year("o_orderdate") + 14).alias("year"),
            F.when(F.col("n_regionkey") < 4, F.element_at(codes, F.col("n_nationkey") + 1))
            .otherwise(F.col("n_name"))
            .alias("team"),
            F.concat("o_orderstatus", F.lit("C")).alias("role"),
            F.when(F.col("o_totalprice") >= 5000, F.col("c_name")).alias("name"),
        )
    )


TEAM_LIST = "[" + ", ".join(f"'{t}'" for t in TEAMS) + "]"

STAFF = f"""
sf AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS id, year(o_orderdate) + 14 AS year,
         CASE WHEN n_regionkey < 4 THEN ({TEAM_LIST})[n_nationkey + 1] ELSE n_name END AS team,
         o_orderstatus || 'C' AS role, CASE WHEN o_totalprice >= 5000 THEN c_name END AS name
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)
"""
