"""Queries over the data-quality rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seasonframe.analog import views as V
from seasonframe.analog.registry import query
from seasonframe.operators import market as M
from seasonframe.operators import quality as Q
from seasonframe.operators.totals import season_totals


def _verdicts(rows: DataFrame, partition: str = "snapshot_date") -> DataFrame:
    return rows.select(
        F.col("partition").alias(partition), "rule_id", "observed", (~F.col("failed")).alias("passed")
    )


@query(f"""WITH {V.TOTALS}, n AS (SELECT season, count(*) AS players, count(*) FILTER (games_played >= 4) AS full_n
                                 FROM per GROUP BY season)
SELECT CAST(season AS VARCHAR) AS season, 'DQ-1' AS rule_id, CAST(players AS VARCHAR) AS observed,
       players >= 150 AS passed FROM n
UNION ALL SELECT CAST(season AS VARCHAR), 'DQ-2', CAST(full_n AS VARCHAR), full_n >= 40 FROM n""")
def q_dq_season(spark: SparkSession, sf: str) -> DataFrame:
    """Season size rules with limits that fit the tables."""
    totals = season_totals(V.entries(spark, sf))
    rows = Q.season_size_rules(totals, min_players=150, full_games=4, min_full=40, keep_passed=True)
    return _verdicts(rows, "season")


@query(f"""WITH {V.TOTALS}
SELECT CAST(season AS VARCHAR) AS season, player_id AS key, 'DQ-7' AS rule_id,
       CAST(dnp_weeks + bye_weeks AS VARCHAR) AS observed FROM per WHERE bye_weeks > 0""")
def q_dq_consistency(spark: SparkSession, sf: str) -> DataFrame:
    """Record rules on totals whose byes were booked as missed weeks too."""
    totals = season_totals(V.entries(spark, sf)).withColumn("dnpWeeks", F.col("dnpWeeks") + F.col("byeWeeks"))
    return Q.season_record_rules(totals).select(F.col("partition").alias("season"), "key", "rule_id", "observed")


@query(f"""WITH {V.TOTALS},
s AS (SELECT 2024 + p_size % 3 AS season, CAST(p_partkey AS VARCHAR) AS player_id, p_size // 10 AS min_games FROM part),
j AS (SELECT s.season, s.player_id, s.min_games, per.games_played FROM s LEFT JOIN per USING (season, player_id)
      WHERE s.season IN (SELECT season FROM per))
SELECT CAST(season AS VARCHAR) AS season, player_id AS key, 'DQ-9' AS rule_id, CAST(NULL AS VARCHAR) AS observed
FROM j WHERE games_played IS NULL
UNION ALL SELECT CAST(season AS VARCHAR), player_id, 'DQ-10', CAST(games_played AS VARCHAR)
FROM j WHERE games_played < min_games""")
def q_dq_sentinels(spark: SparkSession, sf: str) -> DataFrame:
    """Sentinel rules; the parts serve as the list of regulars."""
    sentinels = V.table(spark, sf, "part").select(
        (2024 + F.col("p_size") % 3).alias("season"), F.col("p_partkey").cast("string").alias("player_id"),
        F.floor(F.col("p_size") / 10).cast("int").alias("min_games"), F.col("p_name").alias("name"),
    )
    rows = Q.sentinel_rules(season_totals(V.entries(spark, sf)), sentinels)
    return rows.select(F.col("partition").alias("season"), "key", "rule_id", "observed")


@query(f"""WITH {V.COLLEGE}, n AS (
  SELECT category || '/' || season AS part, count(*) AS n, count(*) FILTER (stat IS NULL) AS bad,
         count(DISTINCT "playerId") AS players FROM co GROUP BY 1)
SELECT part AS partition, 'DQ-13' AS rule_id, CAST(n AS VARCHAR) AS observed, n >= 290 AS passed FROM n
UNION ALL SELECT part, 'DQ-14', CAST(bad AS VARCHAR), bad = 0 FROM n
UNION ALL SELECT part, 'DQ-15', CAST(players AS VARCHAR), players >= 132 FROM n""")
def q_dq_college(spark: SparkSession, sf: str) -> DataFrame:
    """College rules with limits that fit the tables."""
    rows = Q.college_rules(V.college(spark, sf), min_rows=290, min_players=132, keep_passed=True)
    return _verdicts(rows, "partition")


@query(f"""WITH {V.MARKET}, n AS (SELECT snapshot_date, count(*) AS n FROM mk GROUP BY 1)
SELECT CAST(snapshot_date AS VARCHAR) AS snapshot_date, 'DQ-17' AS rule_id, CAST(n AS VARCHAR) AS observed,
       n BETWEEN 900 AND 1170 AS passed FROM n""")
def q_dq_market_size(spark: SparkSession, sf: str) -> DataFrame:
    """Snapshot size rule with limits that fit the tables."""
    return _verdicts(Q.market_size_rules(V.market(spark, sf), rows=(900, 1170), keep_passed=True))


@query(f"""WITH {V.MARKET}
SELECT CAST(d.snapshot_date AS VARCHAR) AS snapshot_date, p.position, 'DQ-18' AS rule_id,
       CAST(count(mk.name) AS VARCHAR) AS observed, count(mk.name) >= 230 AS passed
FROM (SELECT DISTINCT snapshot_date FROM mk) d
CROSS JOIN (SELECT unnest(['BUILDING', 'FURNITURE', 'MACHINERY', 'GARDEN']) AS position) p
LEFT JOIN mk ON mk.snapshot_date = d.snapshot_date AND mk.position = p.position
GROUP BY d.snapshot_date, p.position""")
def q_dq_positions(spark: SparkSession, sf: str) -> DataFrame:
    """Required positions, one of which never occurs."""
    names = ("BUILDING", "FURNITURE", "MACHINERY", "GARDEN")
    rows = Q.market_position_rules(V.market(spark, sf), positions=names, least=230, keep_passed=True)
    return rows.select(
        F.col("partition").alias("snapshot_date"), F.col("key").alias("position"), "rule_id", "observed",
        (~F.col("failed")).alias("passed"),
    )


@query(f"""WITH {V.MARKET},
b AS (SELECT *, row_number() OVER (PARTITION BY snapshot_date ORDER BY ord) AS rn FROM mk WHERE value > 9999),
n AS (SELECT snapshot_date, count(*) FILTER (value > 9999) AS bad FROM mk GROUP BY 1)
SELECT CAST(n.snapshot_date AS VARCHAR) AS snapshot_date, 'DQ-19' AS rule_id, CAST(bad AS VARCHAR) AS observed,
       bad || ' rows with a value outside 0 to 9999: '
       || coalesce(string_agg(b.name || '=' || b.value, ', ' ORDER BY rn), 'null') AS message, bad = 0 AS passed
FROM n LEFT JOIN b ON b.snapshot_date = n.snapshot_date AND rn <= 3 GROUP BY n.snapshot_date, bad""")
def q_dq_range_sample(spark: SparkSession, sf: str) -> DataFrame:
    """Value range with the first three offenders."""
    rows = Q.market_range_rules(V.market(spark, sf), keep_passed=True)
    return rows.select(
        F.col("partition").alias("snapshot_date"), "rule_id", "observed", "message",
        (~F.col("failed")).alias("passed"),
    )


@query(f"""WITH {V.MARKET},
t AS (SELECT * FROM mk QUALIFY row_number() OVER (PARTITION BY snapshot_date ORDER BY value DESC, ord) <= 10),
n AS (SELECT snapshot_date, count(*) FILTER (position = 'BUILDING') AS hits FROM t GROUP BY 1)
SELECT CAST(snapshot_date AS VARCHAR) AS snapshot_date, 'DQ-20' AS rule_id, CAST(hits AS VARCHAR) AS observed,
       hits >= 3 AS passed FROM n""")
def q_dq_top10(spark: SparkSession, sf: str) -> DataFrame:
    """Sentinels among the ten highest values of a snapshot."""
    rows = Q.market_sentinel_rules(
        V.market(spark, sf), is_sentinel=F.col("position") == "BUILDING", keep_passed=True
    )
    return _verdicts(rows)


@query(f"""WITH {V.MARKET},
cal AS (SELECT snapshot_date, lag(snapshot_date) OVER (ORDER BY snapshot_date) AS prev
        FROM (SELECT DISTINCT snapshot_date FROM mk)),
r AS (SELECT n.snapshot_date, cal.prev, count(*) FILTER (o.name IS NULL OR o.tier <> n.tier) AS changed_n
      FROM mk n JOIN cal USING (snapshot_date)
      LEFT JOIN mk o ON o.snapshot_date = cal.prev AND o.name = n.name
      WHERE cal.prev IS NOT NULL GROUP BY 1, 2),
s AS (SELECT snapshot_date AS prev, count(*) AS prev_n FROM mk GROUP BY 1)
SELECT CAST(snapshot_date AS VARCHAR) AS snapshot_date, 'DQ-21' AS rule_id,
       changed_n || '/' || prev_n || ' rows changed' AS message, changed_n / prev_n <= 0.70 AS passed
FROM r JOIN s USING (prev)""")
def q_dq_delta(spark: SparkSession, sf: str) -> DataFrame:
    """Change guard as a rule."""
    ratios = M.change_history(V.market(spark, sf), value="tier")
    return Q.market_delta_rules(ratios, keep_passed=True).select(
        F.col("partition").alias("snapshot_date"), "rule_id", "message", (~F.col("failed")).alias("passed")
    )


@query("""SELECT year(o_orderdate) || '-' || o_orderpriority || '-' || o_orderstatus AS key, count(*) AS n
FROM orders GROUP BY ALL HAVING count(*) > 1""")
def q_dq_dupes(spark: SparkSession, sf: str) -> DataFrame:
    """Key combinations that occur more than once."""
    keyed = V.table(spark, sf, "orders").select(
        F.concat_ws("-", F.year("o_orderdate").cast("string"), "o_orderpriority", "o_orderstatus").alias("key")
    )
    return Q.duplicate_keys(keyed, ["key"])


@query(f"""WITH {V.STAFF}
SELECT id AS key, 'DQ-27' AS rule_id, CAST(NULL AS VARCHAR) AS observed FROM sf WHERE name IS NULL
UNION ALL SELECT id, 'DQ-28', team FROM sf WHERE NOT list_contains({V.TEAM_LIST}, team)
UNION ALL SELECT id, 'DQ-29', CAST(year AS VARCHAR) FROM sf WHERE year NOT BETWEEN 2012 AND 2014
UNION ALL SELECT id, 'DQ-30', role FROM sf WHERE role NOT IN ('HC', 'OC', 'DC')""")
def q_dq_membership(spark: SparkSession, sf: str) -> DataFrame:
    """Entry rules of coaching entries: team, role and year in their sets."""
    rows = Q.overlay_entry_violations(V.staff(spark, sf), "coaching", 2013)
    return rows.select("key", "rule_id", "observed")


@query("""SELECT CAST(user_id AS VARCHAR) AS player_id, count(*) AS n FROM events
WHERE user_id NOT IN (SELECT s_suppkey FROM supplier) GROUP BY 1""")
def q_dq_player_ref(spark: SparkSession, sf: str) -> DataFrame:
    """References to players that are not in the dimension."""
    refs = V.table(spark, sf, "events").select("event_id", F.col("user_id").cast("string").alias("playerId"))
    known = V.table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("player_id"))
    missing = Q.unknown_players(refs, known)
    return missing.groupBy(F.col("playerId").alias("player_id")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {V.NOTES}
SELECT doc_id, 'DQ-35' AS rule_id FROM nt WHERE (player_id IS NULL) = (team IS NULL)
UNION ALL SELECT doc_id, 'DQ-36' FROM nt WHERE team IS NOT NULL
UNION ALL SELECT doc_id, 'DQ-37' FROM nt WHERE player_id NOT IN (SELECT CAST(s_suppkey AS VARCHAR) FROM supplier)
UNION ALL SELECT doc_id, 'DQ-38' FROM nt WHERE year NOT BETWEEN 2012 AND 2025
UNION ALL SELECT doc_id, 'DQ-39' FROM nt WHERE regexp_full_match(body, '\\s*')""")
def q_dq_notes(spark: SparkSession, sf: str) -> DataFrame:
    """Rules of notes over whole texts."""
    players = V.table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("player_id"))
    rows = Q.overlay_entry_violations(V.notes(spark, sf), "notes", 2024, players=players)
    return rows.select(F.substring("key", 2, 20).cast("long").alias("doc_id"), "rule_id")


@query(f"""WITH {V.TOTALS}, {V.INJURIES}
SELECT 'inj-' || inj.season || '-' || inj.player_id || '-w' || inj.week AS key,
       CASE WHEN per.player_id IS NULL THEN 'DQ-33' ELSE 'DQ-34' END AS rule_id,
       CASE WHEN per.player_id IS NULL THEN 'no season totals for player ' || inj.player_id || ' in ' || inj.season
            ELSE 'no absence segment starts at week ' || inj.week || ', available: '
                 || coalesce((SELECT string_agg('w' || seg_start, ', ' ORDER BY seg_start) FROM seg
                              WHERE seg.season = inj.season AND seg.player_id = inj.player_id), 'none') END AS message
FROM inj LEFT JOIN per ON per.season = inj.season AND per.player_id = inj.player_id
LEFT JOIN seg ON seg.season = inj.season AND seg.player_id = inj.player_id AND seg.seg_start = inj.week
WHERE seg.player_id IS NULL""")
def q_dq_injuries(spark: SparkSession, sf: str) -> DataFrame:
    """Segment rules of injuries with the starts that would have been right."""
    rows = Q.overlay_entry_violations(
        V.injuries(spark, sf), "injuries", 2025, totals=season_totals(V.entries(spark, sf))
    )
    return rows.select("key", "rule_id", "message")


@query(f"""WITH {V.STAFF},
v AS (SELECT id, 1 AS r, 'DQ-27' AS rule_id FROM sf WHERE name IS NULL
      UNION ALL SELECT id, 2, 'DQ-28' FROM sf WHERE NOT list_contains({V.TEAM_LIST}, team)
      UNION ALL SELECT id, 3, 'DQ-29' FROM sf WHERE year NOT BETWEEN 2012 AND 2014
      UNION ALL SELECT id, 4, 'DQ-30' FROM sf WHERE role NOT IN ('HC', 'OC', 'DC'))
SELECT 'overlay' AS dataset, 'coaching' AS partition, id AS key, rule_id FROM v ORDER BY id, r LIMIT 1""")
def q_dq_first_failure(spark: SparkSession, sf: str) -> DataFrame:
    """The failure a checker that stops at the first one would report."""
    rows = Q.overlay_entry_violations(V.staff(spark, sf), "coaching", 2013)
    return Q.first_failures(rows).select("dataset", "partition", "key", "rule_id")


_CASE = "CAST(player_id AS BIGINT) % 7"


@query(f"""WITH {V.TOTALS}, c AS (SELECT *, {_CASE} AS k FROM per), v AS (
SELECT season, player_id, 'DQ-3' AS rule_id, '19' AS observed FROM c WHERE k = 0
UNION ALL SELECT season, player_id, 'DQ-4', NULL FROM c WHERE k = 1
UNION ALL SELECT season, player_id, 'DQ-5', CAST(games_played + 1 AS VARCHAR) FROM c WHERE k = 2
UNION ALL SELECT season, player_id, 'DQ-6', CAST(bye_weeks + 1 AS VARCHAR) FROM c WHERE k = 3
UNION ALL SELECT season, player_id, 'DQ-7', CAST(dnp_weeks + 1 AS VARCHAR) FROM c WHERE k = 4
UNION ALL SELECT season, player_id, 'DQ-8', '0' FROM c WHERE k = 5 AND games_played > 0)
SELECT CAST(season AS VARCHAR) AS season, player_id AS key, rule_id, observed FROM v""")
def q_dq_records(spark: SparkSession, sf: str) -> DataFrame:
    """Record rules on totals with one fault each, which the player's number decides."""
    kind = F.col("player_id").cast("long") % 7

    def spoilt(name: str, case: int, value) -> dict:
        return {name: F.when(kind == case, value).otherwise(F.col(name))}

    totals = season_totals(V.entries(spark, sf))
    types = dict(totals.dtypes)
    totals = totals.withColumns(
        spoilt("weeklyStatus", 0, F.array_append("weeklyStatus", "X"))
        | spoilt("availability", 1, F.lit(None).cast(types["availability"]))
        | spoilt("gamesPlayed", 2, F.col("gamesPlayed") + 1)
        | spoilt("byeWeeks", 3, F.col("byeWeeks") + 1)
        | spoilt("dnpWeeks", 4, F.col("dnpWeeks") + 1)
        | spoilt("weeklyPoints", 5, F.create_map().cast(types["weeklyPoints"]))
    )
    return Q.season_record_rules(totals).select(F.col("partition").alias("season"), "key", "rule_id", "observed")


@query(f"""WITH {V.TOTALS}
SELECT DISTINCT CAST(season AS VARCHAR) AS season, 'DQ-11' AS rule_id, 'warning' AS severity FROM per
WHERE season <> (SELECT max(season) FROM per)""")
def q_dq_unwatched(spark: SparkSession, sf: str) -> DataFrame:
    """Seasons without sentinels, when only the last one has any."""
    totals = season_totals(V.entries(spark, sf))
    last = totals.groupBy("season").agg(F.min("player_id").alias("player_id")).orderBy(F.desc("season")).limit(1)
    listed = last.select("season", "player_id", F.lit(0).alias("min_games"), F.lit("x").alias("name"))
    rows = Q.sentinel_rules(totals, listed).filter("rule_id = 'DQ-11'")
    return rows.select(F.col("partition").alias("season"), "rule_id", "severity")


@query("""SELECT CAST(doc_id AS VARCHAR) AS doc, CASE lang WHEN 'de' THEN 'DQ-12' ELSE 'DQ-16' END AS rule_id
FROM documents WHERE lang IN ('de', 'fr')""")
def q_dq_arrays(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that should be arrays: German ones are objects, French ones are cut off."""
    lang, item = F.col("lang"), F.to_json(F.struct("text"))
    value = F.when(lang == "de", item).when(lang == "fr", F.concat(F.lit("["), item)).otherwise(F.concat(F.lit("["), item, F.lit("]")))
    docs = V.table(spark, sf, "documents").select("lang", F.col("doc_id").cast("string").alias("partition"), value.alias("value"))
    college = Q.array_document_rules(docs.filter("lang <> 'fr'"), "college", "DQ-12")
    market = Q.array_document_rules(docs.filter("lang <> 'de'"), "market", "DQ-16")
    return college.unionByName(market).select(F.col("partition").alias("doc"), "rule_id")


@query("""SELECT 'scheme' AS overlay, 'DQ-26' AS rule_id, count(*) AS n FROM documents WHERE doc_id % 5 = 0
UNION ALL SELECT 'scheme', 'DQ-31', count(*) FROM documents WHERE lang = 'fr'
UNION ALL SELECT 'notes', 'DQ-39', count(*) FROM documents WHERE lang = 'es'""")
def q_dq_content(spark: SparkSession, sf: str) -> DataFrame:
    """Overlay entries without id, content or body."""
    docs = V.table(spark, sf, "documents")
    number = F.col("doc_id").cast("string")
    scheme = docs.select(
        F.when(F.col("doc_id") % 5 != 0, number).alias("id"), F.lit(2020).alias("year"), F.lit("SF").alias("team"),
        F.when(F.col("lang") == "fr", "").otherwise("4-3").alias("offense"),
        *[F.lit(None).cast("string").alias(c) for c in ("defense", "tempo")],
    )
    notes = docs.select(
        number.alias("id"), F.lit("p").alias("playerId"), F.lit(None).cast("string").alias("team"), F.lit(None).cast("int").alias("year"),
        F.when(F.col("lang") == "es", "\t \n").otherwise(F.col("text")).alias("body"),
    )
    found = Q.overlay_entry_violations(scheme, "scheme", 2026).unionByName(Q.overlay_entry_violations(notes, "notes", 2026))
    return found.groupBy(F.col("partition").alias("overlay"), "rule_id").agg(F.count(F.lit(1)).alias("n"))
