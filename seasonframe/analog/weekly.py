"""Queries over weekly entries and season totals."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seasonframe.analog import views as V
from seasonframe.analog.registry import query
from seasonframe.functions import player_key, season_of_date
from seasonframe.operators import availability as A
from seasonframe.operators import catalog, dedup, diff, injuries, totals, weekly
from seasonframe.plans.college import college_plan
from seasonframe.plans.buckets import BucketedTable
from seasonframe.plans.season import season_plan
from seasonframe.plans.warehouse import shared_folder

KEY = ["season", "player_id"]


def _totals(spark: SparkSession, sf: str) -> DataFrame:
    return totals.season_totals(V.entries(spark, sf))


@query(f"WITH {V.ENTRIES} SELECT season, week, ord, player_id, team, gp, pts FROM en")
def q_entries(spark: SparkSession, sf: str) -> DataFrame:
    """Usable entries."""
    return weekly.usable_entries(V.entries(spark, sf)).select(
        "season", "week", "ord", "player_id", "team",
        F.col("stats")["gp"].cast("int").alias("gp"), F.col("stats")["pts_half_ppr"].alias("pts"),
    )


@query(f"WITH {V.ENTRIES} SELECT season, week, player_id, ord FROM u")
def q_dedup_first(spark: SparkSession, sf: str) -> DataFrame:
    """First-seen entry per season, week and player."""
    entries = weekly.usable_entries(V.entries(spark, sf)).select("season", "week", "player_id", "ord")
    return dedup.first_seen(entries, weekly.ENTRY_KEY, "ord")


@query(f"""WITH {V.ENTRIES}
SELECT season, week, CAST(sum(n - 1) AS BIGINT) AS n_dupes
FROM (SELECT season, week, player_id, count(*) AS n FROM en GROUP BY ALL) WHERE n > 1 GROUP BY ALL""")
def q_dedup_report(spark: SparkSession, sf: str) -> DataFrame:
    """Dropped copies per week."""
    entries = weekly.usable_entries(V.entries(spark, sf))
    return dedup.duplicate_counts(entries, weekly.ENTRY_KEY, ["season", "week"])


@query(f"""WITH {V.ENTRIES}
SELECT season, week, player_id, ord FROM en
QUALIFY row_number() OVER (PARTITION BY season, week, player_id ORDER BY ord) > 1""")
def q_dedup_removed(spark: SparkSession, sf: str) -> DataFrame:
    """The dropped copies themselves, in encounter order by ``ord``."""
    entries = weekly.usable_entries(V.entries(spark, sf)).select("season", "week", "player_id", "ord")
    return dedup.later_copies(entries, weekly.ENTRY_KEY, "ord")


@query(f"WITH {V.ENTRIES} SELECT season, player_id, week, status FROM st")
def q_weekly_status(spark: SparkSession, sf: str) -> DataFrame:
    """Status code per listed week."""
    return weekly.weekly_status(V.entries(spark, sf))


@query(f"""WITH {V.TOTALS}
SELECT season, player_id, games_played, games_started, bye_weeks, dnp_weeks FROM per""")
def q_season_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Counters per player and season."""
    return _totals(spark, sf).select(
        *KEY, F.col("gamesPlayed").alias("games_played"), F.col("gamesStarted").alias("games_started"),
        F.col("byeWeeks").alias("bye_weeks"), F.col("dnpWeeks").alias("dnp_weeks"),
    )


@query(f"""WITH {V.ENTRIES},
kv AS (SELECT season, player_id, week, 'gp' AS stat_key, CAST(gp AS DOUBLE) AS v FROM st WHERE status = 'P'
       UNION ALL SELECT season, player_id, week, 'gs', gs FROM st WHERE status = 'P'
       UNION ALL SELECT season, player_id, week, 'pts_half_ppr', pts FROM st WHERE status = 'P'
       UNION ALL SELECT season, player_id, week, stat_key, pts FROM st WHERE status = 'P')
SELECT season, player_id, stat_key, list_reduce(list(v ORDER BY week), lambda a, b: a + b) AS total
FROM kv GROUP BY season, player_id, stat_key""")
def q_stat_sums(spark: SparkSession, sf: str) -> DataFrame:
    """Sum per stat key over the played weeks."""
    return totals.stat_rows(_totals(spark, sf))


@query(f"WITH {V.ENTRIES} SELECT season, player_id, week, pts AS points FROM st WHERE status = 'P'")
def q_weekly_points(spark: SparkSession, sf: str) -> DataFrame:
    """Points of the played weeks."""
    return totals.point_rows(_totals(spark, sf))


@query(f"""WITH {V.TOTALS}
SELECT season, player_id, floor(raw_points * 100 + 0.5) / 100 AS fantasy_points FROM per""")
def q_season_points(spark: SparkSession, sf: str) -> DataFrame:
    """Rounded season points."""
    return _totals(spark, sf).select(*KEY, F.col("fantasyPoints").alias("fantasy_points"))


@query(f"""WITH {V.TOTALS}
SELECT CAST(season - 4 AS INTEGER) AS season, player_id,
       substr(status, 1, CASE WHEN season - 4 < 2021 THEN 17 ELSE 18 END) AS status FROM shown""")
def q_status_string(spark: SparkSession, sf: str) -> DataFrame:
    """Status as shown, with the seasons moved to either side of 2021."""
    moved = _totals(spark, sf).withColumn("season", F.col("season") - 4)
    shown = A.shown_status("weeklyStatus", "season")
    return moved.select(*KEY, F.array_join(shown, "").alias("status"))


@query(f"WITH {V.TOTALS} SELECT season, player_id, first_week, last_week FROM per")
def q_played_window(spark: SparkSession, sf: str) -> DataFrame:
    """First and last played week."""
    return _totals(spark, sf).select(
        *KEY, F.col("availability.firstWeek").alias("first_week"), F.col("availability.lastWeek").alias("last_week")
    )


@query(f"WITH {V.TOTALS} SELECT season, player_id, seg_start, seg_end, seg_len FROM seg")
def q_absence_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Absence segments as rows."""
    return A.segment_rows(_totals(spark, sf)).toDF(*KEY, "seg_start", "seg_end", "seg_len")


@query(f"""WITH {V.TOTALS}
SELECT season, player_id, longest, n_segments, returned, longest >= 3 AS long_flag FROM avail""")
def q_availability(spark: SparkSession, sf: str) -> DataFrame:
    """Availability measures."""
    a = "availability."
    longest = F.col(a + "longestAbsence")
    return _totals(spark, sf).select(
        *KEY, longest.alias("longest"), F.size(a + "absenceSegments").alias("n_segments"),
        F.col(a + "returnedFromAbsence").alias("returned"), A.long_absence_flag(longest).alias("long_flag"),
    )


@query(f"""WITH {V.TOTALS}
SELECT per.season, per.player_id, games_played, games_started, bye_weeks, dnp_weeks,
       floor(raw_points * 100 + 0.5) / 100 AS fantasy_points, 'half_ppr' AS scoring_basis, status,
       avail.first_week, avail.last_week, longest, segments, returned, 'unknown' AS absence_cause
FROM per JOIN avail USING (season, player_id) JOIN shown USING (season, player_id)""")
def q_season_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Season totals and availability, one flat row per player and season."""
    t = F.col("availability")
    text = F.expr("transform(availability.absenceSegments, s -> s.start || '-' || s.end)")
    return _totals(spark, sf).select(
        *KEY,
        F.col("gamesPlayed").alias("games_played"),
        F.col("gamesStarted").alias("games_started"),
        F.col("byeWeeks").alias("bye_weeks"),
        F.col("dnpWeeks").alias("dnp_weeks"),
        F.col("fantasyPoints").alias("fantasy_points"),
        F.col("scoringBasis").alias("scoring_basis"),
        F.array_join("weeklyStatus", "").alias("status"),
        t["firstWeek"].alias("first_week"),
        t["lastWeek"].alias("last_week"),
        t["longestAbsence"].alias("longest"),
        F.array_join(text, ",").alias("segments"),
        t["returnedFromAbsence"].alias("returned"),
        t["absenceCause"].alias("absence_cause"),
    )


WEIGHTS = {"gp": 0.25, "gs": 1.0, "pts_half_ppr": 0.5, "k0": 2.0, "k1": -1.0, "k2": 0.1, "k3": 4.0}
_WEIGHTED = " ".join(f"WHEN '{k}' THEN {w}::DOUBLE" for k, w in WEIGHTS.items())


@query(f"""WITH {V.ENTRIES},
kv AS (SELECT season, player_id, week, 'gp' AS k, CAST(gp AS DOUBLE) AS v FROM st WHERE status = 'P'
       UNION ALL SELECT season, player_id, week, 'gs', gs FROM st WHERE status = 'P'
       UNION ALL SELECT season, player_id, week, 'pts_half_ppr', pts FROM st WHERE status = 'P'
       UNION ALL SELECT season, player_id, week, stat_key, pts FROM st WHERE status = 'P'),
sums AS (SELECT season, player_id, k, list_reduce(list(v ORDER BY week), lambda a, b: a + b) AS v
         FROM kv GROUP BY season, player_id, k),
w AS (SELECT season, player_id,
             list_reduce(list(v * CASE k {_WEIGHTED} ELSE 0.0::DOUBLE END ORDER BY k), lambda a, b: a + b) AS p
      FROM sums GROUP BY season, player_id)
SELECT s.season, s.player_id, coalesce(floor(p * 100 + 0.5) / 100, 0.0) AS points
FROM (SELECT DISTINCT season, player_id FROM st) s LEFT JOIN w USING (season, player_id)""")
def q_weighted_points(spark: SparkSession, sf: str) -> DataFrame:
    """Points under a league's scoring weights."""
    scored = totals.league_points(_totals(spark, sf), WEIGHTS)
    return scored.select(*KEY, F.col("leaguePoints").alias("points"))


@query("""SELECT o_orderkey, CAST(year(o_orderdate) - CASE WHEN month(o_orderdate) <= 2 THEN 1 ELSE 0 END
       AS INTEGER) AS season FROM orders""")
def q_current_season(spark: SparkSession, sf: str) -> DataFrame:
    """Season each order date falls into."""
    return V.table(spark, sf, "orders").select("o_orderkey", season_of_date(F.col("o_orderdate")).alias("season"))


# Version comparison ---------------------------------------------------------------------------


def _diff(spark: SparkSession, sf: str) -> DataFrame:
    new = V.order_totals(spark, sf)
    return diff.season_diff(V.carried_over(new), new)


@query(f"""WITH {V.ORDER_DIFF}
SELECT season, count(*) FILTER (status = 'added') AS added, count(*) FILTER (status = 'removed') AS removed,
       count(*) FILTER (status = 'changed') AS changed, count(*) FILTER (status = 'unchanged') AS unchanged,
       bool_and(status = 'unchanged') AS identical FROM dif GROUP BY season""")
def q_diff_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Added, removed and changed players per season."""
    return diff.diff_counts(_diff(spark, sf))


@query(f"""WITH {V.ORDER_DIFF}
SELECT season, player_id, status, old_points, new_points, delta FROM dif WHERE status <> 'unchanged'""")
def q_diff_changed(spark: SparkSession, sf: str) -> DataFrame:
    """Every player that differs."""
    return _diff(spark, sf).filter("status <> 'unchanged'").drop("sort_key")


@query(f"""WITH {V.ORDER_DIFF}
SELECT season, player_id, old_points, new_points, delta, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY season ORDER BY delta DESC, CAST(player_id AS BIGINT)) AS rank
      FROM dif WHERE status = 'changed') WHERE rank <= 5""")
def q_diff_top5(spark: SparkSession, sf: str) -> DataFrame:
    """Five largest changes per season."""
    return diff.diff_top(_diff(spark, sf), 5)


@query(f"""WITH {V.ORDER_DIFF},
top AS (SELECT season, string_agg(printf('  player %s: %.2f → %.2f (Δ%.2f)', player_id, old_points, new_points,
                                         delta), chr(10) ORDER BY rank) AS lines
        FROM (SELECT *, row_number() OVER (PARTITION BY season ORDER BY delta DESC, CAST(player_id AS BIGINT))
              AS rank FROM dif WHERE status = 'changed') WHERE rank <= 5 GROUP BY season),
n AS (SELECT season, count(*) FILTER (status = 'added') AS a, count(*) FILTER (status = 'removed') AS r,
             count(*) FILTER (status = 'changed') AS c FROM dif GROUP BY season)
SELECT season, a + r + c = 0 AS identical,
       CASE WHEN a + r + c = 0 THEN 'no change' ELSE
         concat_ws(', ', CASE WHEN a > 0 THEN a || ' added' END, CASE WHEN r > 0 THEN r || ' removed' END,
                   CASE WHEN c > 0 THEN c || ' changed' END)
         || coalesce(chr(10) || 'Top diffs:' || chr(10) || lines, '') END AS text
FROM n LEFT JOIN top USING (season)""")
def q_diff_text(spark: SparkSession, sf: str) -> DataFrame:
    """Printable summary per season."""
    return diff.diff_summary(_diff(spark, sf))


@query(f"""WITH {V.ORDER_DIFF},
n AS (SELECT season, count(new_points) AS new_n, count(old_points) AS old_n,
             bool_and(status = 'unchanged') AS identical FROM dif GROUP BY season),
man AS (SELECT 'season_totals/' || year(l_shipdate) AS path,
               year(l_shipdate) >= (SELECT max(year(o_orderdate) - CASE WHEN month(o_orderdate) <= 2 THEN 1 ELSE 0 END)
                                    FROM orders) AS in_progress
        FROM lineitem GROUP BY year(l_shipdate))
SELECT season, nullif(old_n, 0) AS old_n, new_n,
       CASE WHEN old_n = 0 THEN 'write' WHEN identical THEN 'skip'
            WHEN in_progress = false THEN 'refuse' ELSE 'write' END AS action
FROM n LEFT JOIN man ON man.path = 'season_totals/' || season WHERE new_n > 0""")
def q_publish_plan(spark: SparkSession, sf: str) -> DataFrame:
    """The season plan's decisions; the manifest lists the ship years."""
    current = V.table(spark, sf, "orders").agg(F.max(season_of_date(F.col("o_orderdate")))).scalar()
    shipped = V.table(spark, sf, "lineitem").select(F.year("l_shipdate").alias("y")).distinct()
    manifest = shipped.select(
        F.concat(F.lit("season_totals/"), F.col("y").cast("string")).alias("path"),
        (F.col("y") >= current).alias("inProgress"),
    )
    new = V.order_totals(spark, sf)
    plan = season_plan(new, V.carried_over(new), manifest, current_season=0)
    return plan.select("season", "old_n", "new_n", "action")


@query("""WITH n AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS season, o_custkey AS part, count(*) AS n
                    FROM orders GROUP BY 1, 2)
SELECT a.season, CAST(a.part AS VARCHAR) AS category, b.n AS old_n, a.n AS new_n,
       CASE WHEN b.n IS NULL THEN 'write' WHEN a.n = b.n THEN 'skip' WHEN a.part % 3 = 0 THEN 'refuse' ELSE 'write' END AS action
FROM n a LEFT JOIN n b ON a.season = b.season + 1 AND a.part = b.part""")
def q_category_plan(spark: SparkSession, sf: str) -> DataFrame:
    """The college plan's decisions by row count; every third category counts as complete."""
    orders = V.table(spark, sf, "orders")
    rows = orders.select(F.year("o_orderdate").alias("season"), F.col("o_custkey").cast("string").alias("category"))
    manifest = rows.distinct().select(
        F.concat_ws("/", F.lit("college"), "category", F.col("season").cast("string")).alias("path"),
        (F.col("category").cast("long") % 3 != 0).alias("inProgress"),
    )
    plan = college_plan(rows, V.carried_over(rows), manifest)
    return plan.select("season", "category", "old_n", "new_n", "action")


@query(f"WITH {V.ORDER_DIFF} SELECT season, player_id, status, old_points, new_points, delta FROM dif")
def q_diff_stored(spark: SparkSession, sf: str) -> DataFrame:
    """Every player's change since last season, which is stored in buckets."""
    new = V.order_totals(spark, sf)
    path = f"{shared_folder(spark)}/totals-{uuid.uuid4().hex}"
    stored = BucketedTable(spark, path, "season INT, player_id STRING, fantasyPoints DOUBLE, player_key STRING", ["season"], "player_key", 16)
    stored.write(V.carried_over(new).withColumn("player_key", player_key("season", "player_id")))
    return diff.season_diff(stored.read(), new).select(*KEY, "status", "old_points", "new_points", "delta")


_REPAIR = """
tot AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS season, o_custkey AS player_id, count(*) AS points,
               count(*) FILTER (year(o_orderdate) % 3 <> 0 OR o_orderstatus <> 'F') AS old_points FROM orders GROUP BY 1, 2),
n AS (SELECT season, nullif(count(*) FILTER (old_points > 0), 0) AS old_n, count(*) AS new_n,
             bool_and(points = old_points) AS identical FROM tot GROUP BY season),
man AS (SELECT 'season_totals/' || season AS path, old_n + CASE WHEN season % 4 = 2 THEN 1 ELSE 0 END AS record_count,
               season % 5 = 0 AS in_progress
        FROM n WHERE old_n IS NOT NULL AND season % 4 <> 1
        UNION ALL SELECT 'season_totals/' || (season + 100), new_n, true FROM n)"""


def _repair(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """New and stored totals, and a manifest that lacks years, has wrong counts and lists years that are not stored.

    Every third year is stored without its finished orders; all others are stored as they are.
    """
    orders = V.table(spark, sf, "orders").select(F.year("o_orderdate").alias("season"), "o_orderstatus", F.col("o_custkey").cast("string").alias("player_id"))
    points = F.count(F.lit(1)).cast("double").alias("fantasyPoints")
    new = orders.groupBy("season", "player_id").agg(points)
    old = orders.filter("season % 3 <> 0 OR o_orderstatus <> 'F'").groupBy("season", "player_id").agg(points)
    counted = catalog.record_counts(old, F.col("season")).withColumnRenamed("path", "season").filter("season % 4 <> 1")
    entries = counted.select(
        "season", (F.col("recordCount") + (F.col("season") % 4 == 2).cast("int")).alias("recordCount"), (F.col("season") % 5 == 0).alias("inProgress")
    )
    gone = catalog.record_counts(new, F.col("season") + 100).withColumnRenamed("path", "season").withColumn("inProgress", F.lit(True))
    manifest = entries.unionByName(gone)
    return new, old, manifest.select(F.concat(F.lit("season_totals/"), F.col("season").cast("string")).alias("path"), "recordCount", "inProgress")


@query(f"""WITH {_REPAIR}
SELECT season, old_n, new_n,
       CASE WHEN old_n IS NULL THEN 'write'
            WHEN identical AND record_count IS DISTINCT FROM old_n THEN 'index' WHEN identical THEN 'skip'
            WHEN in_progress = false THEN 'refuse' ELSE 'write' END AS action
FROM n LEFT JOIN man ON man.path = 'season_totals/' || season""")
def q_publish_repair(spark: SparkSession, sf: str) -> DataFrame:
    """The season plan's decisions where the manifest doesn't tell what is stored."""
    new, old, manifest = _repair(spark, sf)
    return season_plan(new, old, manifest, current_season=0).select("season", "old_n", "new_n", "action")


@query(f"""WITH {_REPAIR},
st AS (SELECT 'season_totals/' || season AS path, old_n FROM n WHERE old_n IS NOT NULL)
SELECT coalesce(st.path, man.path) AS path, old_n AS "storedCount", record_count AS "recordCount",
       CASE WHEN man.path IS NULL THEN 'missing' WHEN st.path IS NULL THEN 'orphan'
            WHEN old_n = record_count THEN 'ok' ELSE 'stale' END AS state
FROM st FULL JOIN man ON st.path = man.path""")
def q_reconcile(spark: SparkSession, sf: str) -> DataFrame:
    """What is stored against what the manifest tells."""
    _, old, manifest = _repair(spark, sf)
    stored = catalog.record_counts(old, F.concat(F.lit("season_totals/"), F.col("season").cast("string")))
    return catalog.reconcile(stored.withColumnRenamed("recordCount", "storedCount"), manifest)


# Injuries against segments ----------------------------------------------------------------------

_OUTCOME = """CASE WHEN per.player_id IS NULL THEN 'no_season' WHEN seg.player_id IS NULL THEN 'no_segment'
                   ELSE 'match' END"""
_INJURY_JOIN = """inj LEFT JOIN per ON per.season = inj.season AND per.player_id = inj.player_id
     LEFT JOIN seg ON seg.season = inj.season AND seg.player_id = inj.player_id AND seg.seg_start = inj.week"""


@query(f"""WITH {V.TOTALS}, {V.INJURIES}
SELECT inj.season, inj.player_id, inj.week, {_OUTCOME} AS outcome FROM {_INJURY_JOIN}""")
def q_injury_match(spark: SparkSession, sf: str) -> DataFrame:
    """Outcome of each injury entry against the absence segments."""
    found = injuries.injury_outcomes(V.injuries(spark, sf), _totals(spark, sf))
    return found.select(
        F.col("year").alias("season"), F.col("playerId").alias("player_id"),
        F.col("segmentStartWeek").alias("week"), "outcome",
    )


@query(f"""WITH {V.TOTALS}, {V.INJURIES}
SELECT inj.season, inj.player_id, inj.week, {_OUTCOME} AS outcome FROM {_INJURY_JOIN}
WHERE seg.player_id IS NULL""")
def q_injury_orphans(spark: SparkSession, sf: str) -> DataFrame:
    """Injury entries without a segment."""
    return q_injury_match(spark, sf).filter("outcome <> 'match'")


@query(f"""WITH {V.TOTALS}, {V.INJURIES}
SELECT seg.season, seg.player_id, CAST(w.week AS INTEGER) AS week, seg_start, seg_end,
       CASE WHEN inj.player_id IS NOT NULL AND (NOT inj.short OR w.week <= seg_start)
            THEN 'inj-' || inj.season || '-' || inj.player_id || '-w' || inj.week END AS injury
FROM seg CROSS JOIN (SELECT unnest(range(1, 19)) AS week) w
     LEFT JOIN inj ON seg.season = inj.season AND seg.player_id = inj.player_id AND seg.seg_start = inj.week
WHERE w.week BETWEEN seg_start AND seg_end""")
def q_injury_weeks(spark: SparkSession, sf: str) -> DataFrame:
    """Missed weeks with the injury noted for them."""
    rows = injuries.injury_weeks(V.injuries(spark, sf), _totals(spark, sf))
    return rows.select(
        *KEY, "week", F.col("start").alias("seg_start"), F.col("end").alias("seg_end"), F.col("id").alias("injury")
    )
