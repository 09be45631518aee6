"""Queries over league documents: nations are leagues with weights of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seasonframe import schemas as S
from seasonframe.analog import views as V
from seasonframe.analog.registry import query
from seasonframe.operators import totals
from seasonframe.operators.totals import season_totals
from seasonframe.sources.documents import array_documents
from seasonframe.sources.league import league_documents, roster_players, scoring_weights

KEYS = ("gp", "gs", "k0", "k1", "k2", "k3", "k4", "pts_half_ppr")

_WEIGHTS = f"""wt AS (
  SELECT 'L' || n_nationkey AS league_id, k AS stat_key, (n_nationkey * 7 + i * 3) % 11 / 4::DOUBLE - 1 AS weight
  FROM nation, (SELECT unnest({list(KEYS)}) AS k, CAST(unnest(range(0, {len(KEYS)})) AS INTEGER) AS i)
  WHERE (n_nationkey + i) % 3 <> 0)"""


def _leagues(spark: SparkSession, sf: str) -> DataFrame:
    """A document for each nation, read back."""
    n = F.col("n_nationkey")
    pairs = F.array(*[F.struct(F.lit(k).alias("k"), ((n * 7 + i * 3) % 11 / 4 - 1).cast("double").alias("w"), ((n + i) % 3 != 0).alias("has")) for i, k in enumerate(KEYS)])
    settings = F.map_from_entries(F.transform(F.filter(pairs, lambda p: p["has"]), lambda p: F.struct(p["k"], p["w"])))
    league = F.struct(
        F.concat(F.lit("L"), n.cast("string")).alias("league_id"), F.col("n_name").alias("name"), F.lit("2024").alias("season"),
        F.col("n_regionkey").cast("int").alias("total_rosters"), settings.alias("scoring_settings"),
    )
    return league_documents(V.table(spark, sf, "nation").select(F.to_json(league).alias("value")))


@query(f"""WITH {_WEIGHTS}
SELECT 'L' || n_nationkey AS league_id, n_name AS name, '2024' AS season, CAST(n_regionkey AS INTEGER) AS total_rosters, stat_key, weight
FROM nation JOIN wt ON league_id = 'L' || n_nationkey""")
def q_leagues(spark: SparkSession, sf: str) -> DataFrame:
    """League documents with one row for each weight."""
    leagues = _leagues(spark, sf)
    named = leagues.select("league_id", "name", "season", "total_rosters")
    return scoring_weights(leagues).join(named, "league_id")


@query(f"""WITH {V.ENTRIES}, {_WEIGHTS},
kv AS (SELECT season, player_id, week, unnest(['gp', 'gs', 'pts_half_ppr', stat_key]) AS k, unnest([gp, gs, pts, pts])::DOUBLE AS v
       FROM st WHERE status = 'P'),
sums AS (SELECT season, player_id, k, list_reduce(list(v ORDER BY week), lambda a, b: a + b) AS v FROM kv GROUP BY season, player_id, k),
pts AS (SELECT season, player_id, league_id, list_reduce(list_prepend(0.0::DOUBLE, list(v * weight ORDER BY k)), lambda a, b: a + b) AS p
        FROM sums JOIN wt ON stat_key = k GROUP BY season, player_id, league_id)
SELECT season, player_id, league_id, floor(p * 100 + 0.5) / 100 AS points FROM pts""")
def q_league_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """Every player's points in every league."""
    return totals.league_matrix(season_totals(V.entries(spark, sf)), scoring_weights(_leagues(spark, sf)))


@query("""WITH r AS (
  SELECT c_nationkey, c_custkey // 10 AS roster, list(c_custkey ORDER BY c_custkey) AS ids FROM customer GROUP BY 1, 2),
l AS (SELECT *, 'players' AS list, ids AS p FROM r
      UNION ALL SELECT *, 'starters', ids[1:2] FROM r UNION ALL SELECT *, 'taxi', ids[3:3] FROM r WHERE roster % 2 = 0)
SELECT 'L' || c_nationkey AS league_id, CAST(roster AS INTEGER) AS roster_id, 'u' || ids[1] AS owner_id, list,
       CAST(slot - 1 AS INTEGER) AS slot, CAST(p[slot] AS VARCHAR) AS player_id
FROM (SELECT *, unnest(range(1, len(p) + 1)) AS slot FROM l)""")
def q_rosters(spark: SparkSession, sf: str) -> DataFrame:
    """Roster documents, an array for each nation, with their lists unfolded; some rosters have none of a kind."""
    ids = F.transform(F.array_sort(F.collect_list("c_custkey")), lambda c: c.cast("string"))
    rosters = V.table(spark, sf, "customer").groupBy("c_nationkey", F.floor(F.col("c_custkey") / 10).alias("roster")).agg(ids.alias("ids"))
    league = F.concat(F.lit("L"), F.col("c_nationkey").cast("string"))
    doc = F.struct(
        league.alias("league_id"), F.col("roster").cast("int").alias("roster_id"), F.concat(F.lit("u"), F.get("ids", F.lit(0))).alias("owner_id"),
        F.col("ids").alias("players"), F.slice("ids", 1, 2).alias("starters"), F.when(F.col("roster") % 2 == 0, F.slice("ids", 3, 1)).alias("taxi"),
    )
    docs = rosters.groupBy("c_nationkey", F.pmod(F.xxhash64("roster"), F.lit(97)).alias("piece")).agg(F.to_json(F.collect_list(doc)).alias("value"))
    return roster_players(array_documents(docs.select("value"), S.ROSTER))
