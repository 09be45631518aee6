"""Season totals: the weekly entries of a player folded into one nested record."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seasonframe.constants import BYE, DNP, POINTS_KEY, SCORING_BASIS
from seasonframe.functions import round_cents, weighted_sum
from seasonframe.operators.skew import SALTS
from seasonframe.operators.availability import absence_segments, availability
from seasonframe.operators.weekly import flag_is_one, player_weeks


def season_totals(entries: DataFrame) -> DataFrame:
    """Totals of every season and player in ``entries`` (schema ``weekly_entries``).

    Once the weeks of a player are together everything is per row: counts, the points sum
    and the key-wise stats sum in week order, and the availability record. Stat keys whose
    value is NULL are not taken in.
    """
    weeks = player_weeks(entries).select(
        "season",
        "player_id",
        F.expr("array_sort(played, (a, b) -> a.week - b.week)").alias("played"),
        "weeklyStatus",
    )
    points = f"coalesce(w.stats['{POINTS_KEY}'], 0D)"
    total = F.expr(f"aggregate(played, 0D, (acc, w) -> acc + {points})")
    return weeks.withColumn("segments", absence_segments("weeklyStatus")).select(
        "season",
        "player_id",
        F.expr(
            """aggregate(played, CAST(map() AS MAP<STRING, DOUBLE>), (acc, w) ->
                 map_zip_with(acc, map_filter(w.stats, (k, v) -> v IS NOT NULL),
                              (k, a, b) -> coalesce(a, 0D) + coalesce(b, 0D)))"""
        ).alias("stats"),
        F.expr("size(played) AS gamesPlayed"),
        F.expr(f"size(filter(played, w -> {flag_is_one('w.stats', 'gs')})) AS gamesStarted"),
        F.expr(f"size(filter(weeklyStatus, s -> s = '{BYE}')) AS byeWeeks"),
        F.expr(f"size(filter(weeklyStatus, s -> s = '{DNP}')) AS dnpWeeks"),
        F.expr(
            f"CAST(map_from_entries(transform(played, w -> struct(w.week, {points}))) AS MAP<INT, DOUBLE>)"
        ).alias("weeklyPoints"),
        round_cents(total).alias("fantasyPoints"),
        F.lit(SCORING_BASIS).alias("scoringBasis"),
        "weeklyStatus",
        availability("weeklyStatus", "segments").alias("availability"),
    )


def stat_rows(totals: DataFrame) -> DataFrame:
    """Long form of the summed stats: ``season, player_id, stat_key, total``."""
    rows = totals.select("season", "player_id", F.explode_outer("stats").alias("stat_key", "total"))
    return rows.filter("stat_key IS NOT NULL")


def point_rows(totals: DataFrame) -> DataFrame:
    """Long form of the weekly points: ``season, player_id, week, points``."""
    rows = totals.select("season", "player_id", F.explode_outer("weeklyPoints").alias("week", "points"))
    return rows.filter("week IS NOT NULL")


def league_matrix(totals: DataFrame, weights: DataFrame, salts: int = SALTS) -> DataFrame:
    """``season, player_id, league_id, points``: every player under the weights of every league.

    A sparse product: stats and weights meet by ``stat_key``, so that only keys with a weight cost
    anything, and a player has a row for each league that weighs one of their stats. Keys are
    few and some are everybody's, so each is dealt over ``salts`` by player; the weights,
    which are many times fewer than the stats, are repeated for each. A player's products of a
    league are added up in the order of their keys. ``weights`` is ``league_id, stat_key, weight``.
    """
    stats = totals.select("season", "player_id", F.explode("stats").alias("stat_key", "total"))
    own = F.pmod(F.xxhash64("season", "player_id"), F.lit(salts)).cast("int")
    repeated = weights.select("league_id", "stat_key", "weight", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    met = stats.withColumn("salt", own).join(repeated, ["stat_key", "salt"])
    product = F.struct("stat_key", (F.col("total") * F.col("weight")).alias("points"))
    rows = met.groupBy("season", "player_id", "league_id").agg(F.array_sort(F.collect_list(product)).alias("products"))
    total = F.aggregate("products", F.lit(0.0), lambda acc, p: acc + p["points"])
    return rows.select("season", "player_id", "league_id", round_cents(total).alias("points"))


def league_points(totals: DataFrame, weights: Mapping[str, float] | Column) -> DataFrame:
    """Points under a league's own scoring weights (a small map, or a map column)."""
    return totals.withColumn("leaguePoints", round_cents(weighted_sum(F.col("stats"), weights)))
