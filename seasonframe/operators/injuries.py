"""Injury entries against the absence segments of the season totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seasonframe.operators.availability import segment_rows
from seasonframe.operators.skew import salted_lookup


def injury_outcomes(injuries: DataFrame, totals: DataFrame) -> DataFrame:
    """Injuries with ``outcome`` match, no_segment or no_season and the player's ``starts``.

    Totals are unique per season and player with at most nine segments, so they travel
    as one narrow row with an array of starts: one join decides all three outcomes. Only
    players with an entry are looked up. The look-up is salted, since a single player may
    collect any number of entries.
    """
    asked = injuries.select("year", "playerId").distinct()
    lookup = totals.select(
        F.col("season").alias("year"),
        F.col("player_id").alias("playerId"),
        F.transform("availability.absenceSegments", lambda s: s["start"]).alias("starts"),
    ).join(asked, ["year", "playerId"], "left_semi")
    joined = salted_lookup(injuries, lookup, ["year", "playerId"], ["id"])
    hit = F.array_contains("starts", F.col("segmentStartWeek"))
    outcome = (
        F.when(F.col("starts").isNull(), "no_season")
        .when(F.coalesce(hit, F.lit(False)), "match")
        .otherwise("no_segment")
    )
    return joined.withColumn("outcome", outcome)


def injury_weeks(injuries: DataFrame, totals: DataFrame) -> DataFrame:
    """D weeks inside segments with every injury noted for them.

    ``season, player_id, week, start, end`` plus an injury's ``id, type, bodyPart,
    severity``: a row for each injury that covers the week, and one of NULLs for a week that
    none covers. An injury without an end week covers its segment. Segments meet injuries
    by week, so a segment of many injuries is spread by their weeks and joins as any key.
    """
    on = ["season", "player_id", "start"]
    segments = segment_rows(totals).select(*on, "end")
    noted = injuries.select(
        F.col("year").alias("season"), F.col("playerId").alias("player_id"), F.col("segmentStartWeek").alias("start"),
        "id", "type", "bodyPart", "severity", "segmentEndWeek",
    )
    last = F.least(F.coalesce("segmentEndWeek", "end"), F.col("end"))
    covered = noted.join(segments, on).filter(last >= F.col("start"))
    covered = covered.withColumn("week", F.explode(F.sequence("start", last)))
    weeks = segments.withColumn("week", F.explode(F.sequence("start", "end")))
    fields = ["id", "type", "bodyPart", "severity"]
    return weeks.join(covered.select(*on, "week", *fields), [*on, "week"], "left").select(
        "season", "player_id", "week", "start", "end", *fields
    )
