"""Weekly entries folded into one row per player and season."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seasonframe.constants import ABSENT, BYE, DNP, PLAYED, WEEKS
from seasonframe.operators.dedup import first_seen
from seasonframe.operators.skew import salted_lookup

ENTRY_KEY = ["season", "week", "player_id"]


def usable_entries(raw: DataFrame) -> DataFrame:
    """Rows with a player id and a stats map (which may be empty) in weeks 1 to 18."""
    return raw.filter(
        f"season IS NOT NULL AND week BETWEEN 1 AND {WEEKS} AND player_id != '' AND stats IS NOT NULL"
    )


def dropped_weeks(raw: DataFrame) -> DataFrame:
    """``season, week, n``: entries that ``usable_entries`` leaves out for their week."""
    outside = F.col("week").isNull() | ~F.col("week").between(1, WEEKS)
    return raw.filter(outside).groupBy("season", "week").agg(F.count(F.lit(1)).alias("n"))


def flag_is_one(stats: str, key: str) -> str:
    """Strictly one: 0, NULL, a missing key and any other number are all false."""
    return f"coalesce({stats}['{key}'] = 1, false)"


def unique_entries(entries: DataFrame) -> DataFrame:
    """First-seen entry per season, week and player, with the ``played`` flag.

    Rows leave for their player, where the fold then needs no further exchange.
    """
    kept = first_seen(usable_entries(entries), ENTRY_KEY, "ord").repartition("season", "player_id")
    return kept.withColumn("played", F.expr(flag_is_one("stats", "gp")))


def bye_rows(unique: DataFrame) -> DataFrame:
    """``season, week, player_id`` of idle entries whose team had nobody playing that week.

    Only narrow rows travel: idle entries on one side, the distinct (week, team) pairs
    with a player in action on the other. A missing or empty team is never on a bye.
    """
    on = ["season", "week", "team"]
    playing = unique.filter("team != '' AND played").select(*on).distinct()
    idle = unique.filter("team != '' AND NOT played").select(*on, "player_id")
    return salted_lookup(idle, playing, on, ["player_id"], "left_anti").drop("team")


def status_array(played: str, byes: str, listed: str) -> Column:
    """Array of 18 codes from the week sets of a player, given as bit masks or NULL."""
    return F.expr(
        f"""transform(sequence(1, {WEEKS}), w -> CASE
            WHEN shiftright({played}, w) & 1 = 1 THEN '{PLAYED}'
            WHEN shiftright({byes}, w) & 1 = 1 THEN '{BYE}'
            WHEN shiftright({listed}, w) & 1 = 1 THEN '{DNP}'
            ELSE '{ABSENT}' END)"""
    )


def player_weeks(entries: DataFrame) -> DataFrame:
    """``season, player_id, played, weeklyStatus``.

    ``played`` lists ``{week, stats}`` of the weeks in action, unordered; ``weeklyStatus``
    holds 18 codes. The stats maps cross the network twice: to their first-seen order, and
    deduplicated to their player. A group has at most 18 entries, and sets of weeks are bits of an INT that merge with
    ``bit_or``. The other readers take narrow columns only.
    """
    unique = unique_entries(entries)
    by_player = unique.groupBy("season", "player_id").agg(
        F.expr("collect_list(CASE WHEN played THEN struct(week, stats) END) AS played"),
        F.expr("bit_or(CASE WHEN played THEN shiftleft(1, week) END) AS in_action"),
        F.expr("bit_or(shiftleft(1, week)) AS listed"),
    )
    byes = bye_rows(unique).groupBy("season", "player_id").agg(F.expr("bit_or(shiftleft(1, week)) AS byes"))
    return by_player.join(byes, ["season", "player_id"], "left").select(
        "season", "player_id", "played", status_array("in_action", "byes", "listed").alias("weeklyStatus")
    )


def weekly_status(entries: DataFrame) -> DataFrame:
    """One row per player and listed week: ``season, player_id, week, status``.

    Row form: needs no fold to the player, only the bye lookup.
    """
    unique = unique_entries(entries)
    byes = bye_rows(unique).withColumn("bye", F.lit(True))
    return unique.join(byes, ENTRY_KEY, "left").selectExpr(
        "season", "player_id", "week",
        f"CASE WHEN played THEN '{PLAYED}' WHEN bye THEN '{BYE}' ELSE '{DNP}' END AS status",
    )
