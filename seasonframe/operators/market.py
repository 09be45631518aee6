"""Dated market values: fingerprints, change guard, trend and name matching."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seasonframe.constants import MARKET_MAX_AGE_DAYS, MARKET_MAX_CHANGED
from seasonframe.functions import canonical_json, multiset_fingerprint, normalized_name
from seasonframe.operators.dedup import first_seen
from seasonframe.operators.ranks import dense_ranks
from seasonframe.operators.skew import salted_lookup

FIELDS = ("name", "team", "value", "position")

TREE_LEVELS = 3
"""Levels of a content digest's tree above its leaves: with leaves of 10,000 rows, enough for 10 to the 16."""


def latest_snapshot(market: DataFrame) -> DataFrame:
    """Rows of the newest snapshot; the date is a scalar subquery, so stored dates are pruned."""
    newest = market.agg(F.max("snapshot_date")).scalar()
    return market.filter(F.col("snapshot_date") == newest)


def snapshot_calendar(market: DataFrame) -> DataFrame:
    """``snapshot_date, previous_date``.

    The unpartitioned window sees one row per calendar date, never the market rows.
    """
    order = Window.orderBy("snapshot_date")
    return market.select("snapshot_date").distinct().withColumn(
        "previous_date", F.lag("snapshot_date").over(order)
    )


def fingerprints(market: DataFrame) -> DataFrame:
    """``snapshot_date, n, hash_lo, hash_hi``; independent of row order."""
    row = canonical_json({name: F.col(name) for name in FIELDS})
    return market.groupBy("snapshot_date").agg(*multiset_fingerprint(row))


def content_digests(market: DataFrame, leaf: int = 10_000) -> DataFrame:
    """``snapshot_date, n, digest``: SHA-256 of each snapshot's rows in the order of their names.

    A snapshot of up to ``leaf`` rows has the digest of the JSON array of its rows, sorted by name
    and then by their text. A larger one is a tree: its rows are cut into leaves of so many, a
    leaf has the digest of its array, and each level above takes up to ``leaf`` digests together
    until one is left. The tree depends on the rows alone, not on how they are dealt out, and
    no task takes more than ``leaf`` of anything.
    """
    row = canonical_json({name: F.col(name) for name in FIELDS})
    rows = market.select("snapshot_date", F.coalesce("name", F.lit("")).alias("name"), row.alias("text"))
    ranked = dense_ranks(rows, ["snapshot_date"], ["name", "text"])
    place, size = F.expr(f"rank div {leaf}").alias("place"), F.count(F.lit(1)).alias("size")
    found = ranked.groupBy("snapshot_date", place).agg(F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("r"), size)
    array = F.concat(F.lit("["), F.array_join(F.transform("r", lambda r: r["text"]), ","), F.lit("]"))
    nodes = found.select("snapshot_date", "place", "size", F.sha2(array, 256).alias("digest"))
    for _ in range(TREE_LEVELS):
        above = nodes.groupBy("snapshot_date", F.expr(f"place div {leaf}").alias("place"))
        above = above.agg(F.array_sort(F.collect_list(F.struct("place", "digest"))).alias("r"), F.sum("size").alias("size"))
        joined = F.array_join(F.transform("r", lambda r: r["digest"]), "")
        only = (F.size("r") == 1) & (F.col("place") == 0)  # all that the snapshot has
        nodes = above.select("snapshot_date", "place", "size", F.when(only, F.get("r", F.lit(0))["digest"]).otherwise(F.sha2(joined, 256)).alias("digest"))
    return nodes.select("snapshot_date", F.col("size").alias("n"), "digest")


def snapshot_changes(market: DataFrame) -> DataFrame:
    """``snapshot_date, changed``: does a snapshot differ from the one before it."""
    order = Window.orderBy("snapshot_date")
    prints = fingerprints(market)
    differs = F.lit(False)
    for name in ("n", "hash_lo", "hash_hi"):
        differs = differs | ~F.col(name).eqNullSafe(F.lag(name).over(order))
    return prints.select("snapshot_date", differs.alias("changed"))


def _cells(rows: DataFrame, by: str, value: str) -> DataFrame:
    """Rows and least order of each name and value: all that the ratio needs, in one hash aggregate."""
    return rows.groupBy(by, "name", F.col(value).alias("cell_value")).agg(
        F.min("ord").alias("ord"), F.count(F.lit(1)).alias("rows")
    )


def _ratio(old: DataFrame, new: DataFrame, by: str) -> DataFrame:
    first = old.groupBy(by, "name").agg(F.min("ord").alias("ord"))
    first = old.join(first, [by, "name", "ord"], "left_semi").select(
        F.col(by).alias("_by"), F.col("name").alias("_name"), F.col("cell_value").alias("_value"), F.lit(True).alias("same")
    )
    equal = (
        (F.col(by) == F.col("_by"))
        & (F.col("name") == F.col("_name"))
        & F.col("cell_value").eqNullSafe(F.col("_value"))
    )
    changed = (
        new.join(first, equal, "left")
        .groupBy(by)
        .agg(F.sum(F.when(F.col("same"), 0).otherwise(F.col("rows"))).alias("changed_n"))
    )
    sizes = old.groupBy(by).agg(F.sum("rows").alias("prev_n"))
    return changed.join(sizes, by).select(
        by, "changed_n", "prev_n", F.try_divide("changed_n", "prev_n").alias("ratio")
    )


def change_ratio(
    baseline: DataFrame, updated: DataFrame, by: str = "snapshot_date", value: str = "value"
) -> DataFrame:
    """``by, changed_n, prev_n, ratio``: updated rows without an equal old row, per old row.

    Names are matched to the first old row of that name, whatever its team. Both sides are
    first reduced to distinct names and values, and the value or the order is part of each
    join key: a name that fills a third of the snapshot, with however many values, stays spread.
    """
    return _ratio(_cells(baseline, by, value), _cells(updated, by, value), by)


def change_history(market: DataFrame, value: str = "value") -> DataFrame:
    """``change_ratio`` of every snapshot against the one before it, from one aggregate."""
    cells = _cells(market, "snapshot_date", value)
    following = snapshot_calendar(cells).select(
        F.col("previous_date").alias("snapshot_date"), F.col("snapshot_date").alias("next_date")
    ).filter("snapshot_date IS NOT NULL")
    old = cells.join(following, "snapshot_date").drop("snapshot_date").withColumnRenamed("next_date", "snapshot_date")
    return _ratio(old, cells, "snapshot_date")


def guard_ratio(
    ratios: DataFrame, max_ratio: float = MARKET_MAX_CHANGED, by: str = "snapshot_date"
) -> DataFrame:
    """Adds ``passed``: at most ``max_ratio`` of the previous rows may have changed."""
    return ratios.withColumn("passed", ~(F.col("ratio") > max_ratio))


def guard_applies(age_days, has_baseline, has_run_before, max_age: float = MARKET_MAX_AGE_DAYS):
    """The guard needs a baseline at most eight days old and an earlier run.

    An unknown age counts as too old.
    """
    return has_baseline & has_run_before & F.coalesce(age_days <= max_age, F.lit(False))


def value_trend(market: DataFrame, value: str = "value") -> DataFrame:
    """``name, snapshot_date, value, previous, delta`` along the snapshots of a name.

    First-seen per (name, date) runs before the window, so a window group has at most
    one row per calendar date.
    """
    single = first_seen(
        market.select("name", "snapshot_date", "ord", F.col(value).alias("value")),
        ["name", "snapshot_date"],
        "ord",
    )
    order = Window.partitionBy("name").orderBy("snapshot_date")
    return single.withColumn("previous", F.lag("value").over(order)).select(
        "name", "snapshot_date", "value", "previous", (F.col("value") - F.col("previous")).alias("delta")
    )


def match_names(market: DataFrame, players: DataFrame) -> DataFrame:
    """``market`` rows with the ``player_id`` of the one player of that name and position.

    Several players under the same normalised name and position make it ambiguous: NULL.
    The player side is aggregated to one row per key, so rows never multiply, and the
    join is salted because a name recurs in every snapshot.
    """
    by_name = (
        players.select(normalized_name(F.col("name")).alias("match_name"), "position", "player_id")
        .groupBy("match_name", "position")
        .agg(F.min("player_id").alias("player_id"), F.max("player_id").alias("_other"))
        .select(
            "match_name",
            "position",
            F.when(F.col("player_id") == F.col("_other"), F.col("player_id")).alias("player_id"),
        )
    )
    keyed = market.withColumn("match_name", normalized_name(F.col("name")))
    spread = [c for c in market.columns if c not in ("name", "position")]
    return salted_lookup(keyed, by_name, ["match_name", "position"], spread or ["name"]).drop(
        "match_name"
    )
