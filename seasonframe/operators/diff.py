"""Version comparison of season totals and of row-counted partitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seasonframe.constants import POINTS_TOLERANCE
from seasonframe.functions import document_key, player_key


def _record_text(df: DataFrame, skip: Sequence[str]) -> Column:
    """Comparable text of a record; map entries are sorted because map order carries no meaning."""
    parts = []
    for field in df.schema.fields:
        if field.name in skip:
            continue
        col = F.col(field.name)
        if field.dataType.typeName() == "map":
            col = F.array_sort(F.map_entries(col))
        parts.append(col.alias(field.name))
    return F.to_json(F.struct(*parts)) if parts else F.lit(None).cast("string")


def season_diff(
    old: DataFrame,
    new: DataFrame,
    *,
    tolerance: float = POINTS_TOLERANCE,
    compare: str = "points",
) -> DataFrame:
    """One row per season and player: ``status`` added, removed, changed or unchanged.

    Only points count as a change, and only beyond the tolerance. ``compare='all'``
    also reports records that differ in any other field. Where ``old`` has a ``player_key``, as
    tables stored in its buckets do, rows meet by it alone and only ``new`` is shuffled.
    """
    keys = ["season", "player_id"]
    stored_key = "player_key" in old.columns

    def side(df: DataFrame, name: str) -> DataFrame:
        if stored_key:
            key = F.col("player_key") if name == "old" else player_key("season", "player_id")
            df = df.select(key.alias("player_key"), *[F.col(c) for c in df.columns if c != "player_key"])
        cols = [*(["player_key"] if stored_key else []), *keys, F.coalesce("fantasyPoints", F.lit(0.0)).alias(f"{name}_points")]
        if compare == "all":
            cols.append(_record_text(df, [*keys, "ord", "player_key"]).alias(f"{name}_text"))
        if name == "old":
            position = F.col("ord") if "ord" in df.columns else None
            cols.append(document_key(F.col("player_id"), position).alias("sort_key"))
        return df.select(*cols, F.lit(True).alias(f"in_{name}"))

    if stored_key:
        o, n = side(old, "old").alias("o"), side(new, "new").alias("n")
        both = o.join(n, F.col("o.player_key") == F.col("n.player_key"), "full")
        both = both.select(
            *[F.coalesce(F.col(f"o.{k}"), F.col(f"n.{k}")).alias(k) for k in keys],
            *[f"{s}.{c}" for s, df in (("o", o), ("n", n)) for c in df.columns if c not in (*keys, "player_key")],
        )
    else:
        both = side(old, "old").join(side(new, "new"), keys, "full")
    delta = F.abs(F.col("new_points") - F.col("old_points"))
    differs = delta > tolerance
    if compare == "all":
        differs = differs | ~F.col("old_text").eqNullSafe(F.col("new_text"))
    status = (
        F.when(F.col("in_old").isNull(), "added")
        .when(F.col("in_new").isNull(), "removed")
        .when(differs, "changed")
        .otherwise("unchanged")
    )
    return both.select(
        *keys, status.alias("status"), "old_points", "new_points", delta.alias("delta"), "sort_key"
    )


def diff_counts(diff: DataFrame) -> DataFrame:
    """Counts per season and whether the versions are identical."""

    def n(status: str) -> Column:
        return F.count_if(F.col("status") == status)

    return diff.groupBy("season").agg(
        n("added").alias("added"),
        n("removed").alias("removed"),
        n("changed").alias("changed"),
        n("unchanged").alias("unchanged"),
        (n("unchanged") == F.count(F.lit(1))).alias("identical"),
    )


def diff_top(diff: DataFrame, n: int = 5) -> DataFrame:
    """The n largest changes per season, ties in document order.

    The rank filter is pushed below the shuffle as a group limit, so each task sends
    at most n rows per season.
    """
    order = Window.partitionBy("season").orderBy(F.desc("delta"), "sort_key")
    ranked = diff.filter("status = 'changed'").withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= n).drop("status", "sort_key")


def diff_summary(diff: DataFrame, n: int = 5) -> DataFrame:
    """``season, identical, text``: counts and the top changes, ready to print."""
    line = F.format_string(
        "  player %s: %.2f → %.2f (Δ%.2f)", "player_id", "old_points", "new_points", "delta"
    )
    top = (
        diff_top(diff, n)
        .groupBy("season")
        .agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("top"))
        .select("season", F.array_join(F.transform("top", lambda t: t["line"]), "\n").alias("top"))
    )

    def part(name: str) -> Column:
        return F.when(F.col(name) > 0, F.concat(F.col(name).cast("string"), F.lit(f" {name}")))

    head = F.concat_ws(", ", part("added"), part("removed"), part("changed"))
    text = F.when(F.col("identical"), "no change").otherwise(
        F.concat(head, F.coalesce(F.concat(F.lit("\nTop diffs:\n"), "top"), F.lit("")))
    )
    return diff_counts(diff).join(top, "season", "left").select("season", "identical", text.alias("text"))


def partition_counts(df: DataFrame, by: Sequence[str], name: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias(name))


def count_plan_input(old: DataFrame, new: DataFrame, by: Sequence[str]) -> DataFrame:
    """``by, old_n, new_n, identical``: partitions compared by their row count alone."""
    both = partition_counts(new, by, "new_n").join(partition_counts(old, by, "old_n"), [*by], "left")
    return both.select(
        *by, "old_n", "new_n", F.coalesce(F.col("old_n") == F.col("new_n"), F.lit(False)).alias("identical")
    )


def publish_action(
    has_old: Column, identical: Column, in_progress: Column, force: bool = False, recorded: Column | None = None
) -> Column:
    """What to do with a partition.

    ``in_progress`` is the flag of its manifest entry, NULL without one; a partition
    that has no entry is never refused. ``recorded`` says whether the manifest tells what is
    stored: where it doesn't, as after a run that died between its write and its index, an
    identical partition is indexed instead of skipped.
    """
    complete = F.coalesce(~in_progress, F.lit(False))
    return (
        F.when(~has_old, "write")
        .when(identical & ~(F.lit(True) if recorded is None else recorded), "index")
        .when(identical, "skip")
        .when(complete & F.lit(not force), "refuse")
        .otherwise("write")
    )
