"""Line dedup by a suffix array over line ids, built by distributed prefix doubling.

Lines that occur once end every repeated run, so only positions of repeated lines are
suffixes. Their ranks by the first line come from a sort of the distinct lines; ranks by
twice as many lines come from a sort of the distinct pairs of ranks a depth apart. At depth
``n`` the suffixes of equal rank are the intervals of the array whose longest common prefix
is ``n`` lines or more; doubling ends at the shortest run that counts by its lines. Where
runs count by their words as well, every depth up to there is looked at. Stretches covered by
later members of an interval are the maximal runs to delete.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seasonframe.llm.common import stored

MIN_LINES = 2

MIN_WORDS = 5
"""Words with which a shorter run counts in the pipeline: a licence line has five."""


def _ranked(keys: DataFrame, by: list[str]) -> DataFrame:
    """Keys that occur more than once with ranks in their order.

    The numbers grow along the sorted partitions; writing them fixes them.
    """
    repeated = keys.groupBy(*by).agg(F.count("*").alias("n")).filter("n > 1").select(*by)
    return stored(repeated.orderBy(*by).withColumn("new", F.monotonically_increasing_id()), "ranks")


def _weight(line: Column) -> Column:
    """Words with a letter or digit, or an eighth of these where writing has no blanks."""
    solid = F.regexp_replace(line, r"[^\p{L}\p{N}\p{M}\s]+", "")
    letters = F.length(F.regexp_replace(solid, r"\s+", ""))
    return F.greatest(F.regexp_count(solid, F.lit(r"\S+")), F.floor(letters / 8)).cast("long")


def suffixes(docs: DataFrame, depth: int, weighed: bool = False) -> Iterator[tuple[int, DataFrame]]:
    """Depths up to ``depth``, each with ``doc_id, pos, rank`` of all positions whose next lines
    to that depth occur elsewhere too.

    Depths double; ``weighed`` takes every depth, with ``head`` and ``weight``, the weights of
    the first line and of the run.
    """
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    kept = ["head", "weight"] if weighed else []
    weight = [_weight(F.col("line")).alias(x) for x in kept]
    lines = lines.select("doc_id", "pos", F.xxhash64("line").alias("a"), F.xxhash64(F.lit(7), "line").alias("b"), *weight)
    ranks = _ranked(lines, ["a", "b"])
    state = stored(lines.join(ranks, ["a", "b"]).select("doc_id", "pos", F.col("new").alias("rank"), *kept), "suffixes")
    reach = 1
    yield reach, state
    while reach < depth:
        step = 1 if weighed else min(reach, depth - reach)
        rest = [F.col("weight").alias("rest")] if weighed else []
        later = state.select("doc_id", (F.col("pos") - step).alias("pos"), F.col("rank").alias("next"), *rest)
        pairs = state.join(later, ["doc_id", "pos"])
        if weighed:
            pairs = pairs.withColumn("weight", F.col("head") + F.col("rest"))
        ranks = _ranked(pairs, ["rank", "next"])
        state = stored(pairs.join(ranks, ["rank", "next"]).select("doc_id", "pos", F.col("new").alias("rank"), *kept), "suffixes")
        reach += step
        yield reach, state


def _copied(state: DataFrame, reach: int) -> DataFrame:
    """``doc_id, pos`` of the lines in runs of ``reach`` lines that stand earlier too."""
    own = state.groupBy("rank", "doc_id").agg(F.min("pos").alias("own"))
    first = own.groupBy("rank").agg(F.min("doc_id").alias("first"))
    copies = state.join(own, ["rank", "doc_id"]).join(first, "rank").filter("doc_id > first OR pos > own")
    return copies.select("doc_id", F.explode(F.sequence("pos", F.col("pos") + (reach - 1))).alias("pos"))


def repeated_runs(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int | None = None) -> DataFrame:
    """``doc_id, start, stop``: maximal stretches of lines that later copies cover."""
    found = []
    for reach, state in suffixes(docs, min_lines, min_words is not None):
        if reach == min_lines:
            found.append(_copied(state, reach))
        elif min_words is not None:
            found.append(_copied(state.filter(F.col("weight") >= min_words), reach))
    covered = reduce(DataFrame.union, found).distinct()
    island = F.col("pos") - F.row_number().over(Window.partitionBy("doc_id").orderBy("pos"))
    runs = covered.withColumn("island", island).groupBy("doc_id", "island")
    return runs.agg(F.min("pos").alias("start"), (F.max("pos") + 1).alias("stop")).drop("island")


def line_dedup(
    docs: DataFrame, min_lines: int = MIN_LINES, carry: tuple[str, ...] = (), min_words: int | None = None
) -> DataFrame:
    """``doc_id, n_lines, n_removed, text`` and the columns of ``carry``.

    A line goes when it lies in a run of ``min_lines`` lines that stands earlier too: in a
    document of smaller doc_id, or before in the same one. With ``min_words`` a shorter run
    counts too, a single line as well, if it has so many words; blank and very short lines
    go only in runs. The rest are joined again; where
    all lines go the text is empty. A NULL text has no lines and stays NULL, an empty one
    has one empty line. Documents without doc_id stay as they are. A doc_id is expected once.
    """
    runs = repeated_runs(docs, min_lines, min_words).groupBy("doc_id")
    runs = runs.agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("runs"))
    # One byte a line, 1 where it goes, so that a line's fate is found by its number.
    marks = F.aggregate(
        "runs", F.lit(""),
        lambda done, r: F.concat(done, F.repeat(F.lit("0"), r["start"] - F.length(done)), F.repeat(F.lit("1"), r["stop"] - r["start"])),
    )
    gone = F.aggregate("runs", F.lit(0).cast("long"), lambda n, r: n + r["stop"] - r["start"])
    marked = runs.select("doc_id", marks.cast("binary").alias("marks"), gone.alias("gone"))
    found = docs.select("doc_id", "text", *carry).join(marked, "doc_id", "left")
    lines = F.split("text", "\n")
    kept = F.filter(lines, lambda x, i: F.substring(F.col("marks"), i + 1, F.lit(1)) != F.lit(b"1"))
    return found.select(
        "doc_id",
        F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce("gone", F.lit(0)).alias("n_removed"),
        F.when(F.col("marks").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"),
        *carry,
    )
