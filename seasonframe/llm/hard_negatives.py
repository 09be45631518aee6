"""Hard negatives by slots: one pass over the scores serves all windows of an anchor.

An anchor's positives each open a window of scores, from a lower to an upper limit in
proportion to their own. Windows overlap, but their upper limits cut the scores into slots
that don't: a negative lies in the slot of the least limit it doesn't exceed. Tasks keep the
best ``k`` of each slot, and so does what merges them. The slots of an anchor, joined up in
descending order, are one list; the best ``k`` under a limit are the first ``k`` of its
suffix that begins with that limit's slot, and those above the lower limit are a prefix of
these.

Anchors meet all rows in blocks: rows are dealt into groups of bounded size, and a copy of
each anchor goes to each group, sorted behind its rows. A task holds the rows of one group
as a matrix and streams the anchors past it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seasonframe.llm.common import stored

GROUP_ROWS = 1 << 16
"""Rows that a task holds as one matrix, about."""

CHUNK_SCORES = 1 << 22
"""Scores of one group that are held at once."""

_EXACT = float(1 << 53)


def scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exact. Raises where one might not fit 64 bits."""
    if not anchors.size or not rows.size:
        return np.zeros((len(anchors), len(rows)), np.int64)
    bound = float(np.abs(anchors).max()) * float(np.abs(rows).max()) * anchors.shape[1]
    if bound < _EXACT:
        return np.rint(anchors.astype(np.float64) @ rows.astype(np.float64).T).astype(np.int64)
    exact = anchors.astype(object) @ rows.astype(object).T
    if max(abs(exact.max()), abs(exact.min())) >= 1 << 63:
        raise ValueError("an inner product does not fit 64 bits")
    return exact.astype(np.int64)


def best(score: np.ndarray, among: np.ndarray, k: int) -> np.ndarray:
    """The first ``k`` of the given positions by score; of equal scores, the earlier positions."""
    if len(among) > k:
        own = score[among]
        bar = np.partition(own, len(own) - k)[len(own) - k]
        above = np.flatnonzero(own > bar)
        among = among[np.sort(np.r_[above, np.flatnonzero(own == bar)[: k - len(above)]])]
    return among[np.argsort(-score[among], kind="stable")]


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows of a matrix, with zeros behind shorter ones."""
    flat, offset = column.flatten().to_numpy(zero_copy_only=False), np.asarray(column.offsets) - column.offsets[0].as_py()
    sizes = np.diff(offset)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(offset[:-1], sizes)] = flat
    return out


class _Group:
    """The rows of one group, in order of their ids, and the anchors that pass them."""

    def __init__(self) -> None:
        self.parts: list[pa.RecordBatch] = []

    def add(self, batch: pa.RecordBatch) -> None:
        self.parts.append(batch)

    def close(self) -> None:
        whole = pa.Table.from_batches(self.parts)
        self.ids = whole.column("vec_id").to_numpy()
        self.labels = whole.column("label").to_numpy()
        self.vectors = whole.column("vector").combine_chunks()
        self.width, self.rows = -1, np.empty((0, 0), np.int64)

    def against(self, anchors: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
        """Each anchor's place in the batch with the scores of all rows."""
        column = anchors.column("vector")
        lengths = np.r_[np.asarray(column.value_lengths()), np.asarray(self.vectors.value_lengths())]
        if lengths.max() != self.width:
            self.width = int(lengths.max())
            self.rows = _matrix(self.vectors, self.width)
        step = max(1, CHUNK_SCORES // max(1, len(self.ids)))
        for first in range(0, len(column), step):
            found = scores(_matrix(column.slice(first, step), self.width), self.rows)
            for k, row in enumerate(found):
                yield first + k, row


Select = Callable[["_Group", pa.RecordBatch], Iterator[tuple]]


def _in_groups(select: Select, names: tuple[str, ...]):
    """Per group, rows first and anchors behind them; only one group's rows are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, group, open_ = None, _Group(), True
        for batch in batches:
            key, kind = batch.column("part").to_numpy(), batch.column("anchor").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((key[1:] != key[:-1]) | (kind[1:] != kind[:-1])) + 1
            for a, b in zip([0, *cuts], [*cuts, len(key)], strict=True):
                if a == b:
                    continue
                piece = batch.slice(a, b - a)
                if key[a] != own:
                    own, group, open_ = key[a], _Group(), True
                if not kind[a]:
                    group.add(piece)
                    continue
                if not group.parts:
                    continue
                if open_:
                    group.close()
                    open_ = False
                found = list(select(group, piece))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([f[i] for f in found]) if found else [], pa.int64()) for i in range(len(names))], list(names)
                )

    return run


def _positives(k: int) -> Select:
    def select(group: _Group, anchors: pa.RecordBatch) -> Iterator[tuple]:
        ids, labels = anchors.column("vec_id").to_numpy(), anchors.column("label").to_numpy()
        for i, score in group.against(anchors):
            found = best(score, np.flatnonzero((group.labels == labels[i]) & (group.ids != ids[i])), k)
            yield np.full(len(found), ids[i]), group.ids[found], score[found]

    return select


def _slots(k: int) -> Select:
    """The best of each slot; slots are numbered from the one of the highest limit."""

    def select(group: _Group, anchors: pa.RecordBatch) -> Iterator[tuple]:
        ids, labels = anchors.column("vec_id").to_numpy(), anchors.column("label").to_numpy()
        limits, floors = anchors.column("limits"), anchors.column("floor").to_numpy()
        for i, score in group.against(anchors):
            tops = limits[i].values.to_numpy()  # descending
            among = np.flatnonzero((group.labels != labels[i]) & (score >= floors[i]) & (score <= tops[0]))
            slot = np.searchsorted(-tops, -score[among], "right") - 1
            for s in np.unique(slot):
                found = best(score, among[slot == s], k)
                yield np.full(len(found), ids[i]), np.full(len(found), s), group.ids[found], score[found]

    return select


def _first(df: DataFrame, by: list[str], k: int) -> DataFrame:
    """The best ``k`` rows of each key; Spark applies the limit before and after the shuffle."""
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), "other")
    return df.withColumn("_nth", F.row_number().over(order)).filter(F.col("_nth") <= k).drop("_nth")


def hard_negatives(
    vectors: DataFrame,
    anchors: Column,
    k: int = 10,
    positives: int = 5,
    low: tuple[int, int] = (3, 10),
    high: tuple[int, int] = (9, 10),
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``vectors`` has ``vec_id, label, vector``, the vectors of whole numbers; ``anchors`` says
    which rows are anchors. Scores are inner products, where zeros follow a shorter vector;
    one that does not fit 64 bits raises. Higher scores come first, ties by smaller vec_id.
    An anchor's positives are its first ``positives`` other rows of its label, its negatives
    for one of these the first ``k`` rows of other labels whose score is from ``low`` to
    ``high`` times (as fractions) the positive's. A positive of negative score has none, since
    its limits exclude each other.

    Rows with NULL in any of the three columns, or in a vector, take no part. Of rows that
    repeat a vec_id the one of least label, then least vector, stands for all. An anchor
    without positives, or a positive without negatives, has no rows. Columns beyond these
    are not read.
    """
    spark = vectors.sparkSession
    sound = vectors.select("vec_id", "label", "vector", anchors.alias("anchor"))
    sound = sound.filter("vec_id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL AND NOT exists(vector, x -> x IS NULL)")
    sound = sound.groupBy("vec_id").agg(F.min(F.struct("label", "vector", "anchor")).alias("r")).select("vec_id", "r.*")
    rows = stored(sound.select("vec_id", F.col("label").cast("long").alias("label"), F.col("vector").cast("array<long>").alias("vector"), "anchor"), "vectors")
    groups = max(-(-rows.count() // group_rows), spark.sparkContext.defaultParallelism)
    asked = rows.filter("anchor").drop("anchor")

    def passed(queries: DataFrame, select: Select, names: tuple[str, ...]) -> DataFrame:
        """The anchors past all rows, group by group."""
        dealt = rows.select("vec_id", "label", "vector").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int"))
        dealt = dealt.withColumn("anchor", F.lit(False))
        copies = queries.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).withColumn("anchor", F.lit(True))
        both = dealt.unionByName(copies, allowMissingColumns=True)
        both = both.repartitionById(groups, "part").sortWithinPartitions("part", "anchor", "vec_id")
        return both.mapInArrow(_in_groups(select, names), ", ".join(f"{n} long" for n in names))

    near = passed(asked, _positives(positives), ("anchor_id", "other", "score"))
    near = stored(_first(near, ["anchor_id"], positives), "positives")
    hi, lo = _floor("score", *high), -_floor("-score", *low)
    windows = near.select("anchor_id", F.col("other").alias("positive_id"), F.col("score").alias("positive_score"), hi.alias("hi"), lo.alias("lo"))
    windows = windows.filter("lo <= hi")

    limits = windows.groupBy("anchor_id").agg(F.sort_array(F.collect_set("hi"), asc=False).alias("limits"), F.min("lo").alias("floor"))
    queries = asked.join(limits.withColumnRenamed("anchor_id", "vec_id"), "vec_id")
    slots = passed(queries, _slots(k), ("anchor_id", "slot", "other", "score"))
    slots = _first(slots, ["anchor_id", "slot"], k)

    # An anchor has at most one slot a positive, so its list is short: slots in descending
    # order, in each of them the best first. Suffixes of the list answer the windows.
    entry = F.struct("slot", (-F.col("score")).alias("minus"), "other")
    ranked = slots.groupBy("anchor_id").agg(F.sort_array(F.collect_list(entry)).alias("list"))
    places = windows.join(limits.select("anchor_id", "limits"), "anchor_id").join(ranked, "anchor_id")
    suffix = F.filter("list", lambda e: e["slot"] >= F.array_position("limits", F.col("hi")) - 1)
    chosen = F.filter(F.slice(suffix, 1, k), lambda e: -e["minus"] >= F.col("lo"))
    out = places.select("anchor_id", "positive_id", "positive_score", F.posexplode(chosen).alias("nth", "e"))
    return out.select(
        "anchor_id", "positive_id", (F.col("nth") + 1).cast("int").alias("rank"),
        F.col("e.other").alias("negative_id"), "positive_score", (-F.col("e.minus")).alias("negative_score"),
    )


def _floor(score: str, num: int, den: int) -> Column:
    """``floor(score * num / den)`` in whole numbers, without an overflow in between."""
    whole = f"CAST(({score}) - pmod({score}, {den}L) AS BIGINT) div {den}"
    return F.expr(f"{whole} * {num} + pmod({score}, {den}L) * {num} div {den}")
