"""Exact join of documents on the Jaccard similarity of their n-gram sets, by PartEnum signatures.

Sets are dealt into bands of size that overlap at their lower ends as far as a link can
reach, so that linked sets share a band. Two linked sets of a band differ in a bounded number
of elements. The band's signatures split the domain of elements into parts, each part into
cells; some part must hold so few of the differences that, with as many cells left out, the
rest of it is the same in both sets. The hash of every such selection of cells is a signature,
and linked sets have one in common, always.

Equal sets are one class; only its first member goes on. Members of a bucket (sets with a
common signature) are compared with its first member: those at least half alike form
families, those alike enough are linked to it. What a family's first member leaves unlinked
is compared with all of the family, in groups of bounded size, by products of incidence
matrices; nothing else of a family has to be. Members of one bucket in different families are
compared pair by pair. Nothing depends on estimates.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seasonframe.llm.common import LOWER, MapArrow, Words, chunks, mix, stored
from seasonframe.llm.near_dedup import components, shingle_sets
from seasonframe.operators.skew import salted_lookup

RATIO = 1.5
"""Greatest size of a band by its least one."""

SEEDS = 2
"""Ways to split the domain; a later one serves sets that a former one leaves a selection empty."""

GROUP_DOCS, GROUP_SHINGLES = 512, 1_000_000
"""What half a group of a family holds at most, in documents and about in shingles."""

RUN_DOCS = 256
"""Members of a bucket's first document that are compared in one run of rows, about."""


@dataclass(frozen=True)
class Band:
    """Sizes ``low`` to ``high``, and how their domain is split."""

    number: int
    join: int
    low: int
    high: int
    parts: int
    cells: int
    left_out: int

    @property
    def selections(self) -> list[tuple[int, ...]]:
        return list(itertools.combinations(range(self.cells), self.cells - self.left_out))


def band(number: int, low: int, high: int, num: int, den: int) -> Band:
    """A band in which linked sets differ in at most ``2 * high * (den - num) / (den + num)`` elements.

    Few differences are left out all at once from a single part. More are shared out, so
    that some part has one at most.
    """
    differ = 2 * high * (den - num) // (den + num)
    join = -(-low * num // den)
    if differ <= 3:
        return Band(number, join, low, high, 1, differ + 3, differ)
    return Band(number, join, low, high, -(-(differ + 1) // 2), 3, 1)


def bands(longest: int, num: int, den: int) -> list[Band]:
    """Bands for sets of up to so many elements. Sets too small to differ and be linked have none."""
    out, low = [], -(-den // (den - num)) if num < den else longest + 1
    while low <= longest:
        high = max(low, int(low * RATIO))
        out.append(band(len(out), low, high, num, den))
        low = high + 1
    return out


def _cell_sums(sets: np.ndarray, sizes: np.ndarray, b: Band, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """For each set, part and cell: the sum of its elements' hashes, and how many there are."""
    spread = mix(sets ^ mix(np.full(1, (seed + 1) * 0x9E3779B9, np.uint64)))
    cell = (spread >> np.uint64(32)) * np.uint64(b.parts * b.cells) >> np.uint64(32)
    per = b.parts * b.cells
    place = np.repeat(np.arange(len(sizes)) * per, sizes) + cell.astype(np.int64)
    order = np.argsort(place, kind="stable")
    count = np.bincount(place, minlength=len(sizes) * per)
    total = np.r_[np.uint64(0), np.cumsum(mix(sets[order]))]
    end = np.cumsum(count)
    return (total[end] - total[end - count]).reshape(-1, b.parts, b.cells), count.reshape(-1, b.parts, b.cells)


def signatures(sets: np.ndarray, offset: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """All signatures with the number of the set each belongs to."""
    sizes = np.diff(offset)
    owner, found = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
    for b in bands(int(sizes.max(initial=0) * den // num) + 1, num, den):
        left = np.flatnonzero((sizes >= b.join) & (sizes <= b.high))
        for seed in range(SEEDS):
            if not len(left):
                break
            own = np.concatenate([sets[offset[i] : offset[i + 1]] for i in left])
            sums, count = _cell_sums(own, sizes[left], b, seed)
            again = np.zeros(len(left), bool)
            for k, pick in enumerate(b.selections):
                pick = list(pick)
                tag = mix(np.arange(b.parts, dtype=np.uint64) + np.uint64((b.number * SEEDS + seed + 1) << 40 | k << 32))
                keys = mix(sums[:, :, pick].sum(axis=2, dtype=np.uint64) ^ tag)
                full = count[:, :, pick].sum(axis=2) > 0
                if seed == SEEDS - 1:
                    full[:] = True
                again |= ~full.all(axis=1)
                owner.append(np.repeat(left, full.sum(axis=1)))
                found.append(keys[full])
            left = left[again]
    return np.concatenate(owner), np.concatenate(found)


def _sign(size: int, num: int, den: int) -> MapArrow:
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches):
            sets, offset = shingle_sets(Words(texts, LOWER), size)
            owner, keys = signatures(sets, offset, num, den)
            order = np.argsort(owner, kind="stable")
            many = np.bincount(owner, minlength=len(texts))
            sums = [np.r_[np.uint64(0), np.cumsum(mix(sets ^ np.uint64(s)))][offset] for s in (0x2545F491, 0x4F6CDD1D)]
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id"),
                    "n_shingles": pa.array(np.diff(offset), pa.int64()),
                    "f1": pa.array(np.diff(sums[0]).view(np.int64)),
                    "f2": pa.array(np.diff(sums[1]).view(np.int64)),
                    "keys": pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(many)], pa.int32()), pa.array(keys[order].view(np.int64))),
                }
            )

    return sign


def _sets(size: int) -> MapArrow:
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches):
            found, offset = shingle_sets(Words(texts, LOWER), size)
            ends = pa.array(offset * 8, pa.int64())
            packed = pa.Array.from_buffers(pa.large_binary(), len(texts), [None, ends.buffers()[1], pa.py_buffer(found.tobytes())])
            yield pa.RecordBatch.from_pydict(
                {"doc_id": batch.column("doc_id"), "n": pa.array(np.diff(offset), pa.int64()), "shingles": packed.cast(pa.binary())}
            )

    return sets


def _array(value: pa.Scalar) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), np.uint64)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come run by run, a run's first document before the others: sizes of intersections with it."""
    run, heads = None, []
    for batch in batches:
        a, b, both, either = [], [], [], []
        columns = (batch.column(c).to_pylist() for c in ("a", "salt", "b"))
        for own, salt, other, value in zip(*columns, batch.column("shingles"), strict=True):
            x = _array(value)
            if (own, salt) != run:
                run, heads = (own, salt), []
            if other is None:
                heads.append(x.copy())
                continue
            for head in heads:
                at = np.searchsorted(head, x)
                common = int((head[np.minimum(at, len(head) - 1)] == x).sum()) if len(head) else 0
                a.append(own)
                b.append(other)
                both.append(common)
                either.append(len(head) + len(x) - common)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, b, both, either)], ["a", "b", "both", "either"])


def compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``a, b, both, either`` of pairs ``a, b``: a document's set is sent once for each of its
    runs of partners, and partners stream past it."""
    heads = pairs.groupBy("a").agg(F.ceil(F.count("*") / RUN_DOCS).cast("int").alias("runs"))
    pairs = salted_lookup(pairs, heads, ["a"], ["b"], "inner")
    pairs = pairs.select("a", "b", F.pmod(F.xxhash64("b"), F.col("runs")).cast("int").alias("salt"))
    others = pairs.join(sets.select(F.col("doc_id").alias("b"), "shingles"), "b").select("a", "salt", "b", "shingles")
    first = heads.join(sets.select(F.col("doc_id").alias("a"), "shingles"), "a")
    salts = F.explode(F.sequence(F.lit(0), F.col("runs") - 1))
    first = first.select("a", salts.alias("salt"), F.lit(None).cast("long").alias("b"), "shingles")
    rows = first.unionByName(others).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    return rows.mapInArrow(_compare, "a long, b long, both long, either long")


def _links(num: int, den: int):
    """Links of a group, each to the least document of its component within the group."""

    def links(group: pa.Table) -> pa.Table:
        group = group.sort_by("doc_id")
        ids = group.column("doc_id").to_numpy()
        sets = [_array(v) for c in group.column("shingles").chunks for v in c]
        sizes = np.array([len(x) for x in sets])
        doc = np.repeat(np.arange(len(sets)), sizes)
        _, element, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        common = seen[element] > 1
        doc, element = doc[common], (np.cumsum(seen > 1) - 1)[element[common]]
        by = np.argsort(element, kind="stable")
        doc, element = doc[by], element[by]
        both = np.zeros((len(sets), len(sets)), np.float32)
        for first in range(0, int(element[-1]) + 1 if len(element) else 0, 1024):
            a, b = np.searchsorted(element, [first, first + 1024])
            part = np.zeros((len(sets), 1024), np.float32)
            part[doc[a:b], element[a:b] - first] = 1
            both += part @ part.T
        alike = den * both.astype(np.float64) >= num * (sizes[:, None] + sizes[None, :] - both.astype(np.float64))
        label = np.arange(len(sets))
        while True:
            least = np.minimum(np.where(alike, label[None, :], len(sets)).min(axis=1), label)
            least = np.minimum(least, least[least])
            if (least == label).all():
                break
            label = least
        tied = ids[label] != ids
        return pa.table({"a": ids[label[tied]], "b": ids[tied]})

    return links


def _within(star: DataFrame, family: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Links of what is not linked to its family's first document, with all of the family."""
    linked = star.filter(F.col("den") * F.col("both") >= F.col("num") * F.col("either")).select(F.col("a").alias("family"), F.col("b").alias("doc_id"))
    linked = linked.distinct().withColumn("sure", F.lit(True))
    placed = family.join(linked, ["family", "doc_id"], "left")
    placed = placed.select("doc_id", "family", (F.col("sure").isNotNull() | (F.col("doc_id") == F.col("family"))).alias("sure"))
    placed = stored(placed.join(sets.select("doc_id", "n").distinct(), "doc_id"), "families")
    sized = placed.groupBy("family").agg(
        F.count_if("sure").alias("docs_s"), F.count_if(~F.col("sure")).alias("docs_u"),
        F.sum(F.when(F.col("sure"), F.col("n")).otherwise(0)).alias("all_s"), F.sum(F.when(F.col("sure"), 0).otherwise(F.col("n"))).alias("all_u"),
    ).filter("docs_u > 0")
    parts = {k: F.greatest(F.ceil(F.col(f"docs_{k}") / GROUP_DOCS), F.ceil(F.col(f"all_{k}") / GROUP_SHINGLES)).cast("int") for k in "su"}
    sized = sized.select("family", parts["s"].alias("s"), parts["u"].alias("u"))
    dealt = salted_lookup(placed, sized, ["family"], ["doc_id"], "inner")
    # Part -1 - i is part i of the linked. A group is two parts, at least one of them unlinked.
    hashed = F.xxhash64("doc_id")
    own = F.when(F.col("sure"), -1 - F.pmod(hashed, "s")).otherwise(F.pmod(hashed, "u")).cast("int")
    dealt = dealt.withColumn("own", own)
    unlinked = F.sequence(F.lit(0), F.col("u") - 1)
    others = F.when(F.col("sure"), unlinked).otherwise(F.sequence(-F.col("s"), F.col("u") - 1))
    others = F.filter(others, lambda j: j != F.col("own"))
    dealt = dealt.select("doc_id", "family", "own", F.explode(others).alias("other"))
    dealt = dealt.select("doc_id", "family", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    groups = dealt.join(sets.select("doc_id", "shingles"), "doc_id").groupBy("family", "i", "j")
    return groups.applyInArrow(_links(num, den), "a long, b long")


def similar_documents(docs: DataFrame, shingle: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id``.

    Documents are linked whose sets of ``shingle``-word shingles (ASCII white space apart,
    A-Z lower-cased) satisfy ``den * |A & B| >= num * |A | B|``; ``component_id`` is the least
    doc_id that links reach. A text of fewer words has its whole sequence as its one shingle;
    NULL and empty texts, and texts without words, have none and stand alone. Rows without
    doc_id have their text's component but make no links to other texts. A doc_id that
    several rows carry is linked with whatever any of their texts is; each row is returned.
    Columns beyond ``doc_id`` and ``text`` are not read.
    """
    if not 0 < num <= den:
        raise ValueError("the similarity must be above 0 and at most 1")
    text = docs.select("doc_id", "text")
    signed = text.mapInArrow(_sign(shingle, num, den), "doc_id long, n_shingles long, f1 long, f2 long, keys array<long>")
    signed = stored(signed, "signatures")
    key = ["n_shingles", "f1", "f2"]
    full = signed.filter("n_shingles > 0")
    classes = full.groupBy(*key).agg(F.min("doc_id").alias("rep"))

    firsts = full.join(classes.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")
    keyed = firsts.select("doc_id", F.explode("keys").alias("bucket")).repartition("bucket")
    bucket = Window.partitionBy("bucket")
    keyed = keyed.select("doc_id", "bucket", F.min("doc_id").over(bucket).alias("first"), F.max("doc_id").over(bucket).alias("last"))
    buckets = stored(keyed.filter("first < last").drop("last"), "buckets")
    members = buckets.select("doc_id").distinct()
    sets = stored(text.join(members, "doc_id", "left_semi").mapInArrow(_sets(shingle), "doc_id long, n long, shingles binary"), "sets")

    star = buckets.filter("first < doc_id").groupBy(F.col("doc_id").alias("b")).agg(F.min("first").alias("a")).select("a", "b")
    star = stored(compared(star, sets).withColumns({"num": F.lit(num), "den": F.lit(den)}), "star")
    alike = F.col("den") * F.col("both") >= F.col("num") * F.col("either")
    family = components(star.filter("2 * both >= either").select("a", "b"))
    family = stored(family.withColumnRenamed("component", "family"), "families")
    links = star.filter(alike).select("a", "b").unionByName(stored(_within(star, family, sets, num, den), "within"))

    # Members of one bucket in different families, of which single documents are some.
    placed = buckets.join(family, "doc_id", "left").select("bucket", "doc_id", F.coalesce("family", "doc_id").alias("family"))
    own = Window.partitionBy("bucket")
    mixed = placed.withColumns({"x": F.min("family").over(own), "y": F.max("family").over(own)}).filter("x < y").drop("x", "y")
    mixed = stored(mixed.join(sets.select("doc_id", "n").distinct(), "doc_id"), "mixed")
    a, b = mixed.alias("a"), mixed.alias("b")
    fit = F.least("a.n", "b.n") * den >= F.greatest("a.n", "b.n") * num
    across = a.join(b, (F.col("a.bucket") == F.col("b.bucket")) & (F.col("a.family") < F.col("b.family")) & fit)
    across = across.select(F.least("a.doc_id", "b.doc_id").alias("a"), F.greatest("a.doc_id", "b.doc_id").alias("b")).distinct()
    across = across.join(star.select("a", "b"), ["a", "b"], "left_anti")
    across = compared(stored(across, "pairs"), sets).withColumns({"num": F.lit(num), "den": F.lit(den)})
    links = links.unionByName(stored(across.filter(alike).select("a", "b"), "across"))

    classed = salted_lookup(full.select("doc_id", *key), classes, key, ["doc_id"], "inner").select("doc_id", "n_shingles", "rep")
    classed = stored(classed, "classed")
    several = classed.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("rep").alias("x"), F.max("rep").alias("y")).filter("x < y")
    several = classed.join(several.select("doc_id"), "doc_id", "left_semi").filter("rep < doc_id")
    links = links.unionByName(several.select(F.col("rep").alias("a"), F.col("doc_id").alias("b")))
    found = salted_lookup(classed, components(links).withColumnRenamed("doc_id", "rep"), ["rep"], ["doc_id"])
    found = found.select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    alone = signed.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return found.unionByName(alone)
