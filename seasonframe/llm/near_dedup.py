"""Near-duplicate documents by SuperMinHash, banding, verification and union-find.

Each shingle of a document ranks the slots of the signature by its own permutation; layer
``j`` gives a shingle's ``j``-th slot a value between ``j`` and ``j + 1``, and the smallest
value of a slot stays. When all slots of a document are filled, later layers can't lower
any, so its work stops: long documents end after a layer or two.

Documents with one shingle set are one class; only its first member goes on. Members of a
band's buckets that roughly resemble the first of them form families. A family's sets meet
in groups of bounded size, which compare all their members by products of their incidence
matrices and give back a spanning forest, so no pairs are shuffled. Candidates of different
families, which are few, are paired and compared one by one. All links are confirmed on
full sets.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seasonframe.llm.common import LOWER, MapArrow, Words, chunks, mix, pair, runs, stored

SLOTS = 256
MISS = 1e-8
"""Greatest chance that a pair right at the threshold shares no band."""

SKETCH_BITS = 4
"""Bits of a slot in the sketch by which candidates are sifted before their sets are compared."""

DEVIATIONS = 5.5
"""A pair at the threshold that differs in more slots by so many standard deviations is let go."""


FAMILY = 0.5
"""Estimated similarity to the first document of a bucket from which on a document joins its family."""

GROUP_DOCS, GROUP_SHINGLES = 512, 1_000_000
"""What half a group of a family holds at most, in documents and about in shingles."""


def sketch_limit(num: int, den: int) -> int:
    """Slots in which the sketches of an alike pair may differ."""
    p = (1 - num / den) * (1 - 0.5**SKETCH_BITS)
    return int(SLOTS * p + DEVIATIONS * (SLOTS * p * (1 - p)) ** 0.5)


def bands(num: int, den: int) -> tuple[int, int]:
    """Rows a band and bands: the longest bands whose chance of a miss is small enough."""
    t = num / den
    rows = max(r for r in range(1, 17) if r == 1 or (1 - t**r) ** (SLOTS // r) <= MISS)
    return rows, SLOTS // rows


def shingle_sets(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text, sorted, and where each text's begin.

    A text of fewer words, but not none, has its whole sequence as its only shingle.
    """
    counts = words.counts()
    found = runs(words.hash, size)
    many = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    offset = np.r_[0, np.cumsum(many)]
    out = np.empty(offset[-1], np.uint64)
    keep = np.ones(offset[-1], bool)
    for i in np.flatnonzero(counts):
        a, b = offset[i], offset[i + 1]
        if counts[i] >= size:
            part = out[a:b]
            part[:] = found[words.offset[i] : words.offset[i] + b - a]
            part.sort()
            keep[a + 1 : b] = part[1:] != part[:-1]
        else:
            whole = words.hash[words.offset[i] : words.offset[i + 1]]
            out[a] = mix(functools.reduce(pair, whole, np.full(1, counts[i], np.uint64)))[0]
    kept = np.r_[0, np.cumsum(keep)]
    return out[keep], kept[offset]


def signatures(sets: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """SuperMinHash of each set, a row of slots each; a slot holds layer and 32 random bits."""
    docs = len(offset) - 1
    none = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.full((docs, SLOTS), none, np.uint64)
    doc = np.repeat(np.arange(docs), np.diff(offset))
    seed = mix(sets ^ np.uint64(0x5851F42D4C957F2D))
    first, step = seed & np.uint64(SLOTS - 1), (seed >> np.uint64(20)) | np.uint64(1)
    for layer in range(SLOTS):
        if not len(doc):
            break
        j = np.uint64(layer)
        slot = (first + j * step) & np.uint64(SLOTS - 1)
        value = (j << np.uint64(32)) | (pair(seed, np.full(1, j)) >> np.uint64(32))
        np.minimum.at(out.reshape(-1), doc * SLOTS + slot.astype(np.int64), value)
        open_ = (out == none).any(axis=1)
        if not open_.all():
            keep = open_[doc]
            doc, seed, first, step = doc[keep], seed[keep], first[keep], step[keep]
    return out


def _sign(size: int, rows: int, count: int) -> MapArrow:
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = mix(np.arange(1, count + 1, dtype=np.uint64))
        for batch, texts in chunks(batches):
            sets, offset = shingle_sets(Words(texts, LOWER), size)
            slots = signatures(sets, offset)
            keys = np.broadcast_to(salt, (len(slots), count))
            for k in range(rows):
                keys = pair(keys, slots[:, k : rows * count : rows])
            bits = [np.packbits((slots >> np.uint64(b) & np.uint64(1)).astype(np.uint8), axis=1).view(np.int64) for b in range(SKETCH_BITS)]
            n = np.diff(offset)
            sums = [np.r_[np.uint64(0), np.cumsum(mix(sets ^ np.uint64(s)))][offset] for s in (0x1234567, 0x89ABCDEF)]
            full = n > 0
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id"),
                    "n_shingles": pa.array(n, pa.int64()),
                    "f1": pa.array(np.diff(sums[0]).view(np.int64)),
                    "f2": pa.array(np.diff(sums[1]).view(np.int64)),
                    "sketch": pa.array(list(np.hstack(bits)), pa.list_(pa.int64())),
                    "bands": pa.ListArray.from_arrays(
                        pa.array(np.r_[0, np.cumsum(full * count)], pa.int32()), pa.array(keys[full].reshape(-1).view(np.int64))
                    ),
                }
            )

    return sign


def _sets(size: int) -> MapArrow:
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches):
            found, offset = shingle_sets(Words(texts, LOWER), size)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id"),
                    "shingles": pa.array([found[a:b].tobytes() for a, b in zip(offset[:-1], offset[1:], strict=True)], pa.binary()),
                }
            )

    return sets


def _confirm(num: int, den: int) -> MapArrow:
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("set_a"), batch.column("set_b"), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (a, b))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(den * both >= num * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return confirm


def _forest(num: int, den: int):
    """Links that join what is alike in a group, each to the least of its component."""

    def forest(group: pa.Table) -> pa.Table:
        group = group.sort_by("doc_id")
        ids = group.column("doc_id").to_numpy()
        sets = [np.frombuffer(v.as_buffer(), np.uint64) for c in group.column("shingles").chunks for v in c]
        sizes = np.array([len(x) for x in sets])
        doc = np.repeat(np.arange(len(sets)), sizes)
        _, shingle, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        place = np.cumsum(seen > 1) - 1
        common = seen[shingle] > 1
        doc, shingle = doc[common], place[shingle[common]]
        by = np.argsort(shingle, kind="stable")
        doc, shingle = doc[by], shingle[by]
        both = np.zeros((len(sets), len(sets)), np.float32)
        for first in range(0, int(shingle[-1]) + 1 if len(shingle) else 0, 1024):
            a, b = np.searchsorted(shingle, [first, first + 1024])
            part = np.zeros((len(sets), 1024), np.float32)
            part[doc[a:b], shingle[a:b] - first] = 1
            both += part @ part.T
        either = sizes[:, None] + sizes[None, :] - both
        alike = den * both.astype(np.float64) >= num * either.astype(np.float64)
        label = np.arange(len(sets))
        while True:
            least = np.where(alike, label[None, :], len(sets)).min(axis=1)
            least = np.minimum(least, label)[np.minimum(least, label)]
            if (least == label).all():
                break
            label = least
        tied = label != np.arange(len(sets))
        return pa.table({"a": ids[label[tied]], "b": ids[tied]})

    return forest


def _union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over the links of a task's batches, as links to each part's least member."""
    for batch in batches:
        parent: dict[int, int] = {}

        def root(x: int, parent: dict[int, int] = parent) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
        links = [(root(x), x) for x in list(parent)]
        yield pa.RecordBatch.from_pydict(
            {"a": pa.array([a for a, b in links if a != b], pa.int64()), "b": pa.array([b for a, b in links if a != b], pa.int64())}
        )


def components(links: DataFrame) -> DataFrame:
    """``doc_id, component`` of every document with a link; the component is its least member.

    Union-find within each batch, then alternately every node's greater and smaller
    neighbours are tied to its least one, until nothing changes.
    """
    links = stored(links.select("a", "b").mapInArrow(_union, "a long, b long").distinct(), "links")
    state = None
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        links = both.filter("b > a").join(least, "a").select(F.col("m").alias("a"), "b").distinct()
        least = links.groupBy("b").agg(F.min("a").alias("m"))
        tied = links.join(least, "b")
        links = tied.select(F.col("m").alias("a"), "b").union(tied.filter("a > m").select("m", F.col("a").alias("b")))
        links = stored(links.distinct(), "links")
        now = links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first()
        if now == state:
            return links.select(F.col("b").alias("doc_id"), F.col("a").alias("component")).union(
                links.select("a", "a").distinct()
            )
        state = now


def _apart(a: str, b: str) -> Column:
    """Slots in which two sketches differ."""
    x, y = F.col(f"{a}.sketch"), F.col(f"{b}.sketch")
    longs, apart = SLOTS // 64, F.lit(0)
    for k in range(longs):
        differ = [F.get(x, F.lit(i)).bitwiseXOR(F.get(y, F.lit(i))) for i in range(k, longs * SKETCH_BITS, longs)]
        apart = apart + F.bit_count(functools.reduce(Column.bitwiseOR, differ))
    return apart


def _close(a: str, b: str, num: int, den: int) -> Column:
    """Whether sizes and sketches of two sets allow the similarity."""
    n, m = F.col(f"{a}.n_shingles"), F.col(f"{b}.n_shingles")
    return (F.least(n, m) * den >= F.greatest(n, m) * num) & (_apart(a, b) <= sketch_limit(num, den))


def near_duplicates(docs: DataFrame, shingle: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, kept``.

    Documents are linked whose shingle sets satisfy ``den * |A & B| >= num * |A | B|``;
    ``component_id`` is the least doc_id that links reach. NULL and empty texts, and texts
    without words, have no shingles and stand alone. Rows of one text are one class. Rows
    without doc_id are kept unless their text has a row with one; they make no links to
    other texts. A doc_id is expected once.
    """
    rows, count = bands(num, den)
    text = docs.select("doc_id", "text")
    sig = stored(
        text.mapInArrow(
            _sign(shingle, rows, count), "doc_id long, n_shingles long, f1 long, f2 long, sketch array<long>, bands array<long>"
        ),
        "signatures",
    )
    full = sig.filter("n_shingles > 0")
    classes = full.groupBy("n_shingles", "f1", "f2").agg(F.min("doc_id").alias("rep"))
    banded = full.join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    banded = banded.select("doc_id", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.min("doc_id").alias("leader"), F.count("*").alias("n")).filter("n > 1").drop("n")
    buckets = stored(banded.join(shared, "band"), "buckets")

    members = buckets.select("doc_id").distinct()
    feature = stored(sig.select("doc_id", "n_shingles", "sketch").join(members, "doc_id", "left_semi"), "features")
    sets = stored(text.join(feature.select("doc_id"), "doc_id", "left_semi").mapInArrow(_sets(shingle), "doc_id long, shingles binary"), "sets")

    # Families: documents that resemble the first leader of their buckets, joined up.
    star = buckets.filter("leader < doc_id").groupBy("doc_id").agg(F.min("leader").alias("leader"))
    b = star.join(feature, "doc_id").alias("b")
    a = feature.withColumnRenamed("doc_id", "first").alias("a")
    near = b.join(a, (F.col("leader") == F.col("first")) & (_apart("a", "b") <= SLOTS * (1 - FAMILY)))
    family = components(near.select(F.col("first").alias("a"), F.col("b.doc_id").alias("b")))
    family = stored(family.withColumnRenamed("component", "family"), "families")

    # A family's groups: all of it, or every two of its parts.
    sized = family.join(feature.select("doc_id", "n_shingles"), "doc_id").groupBy("family")
    sized = sized.agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s"))
    parts = F.greatest(F.ceil(F.col("n") / GROUP_DOCS), F.ceil(F.col("s") / GROUP_SHINGLES)).cast("int")
    own = F.pmod(F.xxhash64("doc_id"), "parts").cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: (F.col("parts") == 1) | (j != F.col("own")))
    dealt = family.join(sized.select("family", parts.alias("parts")), "family").withColumn("own", own)
    dealt = dealt.select("doc_id", "family", "own", F.explode(others).alias("other"))
    dealt = dealt.select("doc_id", "family", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    groups = dealt.join(sets, "doc_id").groupBy("family", "i", "j")
    links = stored(groups.applyInArrow(_forest(num, den), "a long, b long"), "within")

    # Candidates of different families, of which single documents are some.
    placed = buckets.join(family, "doc_id", "left").select("band", "doc_id", F.coalesce("family", "doc_id").alias("family"))
    mixed = placed.groupBy("band").agg(F.min("family").alias("x"), F.max("family").alias("y")).filter("x < y")
    rest = stored(placed.join(mixed.select("band"), "band", "left_semi").join(feature, "doc_id"), "rest")
    a, b = rest.alias("a"), rest.alias("b")
    across = a.join(b, (F.col("a.band") == F.col("b.band")) & (F.col("a.family") < F.col("b.family")) & _close("a", "b", num, den))
    across = across.select(F.least("a.doc_id", "b.doc_id").alias("a"), F.greatest("a.doc_id", "b.doc_id").alias("b")).distinct()
    a, b = (sets.select(F.col("doc_id").alias(k), F.col("shingles").alias(f"set_{k}")) for k in "ab")
    pairs = across.join(a, "a").join(b, "b").select("a", "b", "set_a", "set_b")
    links = links.unionByName(stored(pairs.mapInArrow(_confirm(num, den), "a long, b long"), "across"))
    comp = components(links)

    found = full.select("doc_id", "n_shingles", "f1", "f2").join(classes, ["n_shingles", "f1", "f2"])
    found = found.select("doc_id", "n_shingles", "rep").join(comp.select(F.col("doc_id").alias("rep"), "component"), "rep", "left")
    found = found.select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    alone = sig.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    out = found.unionByName(alone)
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
