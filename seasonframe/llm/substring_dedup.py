"""Substring dedup: words that no window repeats, found by joins of blocks and windows.

Every window of ``window`` consecutive words has an anchor, the least of the seeds (short
word runs) it holds, so equal windows have equal anchors wherever they stand. Windows in
sequence that share an anchor form a block, identified by its anchor and all its words.
The blocks of all documents, dealt out by anchor, are the index that documents are looked
up in. A block that an earlier document has too is copied as a whole. The
other blocks of an anchor that occurs in several contexts are where factors end; their
windows are looked up one by one. Copied windows in sequence from one source form a factor.
This stands in for greedy relative Lempel-Ziv parsing: no longest match is sought, and a factor
ends where the least source changes. The words kept are exact.

Only hashes are shuffled, one block for about eight words; document texts move once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seasonframe.llm.common import EXACT, MapArrow, Words, chunks, mix, pair, runs, stored

WINDOW = 20
SEED = 6

_ODD = 0x9FB21C651E98DF25


class Blocks:
    """Windows, anchors and blocks of the texts of a chunk."""

    def __init__(self, words: Words, window: int, seed: int) -> None:
        h = words.hash
        text_of = words.text_of()
        self.at = np.flatnonzero(words.room() >= window)
        if not len(self.at):
            none = np.empty(0, np.int64)
            self.group = self.first = self.count = self.text = none
            self.anchor = self.block = np.empty(0, np.uint64)
            return
        seeds = runs(h, seed)
        order = mix(seeds ^ np.uint64(0xA24BAED4963EE407))
        least, size, reach = np.arange(len(order)), 1, window - seed + 1
        while size < reach:
            step = min(size, reach - size)
            a, b = least[:-step], least[step:]
            least = np.where(order[a] <= order[b], a, b)
            size += step
        anchor = least[self.at]
        new = np.ones(len(self.at), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (self.at[1:] != self.at[:-1] + 1)
        opens = np.flatnonzero(new)
        self.group = np.cumsum(new) - 1
        self.first = self.at[opens]
        self.count = np.diff(np.r_[opens, len(self.at)])
        self.text = text_of[self.first]
        self.anchor = seeds[anchor[opens]]
        power = np.cumprod(np.r_[np.uint64(1), np.full(len(h), _ODD, np.uint64)])
        inverse = np.cumprod(np.r_[np.uint64(1), np.full(len(h), pow(_ODD, -1, 1 << 64), np.uint64)])
        sums = np.r_[np.uint64(0), np.cumsum(h * power[:-1])]
        last = self.first + self.count + window - 1
        shape = (anchor[opens] - self.first) * 4 * window + self.count
        self.block = pair((sums[last] - sums[self.first]) * inverse[self.first], mix(shape.astype(np.uint64)))


def window_keys(words: Words, window: int) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for each window, by the word it starts at, across text ends too."""
    return runs(words.hash, window), runs(mix(words.hash ^ np.uint64(0xC3A5C85C97CB3127)), window)


def _emit(window: int, seed: int, anchors_only: bool) -> MapArrow:
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches):
            b = Blocks(Words(texts, EXACT), window, seed)
            by = np.lexsort((b.block, b.anchor, b.text))
            t, a, k = b.text[by], b.anchor[by], b.block[by]
            keep = np.ones(len(by), bool)
            keep[1:] = (t[1:] != t[:-1]) | (a[1:] != a[:-1]) | (k[1:] != k[:-1])
            out = {"anchor": pa.array(a[keep].view(np.int64))}
            if not anchors_only:
                out["block"] = pa.array(k[keep].view(np.int64))
                out["doc_id"] = batch.column("doc_id").take(pa.array(t[keep]))
            yield pa.RecordBatch.from_pydict(out)

    return emit


def _marks(column: pa.Array, key: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a column of lists of (key, source): row, key, source and whether there is a source."""
    counts = np.asarray(pa.compute.list_value_length(column).fill_null(0))
    flat = column.flatten()
    source = flat.field("source")
    return (
        np.repeat(np.arange(len(column)), counts),
        np.asarray(flat.field(key)).view(np.uint64),
        np.asarray(source.fill_null(0)),
        np.asarray(source.is_valid()),
    )


def _find(row: np.ndarray, key: np.ndarray, rows: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """For each (row, key) the place of an equal (rows, keys), or -1."""
    if not len(rows) or not len(row):
        return np.full(len(row), -1)
    mine, theirs = (pair(mix(r.astype(np.uint64)), k) for r, k in ((row, key), (rows, keys)))
    by = np.argsort(theirs)
    at = np.minimum(np.searchsorted(theirs[by], mine), len(by) - 1)
    return np.where(theirs[by][at] == mine, by[at], -1)


def _unsettled(window: int, seed: int) -> MapArrow:
    """Windows of blocks without a source, each once a document."""

    def unsettled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches):
            row, key, _, sourced = _marks(batch.column("blocks"), "block")
            ask = np.zeros(len(texts), bool)
            ask[row[~sourced]] = True
            words = Words([t if a else None for t, a in zip(texts, ask, strict=True)], EXACT)
            b = Blocks(words, window, seed)
            wanted = _find(b.text, b.block, row[~sourced], key[~sourced]) >= 0
            at = b.at[wanted[b.group]] if len(b.at) else b.at
            text = b.text[b.group[wanted[b.group]]] if len(b.at) else b.at
            w1, w2 = (k[at] for k in window_keys(words, window))
            by = np.lexsort((w2, w1, text))
            t, x, y = text[by], w1[by], w2[by]
            keep = np.ones(len(by), bool)
            keep[1:] = (t[1:] != t[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])
            yield pa.RecordBatch.from_pydict(
                {
                    "w1": pa.array(x[keep].view(np.int64)),
                    "w2": pa.array(y[keep].view(np.int64)),
                    "doc_id": batch.column("doc_id").take(pa.array(t[keep])),
                }
            )

    return unsettled


def _parse(window: int, seed: int) -> MapArrow:
    factor = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("source", pa.int64())]))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches):
            words = Words(texts, EXACT)
            b = Blocks(words, window, seed)
            ids = np.asarray(batch.column("doc_id").fill_null(-1))
            copied = np.zeros(len(b.at), bool)
            source = np.zeros(len(b.at), np.int64)
            if len(b.at):
                text = b.text[b.group]
                w1, w2 = (k[b.at] for k in window_keys(words, window))
                # Earlier in the same document.
                by = np.lexsort((b.at, w2, w1, text))
                t, x, y = text[by], w1[by], w2[by]
                again = by[1:][(t[1:] == t[:-1]) & (x[1:] == x[:-1]) & (y[1:] == y[:-1])]
                copied[again], source[again] = True, ids[text[again]]
                # Windows, then whole blocks, that earlier documents have.
                row, key, first, _ = _marks(batch.column("windows"), "w1")
                found = _find(text, w1, row, key)
                copied |= found >= 0
                source[found >= 0] = first[found[found >= 0]]
                row, key, first, sourced = _marks(batch.column("blocks"), "block")
                found = _find(b.text, b.block, row[sourced], key[sourced])[b.group]
                copied |= found >= 0
                source[found >= 0] = first[sourced][found[found >= 0]]
            at, source = b.at[copied], source[copied]
            cover = np.zeros(len(words) + 1, np.int32)
            np.add.at(cover, at, 1)
            np.add.at(cover, at + window, -1)
            gone = np.cumsum(cover[:-1]) > 0
            removed = np.diff(np.r_[0, np.cumsum(gone)][words.offset])
            owner = b.text[b.group[copied]] if len(b.at) else at
            new = np.ones(len(at), bool)
            new[1:] = (at[1:] != at[:-1] + 1) | (source[1:] != source[:-1]) | (owner[1:] != owner[:-1])
            opens = np.flatnonzero(new)
            last = at[np.r_[opens[1:], len(at)] - 1] + window if len(at) else at
            base = words.offset[owner[opens]]
            kept = []
            for i, t in enumerate(texts):
                split = (t or b"").split()
                if removed[i]:
                    split = [w for w, g in zip(split, gone[words.offset[i] : words.offset[i + 1]].tolist(), strict=True) if not g]
                kept.append(b" ".join(split))
            factors = pa.StructArray.from_arrays(
                [pa.array(at[opens] - base, pa.int32()), pa.array(last - base, pa.int32()), pa.array(source[opens], pa.int64())],
                ["start", "stop", "source"],
            )
            places = np.searchsorted(owner[opens], np.arange(len(texts) + 1))
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id"),
                    "n_words": pa.array(words.counts(), pa.int64()),
                    "n_removed": pa.array(removed, pa.int64()),
                    "factors": pa.ListArray.from_arrays(pa.array(places, pa.int32()), factors).cast(factor),
                    "kept": pa.array(kept, pa.binary()).cast(pa.string()),
                }
            )

    return parse


def substring_dedup(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """``doc_id, n_words, n_removed, factors, kept`` for each document.

    A word goes when a window of ``window`` words over it stands earlier too: in a document
    of smaller doc_id, or before in the same one. ``factors`` are the copied stretches
    (``start``, ``stop`` in words, ``source`` document); those of different sources may overlap at their ends.
    ``kept`` has the other words, joined by one space. NULL and empty texts have no words.
    Documents without a doc_id have no place in the order: they are only compared with
    themselves. A doc_id is expected once.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    named = docs.filter("doc_id IS NOT NULL")
    anchors = named.mapInArrow(_emit(window, seed, True), "anchor long")
    anchors = anchors.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor")
    blocks = named.mapInArrow(_emit(window, seed, False), "anchor long, block long, doc_id long")
    blocks = stored(blocks.join(anchors, "anchor", "left_semi"), "blocks")

    first = blocks.groupBy("anchor", "block").agg(F.min("doc_id").alias("source"), F.count("*").alias("n"))
    first = stored(first, "first")
    copies = blocks.join(first.filter("n > 1"), ["anchor", "block"]).filter("doc_id > source").select("doc_id", "block", "source")
    mixed = first.groupBy("anchor").agg(F.count("*").alias("contexts")).filter("contexts > 1")
    ends = first.join(mixed, "anchor", "left_semi").select(F.col("source").alias("doc_id"), "block", F.lit(None).cast("long").alias("source"))
    marks = copies.unionByName(ends).groupBy("doc_id").agg(F.collect_list(F.struct("block", "source")).alias("blocks"))
    marks = stored(marks, "marks")

    marked = docs.join(marks, "doc_id", "left")
    windows = marked.mapInArrow(_unsettled(window, seed), "w1 long, w2 long, doc_id long")
    known = windows.groupBy("w1", "w2").agg(F.min("doc_id").alias("source"), F.count("*").alias("n")).filter("n > 1")
    known = windows.join(known.drop("n"), ["w1", "w2"]).filter("doc_id > source")
    known = known.groupBy("doc_id").agg(F.collect_list(F.struct("w1", "source")).alias("windows"))
    schema = "doc_id long, n_words long, n_removed long, factors array<struct<start:int,stop:int,source:long>>, kept string"
    return marked.join(known, "doc_id", "left").mapInArrow(_parse(window, seed), schema)
