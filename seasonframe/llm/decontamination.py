"""Benchmark decontamination with an FM-index for each shard of training text.

A task cuts its documents into shards. The words of a shard become symbols of the phrases'
vocabulary; a word that no phrase holds ends a run, and a run shorter than the shortest
phrase can't hold one, so it isn't indexed. Over the rest the shard gets a suffix array
(prefix doubling), its Burrows-Wheeler transform as a wavelet matrix, and sampled suffix
positions. All phrases are searched backwards at once, found rows are walked to the next
sampled position, and overlapping occurrences are merged into spans.

Phrases come in blocks of bounded size, one broadcast and one pass over the documents each;
spans found so far travel with the row, so no pass shuffles anything.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seasonframe.llm.common import ALNUM, MapArrow, Words, chunks

WINDOW = 10
BLOCK_BYTES = 4 << 20
SAMPLE = 16

SPANS = "array<struct<start:int,stop:int>>"


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffixes in order, by prefix doubling; only groups still tied are sorted again.

    The last symbol has to be smaller than all others and occur once.
    """
    n = len(text)
    width = int(text.max()) + 1 if n else 1
    key = text.astype(np.int64)
    depth = 1
    while depth < 4 and width ** (depth + 1) < 1 << 62:
        key = key * width + np.r_[text[depth:], np.zeros(min(depth, n), text.dtype)]
        depth += 1
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.r_[True, key[1:] != key[:-1]]
    slots = np.arange(n)
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(first, slots, 0))
    while True:
        single = first & np.r_[first[1:], True]
        slots = slots[~single]
        if not len(slots):
            return order
        at = order[slots]
        after = np.where(at + depth < n, rank[np.minimum(at + depth, n - 1)] + 1, 0)
        key = rank[at] * (n + 1) + after
        by = np.argsort(key, kind="stable")
        key, at = key[by], at[by]
        order[slots] = at
        first = np.r_[True, key[1:] != key[:-1]]
        rank[at] = slots[np.maximum.accumulate(np.where(first, np.arange(len(slots)), 0))]
        depth *= 2


class FmIndex:
    """Backward search and positions over a text of small integers, the last one a lone 0."""

    def __init__(self, text: np.ndarray, symbols: int, sample: int = SAMPLE) -> None:
        order = suffix_array(text)
        self.n = len(text)
        bwt = text[order - 1]
        self.before = np.r_[0, np.cumsum(np.bincount(text, minlength=symbols))]
        self.levels: list[tuple[int, np.ndarray, int]] = []
        for bit in reversed(range(max(1, int(symbols - 1).bit_length()))):
            zero = (bwt >> bit) & 1 == 0
            zeros = np.zeros(self.n + 1, np.int32)
            np.cumsum(zero, out=zeros[1:])
            self.levels.append((bit, zeros, int(zeros[-1])))
            bwt = np.r_[bwt[zero], bwt[~zero]]
        self.base = self._walk(np.arange(symbols), np.zeros(symbols, np.int64))
        sampled = order % sample == 0
        self.sampled = np.r_[0, np.cumsum(sampled)]
        self.positions = order[sampled]

    def _walk(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        for bit, zeros, total in self.levels:
            z = zeros[row]
            row = np.where((symbol >> bit) & 1 == 0, z, total + row - z)
        return row

    def rank(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        """How often a symbol stands before a row of the transform."""
        return self._walk(symbol, row) - self.base[symbol]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of the phrases that occur, with their first row and the row after the last."""
        live = np.arange(len(phrases))
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for k in reversed(range(phrases.shape[1])):
            symbol = phrases[live, k]
            low, high = (self.before[symbol] + self.rank(symbol, x) for x in (low, high))
            keep = low < high
            live, low, high = live[keep], low[keep], high[keep]
        return live, low, high

    def locate(self, row: np.ndarray) -> np.ndarray:
        """Text positions of rows: steps back through the text to a sampled position."""
        out = np.empty(len(row), np.int64)
        open_, steps = np.arange(len(row)), 0
        while len(open_):
            at = self.sampled[row]
            done = self.sampled[row + 1] > at
            out[open_[done]] = self.positions[at[done]] + steps
            open_, row = open_[~done], row[~done]
            symbol, low = np.zeros(len(row), np.int64), row
            for bit, zeros, total in self.levels:
                z = zeros[low]
                one = zeros[low + 1] == z
                symbol |= one.astype(np.int64) << bit
                low = np.where(one, total + low - z, z)
            row = self.before[symbol] + low - self.base[symbol]
            steps += 1
        return out


class Phrases:
    """Windows of a block of benchmark items, as symbols 2, 3, ... of their vocabulary."""

    def __init__(self, items: list[tuple[str, bytes | None]], window: int = WINDOW) -> None:
        words = Words([text for _, text in items], ALNUM)
        self.ids = [name for name, _ in items]
        self.vocabulary = np.unique(words.hash)
        symbol = self.symbols(words.hash)
        owners: dict[int, list[np.ndarray]] = {}
        found: dict[int, list[np.ndarray]] = {}
        for k, (a, b) in enumerate(zip(words.offset[:-1], words.offset[1:], strict=True)):
            size = min(window, b - a)
            if size:
                rows = np.lib.stride_tricks.sliding_window_view(symbol[a:b], size)
                found.setdefault(int(size), []).append(rows)
                owners.setdefault(int(size), []).append(np.full(len(rows), k))
        self.by_size = []
        for size, rows in sorted(found.items()):
            distinct, which = np.unique(np.concatenate(rows), axis=0, return_inverse=True)
            owned = np.unique(np.c_[which.reshape(-1), np.concatenate(owners[size])], axis=0)
            first = np.searchsorted(owned[:, 0], np.arange(len(distinct) + 1))
            self.by_size.append((size, distinct, first, owned[:, 1]))

    def symbols(self, hashes: np.ndarray) -> np.ndarray:
        """Symbols of words, 0 for words that no phrase holds."""
        if not len(self.vocabulary):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 2, 0)

    def occurrences(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """For a shard: whether each word is hit, and distinct pairs of text and item."""
        hit = np.zeros(len(words) + 1, np.int32)
        none = np.zeros(len(words), bool), np.empty((0, 2), np.int64)
        if not self.by_size or not len(words):
            return none
        symbol = self.symbols(words.hash)
        known = symbol > 0
        new = known.copy()
        new[1:] &= ~known[:-1]
        opens = words.offset[:-1][words.counts() > 0]
        new[opens] |= known[opens]
        run = np.cumsum(new) - 1
        length = np.bincount(run[known], minlength=1)
        kept = np.flatnonzero(known & (length[np.maximum(run, 0)] >= self.by_size[0][0]))
        if not len(kept):
            return none
        _, run = np.unique(run[kept], return_inverse=True)
        at = np.arange(len(kept)) + run
        text = np.ones(at[-1] + 3, np.int64)
        text[-1] = 0
        text[at] = symbol[kept]
        word_at = np.zeros(len(text), np.int64)
        word_at[at] = kept
        index = FmIndex(text, len(self.vocabulary) + 2)
        text_of, pairs = words.text_of(), []
        for size, distinct, first, owner in self.by_size:
            live, low, high = index.search(distinct)
            if not len(live):
                continue
            many = high - low
            rows = np.repeat(low - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(many.sum())
            word = word_at[index.locate(rows)]
            np.add.at(hit, word, 1)
            np.add.at(hit, word + size, -1)
            seen = np.unique(np.c_[text_of[word], np.repeat(live, many)], axis=0)
            many = first[seen[:, 1] + 1] - first[seen[:, 1]]
            owned = np.repeat(first[seen[:, 1]] - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(many.sum())
            pairs.append(np.c_[np.repeat(seen[:, 0], many), owner[owned]])
        return np.cumsum(hit[:-1]) > 0, np.unique(np.concatenate(pairs), axis=0) if pairs else none[1]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _scan(shared) -> MapArrow:
    span_type = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases: Phrases = shared.value
        for batch, texts in chunks(batches):
            words = Words(texts, ALNUM)
            hit, pairs = phrases.occurrences(words)
            spans = batch.column("spans").to_pylist()
            items = batch.column("items").to_pylist()
            for i in np.unique(pairs[:, 0]):
                a, b = words.offset[i], words.offset[i + 1]
                own = np.diff(np.r_[0, hit[a:b].astype(np.int8), 0])
                found = zip(np.flatnonzero(own == 1).tolist(), np.flatnonzero(own == -1).tolist(), strict=True)
                old = [(s["start"], s["stop"]) for s in spans[i]]
                spans[i] = [{"start": x, "stop": y} for x, y in merged([*old, *found])]
            for i, item in pairs.tolist():
                items[i].append(phrases.ids[item])
            out = {name: batch.column(name) for name in batch.schema.names}
            out["n_words"] = pa.array(words.counts(), pa.int64())
            out["spans"] = pa.array(spans, span_type)
            out["items"] = pa.array([sorted(set(x)) for x in items], pa.list_(pa.string()))
            yield pa.RecordBatch.from_pydict(out)

    return scan


def find_spans(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
    carry: tuple[str, ...] = (),
    then: MapArrow | None = None,
    schema: T.StructType | None = None,
) -> DataFrame:
    """``doc_id, text`` with ``n_words``, merged word ``spans`` and ``items`` that occur.

    Columns named in ``carry`` come along in the struct ``carried``; others don't. With
    ``then`` the batches of the last pass go through it, in the same task, into ``schema``.

    NULL or empty texts have no words and no spans; items without words occur nowhere; an
    item_id that comes twice counts once; without items nothing is hit. ``block_bytes``
    bounds the item text that is brought to the driver and broadcast at a time.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").alias("phrase"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("phrase")), F.lit(0)).alias("bytes")).first()["bytes"]
    blocks = max(1, -(-int(size) // block_bytes))
    found = docs.select(
        "doc_id", "text", F.lit(0).cast("long").alias("n_words"),
        F.array().cast(SPANS).alias("spans"), F.array().cast("array<string>").alias("items"),
        F.struct(F.lit(0).alias("_"), *[F.col(c) for c in carry]).alias("carried"),
    )
    for block in range(blocks):
        part = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("item", "phrase"), F.lit(blocks)) == block)
        rows = [(r["item"], r["phrase"].encode() if r["phrase"] is not None else None) for r in part.toLocalIterator()]
        scan = _scan(spark.sparkContext.broadcast(Phrases(rows, window)))
        if then is not None and block == blocks - 1:
            return found.mapInArrow(lambda batches, scan=scan: then(scan(batches)), schema)
        found = found.mapInArrow(scan, found.schema)
    return found


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document: words, hit words, items that occur and a digest of their ids."""
    found = find_spans(docs, benchmark, window)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + (s["stop"] - s["start"]))
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"), "spans",
    )


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in chunks(batches):
        spans, out, gone = batch.column("spans").to_pylist(), [], []
        for text, cut in zip(texts, spans, strict=True):
            if cut:
                words, kept, at = Words([text], ALNUM), [], 0
                for s in cut:
                    kept.append(text[at : words.start[s["start"]]])
                    at = words.end[s["stop"] - 1]
                gone.append(sum(s["stop"] - s["start"] for s in cut) == len(words))
                text = b"".join([*kept, text[at:]])
            else:
                gone.append(False)
            out.append(text)
        yield pa.RecordBatch.from_pydict(
            {
                "doc_id": batch.column("doc_id"),
                "text": pa.array(out, pa.binary()).cast(pa.string()),
                "gone": pa.array(gone),
                "carried": batch.column("carried"),
            }
        )


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, carry: tuple[str, ...] = ()) -> DataFrame:
    """Texts without their spans. A document that held nothing else goes.

    Returns ``doc_id, text`` and the columns of ``carry``; NULL texts stay NULL.
    """
    kept = F.struct(F.lit(0).alias("_"), *[F.col(c) for c in carry]).alias("carried")
    schema = docs.select("doc_id", "text", F.lit(False).alias("gone"), kept).schema
    clean = find_spans(docs, benchmark, window, carry=carry, then=_cut, schema=schema).filter(~F.col("gone"))
    return clean.select("doc_id", "text", *[F.col("carried")[c].alias(c) for c in carry])
