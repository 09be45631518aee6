"""LM scoring: a bigram Katz model over words, counted and looked up in blocks of documents.

Documents are hashed into blocks. A block sends its distinct words and bigrams with their
training counts to parts of the key space, sorted and packed, and gets the whole corpus'
counts back in the same order, so answers carry no keys. Discounts follow Good-Turing.
Of every seen bigram one block is the owner; the owners add up, by context, the discounted
probabilities and the lower-order probabilities of what was seen, from which the parts
give back the backoff weights. Scoring then looks at each token: the bigram if it was seen,
else the context's weight times the word, and below that the mass of unknown words.

Tables of counts and weights are partitioned by block and part. No step holds more
than a block, or a part, of bounded size, and every key is sent once a block, so a word or
pair that fills a third of the corpus is a few hundred rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seasonframe.llm.common import LOWER, Words, pair, stored

BLOCK_BYTES = 12 << 20
ROW_BYTES = 64
CUT = 5
"""Counts up to this have Good-Turing discounts."""

_END, _START = np.uint64(0x5EED0000000000E1), np.uint64(0x5EED0000000000A7)


def pack(a: np.ndarray) -> bytes:
    """Compressed by bytes of equal weight, which are alike in neighbouring numbers."""
    planes = np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(data: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).view(kind).reshape(-1)


def pack_keys(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, "u8"), dtype=np.uint64)


def cuts(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where the parts of the key space begin in sorted keys."""
    edges = np.array([-(-(p << 64) // parts) for p in range(parts)], np.uint64)
    return np.r_[np.searchsorted(keys, edges), len(keys)]


@dataclass(frozen=True)
class Discounts:
    """Shares of a count that stay, for counts 0 to CUT, and the counts that larger ones lose."""

    small: tuple[float, ...]
    large: float

    def kept(self, count: np.ndarray) -> np.ndarray:
        """Discounted counts."""
        small = np.array(self.small)[np.minimum(count, CUT)]
        return np.where(count <= CUT, small * count, count - self.large)


def good_turing(n: list[int]) -> Discounts:
    """From how many keys have count 1, 2, ... CUT + 1.

    Where the estimates are no proper discounts, as in small data, one and the same part of
    a count is taken off instead. Counts above CUT lose as much as CUT does, so that every
    context has something left for what it hasn't seen.
    """
    r = np.arange(1, CUT + 1)
    counts = np.array([*n, 0], float)
    with np.errstate(divide="ignore", invalid="ignore"):
        common = (CUT + 1) * counts[CUT] / counts[0]
        d = ((r + 1) * counts[1 : CUT + 1] / counts[:CUT] / r - common) / (1 - common)
    if not (np.isfinite(d).all() and (d > 0).all() and (d < 1).all()):
        off = counts[0] / (counts[0] + 2 * counts[1]) if counts[0] else 0.5
        off = min(0.9, max(0.1, off))
        d = (r - off) / r
    return Discounts((0.0, *d.tolist()), float(CUT * (1 - d[-1])))


@dataclass(frozen=True)
class Model:
    """What holds for the whole corpus."""

    tokens: int
    types: int
    unigram: Discounts
    bigram: Discounts
    unknown: float
    """Probability of all words that training hasn't seen, as one word."""

    def lower(self, count: np.ndarray) -> np.ndarray:
        """Unigram probabilities by training count."""
        return np.where(count > 0, self.unigram.kept(count) / max(1, self.tokens), self.unknown)


class Block:
    """Tokens of a block's documents: words, then one end each, by number of distinct word."""

    def __init__(self, docs: pa.Table) -> None:
        texts = docs.column("text").combine_chunks().cast(pa.binary()).to_pylist()
        words = Words(texts, LOWER)
        sizes = words.counts() + 1
        self.first = np.r_[0, np.cumsum(sizes)]
        token = np.full(self.first[-1], _END, np.uint64)
        token[np.arange(len(words)) + words.text_of()] = words.hash
        before = np.r_[_START, token[:-1]]
        before[self.first[:-1]] = _START
        self.train = np.repeat(np.asarray(docs.column("train").combine_chunks()), sizes)
        self.words, self.word = np.unique(token, return_inverse=True)
        self.pairs, at, self.pair = np.unique(pair(before, token), return_index=True, return_inverse=True)
        starts = np.zeros(len(token), bool)
        starts[self.first[:-1]] = True
        context = np.where(starts, len(self.words), np.r_[0, self.word[:-1]])
        self.context = context
        self.pair_word, self.pair_context = self.word[at], context[at]
        self.contexts = np.r_[self.words, _START]

    def counted(self, which: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(which, weights=self.train, minlength=size).astype(np.uint32)

    def take(self, answers: pa.Table) -> None:
        """Counts of the corpus, from the answers of all parts."""
        rows = sorted((r for r in answers.to_pylist() if r["kind"] == 0), key=lambda r: r["part"])
        self.word_count = np.concatenate([unpack(r["a"], "u4") for r in rows]).astype(np.int64)
        self.pair_count = np.concatenate([unpack(r["b"], "u4") for r in rows]).astype(np.int64)
        self.owned = np.concatenate([unpack(r["c"], "u1") for r in rows]).astype(bool)
        end = np.searchsorted(self.words, _END)
        self.context_count = np.r_[self.word_count, self.word_count[end]]

    def asked(self) -> np.ndarray:
        """Contexts whose backoff weight this block needs."""
        unseen = self.pair_context[self.pair_count == 0]
        ask = np.zeros(len(self.contexts), bool)
        ask[unseen] = True
        return ask & (self.context_count > 0)


_PACKED = pa.schema([("part", pa.int32()), ("block", pa.int32()), *((c, pa.binary()) for c in "abcd")])
_ANSWER = pa.schema(
    [("block", pa.int32()), ("part", pa.int32()), ("kind", pa.int32()), *((c, pa.binary()) for c in "abc"), ("stats", pa.list_(pa.int64()))]
)


def _send_counts(parts: int):
    def send(docs: pa.Table) -> pa.Table:
        block, number = Block(docs), docs.column("block")[0].as_py()
        n = block.counted(block.word, len(block.words)), block.counted(block.pair, len(block.pairs))
        x, y = cuts(block.words, parts), cuts(block.pairs, parts)
        rows = [
            {
                "part": p, "block": number,
                "a": pack_keys(block.words[x[p] : x[p + 1]]), "b": pack(n[0][x[p] : x[p + 1]]),
                "c": pack_keys(block.pairs[y[p] : y[p + 1]]), "d": pack(n[1][y[p] : y[p + 1]]),
            }
            for p in range(parts)
        ]
        return pa.Table.from_pylist(rows, _PACKED)

    return send


def _totals(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Of the same keys in several blocks: totals and owners for each block, and all totals."""
    sizes = np.cumsum([len(k) for k in keys])[:-1]
    every, n = np.concatenate(keys), np.concatenate(counts)
    distinct, at = np.unique(every, return_inverse=True)
    total = np.bincount(at, weights=n, minlength=len(distinct)).astype(np.uint32)
    owner = np.zeros(len(every), np.uint8)
    trained = np.flatnonzero(n)
    owner[trained[np.unique(at[trained], return_index=True)[1]]] = 1
    return np.split(total[at], sizes), np.split(owner, sizes), total


def _answer_counts(part: pa.Table) -> pa.Table:
    rows = sorted(part.to_pylist(), key=lambda r: r["block"])
    words, _, all_words = _totals([unpack_keys(r["a"]) for r in rows], [unpack(r["b"], "u4") for r in rows])
    pairs, owned, all_pairs = _totals([unpack_keys(r["c"]) for r in rows], [unpack(r["d"], "u4") for r in rows])
    stats = [int(all_words.sum()), int((all_words > 0).sum())]
    for n in (all_words, all_pairs):
        stats += np.bincount(np.minimum(n, CUT + 2), minlength=CUT + 3)[1 : CUT + 2].tolist()
    out = [{"part": rows[0]["part"], "kind": 2, "stats": stats}]
    for r, w, p, o in zip(rows, words, pairs, owned, strict=True):
        out.append({"block": r["block"], "part": r["part"], "kind": 0, "a": pack(w), "b": pack(p), "c": pack(o)})
    return pa.Table.from_pylist(out, _ANSWER)


def _send_sums(parts: int, model: Model):
    def send(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _PACKED.empty_table()
        block, number = Block(docs), docs.column("block")[0].as_py()
        block.take(answers)
        own = np.flatnonzero(block.owned & (block.pair_count > 0))
        context, size = block.pair_context[own], len(block.contexts)
        seen = np.bincount(context, weights=model.bigram.kept(block.pair_count[own]) / block.context_count[context], minlength=size)
        lower = np.bincount(context, weights=model.lower(block.word_count[block.pair_word[own]]), minlength=size)
        ask = block.asked()
        use = np.flatnonzero(ask | (seen > 0))
        use = use[np.argsort(block.contexts[use], kind="stable")]
        keys = block.contexts[use]
        x = cuts(keys, parts)
        rows = []
        for p in range(parts):
            own = use[x[p] : x[p + 1]]
            rows.append(
                {
                    "part": p, "block": number, "a": pack_keys(keys[x[p] : x[p + 1]]),
                    "b": pack(seen[own]), "c": pack(lower[own]), "d": pack(ask[own].astype(np.uint8)),
                }
            )
        return pa.Table.from_pylist(rows, _PACKED)

    return send


def _answer_sums(part: pa.Table) -> pa.Table:
    rows = sorted(part.to_pylist(), key=lambda r: r["block"])
    keys = [unpack_keys(r["a"]) for r in rows]
    distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
    seen, lower = (np.bincount(at, weights=np.concatenate([unpack(r[c], "f8") for r in rows]), minlength=len(distinct)) for c in "bc")
    weight = ((1 - seen) / (1 - lower))[at]
    out, first = [], 0
    for r, k in zip(rows, keys, strict=True):
        ask = unpack(r["d"], "u1").astype(bool)
        out.append({"block": r["block"], "part": r["part"], "kind": 1, "a": pack(weight[first : first + len(k)][ask])})
        first += len(k)
    return pa.Table.from_pylist(out, _ANSWER)


SCORES = "doc_id long, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(model: Model):
    def score(docs: pa.Table, answers: pa.Table) -> pa.Table:
        block = Block(docs)
        block.take(answers)
        rows = sorted((r for r in answers.to_pylist() if r["kind"] == 1), key=lambda r: r["part"])
        asked = np.flatnonzero(block.asked())
        weight = np.ones(len(block.contexts))
        weight[asked[np.argsort(block.contexts[asked], kind="stable")]] = np.concatenate([unpack(r["a"], "f8") for r in rows])
        lower = model.lower(block.word_count)
        context = block.context_count[block.pair_context]
        seen = model.bigram.kept(block.pair_count) / np.maximum(context, 1)
        log = np.log10(np.where(block.pair_count > 0, seen, weight[block.pair_context] * lower[block.pair_word]))
        base = np.log10((block.word_count + 0.5) / (model.tokens + 0.5 * (model.types + 1)))

        def summed(x: np.ndarray) -> np.ndarray:
            return np.add.reduceat(x, block.first[:-1])

        return pa.table(
            {
                "doc_id": docs.column("doc_id"),
                "train": docs.column("train"),
                "n_tokens": np.diff(block.first),
                "n_known": summed((block.word_count > 0)[block.word].astype(np.int64)),
                "train_tokens": np.full(docs.num_rows, model.tokens),
                "base_score": summed(base[block.word]),
                "score": summed(log[block.pair]),
            }
        )

    return score


def katz_scores(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Scores of ``doc_id, text, train``, learnt from the rows with ``train``.

    Tokens are words, A-Z lower-cased, and one end. ``score`` is the model's log10
    probability of all of them, ``base_score`` that of smoothed word counts; ``n_known`` counts
    tokens that training has seen. NULL and empty texts are just an end; NULL ``train`` is
    false. Without training rows all words are the unknown one, and scores are 0.
    """
    # Every document counts some bytes, so that many without text fill many blocks too.
    cost = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + ROW_BYTES
    size = docs.agg(F.coalesce(F.sum(cost), F.lit(0)).alias("bytes")).first()["bytes"]
    blocks = max(1, -(-int(size) // block_bytes))
    rows = docs.select(
        F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int").alias("block"),
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("train", F.lit(False)).alias("train"), "text",
    )
    packed = "part int, block int, a binary, b binary, c binary, d binary"
    answer = "block int, part int, kind int, a binary, b binary, c binary, stats array<long>"

    sent = rows.groupBy("block").applyInArrow(_send_counts(blocks), packed)
    counts = stored(sent.groupBy("part").applyInArrow(_answer_counts, answer), "counts")
    stats = counts.filter("kind = 2").select(F.posexplode("stats").alias("at", "n")).groupBy("at").agg(F.sum("n").alias("n"))
    found = {r["at"]: r["n"] for r in stats.collect()}
    n = [int(found.get(k, 0)) for k in range(2 + 2 * (CUT + 1))]
    unigram, bigram = good_turing(n[2 : 3 + CUT]), good_turing(n[3 + CUT :])
    model = Model(n[0], n[1], unigram, bigram, _left(n[0], n[1], n[2 : 3 + CUT], unigram))

    counts = counts.filter("kind = 0")
    sent = rows.groupBy("block").cogroup(counts.groupBy("block")).applyInArrow(_send_sums(blocks, model), packed)
    weights = stored(sent.groupBy("part").applyInArrow(_answer_sums, answer), "weights")
    answers = counts.unionByName(weights)
    return rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_score(model), SCORES)


def _left(tokens: int, types: int, n: list[int], unigram: Discounts) -> float:
    """What the discounts leave of all tokens: n[r - 1] words have count r, the rest more."""
    lost = sum(n[r - 1] * r * (1 - unigram.small[r]) for r in range(1, CUT + 1))
    lost += (types - sum(n[:CUT])) * unigram.large
    return lost / tokens if tokens else 1.0
