"""Toxicity: a linear classifier whose scores don't hang on which group a text mentions.

Features are words by presence. They are chosen by a chi-square test on the labelled texts,
identity terms always among them. The loss adds, for every labelled text with identity
terms, the squared change of its score when a term is swapped for another of its kind or
left out. The weights are fitted on a bounded sample of labelled rows, the score is one
lookup a word in a table of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seasonframe.llm.common import ALNUM, MapArrow, Words, chunks

SAMPLE = 16384
"""Labelled rows that the weights are fitted on; with more, those of the least hashed doc_id."""

FEATURES = 4096
CHI_SQUARE = 15.1
"""Value that an irrelevant word exceeds once in 10,000."""

PENALTY = 10.0
RIDGE = 1e-5
STEPS = 400

#: Terms of one kind can stand for each other.
IDENTITY = (
    ("christian", "muslim", "jewish", "hindu", "buddhist", "sikh", "atheist", "catholic", "protestant"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "sikhs", "atheists", "catholics", "protestants"),
    ("black", "white", "asian", "latino", "african", "european", "arab", "indigenous"),
    ("man", "woman", "boy", "girl"),
    ("men", "women", "boys", "girls"),
    ("male", "female", "transgender", "nonbinary"),
    ("gay", "straight", "lesbian", "bisexual", "queer", "heterosexual"),
    ("immigrant", "refugee", "foreigner", "native"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("deaf", "blind", "disabled", "autistic"),
    ("old", "young", "elderly", "teenage"),
)


@dataclass
class Model:
    """Sorted word hashes with their weights, and the score of a text without any."""

    words: np.ndarray
    weights: np.ndarray
    bias: float


def term_hashes(groups: tuple[tuple[str, ...], ...]) -> tuple[np.ndarray, np.ndarray]:
    terms = [t.encode() for g in groups for t in g]
    kind = np.repeat(np.arange(len(groups)), [len(g) for g in groups])
    return Words([b" ".join(terms)], ALNUM).hash, kind


def fit(texts: list[np.ndarray], labels: np.ndarray, penalty: float = PENALTY, groups: tuple[tuple[str, ...], ...] = IDENTITY) -> Model:
    """Weights from distinct word hashes per text. Repeated texts count once; without texts
    of both labels there are no weights and the bias is the smoothed share of label 1."""
    distinct = {(t.tobytes(), int(y)): (t, y) for t, y in zip(texts, labels, strict=True)}
    texts, labels = [t for t, _ in distinct.values()], np.array([y for _, y in distinct.values()], float)
    n, positive = len(texts), float(labels.sum())
    bias = float(np.log((positive + 0.5) / (n - positive + 0.5))) if n else -20.0
    if not 0 < positive < n:
        return Model(np.empty(0, np.uint64), np.empty(0), bias)
    flat = np.concatenate(texts)
    row = np.repeat(np.arange(n), [len(t) for t in texts])
    words, at = np.unique(flat, return_inverse=True)
    seen = np.bincount(at, minlength=len(words)).astype(float)
    hits = np.bincount(at, weights=labels[row], minlength=len(words))
    spread = seen * (n - seen) * positive * (n - positive)
    chi = n * (hits * n - seen * positive) ** 2 / np.maximum(spread, 1)
    terms, kind = term_hashes(groups)
    chosen = np.argsort(-chi, kind="stable")[:FEATURES]
    chosen = chosen[(chi[chosen] > CHI_SQUARE) & (seen[chosen] >= 5)]
    known = np.unique(np.r_[words[chosen], terms])
    column = np.minimum(np.searchsorted(known, flat), len(known) - 1)
    own = known[column] == flat
    row, column = row[own], column[own]

    # Changes of the features under a swap or removal of a term, as a quadratic form.
    place = np.searchsorted(known, terms)
    kind_of, slot_of = np.full(len(known), -1), np.full(len(known), -1)
    kind_of[place], slot_of[place] = kind, np.arange(len(terms))
    form = np.zeros((len(terms), len(terms)))
    named = kind_of[column] >= 0
    texts_with = max(1, len(np.unique(row[named])))
    present = set(zip(row[named].tolist(), slot_of[column[named]].tolist(), strict=True))
    for r, term in present:
        for other in [*np.flatnonzero(kind == kind[term]).tolist(), None]:
            if other != term:
                change = np.zeros(len(terms))
                change[term] = -1
                if other is not None and (r, other) not in present:
                    change[other] = 1
                form += np.outer(change, change) / texts_with
    # Adam on the regularised logistic loss.
    w = np.zeros(len(known) + 1)
    w[-1] = bias
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, STEPS + 1):
        z = np.bincount(row, weights=w[column], minlength=n) + w[-1]
        error = 1 / (1 + np.exp(-z)) - labels
        grad = np.r_[np.bincount(column, weights=error[row], minlength=len(known)), error.sum()] / n
        grad[:-1] += RIDGE * w[:-1]
        grad[place] += 2 * penalty * form @ w[place]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        rate = 0.1 * (1 - step / (STEPS + 1))
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return Model(known, w[:-1], float(w[-1]))


def _distinct_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in chunks(batches):
        words = Words(texts, ALNUM)
        sets = [np.unique(words.hash[a:b]).tobytes() for a, b in zip(words.offset[:-1], words.offset[1:], strict=True)]
        yield pa.RecordBatch.from_pydict({"words": pa.array(sets, pa.binary()), "label": batch.column("label")})


def _score(shared) -> MapArrow:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        size = max(1, len(model.words))
        for batch, texts in chunks(batches):
            words = Words(texts, ALNUM)
            z = np.full(len(texts), model.bias)
            if len(model.words):
                at = np.minimum(np.searchsorted(model.words, words.hash), size - 1)
                own = model.words[at] == words.hash
                cell = np.unique(words.text_of()[own] * size + at[own])
                z += np.bincount(cell // size, weights=model.weights[cell % size], minlength=len(texts))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "text": batch.column("text"), "z": pa.array(z), "carried": batch.column("carried")})

    return score


def train(docs: DataFrame, labels: DataFrame, penalty: float = PENALTY, sample: int = SAMPLE) -> Model:
    """Fit on ``labels`` (``doc_id, toxic``), at most ``sample`` of its rows.

    Rows with a NULL id or label are left out; an id that comes twice has its greatest label.
    """
    named = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    chosen = named.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "label")
    rows = rows.mapInArrow(_distinct_words, "words binary, label int")

    def fitted(part: pd.DataFrame) -> pd.DataFrame:
        model = fit([np.frombuffer(w, np.uint64) for w in part["words"]], part["label"].to_numpy(), penalty)
        return pd.DataFrame({"words": [model.words.tobytes()], "weights": [model.weights.tobytes()], "bias": [model.bias]})

    found = rows.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(fitted, "words binary, weights binary, bias double").first()
    if found is None:
        return Model(np.empty(0, np.uint64), np.empty(0), -20.0)
    return Model(np.frombuffer(found["words"], np.uint64), np.frombuffer(found["weights"]), found["bias"])


def score(docs: DataFrame, model: Model, carry: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, text, score, predicted`` and the columns of ``carry``.

    NULL and empty texts have the score of a text without known words.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select("doc_id", "text", F.struct(F.lit(0).alias("_"), *[F.col(c) for c in carry]).alias("carried"))
    schema = rows.withColumn("z", F.lit(0.0)).select("doc_id", "text", "z", "carried").schema
    found = rows.mapInArrow(_score(shared), schema).withColumn("score", 1 / (1 + F.exp(-F.col("z"))))
    return found.select(
        "doc_id", "text", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), *[F.col("carried")[c].alias(c) for c in carry]
    )
