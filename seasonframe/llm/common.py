"""What the operators share: words as 64-bit hashes, bounded chunks, intermediate tables.

A word is identified by a 64-bit hash of its bytes, a run of words by the combined hashes
of its words. Everything that is counted or compared across documents uses these hashes;
where two texts are declared equal over many documents, 128 bits stand behind it.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame, SparkSession

CHUNK_BYTES = 2 << 20
"""Text that one step of a task holds as arrays; a longer document is a chunk of its own."""

_PIECE = 1 << 16
_LONG_WORD = 4096


def _table(lower: bool, apart: bytes) -> bytes:
    out = bytearray(range(256))
    for byte in apart:
        out[byte] = 32
    if lower:
        for byte in range(65, 91):
            out[byte] = byte + 32
    return bytes(out)


WHITESPACE = bytes(range(9, 14))
#: Words between ASCII white space, unchanged.
EXACT = _table(False, WHITESPACE)
#: The same with A-Z lower-cased.
LOWER = _table(True, WHITESPACE)
#: Runs of digits, a-z and all that is not ASCII, with A-Z lower-cased.
ALNUM = _table(True, bytes(b for b in range(128) if not chr(b).isalnum()))

_rng = np.random.default_rng(20240601)
_BYTE = _rng.integers(0, 1 << 64, 256, dtype=np.uint64, endpoint=False)
_BASE = int(_rng.integers(0, 1 << 63, dtype=np.uint64)) * 2 + 1
_POWER = np.cumprod(np.r_[np.uint64(1), np.full(_PIECE + _LONG_WORD, _BASE, np.uint64)])
_INVERSE = np.cumprod(np.r_[np.uint64(1), np.full(_PIECE + _LONG_WORD, pow(_BASE, -1, 1 << 64), np.uint64)])


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64 bits, one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of an ordered pair of hashes."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + b
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


class Words:
    """The words of a list of texts, as arrays over all of them.

    ``hash``, ``start`` and ``end`` (bytes in ``data``) have one entry a word; text ``i``
    has the words ``offset[i]`` to ``offset[i + 1]``. NULL texts have no words.
    """

    def __init__(self, texts: list[bytes | None], table: bytes) -> None:
        self.data = b" ".join([t or b"" for t in texts]).translate(table)
        sizes = np.fromiter((len(t) + 1 if t else 1 for t in texts), np.int64, len(texts))
        self.text_start = np.r_[0, np.cumsum(sizes)][:-1]
        raw = np.frombuffer(self.data, np.uint8)
        solid = np.zeros(len(raw) + 2, bool)
        np.not_equal(raw, 32, out=solid[1:-1])
        edge = np.flatnonzero(solid[1:] != solid[:-1])
        self.start, self.end = edge[0::2], edge[1::2]
        self.offset = np.r_[np.searchsorted(self.start, self.text_start), len(self.start)].astype(np.int64)
        self.hash = self._hashes(raw)

    def __len__(self) -> int:
        return len(self.start)

    def _hashes(self, raw: np.ndarray) -> np.ndarray:
        out = np.empty(len(self.start), np.uint64)
        first = 0
        while first < len(out):
            base = self.start[first]
            last = int(np.searchsorted(self.end, base + _PIECE, "right"))
            if last <= first or self.end[last - 1] - base > _PIECE:
                last = first + 1
            s, e = self.start[first:last] - base, self.end[first:last] - base
            if e[-1] <= _PIECE:
                sums = np.zeros(int(e[-1]) + 1, np.uint64)
                np.cumsum(_BYTE[raw[base : base + e[-1]]] * _POWER[: e[-1]], out=sums[1:])
                out[first:last] = (sums[e] - sums[s]) * _INVERSE[s]
            for k in np.flatnonzero(e - s > _LONG_WORD):
                out[first + k] = xxhash.xxh3_64_intdigest(raw[base + s[k] : base + e[k]].tobytes())
            first = last
        return mix(out)

    def counts(self) -> np.ndarray:
        return np.diff(self.offset)

    def text_of(self) -> np.ndarray:
        """The number of the text that each word stands in."""
        return np.repeat(np.arange(len(self.offset) - 1), self.counts())

    def room(self) -> np.ndarray:
        """Words from each word to the end of its text, itself included."""
        return np.repeat(self.offset[1:], self.counts()) - np.arange(len(self))


def runs(h: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all runs of ``length`` consecutive words, by where they start."""
    if len(h) < length:
        return np.empty(0, np.uint64)
    got, size, power, reach = None, 0, h, 1
    while True:
        if length & reach:
            if got is None:
                got, size = power, reach
            else:
                n = min(len(got), len(power) - size)
                got, size = pair(got[:n], power[size : size + n]), size + reach
        if size == length:
            return got
        power = pair(power[:-reach], power[reach:])
        reach *= 2


def chunks(batches: Iterator[pa.RecordBatch], size: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Slices of the batches with their column ``text`` as bytes, about ``size`` bytes each."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index("text"))
        lengths = np.asarray(pa.compute.binary_length(column).fill_null(0))
        part = np.cumsum(lengths.astype(np.int64)) // size
        cuts = np.r_[0, np.flatnonzero(part[1:] != part[:-1]) + 1, len(part)] if len(part) else [0]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            piece = column.slice(a, b - a).cast(pa.binary())
            yield batch.slice(a, b - a), piece.to_pylist()


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it.

    Only a local session that names none gets a temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        named = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def stored(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write an intermediate table to the shared folder and read it again, in a folder for each
    value of ``by`` if that is given.

    Later steps read columns they need and start from the files, whatever executor is lost.
    The shuffle files behind the table go once it is written.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        (df.write.partitionBy(by) if by else df.write).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before) if before is not None else spark.conf.unset(_CLEANUP)
    return spark.read.schema(df.schema).parquet(path)


def plain_columns(df: DataFrame, needed: list[str]) -> DataFrame:
    """Only the columns an operator reads, so that extra ones can clash with nothing."""
    return df.select(*[df[c] for c in needed])


MapArrow = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
