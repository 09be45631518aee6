"""Spelling variants: words one edit apart, found by walking a trie of all words level by level.

The trie is a table of edges, built from hashes of prefixes: a prefix that goes on in two
ways is a node, and what lies between two nodes of a word is the label of one edge, so that
a long word has as many edges as others turn off from it. Every word ends with a mark and
thus on an edge of its own, a leaf.

All words walk down from the root at once. The frontier holds ``(word, position, node,
edits)``; joined with the edges of its level it moves on along labels that match, and, while
no edit is made, along those that match after one. A state with an edit goes on only where
the node below continues with the word's next letters. States that reach a leaf with just the
one edit are neighbours.

Near the root everything branches, so no edits are made there: a word whose edit lies in its
first half is found from its end, in a second trie of the words reversed. Both are walked in
the same steps, and in either a word is followed along its one path to its middle.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seasonframe.llm.common import MapArrow, chunks, stored
from seasonframe.operators.skew import salted_lookup

END = "\0"
"""The mark behind each word. Words can't hold it."""

STATES = 8192
"""Words for which the edges of a node are repeated once more, so that a join splits them."""


def _root(side: int) -> bytes:
    return xxhash.xxh3_128(bytes([side])).digest()


FAR = 3
"""Symbols from which on a node tells two symbols of how its words go on, not one."""

_LETTER = re.compile("[A-Za-zÀ-ÿ]")
_LOWER = {c: c + 32 for c in range(65, 91)}
_PIECE = 1 << 22
_HELD = 1 << 18


def _counter(text: str, runs: re.Pattern) -> Counter:
    """How often each of the runs occurs in a text, which is taken in pieces that end between runs."""
    if len(text) <= _PIECE:
        return Counter(runs.findall(text))
    out, first = Counter(), 0
    while first < len(text):
        last = first + _PIECE
        while last < len(text) and _LETTER.match(text, last - 1, last):
            last += 1
        out.update(runs.findall(text, first, last))
        first = last
    return out


def _count(least: int, slips: int | None) -> MapArrow:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A run as it stands in the text, with its lower-cased form, that in bytes, and its count.
        runs = re.compile(f"[A-Za-zÀ-ÿ]{{{max(1, least)},}}")
        held: dict[str, list] = {}
        slipped: Counter = Counter()

        def out() -> pa.RecordBatch:
            words = [*(form[0] for form in held.values()), *slipped]
            counts = [*(form[2] for form in held.values()), *slipped.values()]
            held.clear()
            slipped.clear()
            return pa.RecordBatch.from_pydict({"word": pa.array(words, pa.string()), "n": pa.array(counts, pa.int64())})

        crc32 = zlib.crc32
        for batch, texts in chunks(batches):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts, strict=True):
                if not text:
                    continue
                start = crc32(f"{doc_id}:".encode())
                slips_here = slips if doc_id is not None else None
                for run, n in _counter(text.decode("utf-8", "replace"), runs).items():
                    form = held.get(run)
                    if form is None:
                        word = run if run.islower() else run.translate(_LOWER)
                        form = held[run] = [word, word.encode(), 0]
                    if slips_here:
                        h = crc32(form[1], start)
                        if h % slips_here == 0:
                            word, at = form[0], h % len(form[0])
                            if len(word) > least:
                                slipped[word[:at] + word[at + 1 :]] += n
                            continue
                    form[2] += n
                if len(held) >= _HELD:
                    yield out()
        yield out()

    return count


def vocabulary(docs: DataFrame, least_length: int = 6, least_count: int = 5, slips: int | None = None) -> DataFrame:
    """``word, n``: runs of A-Z, a-z and U+00C0 to U+00FF of whole texts, A-Z lower-cased, with
    so many code points and occurrences at least.

    With ``slips``, a run of a document of which the crc32 of ``<doc_id>:<run>`` is a multiple of
    it has lost the code point at that crc32 modulo its length: misspellings of a known rate.
    NULL texts have no words; rows without doc_id lose nothing; every row counts.
    """
    found = docs.select("doc_id", "text").mapInArrow(_count(least_length, slips), "word string, n long").filter("n > 0")
    return found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All prefixes of each word, read from either side, with the two symbols that come next; a digest stands for a prefix."""
    schema = pa.schema([("id", pa.int64()), ("side", pa.int8()), ("at", pa.int32()), ("node", pa.binary()), ("next", pa.string())])
    for batch in batches:
        rows = []
        for k, word in zip(batch.column("id").to_pylist(), batch.column("word").to_pylist(), strict=True):
            if END in word:
                raise ValueError("a word holds the end mark")
            for side, text in ((0, word), (1, word[::-1])):
                state = xxhash.xxh3_128(bytes([side]))
                text += END
                for at, symbol in enumerate(text):
                    rows.append((k, side, at, state.digest(), text[at : at + 2]))
                    state.update(symbol.encode())
                    if len(rows) >= _HELD:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                        rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


def trie(words: DataFrame) -> DataFrame:
    """The edge table of both tries: ``level, node, salt, edges``, a row for each node and salt.

    ``words`` has ``id, word``. An edge has ``label, child, copies, next, width, word``: the node below it with
    its number of salts and the ``width`` symbols that words go on with there, or the word that ends
    on it.
    ``level`` counts the edges from the root.
    """
    prefixes = stored(words.mapInArrow(_prefixes, "id long, side byte, at int, node binary, next string"), "prefixes")
    # A root is a node whether it goes on in one way or more.
    symbol = F.substring("next", 1, 1)
    info = prefixes.groupBy("node").agg(
        F.count("*").alias("words"), F.collect_set("next").alias("pairs"), F.min("at").alias("at"), F.min(symbol).alias("low"), F.max(symbol).alias("high")
    )
    # Near the root there are few edits to look ahead for, and many pairs.
    singles = F.array_distinct(F.transform("pairs", lambda x: F.substring(x, 1, 1)))
    far = F.col("at") >= FAR
    info = info.filter("low <> high OR at = 0").select(
        "node", "words", F.when(far, F.col("pairs")).otherwise(singles).alias("next"), F.when(far, 2).otherwise(1).alias("width")
    )
    info = stored(info, "nodes")
    passed = salted_lookup(prefixes.select("id", "side", "at", "node"), info.select("node", "words"), ["node"], ["id"], "inner")
    path = passed.groupBy("id", "side").agg(F.array_sort(F.collect_list(F.struct("at", "node", "words"))).alias("path"))
    steps = path.join(words, "id").select(F.concat(F.when(F.col("side") == 0, F.col("word")).otherwise(F.reverse("word")), F.lit(END)).alias("w"), F.col("word").alias("whole"), "path", F.posexplode("path").alias("level", "step"))
    below = F.get("path", F.col("level") + 1)
    last = F.when(below.isNull(), F.length("w")).otherwise(below["at"])
    steps = steps.select(
        "level", F.col("step.node").alias("node"), F.ceil(F.col("step.words") / STATES).cast("int").alias("copies"),
        F.substring("w", F.col("step.at") + 1, last - F.col("step.at")).alias("label"), below["node"].alias("child"),
        F.when(below.isNull(), F.col("whole")).alias("word"),
    )
    edges = stored(steps.distinct(), "edges")
    edges_below = edges.join(info.select(F.col("node").alias("child"), "next", "width"), "child", "left")
    entry = F.struct("label", "child", "copies", "next", "width", "word")
    nodes = edges_below.groupBy("level", "node").agg(F.collect_list(entry).alias("edges"))
    root = edges.filter("level = 0").select("node", "copies").distinct()
    above = edges.filter("child IS NOT NULL").select(F.col("child").alias("node"), "copies").unionByName(root)
    nodes = nodes.join(above, "node")
    return nodes.select("level", "node", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("salt"), "edges")


_STEP = "substring(w, pos + 1, length(label)) = label"
_FREE = "greatest(first - pos, 0)"
"""Symbols of a label that lie before the first place where an edit may be."""

_EDIT = f"""edits = 0 AND length(label) > {_FREE} AND length(substring(w, pos + 1, length(label) + {{d}})) = length(label) + {{d}}
AND substring(w, pos + 1, {_FREE}) = substring(label, 1, {_FREE})
AND levenshtein(substring(w, pos + {_FREE} + 1, length(label) - {_FREE} + {{d}}), substring(label, {_FREE} + 1), 1) = 1"""


def _moves(states: DataFrame) -> DataFrame:
    """States with the edges they may take, moved along labels that match, and along those one edit away."""
    ways = [F.struct(F.expr("pos + length(label)").alias("to"), F.col("edits").alias("made"), F.expr(_STEP).alias("fits"))]
    for d in (-1, 0, 1):
        ways.append(F.struct(F.expr(f"pos + length(label) + {d}").alias("to"), F.lit(1).alias("made"), F.expr(_EDIT.format(d=d)).alias("fits")))
    moved = states.select("w", "first", "side", "child", "copies", "next", "width", "word", F.inline(F.array(*ways))).filter("fits")
    goes_on = "CASE WHEN child IS NULL THEN made = 1 AND to = length(w) ELSE made = 0 OR array_contains(next, substring(w, to + 1, width)) END"
    return moved.filter(goes_on)


def neighbours(words: DataFrame) -> DataFrame:
    """``word, other``: all ordered pairs of different words that one inserted, deleted or
    replaced code point makes equal. ``words`` has ``word``; NULL and repeated words count once."""
    listed = words.select("word").filter("word IS NOT NULL").distinct().withColumn("id", F.monotonically_increasing_id())
    listed = stored(listed, "listed")
    edges = stored(trie(listed), "trie", by="level")
    deepest = edges.agg(F.max("level")).first()[0]
    salt = F.pmod(F.xxhash64("w"), "copies").cast("int")
    copies = F.lit(-(-listed.count() // STATES)).alias("copies")
    half = F.floor(F.length("word") / 2).cast("int")
    both = [
        listed.select(F.concat(text, F.lit(END)).alias("w"), first.alias("first"), F.lit(side).alias("side"), F.lit(_root(side)).alias("node"), copies)
        for side, text, first in ((0, F.col("word"), half), (1, F.reverse("word"), F.length("word") - half))
    ]
    state = both[0].unionByName(both[1]).withColumn("salt", salt).drop("copies").withColumns({"pos": F.lit(0), "edits": F.lit(0)})
    found = None
    for level in range(-1 if deepest is None else deepest + 1):
        here = edges.filter(F.col("level") == level).select("node", "salt", "edges")
        symbol = F.substring("w", F.col("pos") + 1, F.lit(1))
        bound = (F.col("edits") == 1) | (F.col("pos") < F.col("first"))
        taken = F.filter("edges", lambda e: ~bound | (F.substring(e["label"], 1, 1) == symbol))  # noqa: B023
        met = state.join(here, ["node", "salt"]).select("w", "pos", "edits", "first", "side", F.inline(taken))
        moved = _moves(met).select("w", F.col("to").alias("pos"), F.col("made").alias("edits"), "first", "side", F.col("child").alias("node"), salt.alias("salt"), "word")
        moved = stored(moved, "frontier")
        own = F.expr("substring(w, 1, length(w) - 1)")
        ended = moved.filter("node IS NULL").select(F.when(F.col("side") == 0, own).otherwise(F.reverse(own)).alias("word"), F.col("word").alias("other"))
        found = ended if found is None else found.unionByName(ended)
        state = moved.filter("node IS NOT NULL").drop("word")
    if found is None:
        return listed.select("word", F.col("word").alias("other")).limit(0)
    return found.distinct()


def variants(words: DataFrame, ratio: int = 5) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for every word.

    ``words`` has ``word, n``. A word's form is the most frequent of its neighbours (ties: the smaller
    in code-point order), if that occurs at least ``ratio`` times as often; else NULL. Its root is
    reached by following forms to the last; without a form it is the word itself. ``n_near``
    counts the neighbours. Rows that repeat a word are added up; rows with NULL in either column
    take no part. Columns beyond these are not read.
    """
    if ratio < 2:
        raise ValueError("a form must occur more often than its word")
    words = words.select("word", "n").filter("word IS NOT NULL AND n IS NOT NULL").groupBy("word").agg(F.sum("n").alias("n"))
    words = stored(words, "words")
    near = salted_lookup(neighbours(words), words.select(F.col("word").alias("other"), F.col("n").alias("other_n")), ["other"], ["word"], "inner")
    near = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("minus"), "other")).alias("top"))
    fits = -F.col("top.minus") >= ratio * F.col("n")
    out = words.join(near, "word", "left").select(
        "word", F.when(fits, F.col("top.other")).alias("form"), "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, -F.col("top.minus")).alias("form_n"),
    )
    out = stored(out, "forms")

    # Counts grow along forms by the ratio, so chains are short; each round doubles what they skip.
    links = out.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        further = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        jumped = salted_lookup(links, further, ["root"], ["word"]).select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        jumped = stored(jumped, "roots")
        links = jumped.select("word", "root")
        if jumped.filter("moved").isEmpty():
            break
    out = out.join(links, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
