"""Chat formatting: the cheapest repair of a conversation's roles, then its rendering.

Legal conversations are runs of an automaton: an optional system turn, then user and
assistant in turn. For each turn dynamic programming over the automaton's states keeps the
cheapest way to end in each role: keep the label or change it, then follow on, join the turn
to the one before, or put an empty turn in between. A long conversation is cut into ordered
segments, each reduced to its costs from state to state; these are combined, and the states
chosen go back to the segments.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seasonframe.llm.common import CHUNK_BYTES, MapArrow, stored

ROLES = ("system", "user", "assistant")
#: Names that stand for a role.
ALIASES = {"human": "user", "prompter": "user", "bot": "assistant", "gpt": "assistant", "model": "assistant"}
#: What may follow; None is the beginning.
NEXT = {None: ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}


@dataclass(frozen=True)
class Costs:
    merge: int = 1
    relabel: int = 3
    insert: int = 4


def repair(
    roles: list[str | None], costs: Costs = Costs(), closed: bool = False, start: str | None = None, end: str | None = None
) -> tuple[int, list[tuple[str, str]]]:
    """Least cost, and for each turn its role and ``step``, ``merge`` or ``insert:<role>``.

    Of equally cheap ways the one is kept that is found first, trying the states and roles
    in the order of ROLES and following on before joining before inserting. ``closed`` asks
    for an assistant turn at the end; where there is no turn the cost is 0. A segment of a
    conversation has the state before it as ``start`` and its last one as ``end``.
    """
    state: dict[str | None, int] = {start: 0}
    back: list[dict[str, tuple[str | None, str]]] = []
    for role in roles:
        best: dict[str, int] = {}
        via: dict[str, tuple[str | None, str]] = {}
        for target in ROLES:
            label = 0 if target == role else costs.relabel
            for before, paid in state.items():
                ways = []
                if target in NEXT[before]:
                    ways.append((0, "step"))
                if target == before:
                    ways.append((costs.merge, "merge"))
                ways += [(costs.insert, f"insert:{x}") for x in NEXT[before] if target in NEXT[x]]
                for price, how in ways:
                    total = paid + label + price
                    if total < best.get(target, total + 1):
                        best[target], via[target] = total, (before, how)
        state = best
        back.append(via)
    if not roles:
        return 0, []
    ends = [r for r in ("assistant", "user", "system") if r in state and (r == "assistant" or not closed)]
    end = end or min(ends, key=lambda r: state[r])
    cost, way = state[end], []
    for via in reversed(back):
        before, how = via[end]
        way.append((end, how))
        end = before
    return cost, way[::-1]


def _ways(target: str, costs: Costs) -> list[tuple[str | None, int, str]]:
    """All ``(before, price, how)`` into a role, in the order that ``repair`` tries them."""
    out: list[tuple[str | None, int, str]] = []
    for before in (None, *ROLES):
        if target in NEXT[before]:
            out.append((before, 0, "step"))
        if target == before:
            out.append((before, costs.merge, "merge"))
        out += [(before, costs.insert, f"insert:{x}") for x in NEXT[before] if target in NEXT[x]]
    return out


def matrix(roles: list[str | None], filled: list[bool], costs: Costs = Costs()) -> list[list]:
    """``start, end, cost, order, tail`` of the way that ``repair`` would take between two states.

    Of ways into one end from several starts that cost the same in all, ``repair`` takes the
    one of least ``order``. ``tail`` tells of the turn open at the end: 1 it has text, 2 it
    began here and has none, 0 all was merged into the turn open at the start, without text.
    """
    ways = {t: _ways(t, costs) for t in ROLES}
    state: dict = {s: {s: (0, 0, 0)} for s in (None, *ROLES)}
    for role, full in zip(roles, filled, strict=True):
        new = {}
        for target in ROLES:
            label, cell = 0 if target == role else costs.relabel, {}
            for k, (before, price, how) in enumerate(ways[target]):
                for start, (paid, order, tail) in state.get(before, {}).items():
                    total = paid + label + price
                    if start not in cell or total < cell[start][0]:
                        cell[start] = (total, (k, order), 1 if full else tail if how == "merge" else 2)
            rank = {key: k for k, key in enumerate(sorted(c[1] for c in cell.values()))}
            new[target] = {s: (total, rank[key], tail) for s, (total, key, tail) in cell.items()}
        state = new
    return [[s, t, *c] for t, cell in state.items() for s, c in cell.items()]


def join_segments(cells: list[list[list]], closed: bool = False) -> list[tuple[str | None, str, bool]]:
    """For each segment of a conversation its first state, its last, and whether the turn open
    before it has text, on the way that ``repair`` takes through the whole."""
    state: dict[str | None, int] = {None: 0}
    back = []
    for segment in cells:
        best: dict = {}
        for start, end, cost, order, tail in segment:
            if start in state:
                best[end] = min(best.get(end, (float("inf"),)), (state[start] + cost, order, tail, start), key=lambda x: x[:2])
        back.append(best)
        state = {end: x[0] for end, x in best.items()}
    end = min((r for r in ("assistant", "user", "system") if r in state and (r == "assistant" or not closed)), key=lambda r: state[r])
    way = []
    for best in reversed(back):
        _, _, tail, start = best[end]
        way.append((start, end, tail))
        end = start
    out, full = [], False
    for start, end, tail in reversed(way):
        out.append((start, end, full))
        full = tail == 1 or (tail == 0 and full)
    return out


def apply(way: list[tuple[str, str]], texts: list[str]) -> list[tuple[str, str]]:
    turns: list[tuple[str, str]] = []
    for (role, how), text in zip(way, texts, strict=True):
        if how == "merge":
            turns[-1] = (role, "\n\n".join(x for x in (turns[-1][1], text) if x))
        else:
            if how.startswith("insert:"):
                turns.append((how[7:], ""))
            turns.append((role, text))
    return turns


def render(turns: list[tuple[str, str]]) -> str:
    """Turns between markers; a marker inside a text is broken up."""
    return "".join(f"<|{role}|>\n{text.replace('<|', '< |')}\n" for role, text in turns)


def render_part(way: list[tuple[str, str]], texts: list[str], first: bool, last: bool, full: bool) -> tuple[list[str], str]:
    """Roles of the turns that begin in a segment, and its share of ``render`` of the whole.

    The end of a turn is written where the next one begins, as a segment doesn't know whether
    its last turn goes on. ``full`` tells whether the turn open before has text.
    """
    roles, out = [], []
    for (role, how), text in zip(way, texts, strict=True):
        if how != "merge":
            for name in ([how[7:]] if how.startswith("insert:") else []) + [role]:
                out.append(f"<|{name}|>\n" if first and not roles else f"\n<|{name}|>\n")
                roles.append(name)
            full = False
        if text:
            out.append(("\n\n" if full else "") + text.replace("<|", "< |"))
            full = True
    return roles, "".join(out) + ("\n" if last else "")


SEGMENT_BYTES = 4 * CHUNK_BYTES
"""A conversation that is longer is cut into segments of about this size, a row each."""

TURN_BYTES = 32
"""What a turn counts besides its text."""

COUNTS = "n_turns n_merged n_relabelled n_inserted cost".split()
ROW = pa.schema(
    [("conv_id", pa.int64()), ("part", pa.int64()), *((n, pa.int64()) for n in COUNTS), ("roles", pa.string()), ("rendered", pa.string())]
)
SCHEMA = "conv_id long, part long, " + "".join(f"{n} long, " for n in COUNTS) + "roles string, rendered string"
TURN = pa.struct([("role", pa.string()), ("text", pa.string())])
SEGMENT = pa.schema([("conv_id", pa.int64()), ("segment", pa.int64()), ("cells", pa.string()), ("turns", pa.list_(TURN))])
PLAN = "segment long, part long, last boolean, first_state string, last_state string, full boolean"


def _rows(costs: Costs, closed: bool) -> MapArrow:
    """Conversations, or segments with what ``PLAN`` tells of them, to rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            for k in range(batch.num_rows):
                x = {n: batch.column(n)[k].as_py() for n in batch.schema.names}
                roles, texts = [ALIASES.get(t["role"], t["role"]) for t in x["turns"]], [t["text"] for t in x["turns"]]
                cost, way = repair(roles, costs, closed, x.get("first_state"), x.get("last_state"))
                part = x.get("part", 0)
                names, rendered = render_part(way, texts, part == 0, x.get("last", True), x.get("full", False))
                rows.append(
                    {
                        "conv_id": x["conv_id"],
                        "part": part,
                        "n_turns": len(way),
                        "n_merged": sum(how == "merge" for _, how in way),
                        "n_relabelled": sum(a != b for (a, _), b in zip(way, roles, strict=True)),
                        "n_inserted": sum(how.startswith("insert") for _, how in way),
                        "cost": cost,
                        "roles": ",".join(names),
                        "rendered": rendered,
                    }
                )
                size += len(rows[-1]["rendered"])
                if size > CHUNK_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, ROW)
                    rows, size = [], 0
            yield pa.RecordBatch.from_pylist(rows, ROW)

    return run


def _segments(turns: DataFrame, costs: Costs, size: int) -> DataFrame:
    """Turns dealt out in the order of conversations, cut into segments with their matrices."""
    by = ["conv_id", "turn", "role", "text", "salt"]
    count = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, number, key, held, used = TaskContext.get().partitionId() << 32, 0, None, [], 0

        def row() -> pa.RecordBatch:
            cells = matrix([ALIASES.get(t["role"], t["role"]) for t in held], [bool(t["text"]) for t in held], costs)
            found = {"conv_id": key, "segment": base + number, "cells": json.dumps(cells), "turns": held}
            return pa.RecordBatch.from_pylist([found], SEGMENT)

        for batch in batches:
            for conv, role, text in zip(*(batch.column(n) for n in ("conv_id", "role", "text")), strict=True):
                conv, text = conv.as_py(), text.as_py()
                if held and (conv != key or used >= size):
                    yield row()
                    number, held, used = number + 1, [], 0
                key = conv
                held.append({"role": role.as_py(), "text": text})
                used += TURN_BYTES + len(text)
        if held:
            yield row()

    # Equal turns are told apart by a salt, so that any number of them is dealt out too.
    dealt = turns.withColumn("salt", F.monotonically_increasing_id()).repartitionByRange(count, *by).sortWithinPartitions(*by)
    schema = "conv_id long, segment long, cells string, turns array<struct<role: string, text: string>>"
    return stored(dealt.select("conv_id", "role", "text").mapInArrow(cut, schema), "segments")


def _plan(segments: DataFrame, closed: bool) -> DataFrame:
    """``PLAN``: part, states and open turn of every segment, from the matrices alone."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for parts in batch.column("parts").to_pylist():
                way = join_segments([json.loads(p["cells"]) for p in parts], closed)
                rows = [(p["segment"], k, k + 1 == len(parts), *x) for k, (p, x) in enumerate(zip(parts, way, strict=True))]
                kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.string(), pa.bool_()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), kinds, strict=True)],
                    names="segment part last first_state last_state full".split(),
                )

    parts = F.sort_array(F.collect_list(F.struct("segment", "cells"))).alias("parts")
    return segments.groupBy("conv_id").agg(parts).mapInArrow(fold, PLAN)


def format_chats(conversations: DataFrame, costs: Costs = Costs(), closed: bool = False, segment: int = SEGMENT_BYTES) -> DataFrame:
    """One row per conversation, turns in the order of ``turn``, ties by role and text.

    Roles count without case and outer blanks; NULL and unknown roles are always relabelled.
    NULL texts are empty; rows with NULL conv_id are one conversation, NULL turns come first.
    A conversation of more than ``segment`` bytes is repaired as a whole too, but has a row
    for each of its segments: counts and costs add up over ``part``, texts and roles follow on.
    """
    role = F.lower(F.trim("role")).alias("role")
    text = F.coalesce("text", F.lit("")).alias("text")
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role, text)
    size = F.sum(F.octet_length("text") + F.lit(TURN_BYTES).cast("long"))
    large = stored(turns.groupBy("conv_id").agg(size.alias("size")).filter(F.col("size") > segment).select("conv_id"), "conversations")

    def only(kind: str, of: DataFrame = turns) -> DataFrame:
        ids = F.broadcast(large.withColumnRenamed("conv_id", "id"))
        return of.join(ids, F.col("conv_id").eqNullSafe(F.col("id")), kind)

    whole = turns if large.isEmpty() else only("left_anti")
    listed = F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns")
    out = whole.groupBy("conv_id").agg(listed).mapInArrow(_rows(costs, closed), SCHEMA)
    if large.isEmpty():
        return out
    segments = _segments(only("left_semi"), costs, segment)
    parts = segments.drop("cells").join(F.broadcast(_plan(segments.drop("turns"), closed)), "segment")
    return out.union(parts.mapInArrow(_rows(costs, closed), SCHEMA))
