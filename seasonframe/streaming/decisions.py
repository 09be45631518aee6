"""Decide on arriving market snapshots with one keyed, stateful operator.

Each market is a key. Its state is the snapshot last accepted: day, size, fingerprint and the
value of each name, which the size rule bounds. All that a document tells about itself is
worked out before, by expressions over its one row, so that the state sees only sound
documents and nothing but the comparison happens there. Markets are decided side by side,
the snapshots of a market in date order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from datetime import date
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from seasonframe import constants as K
from seasonframe import schemas as S
from seasonframe.functions import canonical_json
from seasonframe.plans.warehouse import Warehouse, materialize, write_partitions
from seasonframe.sources.documents import array_documents

DECISIONS = (
    "market STRING, snapshot_date DATE, file STRING, decision STRING, rule STRING, baseline DATE, "
    "changed_n INT, prev_n INT, value STRING"
)

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass(frozen=True)
class Limits:
    """What a snapshot must keep to. A maximum size bounds the state of a market."""

    rows: tuple[int, int] = K.MARKET_ROWS
    positions: tuple[str, ...] = tuple(K.MARKET_POSITIONS)
    per_position: int = K.MARKET_MIN_PER_POSITION
    values: tuple[int, int] = K.MARKET_VALUE_RANGE
    known: tuple[str, ...] = tuple(K.MARKET_SENTINELS)
    top: int = K.MARKET_TOP
    known_in_top: int = K.MARKET_MIN_SENTINELS
    max_changed: float = K.MARKET_MAX_CHANGED
    max_age_days: float = K.MARKET_MAX_AGE_DAYS


def _hash_sum(rows: Column, start: int) -> Column:
    """A slice sum as in ``multiset_fingerprint``, over the rows of one document."""

    def part(r: Column) -> Column:
        text = canonical_json({name: r[name] for name in ("name", "team", "value", "position")})
        return F.conv(F.substring(F.sha1(text), start, 15), 16, 10).cast("decimal(38,0)")

    zero = F.lit(0).cast("decimal(38,0)")
    return F.aggregate(rows, zero, lambda total, r: (total + part(r)).cast("decimal(38,0)")).cast("string")


def snapshot_facts(docs: DataFrame, limits: Limits) -> DataFrame:
    """``market, snapshot_date, file, value`` with size, fingerprint, names, amounts and the first rule that fails.

    Every document has a row, an undated one too (``date``). Nothing is shuffled.
    """
    parsed = F.when(F.col("value").rlike(r"^\s*\["), F.from_json("value", S.array_of(S.MARKET_ROW)))
    rows, n = F.col("rows"), F.size("rows")
    low, high = limits.values

    def at(position: str) -> Column:
        return F.size(F.filter(rows, lambda r: r["position"] == position))

    bad = F.exists(rows, lambda r: r["value"].isNull() | (r["value"] < low) | (r["value"] > high))
    ranked = F.array_sort(F.transform(rows, lambda r, i: F.struct((-r["value"]).alias("minus"), i.alias("at"), r["name"].alias("name"))))
    top = F.transform(F.slice(ranked, 1, limits.top), lambda r: r["name"])
    hits = F.size(F.array_intersect(top, F.array(*[F.lit(k) for k in limits.known]).cast("array<string>")))
    rule = F.when(F.col("snapshot_date").isNull(), "date").when(rows.isNull(), "DQ-16")
    rule = rule.when((n < limits.rows[0]) | (n > limits.rows[1]), "DQ-17")
    for position in limits.positions:
        rule = rule.when(at(position) < limits.per_position, "DQ-18")
    rule = rule.when(bad, "DQ-19")
    if limits.known_in_top:
        rule = rule.when(hits < limits.known_in_top, "DQ-20")
    facts = docs.select("market", "snapshot_date", "file", "value", parsed.alias("rows"))
    facts = facts.withColumn("failed", rule)
    sound = F.col("failed").isNull()
    return facts.select(
        "market", "snapshot_date", "file", "value", "failed", n.alias("n"),
        F.when(sound, _hash_sum(rows, 1)).alias("hash_lo"), F.when(sound, _hash_sum(rows, 16)).alias("hash_hi"),
        F.when(sound, F.transform(rows, lambda r: r["name"])).alias("names"),
        F.when(sound, F.transform(rows, lambda r: r["value"])).alias("amounts"),
    )


class Last(NamedTuple):
    """The state of a market. Names match by the first row of each; rows without a name never do."""

    day: int
    n: int
    hash_lo: str
    hash_hi: str
    values: dict[str, int]

    @staticmethod
    def of(row: Row) -> Last:
        values = {name: value for name, value in reversed(list(zip(row.names, row.amounts))) if name is not None}
        return Last(row.snapshot_date.toordinal(), row.n, row.hash_lo, row.hash_hi, values)


class SnapshotChain(StatefulProcessor):
    """The snapshots of a market, each against the one accepted last."""

    def __init__(self, max_changed: float, max_age_days: float) -> None:
        self.max_changed, self.max_age = max_changed, max_age_days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("last", "day INT, n INT, hash_lo STRING, hash_hi STRING, values MAP<STRING, INT>")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:  # noqa: N802, N803
        last = Last(*self.state.get()) if self.state.exists() else None
        before = last
        for row in sorted(rows, key=lambda r: (r.snapshot_date or date.min, r.file or "")):
            own, changed = Last.of(row) if row.failed is None else None, None
            decision, rule = "reject", row.failed
            if own:
                decision, rule, changed = self.decide(own, list(zip(row.names, row.amounts)), last)
            yield Row(
                market=key[0], snapshot_date=row.snapshot_date, file=row.file, decision=decision, rule=rule,
                baseline=date.fromordinal(last.day) if last and own else None, changed_n=changed,
                prev_n=None if changed is None else last.n, value=row.value if decision == "write" else None,
            )
            if decision == "write":
                last = own
        if last is not before:
            self.state.update(tuple(last))

    def decide(self, own: Last, cells: list[tuple], last: Last | None) -> tuple[str, str | None, int | None]:
        """Decision, rule and how many rows have no equal row in the last accepted snapshot."""
        if last is None:
            return "write", None, None
        if own.day >= last.day and own[1:4] == last[1:4]:
            return "skip", None, None
        if own.day <= last.day:
            return "late", None, None
        changed = sum(name not in last.values or last.values[name] != value for name, value in cells)
        # A snapshot is looked at on the midnight after its day.
        if own.day + 1 - last.day <= self.max_age and changed > self.max_changed * last.n:
            return "reject", "DQ-21", changed
        return "write", None, changed

    def close(self) -> None:
        pass


def decisions(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """A row for each document of a stream of ``market, snapshot_date, file, value``.

    ``decision`` is ``write``, ``skip`` (the same content as the one accepted last), ``reject`` with the
    ``rule`` that failed, or ``late``: of a day before or on that of the accepted one, for
    ``publish_snapshot`` to place. A refused or late snapshot leaves the state as it is.
    ``value`` is the document where it is to be written. Documents without a market are one market.
    """
    chain = SnapshotChain(limits.max_changed, limits.max_age_days)
    return snapshot_facts(docs, limits).groupBy("market").transformWithState(
        statefulProcessor=chain, outputStructType=DECISIONS, outputMode="Append", timeMode="None"
    )


def publish_decisions(docs: DataFrame, wh: Warehouse, checkpoint: str, limits: Limits = Limits()) -> StreamingQuery:
    """Take all documents that have arrived, then stop.

    Decisions go to ``market_decisions``, a partition for each batch; the rows of accepted
    snapshots of all markets and days of a batch go to ``markets`` in one write. A batch that is
    repeated replaces what it wrote.
    """
    spark = docs.sparkSession
    before = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, ROCKS)

    def publish(batch: DataFrame, number: int) -> None:
        made = materialize(batch)
        write_partitions(made.drop("value").withColumn("batch", F.lit(number).cast("long")), wh.path("market_decisions"), ["batch"], ["market", "snapshot_date"])
        accepted = made.filter("decision = 'write'").select("market", "snapshot_date", "value")
        rows = array_documents(accepted, S.MARKET_ROW)
        rows = rows.withColumn("batch", F.lit(number).cast("long"))
        write_partitions(rows, wh.path("markets"), ["snapshot_date", "batch"], ["market", "ord"])

    try:
        stream = decisions(docs, limits).writeStream.trigger(availableNow=True).outputMode("append")
        return stream.option("checkpointLocation", checkpoint).foreachBatch(publish).start()
    finally:
        spark.conf.set(STATE_STORE, before) if before else spark.conf.unset(STATE_STORE)
