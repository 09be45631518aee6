"""Hand-curated overlay entries: ids, keyed upsert, delete, diff and listing."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seasonframe.constants import OVERLAY_PREFIX, OVERLAY_TYPES
from seasonframe.functions import canonical_json, entry_digest
from seasonframe.operators.skew import salted_lookup
from seasonframe.schemas import OVERLAY_ENTRIES
from seasonframe.storage import materialize

CHUNK = 10_000


def entry_fields(kind: str) -> list[str]:
    """Fields of an entry besides its id."""
    return [name for name in OVERLAY_ENTRIES[kind] if name != "id"]


def conform(df: DataFrame, kind: str, keep: Sequence[str] = ()) -> DataFrame:
    """Project to the fields of a type; a field the input lacks is NULL, i.e. not set."""
    cols = [
        (F.col(name) if name in df.columns else F.lit(None)).cast(type_).alias(name)
        for name, type_ in OVERLAY_ENTRIES[kind].items()
    ]
    return df.select(*cols, *[c for c in keep if c in df.columns])


def _said(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("undefined"))


def id_key(kind: str) -> Column:
    """The readable middle part of an id."""
    if kind == "coaching":
        return F.concat(_said("team"), F.lit("-"), _said("role"))
    if kind == "scheme":
        return _said("team")
    if kind == "injuries":
        return F.concat(_said("playerId"), F.lit("-w"), _said("segmentStartWeek"))
    return F.coalesce(
        F.nullif(F.col("playerId"), F.lit("")), F.nullif(F.col("team"), F.lit("")), F.lit("unknown")
    )


def entry_id(kind: str, fields: Sequence[str] | None = None) -> Column:
    """Deterministic id: prefix, year if set, key, six hex digits over all fields."""
    names = entry_fields(kind) if fields is None else fields
    digest = entry_digest(canonical_json({n: F.col(n) for n in names}))
    return F.concat_ws(
        "-", F.lit(OVERLAY_PREFIX[kind]), F.col("year").cast("string"), id_key(kind), digest
    )


def with_ids(fields: DataFrame, kind: str) -> DataFrame:
    """Proposed field rows as entries; a given ``ord`` column is kept."""
    entries = conform(fields, kind, keep=["ord"])
    return entries.withColumn("id", entry_id(kind))


# Columns of the natural key; notes have none and match by id only.
NATURAL_KEY = {
    "coaching": ("year", "team", "role"),
    "scheme": ("year", "team"),
    "injuries": ("playerId", "year", "segmentStartWeek"),
    "notes": (),
}


def natural_key(kind: str) -> Column:
    cols = NATURAL_KEY[kind]
    if not cols:
        return F.lit(None).cast("string")
    return F.concat_ws("|", *[_said(c) for c in cols])


def entry_json(kind: str) -> Column:
    return canonical_json({name: F.col(name) for name in OVERLAY_ENTRIES[kind]})


def entry_diff(
    existing: DataFrame, updated: DataFrame, fields: Sequence[str], key: str = "id"
) -> DataFrame:
    """``key, field, old, new`` for each field whose JSON text differs; NULL is "not set".

    One join on the key compares whole rows; only differing fields are unfolded.
    """

    def values(df: DataFrame, name: str) -> DataFrame:
        texts = [F.to_json(F.struct(F.col(f).alias("v"))).alias(f) for f in fields]
        return df.select(F.col(key), F.struct(*texts).alias(name))

    both = values(existing, "old").join(values(updated, "new"), key)
    pairs = F.array(
        *[
            F.struct(F.lit(f).alias("field"), F.col(f"old.{f}").alias("o"), F.col(f"new.{f}").alias("n"))
            for f in sorted(fields)
        ]
    )
    changed = F.filter(pairs, lambda p: ~p["o"].eqNullSafe(p["n"]))

    def bare(text: Column) -> Column:
        return F.nullif(F.regexp_extract(text, r'(?s)^\{"v":(.*)\}$', 1), F.lit(""))

    rows = both.select(key, F.inline(changed))
    return rows.select(key, "field", bare(F.col("o")).alias("old"), bare(F.col("n")).alias("new"))


def lag_in_order(df: DataFrame, key: str, order: str, value: str, out: str) -> DataFrame:
    """``lag(value)`` per key without putting a whole key into one task.

    ``order`` is unique; its values may lie anywhere. A sort by it deals all rows out evenly,
    whatever their keys, and numbers them in each part, so that each chunk of numbers is full but
    for the last of a part. Chunks are lagged on their own; the first row of a key in a chunk
    takes the last value of the nearest earlier chunk of the key, which is looked up in a table
    of one row per key and chunk. The sorted rows are stored: numbers made twice might differ.
    """
    chunked = materialize(df.orderBy(order).withColumn("_chunk", F.expr(f"monotonically_increasing_id() div {CHUNK}")))
    inner = Window.partitionBy(key, "_chunk").orderBy(order)
    outer = Window.partitionBy(key).orderBy("_chunk")
    lasts = (
        chunked.groupBy(key, "_chunk")
        .agg(F.max_by(F.struct(F.col(value).alias("v")), order).alias("_last"))
        .select(key, "_chunk", F.lag("_last").over(outer).alias("_carry"))
    )
    here = chunked.withColumn("_row", F.row_number().over(inner)).withColumn(
        "_lag", F.lag(value).over(inner)
    )
    joined = here.join(lasts, [key, "_chunk"], "left")
    return joined.withColumn(
        out, F.when(F.col("_row") == 1, F.col("_carry.v")).otherwise(F.col("_lag"))
    ).drop("_chunk", "_row", "_lag", "_carry")


def _slots(existing: DataFrame, proposed: DataFrame, kind: str) -> DataFrame:
    """Stored entries with the ``key`` of the slot they fill.

    That is their natural key; an entry whose natural key nobody asks for, but whose id
    is proposed, fills the slot of that proposal. Notes only have their id.
    """
    own = natural_key(kind)
    if not NATURAL_KEY[kind]:
        return existing.withColumn("key", F.col("id"))
    asked_keys = proposed.select(own.alias("_own")).distinct().withColumn("_asked", F.lit(True))
    asked_ids = proposed.groupBy("id").agg(F.min_by(own, "ord").alias("_by_id"))
    joined = existing.withColumn("_own", own).join(asked_keys, "_own", "left").join(
        asked_ids, "id", "left"
    )
    key = F.when(F.col("_asked"), F.col("_own")).otherwise(F.coalesce("_by_id", "_own"))
    return joined.withColumn("key", key).drop("_own", "_asked", "_by_id")


def upsert_plan(
    existing: DataFrame, proposed: DataFrame, kind: str, force: bool = False
) -> DataFrame:
    """Action per proposed entry, as if the batch were added one by one in ``ord`` order.

    ``added`` when neither natural key nor id is known, ``no-op`` when the stored entry
    is identical, else ``updated`` with force and ``conflict`` without. Result: ``ord, id,
    key, action, existing_id, entry_json``.

    Without force a slot never changes once it is filled, so each proposal is compared
    with the stored entry or else with the first proposal of its slot. With force each
    is compared with its predecessor. Slots are one row each, and the join back to the
    proposals is salted, so repeats of one key stay spread.
    """
    by_key = F.coalesce(natural_key(kind), F.col("id"))
    asked = proposed.select("ord", "id", by_key.alias("key"), entry_json(kind).alias("entry_json"))
    # The first stored entry of a slot counts, by document order where it is known.
    entry = F.struct(F.col("id").alias("old_id"), entry_json(kind).alias("old_json"))
    stored = _slots(existing, proposed, kind).groupBy("key").agg(F.min_by(entry, _place(existing)).alias("e"))
    stored = stored.select("key", "e.*")
    firsts = asked.groupBy("key").agg(
        F.min_by(F.struct("ord", "id", "entry_json"), "ord").alias("first")
    )
    slots = firsts.join(stored, "key", "left")
    if not force:
        base = slots.select(
            "key",
            F.coalesce("old_id", "first.id").alias("base_id"),
            F.coalesce("old_json", "first.entry_json").alias("base_json"),
            F.when(F.col("old_id").isNull(), F.col("first.ord")).alias("added_ord"),
        )
        joined = salted_lookup(asked, base, ["key"], ["ord"], "inner")
        added = F.col("ord").eqNullSafe(F.col("added_ord"))
        same = F.col("entry_json") == F.col("base_json")
        action = F.when(added, "added").when(same, "no-op").otherwise("conflict")
        existing_id = F.when(~added, F.col("base_id"))
    else:
        state = F.struct("id", "entry_json")
        lagged = lag_in_order(asked.withColumn("_state", state), "key", "ord", "_state", "_prev")
        base = slots.select("key", F.col("first.ord").alias("first_ord"), "old_id", "old_json")
        joined = salted_lookup(lagged, base, ["key"], ["ord"], "inner")
        first = F.col("ord") == F.col("first_ord")
        existing_id = F.when(first, F.col("old_id")).otherwise(F.col("_prev.id"))
        before = F.when(first, F.col("old_json")).otherwise(F.col("_prev.entry_json"))
        same = F.col("entry_json") == before
        action = F.when(before.isNull(), "added").when(same, "no-op").otherwise("updated")
    return joined.select(
        "ord", "id", "key", action.alias("action"), existing_id.alias("existing_id"), "entry_json"
    )


def upsert_result(
    existing: DataFrame, proposed: DataFrame, kind: str, force: bool = False
) -> DataFrame:
    """The overlay after the batch: untouched entries plus the final entry of each slot.

    Per slot the last proposal wins with force, the first one without, and only when
    nothing is stored. A replaced entry is replaced as a whole, so its id may change. Of
    several stored entries of a slot the first is replaced and the others stay. With
    ``ord`` in ``existing`` the result has it too: replaced entries keep their place, new
    ones follow the last.
    """
    entry = F.struct(*OVERLAY_ENTRIES[kind])
    place = _place(existing)
    slots = _slots(existing, proposed, kind).select("key", entry.alias("_old"), place.alias("_at"))
    first = slots.groupBy("key").agg(F.min("_at").alias("_at")).withColumn("_first", F.lit(True))
    slots = slots.join(first, ["key", "_at"], "left")
    old = slots.filter("_first").drop("_first")
    others = slots.filter("_first IS NULL").select("_old.*", *([F.col("_at").alias("ord")] if "ord" in existing.columns else []))
    pick = F.max_by if force else F.min_by
    new = (
        proposed.withColumn("key", F.coalesce(natural_key(kind), F.col("id")))
        .groupBy("key")
        .agg(pick(entry, "ord").alias("_new"), F.min("ord").alias("_asked"))
    )
    order = ["_new", "_old"] if force else ["_old", "_new"]
    both = old.join(new, "key", "full")
    if "ord" not in existing.columns:
        return both.select(F.coalesce(*order).alias("_entry")).select("_entry.*").unionByName(others)
    top = existing.agg(F.coalesce(F.max("ord"), F.lit(-1))).scalar()
    at = F.coalesce(F.col("_at"), top + 1 + F.col("_asked"))
    return both.select(F.coalesce(*order).alias("_entry"), at.alias("ord")).select("_entry.*", "ord").unionByName(others)


def _place(entries: DataFrame) -> Column:
    """Document order of stored entries, their id where it is not known."""
    return F.col("ord") if "ord" in entries.columns else F.col("id")


def all_overlays(overlays: Mapping[str, DataFrame]) -> DataFrame:
    """The four types stacked, with ``overlay`` naming the type and fields missing as NULL."""
    stacked = None
    for kind in OVERLAY_TYPES:
        if kind not in overlays:
            continue
        part = overlays[kind].withColumn("overlay", F.lit(kind))
        stacked = part if stacked is None else stacked.unionByName(part, allowMissingColumns=True)
    return stacked


def removal_targets(stacked: DataFrame, ids: DataFrame) -> DataFrame:
    """``id, overlay, found``: the first type, in scan order, that holds each asked id."""
    rank = F.create_map(*[F.lit(x) for i, k in enumerate(OVERLAY_TYPES) for x in (k, i)])
    holders = stacked.groupBy("id").agg(F.min_by("overlay", rank[F.col("overlay")]).alias("overlay"))
    asked = ids.select("id").distinct()
    return asked.join(holders, "id", "left").withColumn("found", F.col("overlay").isNotNull())


def remove_entries(stacked: DataFrame, ids: DataFrame) -> DataFrame:
    """Entries left after the asked ids are taken out of the first type that has them."""
    gone = removal_targets(stacked, ids).filter("found").select("id", "overlay")
    return stacked.join(gone, ["id", "overlay"], "left_anti")


def list_entries(entries: DataFrame, year: int | None = None) -> DataFrame:
    return entries if year is None else entries.filter(F.col("year") == year)
