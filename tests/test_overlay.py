import json
import random
from hashlib import sha1

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from seasonframe import schemas as S
from seasonframe.operators import injuries as I
from seasonframe.operators import overlay as O
from seasonframe.storage import materialize


def entries(spark, kind, rows):
    schema = S.ddl(S.OVERLAY_ENTRIES[kind]) + ", ord LONG"
    names = [*S.OVERLAY_ENTRIES[kind], "ord"]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)


def digest(fields):
    text = json.dumps(fields, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    return sha1(text.encode()).hexdigest()[:6]


def ids(spark, kind, *rows):
    df = O.with_ids(entries(spark, kind, [{"ord": i, **r} for i, r in enumerate(rows)]), kind)
    return [r.id for r in df.orderBy("ord").collect()]


def test_ids(spark):
    coach = {"year": 2026, "team": "ARI", "role": "HC", "name": "Mike LaFleur"}
    assert ids(spark, "coaching", coach) == ["coach-2026-ARI-HC-b1fa7d"]
    scheme = {"year": 2024, "team": "MIA", "offense": "wide zone", "changedFromPrev": False}
    assert ids(spark, "scheme", scheme) == [f"scheme-2024-MIA-{digest(scheme)}"]
    injury = {"playerId": "6803", "year": 2023, "segmentStartWeek": 2}
    assert ids(spark, "injuries", injury) == [f"inj-2023-6803-w2-{digest(injury)}"]
    notes = [{"playerId": "4034", "body": "x é"}, {"team": "SF", "year": 2024, "body": "y"}, {"body": "z"}]
    assert ids(spark, "notes", *notes) == [
        f"note-4034-{digest(notes[0])}", f"note-2024-SF-{digest(notes[1])}", f"note-unknown-{digest(notes[2])}"
    ]


def coach(year, role, name, **more):
    return {"year": year, "team": "SF", "role": role, "name": name, **more}


def stored(spark, rows, kind="coaching"):
    return O.with_ids(entries(spark, kind, rows), kind).drop("ord")


def run(spark, old, new, force=False, kind="coaching"):
    existing = stored(spark, old, kind)
    proposed = O.with_ids(entries(spark, kind, [{"ord": i, **r} for i, r in enumerate(new)]), kind)
    plan = [r.action for r in O.upsert_plan(existing, proposed, kind, force).orderBy("ord").collect()]
    after = sorted(r.name if kind == "coaching" else r.body for r in O.upsert_result(existing, proposed, kind, force).collect())
    return plan, after


OLD = [coach(2024, "HC", "A"), coach(2024, "OC", "B"), coach(2023, "HC", "Z")]


def test_upsert(spark):
    new = [coach(2024, "HC", "A"), coach(2024, "OC", "C"), coach(2025, "HC", "N")]
    assert run(spark, OLD, new) == (["no-op", "conflict", "added"], ["A", "B", "N", "Z"])
    assert run(spark, OLD, new, force=True) == (["no-op", "updated", "added"], ["A", "C", "N", "Z"])


def test_batch_acts_in_order(spark):
    new = [coach(2025, "HC", n) for n in ("N", "M", "N", "N")]
    assert run(spark, OLD, new) == (["added", "conflict", "no-op", "no-op"], ["A", "B", "N", "Z"])
    assert run(spark, OLD, new, force=True) == (["added", "updated", "updated", "no-op"], ["A", "B", "N", "Z"])


def test_repeat_is_a_no_op(spark):
    assert run(spark, OLD, OLD)[0] == ["no-op"] * 3


def test_notes_match_by_content_only(spark):
    old = [{"playerId": "1", "year": 2024, "body": "x"}]
    new = [{"playerId": "1", "year": 2024, "body": "x"}, {"playerId": "1", "year": 2024, "body": "y"}]
    assert run(spark, old, new, kind="notes") == (["no-op", "added"], ["x", "y"])


def test_entry_with_a_foreign_id_is_replaced(spark):
    """An entry that kept its id while its key was edited is found by id."""
    proposed = O.with_ids(entries(spark, "coaching", [{"ord": 0, **coach(2024, "HC", "A")}]), "coaching")
    existing = proposed.drop("ord").withColumn("year", F.lit(2020))
    plan = O.upsert_plan(existing, proposed, "coaching").first()
    assert plan.action == "conflict"
    after = O.upsert_result(existing, proposed, "coaching", force=True).collect()
    assert [r.year for r in after] == [2024]


@pytest.mark.parametrize("force", [False, True])
def test_hot_slot_matches_one_by_one(spark, force, monkeypatch):
    monkeypatch.setattr(O, "CHUNK", 16)
    rng = random.Random(5)
    new = [coach(2024 if i % 3 == 0 else 1900 + rng.randrange(30), "HC", rng.choice("ABCD")) for i in range(300)]
    state = {(c["year"], c["role"]): c["name"] for c in OLD}
    want = []
    for c in new:
        key = (c["year"], c["role"])
        if key not in state:
            want.append("added")
            state[key] = c["name"]
        elif state[key] == c["name"]:
            want.append("no-op")
        elif force:
            want.append("updated")
            state[key] = c["name"]
        else:
            want.append("conflict")
    plan, after = run(spark, OLD, new, force)
    assert plan == want
    assert after == sorted(state.values())


def test_entry_diff(spark):
    old = stored(spark, [coach(2024, "HC", 'A "x"', tenureStart=2017)]).withColumn("key", F.lit("k"))
    new = stored(spark, [coach(2024, "HC", "B", isNew=False)]).withColumn("key", F.lit("k"))
    rows = O.entry_diff(old, new, [*S.OVERLAY_ENTRIES["coaching"]], key="key").filter("field <> 'id'").collect()
    assert {r.field: (r.old, r.new) for r in rows} == {
        "name": ('"A \\"x\\""', '"B"'), "tenureStart": ("2017", None), "isNew": (None, "false")
    }


def test_remove_takes_the_first_type(spark):
    c = entries(spark, "coaching", [{"id": "x"}, {"id": "c"}]).drop("ord")
    n = entries(spark, "notes", [{"id": "x"}, {"id": "n"}]).drop("ord")
    stacked = O.all_overlays({"notes": n, "coaching": c})
    asked = spark.createDataFrame([("x",), ("n",), ("none",)], "id STRING")
    left = {(r.overlay, r.id) for r in O.remove_entries(stacked, asked).collect()}
    assert left == {("coaching", "c"), ("notes", "x")}
    found = {r.id: (r.overlay, r.found) for r in O.removal_targets(stacked, asked).collect()}
    assert found == {"x": ("coaching", True), "n": ("notes", True), "none": (None, False)}


def totals(spark, rows):
    schema = "season INT, player_id STRING, availability STRUCT<absenceSegments: ARRAY<STRUCT<start: INT, end: INT, length: INT>>>"
    return spark.createDataFrame([(s, p, ([(a, b, b - a + 1) for a, b in seg],)) for s, p, seg in rows], schema)


def test_injuries(spark):
    t = totals(spark, [(2024, "1", [(2, 4), (6, 6)]), (2024, "2", [])])
    inj = entries(spark, "injuries", [
        {"id": "i1", "playerId": "1", "year": 2024, "segmentStartWeek": 2, "segmentEndWeek": 3, "type": "knee"},
        {"id": "i2", "playerId": "1", "year": 2024, "segmentStartWeek": 3},
        {"id": "i3", "playerId": "2", "year": 2024, "segmentStartWeek": 3},
        {"id": "i4", "playerId": "1", "year": 2023, "segmentStartWeek": 2},
    ])
    got = {r.id: r.outcome for r in I.injury_outcomes(inj, t).collect()}
    assert got == {"i1": "match", "i2": "no_segment", "i3": "no_segment", "i4": "no_season"}
    weeks = {r.week: r.id for r in I.injury_weeks(inj, t).collect()}
    assert weeks == {2: "i1", 3: "i1", 4: None, 6: None}


def test_forced_upsert_replaces_the_first_of_several(spark):
    base = {"playerId": "1", "year": 2024, "segmentStartWeek": 2}
    old = entries(spark, "injuries", [
        {**base, "id": "z", "type": "knee", "ord": 0}, {**base, "id": "a", "type": "hip", "ord": 1},
        {**base, "id": "k", "segmentStartWeek": 9, "ord": 2},
    ])
    new = O.with_ids(entries(spark, "injuries", [{**base, "type": "toe", "ord": 0}, {**base, "year": 2020, "type": "arm", "ord": 1}]), "injuries")
    out = {r.ord: r.type for r in O.upsert_result(old, new, "injuries", force=True).collect()}
    assert out == {0: "toe", 1: "hip", 2: None, 4: "arm"}
    plan = {r.ord: (r.action, r.existing_id) for r in O.upsert_plan(old, new, "injuries", force=True).collect()}
    assert plan == {0: ("updated", "z"), 1: ("added", None)}
    kept = {r.ord: r.type for r in O.upsert_result(old, new, "injuries").collect()}
    assert kept == {0: "knee", 1: "hip", 2: None, 4: "arm"}
    # Without document order the least id counts as the first.
    bare = O.upsert_result(old.drop("ord"), new, "injuries", force=True)
    assert sorted(r.type or "" for r in bare.collect()) == ["", "arm", "knee", "toe"]


def test_all_injuries_of_a_segment(spark):
    totals = spark.createDataFrame(
        [(2024, "1", ([(2, 4, 3)],)), (2024, "2", ([(5, 5, 1)],))],
        "season INT, player_id STRING, availability STRUCT<absenceSegments: ARRAY<STRUCT<start: INT, end: INT, length: INT>>>",
    )
    base = {"playerId": "1", "year": 2024, "segmentStartWeek": 2}
    noted = entries(spark, "injuries", [{**base, "id": "a", "segmentEndWeek": 3}, {**base, "id": "b"}, {**base, "id": "c", "segmentEndWeek": 1}])
    out = sorted((r.player_id, r.week, r.id) for r in I.injury_weeks(noted, totals).collect())
    assert out == [("1", 2, "a"), ("1", 2, "b"), ("1", 3, "a"), ("1", 3, "b"), ("1", 4, "b"), ("2", 5, None)]


def test_sparse_order_makes_full_chunks(spark, monkeypatch):
    monkeypatch.setattr(O, "CHUNK", 50)
    n = 6000
    # Orders far apart, and a third of the rows on one key.
    df = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 400).cast("string"))).alias("k"),
        F.abs(F.xxhash64("id")).alias("o"), F.col("id").alias("v"),
    )
    seen = []
    monkeypatch.setattr(O, "materialize", lambda rows: seen.append(materialize(rows)) or seen[-1])
    found = O.lag_in_order(df, "k", "o", "v", "before")
    plain = df.withColumn("before", F.lag("v").over(Window.partitionBy("k").orderBy("o")))
    assert sorted(map(tuple, found.select("k", "o", "v", "before").collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)
    chunks = seen[0].groupBy("_chunk").count().collect()
    assert max(r["count"] for r in chunks) <= 50 and len(chunks) <= n / 50 + 2 * seen[0].rdd.getNumPartitions()
