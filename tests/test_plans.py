import json
from concurrent.futures import ThreadPoolExecutor
from datetime import UTC, date, datetime, timedelta

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from seasonframe import schemas as S
from seasonframe.constants import MARKET_SENTINELS
from seasonframe.functions import player_key
from seasonframe.operators.catalog import manifest_upsert, supported
from seasonframe.operators.diff import season_diff
from seasonframe.operators.quality import QualityError
from seasonframe.plans.buckets import BucketedTable
from seasonframe.plans.college import publish_college
from seasonframe.plans.landing import (
    land_college, land_season_totals, land_snapshots, land_weekly, landed_entries, quarantined,
)
from seasonframe.plans.market import publish_snapshot
from seasonframe.plans.overlay import remove_by_id, stored_overlay, upsert_entries, validate_overlays
from seasonframe.plans.reconcile import repair_manifest
from seasonframe.plans.season import publish_seasons as publish
from seasonframe.plans.season import season_table
from seasonframe.plans.versions import publish_version, read_version, write_version
from seasonframe.plans.warehouse import Warehouse, export_json, index, stored_manifest, write_partitions
from seasonframe.operators.totals import season_totals
from seasonframe.sources.checked import SEASON, checked_records, split_keyed
from seasonframe.streaming.decisions import publish_decisions
from seasonframe.streaming.snapshots import publish_stream

T0 = datetime(2026, 5, 18, 12, tzinfo=UTC)
SMALL = {"min_players": 2, "full_games": 1, "min_full": 1}


def hours(n):
    return T0 + timedelta(hours=n)


def entries(spark, points, seasons=(2024, 2025)):
    rows = [(s, 1, i, p, "SF", {"gp": 1.0, "pts_half_ppr": v}) for s in seasons for i, (p, v) in enumerate(points.items())]
    return spark.createDataFrame(rows, S.WEEKLY_ENTRIES)


def actions(plan):
    return {r.season: r.action for r in plan.collect()}


def test_seasons(spark, tmp_path):
    wh = Warehouse(str(tmp_path))
    first = entries(spark, {"a": 1.0, "b": 2.0})
    none = spark.createDataFrame([], "season INT, player_id STRING, min_games INT, name STRING")

    def publish_seasons(spark, entries, wh, current, run_time, **kw):
        return publish(spark, entries, wh, [2024, 2025], current, run_time, **{"sentinels": none, **kw})

    assert actions(publish_seasons(spark, first, wh, 2025, hours(0), dry_run=True, **SMALL)) == {2024: "write", 2025: "write"}
    assert stored_manifest(spark, wh).count() == 0
    assert actions(publish_seasons(spark, first, wh, 2025, hours(0), **SMALL)) == {2024: "write", 2025: "write"}
    assert actions(publish_seasons(spark, first, wh, 2025, hours(1), **SMALL)) == {2024: "skip", 2025: "skip"}
    second = entries(spark, {"a": 1.0, "b": 3.0})
    assert actions(publish_seasons(spark, second, wh, 2025, hours(2), **SMALL)) == {2024: "refuse", 2025: "write"}
    stored = spark.read.parquet(wh.season_totals)
    got = {(r.season, r.player_id): r.fantasyPoints for r in stored.collect()}
    assert got == {(2024, "a"): 1.0, (2024, "b"): 2.0, (2025, "a"): 1.0, (2025, "b"): 3.0}
    assert actions(publish_seasons(spark, second, wh, 2025, hours(3), force=True, **SMALL)) == {2024: "write", 2025: "skip"}
    manifest = {r.path: (r.recordCount, r.inProgress, r.schemaVersion) for r in stored_manifest(spark, wh).collect()}
    assert manifest == {"season_totals/2024": (2, False, 2), "season_totals/2025": (2, True, 2)}
    with pytest.raises(QualityError):
        publish_seasons(spark, second, wh, 2025, hours(4), min_players=3)
    with pytest.raises(QualityError, match="only 0 players"):
        publish(spark, second, wh, [2023, 2024], 2025, hours(4), sentinels=none, **SMALL)
    with pytest.raises(QualityError, match="sentinel Lamar Jackson"):
        publish(spark, second, wh, [2024], 2025, hours(4), **SMALL)


def test_college(spark, tmp_path):
    wh = Warehouse(str(tmp_path))
    limits = {"min_rows": 1, "min_players": 1}

    def rows(n, stat="1"):
        return spark.range(n).select(
            F.lit(2023).alias("season"), F.col("id").cast("string").alias("playerId"),
            *[F.lit("x").alias(c) for c in ("player", "position", "team", "conference")],
            F.lit("passing").alias("category"), F.lit("YDS").alias("statType"), F.lit(stat).alias("stat"),
        )

    def run(df, hour, **kw):
        return publish_college(spark, df, wh, [("passing", 2023)], hours(hour), **limits, **kw).first().action

    assert run(rows(3), 0) == "write"
    assert run(rows(3, "2"), 1) == "skip"  # content is not looked at
    assert run(rows(3, "2"), 2, compare="fingerprint") == "refuse"
    assert run(rows(3), 3, compare="fingerprint") == "skip"
    assert run(rows(4), 4) == "refuse"
    assert run(rows(4), 5, force=True) == "write"
    assert spark.read.parquet(wh.college).count() == 4
    assert stored_manifest(spark, wh).first().recordCount == 4
    with pytest.raises(QualityError, match="rushing/2023: 0 rows"):
        publish_college(spark, rows(3), wh, [("passing", 2023), ("rushing", 2023)], hours(6), **limits)


def market_rows(changed=0, n=300):
    rows = []
    for i in range(n):
        name = MARKET_SENTINELS[i] if i < 3 else f"n{i}"
        value = 9000 - i + (1 if i >= n - changed else 0)
        rows.append({"name": name, "team": None if i % 2 else "SF", "value": value, "position": ("QB", "RB", "WR", "TE")[i % 4]})
    return rows


def snapshot(spark, rows):
    return spark.createDataFrame([(i, *r.values()) for i, r in enumerate(rows)], "ord LONG, name STRING, team STRING, value INT, position STRING")


def test_market(spark, tmp_path):
    wh = Warehouse(str(tmp_path))

    def run(rows, day, **kw):
        d = date(2026, 5, day)
        return publish_snapshot(spark, snapshot(spark, rows), wh, d, datetime(2026, 5, day, 12, tzinfo=UTC), **kw)

    assert run(market_rows(), 1, dry_run=True) == "write"
    assert run(market_rows(), 1) == "write"
    assert run(market_rows()[::-1], 2) == "skip"
    assert run(market_rows(changed=210), 2) == "write"  # exactly 70 %
    with pytest.raises(QualityError, match="rows changed"):
        run([{**r, "value": r["value"] - 5} for r in market_rows()], 3)
    assert run([{**r, "value": r["value"] - 5} for r in market_rows()], 11) == "write"  # baseline is too old
    assert run(market_rows(), 11, dry_run=True) == "write"
    checks = sorted((r.checkedAt.day, r.identical) for r in spark.read.parquet(wh.market_checks).collect())
    assert checks == [(1, False), (2, False), (11, False)]
    with pytest.raises(QualityError, match="0 rows"):
        run([], 12)
    dates = {r[0].day for r in spark.read.parquet(wh.market).select("snapshot_date").distinct().collect()}
    assert dates == {1, 2, 11}
    assert stored_manifest(spark, wh).filter("inProgress").count() == 3


def test_overlay(spark, tmp_path):
    wh = Warehouse(str(tmp_path))

    def add(*rows, hour=0, **kw):
        df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "ord LONG, year INT, team STRING, role STRING, name STRING")
        plan = upsert_entries(spark, "coaching", df, wh, hours(hour), current_year=2026, **kw)
        return [r.action for r in plan.orderBy("ord").collect()]

    hc, oc = (2026, "SF", "HC", "A"), (2026, "SF", "OC", "B")
    assert add(hc, oc, dry_run=True) == ["added", "added"]
    assert stored_overlay(spark, wh, "coaching").count() == 0
    assert add(hc, oc) == ["added", "added"]
    assert add(hc, oc, hour=1) == ["no-op", "no-op"]
    assert add((2026, "SF", "HC", "C"), hour=2) == ["conflict"]
    assert add((2026, "SF", "HC", "C"), hour=3, force=True) == ["updated"]
    with pytest.raises(QualityError, match="unknown team"):
        add((2026, "XX", "HC", "C"), hour=4)
    stored = stored_overlay(spark, wh, "coaching")
    assert sorted(r.name for r in stored.collect()) == ["B", "C"]
    ids = stored.select("id").union(spark.createDataFrame([("no-such-id",)], "id STRING"))
    asked = spark.createDataFrame([tuple(r) for r in ids.collect()], "id STRING")
    assert remove_by_id(spark, asked, wh, hours(5), dry_run=True).filter("found").count() == 2
    found = remove_by_id(spark, asked, wh, hours(5))
    assert found.filter("NOT found").first().id == "no-such-id"
    assert stored_overlay(spark, wh, "coaching").count() == 0
    assert stored_manifest(spark, wh).first().recordCount == 0


def dies(*_, **__):
    raise ConnectionError("lost")


def recorded(spark, wh):
    return {r.path: r.recordCount for r in stored_manifest(spark, wh).collect()}


def test_run_that_dies_between_write_and_index_is_indexed_when_repeated(spark, tmp_path, monkeypatch):
    wh = Warehouse(str(tmp_path))
    none = spark.createDataFrame([], "season INT, player_id STRING, min_games INT, name STRING")
    df = entries(spark, {"a": 1.0, "b": 2.0})
    college = spark.createDataFrame(
        [(2023, str(i), "x", "x", "x", "x", c, "YDS", "1") for c, n in (("passing", 3), ("rushing", 2)) for i in range(n)], S.COLLEGE_STATS
    )
    parts = [("passing", 2023), ("rushing", 2023)]
    day = date(2026, 5, 1)

    def run(hour):
        return (
            actions(publish(spark, df, wh, [2024, 2025], 2025, hours(hour), sentinels=none, **SMALL)),
            {r.category: r.action for r in publish_college(spark, college, wh, parts, hours(hour), min_rows=1, min_players=1).collect()},
            publish_snapshot(spark, snapshot(spark, market_rows()), wh, day, hours(hour)),
        )

    with monkeypatch.context() as broken:
        for module in ("warehouse", "market"):
            broken.setattr(f"seasonframe.plans.{module}.index", dies)
        for step in (
            lambda: publish(spark, df, wh, [2024, 2025], 2025, hours(0), sentinels=none, **SMALL),
            lambda: publish_college(spark, college, wh, parts, hours(0), min_rows=1, min_players=1),
            lambda: publish_snapshot(spark, snapshot(spark, market_rows()), wh, day, hours(0)),
        ):
            with pytest.raises(ConnectionError):
                step()
    assert recorded(spark, wh) == {}
    assert run(1) == ({2024: "index", 2025: "index"}, {"passing": "index", "rushing": "index"}, "index")
    expected = {"season_totals/2024": 2, "season_totals/2025": 2, "college/passing/2023": 3, "college/rushing/2023": 2, "market/snapshot-2026-05-01": 300}
    assert recorded(spark, wh) == expected
    assert run(2) == ({2024: "skip", 2025: "skip"}, {"passing": "skip", "rushing": "skip"}, "skip")
    assert recorded(spark, wh) == expected


def exchanges(df):
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def test_only_the_new_side_of_a_comparison_moves(spark, tmp_path):
    session = spark.newSession()
    session.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    session.conf.set("spark.sql.adaptive.enabled", "false")
    session.conf.set("spark.sql.shuffle.partitions", "5")
    wh = Warehouse(str(tmp_path / "it's here"), buckets=8)
    rows = session.range(3000).selectExpr("CAST(2020 + id % 3 AS INT) AS season", "CAST(id AS STRING) AS player_id", "CAST(id % 50 AS DOUBLE) AS fantasyPoints")
    table = season_table(session, wh)
    empty = session.createDataFrame([], S.SEASON_TOTALS)
    full = empty.unionByName(rows, allowMissingColumns=True).withColumn("player_key", player_key("season", "player_id"))
    assert table.write(full, [Row(season=s) for s in (2020, 2021, 2022)]) == {Row(season=s): 1000 for s in (2020, 2021, 2022)}
    new = rows.filter("player_id % 7 <> 0").withColumn("fantasyPoints", F.col("fantasyPoints") + (F.col("player_id") % 5 == 0).cast("int"))
    for compare in ("points", "all"):
        side = new if compare == "points" else empty.unionByName(new, allowMissingColumns=True)
        old = table.read().filter("season > 2020") if compare == "points" else table.read()
        plain = old.drop("player_key") if compare == "all" else old.drop("player_key")
        diff = season_diff(old, side, compare=compare)
        plan = exchanges(diff)
        assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan, plan
        assert sorted(map(tuple, diff.collect()), key=str) == sorted(map(tuple, season_diff(plain, side, compare=compare).collect()), key=str)
    again = BucketedTable(spark.newSession(), wh.season_totals, f"{S.SEASON_TOTALS}, player_key STRING", ["season"], "player_key", 8)
    assert again.read().count() == 3000


def test_manifest_is_mended_from_what_is_stored(spark, tmp_path):
    wh = Warehouse(str(tmp_path))
    none = spark.createDataFrame([], "season INT, player_id STRING, min_games INT, name STRING")
    publish(spark, entries(spark, {"a": 1.0, "b": 2.0}), wh, [2024, 2025], 2025, hours(0), sentinels=none, **SMALL)
    publish_snapshot(spark, snapshot(spark, market_rows()), wh, date(2026, 5, 1), hours(0))
    coach = spark.createDataFrame([(0, 2026, "SF", "HC", "A")], "ord LONG, year INT, team STRING, role STRING, name STRING")
    upsert_entries(spark, "coaching", coach, wh, hours(0), current_year=2026)
    good = {r.path: (r.recordCount, r.inProgress, r.schemaVersion) for r in stored_manifest(spark, wh).collect()}
    assert len(good) == 4
    assert {r.state for r in repair_manifest(spark, wh, 2025, hours(1)).collect()} == {"ok"}
    broken = stored_manifest(spark, wh).filter("path <> 'season_totals/2024' AND path <> 'overlay/coaching'")
    broken = broken.withColumn("recordCount", F.when(F.col("path").startswith("market"), 7).otherwise(F.col("recordCount")))
    gone = spark.createDataFrame([("college/passing/2001", None, 5, False, 1, T0)], S.MANIFEST)
    write_version(broken.unionByName(gone), wh.manifest, hours(2))
    expected = {
        "season_totals/2024": "missing", "season_totals/2025": "ok", "market/snapshot-2026-05-01": "stale",
        "overlay/coaching": "missing", "college/passing/2001": "orphan",
    }
    for dry in (True, False):
        assert {r.path: r.state for r in repair_manifest(spark, wh, 2025, hours(3), dry_run=dry).collect()} == expected
    mended = {r.path: (r.recordCount, r.inProgress, r.schemaVersion) for r in stored_manifest(spark, wh).collect()}
    assert mended == good | {"college/passing/2001": (5, False, 1)}


def test_rows_are_counted_by_the_write(spark, tmp_path):
    df = spark.range(1000).selectExpr("id % 3 AS k", "id")
    parts = [Row(k=0), Row(k=1), Row(k=2), Row(k=9)]
    assert write_partitions(df, str(tmp_path / "a"), ["k"], ["id"], parts) == {Row(k=0): 334, Row(k=1): 333, Row(k=2): 333, Row(k=9): 0}
    with pytest.raises(ValueError, match="outside"):
        write_partitions(df, str(tmp_path / "b"), ["k"], ["id"], parts[:2])
    assert write_partitions(df.limit(0), str(tmp_path / "c"), ["k"], ["id"], parts[:1]) == {Row(k=0): 0}


def test_manifest_keeps_other_fields(spark):
    old = spark.createDataFrame([("a", "key-a", 1, False, 1, T0), ("b", "key-b", 2, True, 3, T0)], S.MANIFEST)
    new = spark.createDataFrame([("a", 9, None, 2, hours(1)), ("c", 5, True, 1, hours(1))], "path STRING, recordCount LONG, inProgress BOOLEAN, schemaVersion INT, lastModified TIMESTAMP")
    merged = manifest_upsert(old, new)
    got = {r.path: (r.originalKey, r.recordCount, r.inProgress, r.schemaVersion) for r in merged.collect()}
    assert got == {"a": ("key-a", 9, None, 2), "b": ("key-b", 2, True, 3), "c": (None, 5, True, 1)}
    assert sorted(r.path for r in supported(merged).collect()) == ["a", "c"]


def test_json_export_is_repeatable(spark, tmp_path):
    df = entries(spark, {"b": 1.0, "a": 2.0})
    texts = []
    for name in ("x", "y"):
        export_json(df.repartition(3), str(tmp_path / name), ["season"], ["player_id"])
        files = sorted((tmp_path / name).glob("season=*/*.json"), key=lambda f: (f.parent.name, f.name))
        texts.append("".join(f.read_text() for f in files))
    assert texts[0] == texts[1] and [json.loads(t)["player_id"] for t in texts[0].splitlines()] == ["a", "b", "a", "b"]


def test_stream(spark, tmp_path):
    wh, landing = Warehouse(str(tmp_path / "wh")), tmp_path / "landing"
    landing.mkdir()

    def land(day, rows):
        (landing / f"snapshot-2026-05-{day:02d}.json").write_text(json.dumps(rows))

    def run():
        query = publish_stream(spark, str(landing), wh, str(tmp_path / "cp"))
        query.awaitTermination(120)
        assert query.exception() is None

    # Written out of date order on purpose.
    land(2, market_rows(changed=3))
    land(1, market_rows())
    land(3, market_rows(changed=3))
    land(4, market_rows(n=10))
    (landing / "readme.json").write_text("[]")
    run()
    stored = {r[0].day for r in spark.read.parquet(wh.market).select("snapshot_date").distinct().collect()}
    assert stored == {1, 2}
    rejected = spark.read.parquet(wh.market_rejects).first()
    assert rejected.snapshot_date.day == 4 and "10 rows" in rejected.message
    land(5, market_rows(changed=9))
    run()
    assert spark.read.parquet(wh.market).select("snapshot_date").distinct().count() == 3
    assert spark.read.parquet(wh.market_checks).count() == 4

    # The same files once more, from a lost checkpoint, and files without rows.
    def state():
        tables = (wh.market, wh.market_checks, wh.market_rejects)
        rows = [sorted(map(tuple, spark.read.parquet(t).collect()), key=str) for t in tables]
        return rows, sorted((r.path, r.recordCount) for r in stored_manifest(spark, wh).collect())

    before = state()
    query = publish_stream(spark, str(landing), wh, str(tmp_path / "cp2"))
    query.awaitTermination(120)
    assert query.exception() is None and state() == before
    (landing / "snapshot-2026-05-07.json").write_text("{}")
    (landing / "snapshot-2026-05-08.json").write_text("[]")
    run()
    refused = {r.file: r.message for r in spark.read.parquet(wh.market_rejects).collect()}
    assert "not an array" in refused["snapshot-2026-05-07.json"] and "0 rows" in refused["snapshot-2026-05-08.json"]


def test_versions_count_up_whatever_the_run_times(spark, tmp_path):
    wh = Warehouse(str(tmp_path))
    for day, hour in ((1, 5000), (2, 10)):
        publish_snapshot(spark, snapshot(spark, market_rows(changed=day)), wh, date(2026, 6, day), hours(hour))
    assert stored_manifest(spark, wh).count() == 2


def test_exports_replace_only_their_partitions(spark, tmp_path):
    df = entries(spark, {"a": 1.0})
    for season in (2024, 2025):
        export_json(df.filter(F.col("season") == season), str(tmp_path), ["season"], ["player_id"])
    assert sorted(p.name for p in tmp_path.glob("season=*")) == ["season=2024", "season=2025"]


def test_injury_of_nobody_is_refused_and_all_overlays_are_checked(spark, tmp_path):
    wh = Warehouse(str(tmp_path))
    row = [(0, "p1", 2025, 3)]
    df = spark.createDataFrame(row, "ord LONG, playerId STRING, year INT, segmentStartWeek INT")
    with pytest.raises(QualityError, match="no season totals for player p1"):
        upsert_entries(spark, "injuries", df, wh, hours(0), current_year=2026)
    assert validate_overlays(spark, wh, current_year=2026).isEmpty()
    coach = spark.createDataFrame([(0, 2026, "SF", "HC", "A")], "ord LONG, year INT, team STRING, role STRING, name STRING")
    upsert_entries(spark, "coaching", coach, wh, hours(0), current_year=2026)
    assert {r.rule_id for r in validate_overlays(spark, wh, current_year=2020).collect()} == {"DQ-29"}


def test_landing(spark, tmp_path):
    wh, src = Warehouse(str(tmp_path / "wh")), tmp_path / "src"

    def week(n, text):
        target = src / "season=2024" / f"week={n}"
        target.mkdir(parents=True, exist_ok=True)
        (target / "entries.json").write_text(text)

    def landed():
        return {(r.week, r.player_id): r.stats for r in landed_entries(spark, wh).collect()}

    week(1, '[{"player_id": "a", "team": "SF", "stats": {"gp": 1}}]')
    week(2, '[{"player_id": "b", "team": "SF", "stats": {}}]')
    land_weekly(spark, str(src), wh)
    assert landed() == {(1, "a"): {"gp": 1.0}, (2, "b"): {}}
    week(1, '[{"player_id": "c", "team": "SF", "stats": {"gp": 0}}]')
    week(2, "error")
    land_weekly(spark, str(src), wh)
    assert landed() == {(1, "c"): {"gp": 0.0}, (2, "b"): {}}
    plan = landed_entries(spark, wh).filter("season = 2024 AND week = 1")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(season" in plan


def aside(spark, wh, dataset):
    rows = [(r.partition, r.file.rsplit("/", 1)[-1], r.position, r.reason) for r in quarantined(spark, wh, dataset).collect()]
    return sorted(rows, key=lambda r: (r[0] or "", r[1], r[2] or 0))


def test_what_cannot_be_used_is_put_aside_and_refused(spark, tmp_path):
    wh, src = Warehouse(str(tmp_path / "wh")), tmp_path / "src"

    def put(path, text):
        (src / path).parent.mkdir(parents=True, exist_ok=True)
        (src / path).write_text(text)

    entry = '{"player_id": "a", "team": "SF", "stats": {"gp": 1}}'
    put("weekly/season=2024/week=1/a.json", f'[{entry}, 7, {{"player_id": "b", "stats": [1]}}]')
    put("weekly/season=2024/week=2/a.json", f"[{entry}, {{")
    put("weekly/season=2024/week=19/a.json", f"[{entry}]")
    put("weekly/season=2024/week=3/a.json", "[]")
    land_weekly(spark, str(src / "weekly"), wh)
    assert [(r.week, r.player_id) for r in landed_entries(spark, wh).collect()] == [(1, "a")]
    assert aside(spark, wh, "weekly") == [
        ("2024/1", "a.json", 1, "record"), ("2024/1", "a.json", 2, "type"),
        ("2024/19", "a.json", 0, "place"), ("2024/2", "a.json", None, "document"),
    ]

    def row(pid, stat="1"):
        return {"season": 2023, "playerId": pid, "player": "x", "position": "x", "team": "x", "conference": "x", "category": "passing", "statType": "YDS", "stat": stat}

    put("college/passing/2023.json", json.dumps([row("1"), row("2"), row("3")]))
    put("college/rushing/2023.json", json.dumps([row("1")])[:-4])
    land_college(spark, str(src / "college" / "*"), wh)
    rows = spark.read.parquet(wh.path("landed", "college")).select(*[f.split()[0] for f in S.COLLEGE_STATS.split(", ")])
    limits = {"min_rows": 1, "min_players": 1}
    assert publish_college(spark, rows, wh, [("passing", 2023)], hours(0), **limits).first().action == "write"
    with pytest.raises(QualityError, match="rushing/2023.*not an array"):
        publish_college(spark, rows, wh, [("passing", 2023), ("rushing", 2023)], hours(1), **limits)
    # The next landing replaces what the last one put aside.
    put("college/rushing/2023.json", "[]")
    land_college(spark, str(src / "college" / "*"), wh)
    assert aside(spark, wh, "college") == [] and len(aside(spark, wh, "weekly")) == 4

    put("market/snapshot-2026-05-01.json", json.dumps([*market_rows(), {"name": "x", "value": "much"}]))
    put("market/snapshot-latest.json", json.dumps(market_rows()[:1]))
    land_snapshots(spark, str(src / "market"), wh)
    assert aside(spark, wh, "market") == [
        (None, "snapshot-latest.json", 0, "place"), ("2026-05-01", "snapshot-2026-05-01.json", 300, "type"),
    ]
    landed = spark.read.parquet(wh.path("landed", "market")).drop("snapshot_date")
    with pytest.raises(QualityError, match="1 records put aside"):
        publish_snapshot(spark, landed, wh, date(2026, 5, 1), hours(0))
    assert publish_snapshot(spark, landed, wh, date(2026, 5, 2), hours(0)) == "write"


def test_a_document_of_many_players_is_parsed_by_many_tasks(spark, tmp_path):
    wh, src = Warehouse(str(tmp_path / "wh")), tmp_path / "src"
    src.mkdir()
    totals = season_totals(entries(spark, {f"p{i}": float(i) for i in range(500)}, seasons=(2024,)))
    document = {r.player_id: json.loads(r.j) for r in totals.select("player_id", F.to_json(F.struct("*")).alias("j")).collect()}
    (src / "2024.json").write_text(json.dumps(document))
    (src / "readme.json").write_text("{}")
    session = spark.newSession()
    session.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    docs = session.read.option("wholetext", True).text(str(src)).select(F.lit("2024").alias("partition"), F.lit("f").alias("file"), "value")
    spread = split_keyed(docs).repartition(F.xxhash64("partition", "file", "position"))
    tasks = checked_records(spread, SEASON).filter("reason IS NULL").groupBy(F.spark_partition_id()).count()
    assert tasks.count() > 1
    land_season_totals(spark, str(src), wh)
    landed = spark.read.schema(S.SEASON_TOTALS).parquet(wh.path("landed", "season_totals"))
    assert landed.count() == 500 and aside(spark, wh, "season_totals") == []
    assert season_diff(totals, landed, compare="all").filter("status <> 'unchanged'").isEmpty()


def test_writers_at_the_same_time_lose_nothing(spark, tmp_path):
    wh = Warehouse(str(tmp_path))

    def entry(n):
        return spark.createDataFrame([(f"a/{n}", n, False)], "path STRING, recordCount LONG, inProgress BOOLEAN")

    def coach(n):
        return spark.createDataFrame([(0, 2020 + n, "SF", "HC", f"C{n}")], "ord LONG, year INT, team STRING, role STRING, name STRING")

    with ThreadPoolExecutor(4) as pool:
        for done in [pool.submit(index, spark, wh, entry(n), hours(n)) for n in range(4)]:
            done.result()
        for done in [pool.submit(upsert_entries, spark, "coaching", coach(n), wh, hours(n), current_year=2026) for n in range(3)]:
            assert [r.action for r in done.result().collect()] == ["added"]
    assert recorded(spark, wh) == {f"a/{n}": n for n in range(4)} | {"overlay/coaching": 3}
    assert sorted(r.name for r in stored_overlay(spark, wh, "coaching").collect()) == ["C0", "C1", "C2"]
    assert sorted(p.name for p in (tmp_path / "overlay" / "coaching" / "versions").glob("0*")) == [f"{n:012d}" for n in (1, 2, 3)]


def test_version_of_another_writer_is_built_upon(spark, tmp_path):
    path, calls = str(tmp_path / "t"), []

    def add(value, first=None):
        def change(stored):
            calls.append(stored.count())
            if first and len(calls) == 1:
                first()
            return stored.union(spark.createDataFrame([(value,)], "x INT"))

        return change

    other = lambda: publish_version(spark, path, "x INT", lambda s: s.union(spark.createDataFrame([(1,)], "x INT")), T0)
    assert publish_version(spark, path, "x INT", add(2, other), T0) == 2
    assert calls == [0, 1] and sorted(r.x for r in read_version(spark, path, "x INT").collect()) == [1, 2]
    assert publish_version(spark, path, "x INT", lambda s: None, T0) is None
    assert write_version(spark.createDataFrame([], "x INT"), path, T0) == 3 and read_version(spark, path, "x INT").count() == 0


def test_decisions_of_a_stream(spark, tmp_path):
    wh, landing = Warehouse(str(tmp_path / "wh")), tmp_path / "landing"
    landing.mkdir()
    (landing / "in").mkdir()

    def land(market, day, rows, name=None):
        file = name or f"snapshot-2026-05-{day:02d}.json"
        doc = {"market": market, "snapshot_date": f"2026-05-{day:02d}" if name is None else None, "file": file}
        (landing / "in" / f"{market}-{file}").write_text(json.dumps(doc | {"value": rows if isinstance(rows, str) else json.dumps(rows)}))

    def run(checkpoint="cp"):
        docs = spark.readStream.schema("market STRING, snapshot_date DATE, file STRING, value STRING").json(str(landing / "in"))
        query = publish_decisions(docs, wh, str(tmp_path / checkpoint))
        query.awaitTermination(180)
        assert query.exception() is None

    def made():
        rows = spark.read.parquet(wh.path("market_decisions")).collect()
        return {(r.market, r.snapshot_date and r.snapshot_date.day): (r.decision, r.rule, r.baseline and r.baseline.day, r.changed_n) for r in rows}

    land("a", 2, market_rows(changed=3))
    land("a", 1, market_rows())
    land("a", 3, market_rows(changed=3)[::-1])
    land("a", 4, market_rows(n=10))
    land("a", 5, [{**r, "value": r["value"] - 5} for r in market_rows()])
    land("b", 1, market_rows(), name="readme.json")
    land("b", 2, market_rows(changed=1))
    land("b", 3, "[{")
    run()
    first = {
        ("a", 1): ("write", None, None, None), ("a", 2): ("write", None, 1, 3), ("a", 3): ("skip", None, 2, None), ("a", 4): ("reject", "DQ-17", None, None),
        ("a", 5): ("reject", "DQ-21", 2, 300), ("b", None): ("reject", "date", None, None), ("b", 2): ("write", None, None, None), ("b", 3): ("reject", "DQ-16", None, None),
    }
    assert made() == first
    # State outlives the run; a late file is told, and one whose baseline is too old is not guarded.
    land("a", 12, [{**r, "value": r["value"] - 5} for r in market_rows()])
    land("b", 1, market_rows(changed=9))
    run()
    second = first | {("a", 12): ("write", None, 2, 300), ("b", 1): ("late", None, 2, None)}
    assert made() == second
    stored = spark.read.parquet(wh.path("markets")).groupBy("market", "snapshot_date").count().collect()
    assert {(r.market, r.snapshot_date.day): r["count"] for r in stored} == {("a", 1): 300, ("a", 2): 300, ("a", 12): 300, ("b", 2): 300}
    run()
    assert made() == second
