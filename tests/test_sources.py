import json
from datetime import date

import pytest
from pyspark.errors import AnalysisException

from seasonframe import sources as R
from seasonframe.analog import files
from seasonframe.operators.college import pivot_category
from seasonframe.operators.totals import season_totals
from seasonframe.sources.documents import college_documents, overlay_documents


def put(root, path, value):
    target = root / path
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_text(value if isinstance(value, str) else json.dumps(value), encoding="utf8")


def test_weekly(spark, tmp_path):
    week1 = [
        {"player_id": "a", "team": "SF", "stats": {"gp": 1, "pts_half_ppr": 2.5}, "extra": 1},
        {"player_id": "", "team": "SF", "stats": {}},
        {"player_id": "b", "stats": {}},
        {"player_id": "c", "team": "SF"},
    ]
    put(tmp_path, "season=2024/week=1/entries.json", week1)
    put(tmp_path, "season=2024/week=2/entries.json", "{}")
    put(tmp_path, "season=2024/week=3/entries.json", "<html>error</html>")
    df = R.read_weekly(spark, str(tmp_path))
    assert [tuple(r) for r in df.orderBy("ord").collect()] == [
        (2024, 1, 0, "a", "SF", {"gp": 1.0, "pts_half_ppr": 2.5}), (2024, 1, 2, "b", None, {})
    ]
    assert season_totals(df).count() == 2
    assert R.read_weekly(spark, str(tmp_path / "nowhere")).count() == 0


def test_season_totals_round_trip(spark, tmp_path):
    record = {
        "stats": {"rec": 3, "gp": 1}, "gamesPlayed": 1, "gamesStarted": 0, "byeWeeks": 0, "dnpWeeks": 0,
        "weeklyPoints": {"1": 18.4}, "fantasyPoints": 18.4, "scoringBasis": "half_ppr", "weeklyStatus": ["P"] + ["X"] * 17,
        "availability": {"longestAbsence": 0, "absenceSegments": [], "firstWeek": 1, "lastWeek": 1,
                         "returnedFromAbsence": False, "absenceCause": "unknown"},
    }
    put(tmp_path, "2024.json", {"SF": record, "4034": record})
    rows = R.read_season_totals(spark, str(tmp_path)).orderBy("ord").collect()
    assert [(r.season, r.ord, r.player_id, r.weeklyPoints, r.stats) for r in rows] == [
        (2024, 0, "SF", {1: 18.4}, {"rec": 3.0, "gp": 1.0}), (2024, 1, "4034", {1: 18.4}, {"rec": 3.0, "gp": 1.0})
    ]


def test_college(spark, tmp_path):
    def row(stat_type, stat, pid="1"):
        return {"season": 2023, "playerId": pid, "player": "N", "position": "QB", "team": "A", "conference": "P",
                "category": "passing", "statType": stat_type, "stat": stat}

    put(tmp_path, "passing/2023.json", [row("YDS", "2869"), row("TD", "x"), row("INT", None), row("YDS", "1.5", "2")])
    put(tmp_path, "rushing/2023.json", {"message": "error"})
    df = R.read_college(spark, str(tmp_path / "*"))
    assert df.count() == 4
    wide = {r.playerId: r for r in pivot_category(df, "passing").collect()}
    assert wide["1"].YDS == 2869.0 and wide["1"].TD is None and wide["2"].YDS == 1.5 and wide["1"].ATT is None
    shapes = {r.partition for r in college_documents(spark, str(tmp_path / "*")).collect()}
    assert shapes == {"passing/2023", "rushing/2023"}


def test_snapshots(spark, tmp_path):
    put(tmp_path, "snapshot-2026-05-18.json", [{"name": "A", "team": "SF", "value": 5, "position": "QB"}, {"name": "B", "value": "x"}])
    put(tmp_path, "snapshot-latest.json", [{"name": "C"}])
    rows = R.read_snapshots(spark, str(tmp_path)).orderBy("name").collect()
    assert [(r.snapshot_date, r.ord, r.name, r.value) for r in rows] == [
        (date(2026, 5, 18), 0, "A", 5), (date(2026, 5, 18), 1, "B", None), (None, 0, "C", None)
    ]


def test_overlays(spark, tmp_path):
    put(tmp_path, "coaching.json", {"schemaVersion": 1, "updatedAt": "2026-05-19T09:42:37.732Z", "entries": [
        {"id": "c1", "year": 2026, "team": "ARI", "role": "HC", "name": "X"}, {"id": "c2", "year": "2026"}]})
    put(tmp_path, "notes.json", {"schemaVersion": 1, "entries": []})
    got = R.read_overlays(spark, str(tmp_path))
    assert {k: v.count() for k, v in got.items()} == {"coaching": 2, "scheme": 0, "injuries": 0, "notes": 0}
    assert [r.year for r in got["coaching"].orderBy("ord").collect()] == [2026, None]
    assert {r.overlay for r in overlay_documents(spark, str(tmp_path)).collect()} == {"coaching", "notes"}


def test_manifest(spark, tmp_path):
    put(tmp_path, "manifest.json", {"schemaVersion": 1, "files": {
        "a/2024.json": {"originalKey": "k", "recordCount": 3, "inProgress": False, "schemaVersion": 2,
                        "lastModified": "2026-05-19T18:32:11.123Z"}}})
    row = R.read_manifest(spark, str(tmp_path / "manifest.json")).first()
    assert (row.path, row.recordCount, row.inProgress, row.schemaVersion) == ("a/2024.json", 3, False, 2)
    with pytest.raises(AnalysisException):
        R.read_manifest(spark, str(tmp_path / "missing.json"))


def test_state_and_players(spark, tmp_path):
    put(tmp_path, "state.json", {"week": 0, "season": "2026", "season_type": "off"})
    assert R.read_state(spark, str(tmp_path / "state.json")).first().current_season == 2026
    put(tmp_path, "players.json", {"1": {"first_name": "A", "position": "QB"}, "SF": {"position": "DEF"}})
    assert {r.player_id: r.position for r in R.read_players(spark, str(tmp_path / "players.json")).collect()} == {"1": "QB", "SF": "DEF"}
    assert R.read_players(spark, str(tmp_path / "none.json")) is None


def test_league_documents(spark, tmp_path):
    put(tmp_path, "league.json", {"league_id": "L", "settings": {"teams": 2}, "scoring_settings": {"rec": 0.5, "fum": -2},
                                  "roster_positions": ["QB", "BN"], "metadata": {"a": "b"}})
    put(tmp_path, "rosters.json", [
        {"league_id": "L", "roster_id": 1, "players": ["1", "2"], "starters": ["1"], "taxi": None, "reserve": None},
        {"league_id": "L", "roster_id": 2, "players": None, "taxi": ["3"]}])
    put(tmp_path, "users.json", [{"user_id": "u", "is_bot": False, "metadata": {"team_name": "T"}}])
    put(tmp_path, "drafts.json", [{"draft_id": "d", "created": 1767171379968, "draft_order": {"u": 1}, "settings": {"rounds": 5}}])
    leagues = R.read_leagues(spark, str(tmp_path / "league.json"))
    assert {r.stat_key: r.weight for r in R.scoring_weights(leagues).collect()} == {"rec": 0.5, "fum": -2.0}
    listed = R.roster_players(R.read_rosters(spark, str(tmp_path / "rosters.json")))
    assert sorted((r.roster_id, r.list, r.slot, r.player_id) for r in listed.collect()) == [
        (1, "players", 0, "1"), (1, "players", 1, "2"), (1, "starters", 0, "1"), (2, "taxi", 0, "3")]
    assert R.read_users(spark, str(tmp_path / "users.json")).first().metadata == {"team_name": "T"}
    draft = R.read_drafts(spark, str(tmp_path / "drafts.json")).first()
    assert draft.draft_order == {"u": 1} and draft.created_at.year == 2025


def test_files_of_a_week_follow_each_other(spark, tmp_path):
    for name in ("b", "a"):
        put(tmp_path, f"season=2024/week=1/{name}.json", [{"player_id": name + str(k), "team": "SF", "stats": {}} for k in range(2)])
    df = R.read_weekly(spark, str(tmp_path))
    assert [r.player_id for r in df.orderBy("ord").collect()] == ["a0", "a1", "b0", "b1"]


def test_current_season_and_manifest_header(spark, tmp_path):
    from pyspark.sql import functions as F

    from seasonframe.sources.documents import current_season, manifest_header

    today = F.lit(date(2026, 2, 1))
    assert current_season(spark, str(tmp_path / "none.json"), today).first()[0] == 2025
    put(tmp_path, "state.json", {"season": "2023", "week": 1})
    assert current_season(spark, str(tmp_path / "state.json"), today).first()[0] == 2023
    put(tmp_path, "manifest.json", {"generatedAt": "2026-05-01T00:00:00Z", "files": {}})
    header = manifest_header(spark, str(tmp_path / "manifest.json")).first()
    assert header.generatedAt.day == 1 and header.exportedAt is None


def test_documents_on_lines(spark, tmp_path):
    states = [{"week": 1, "season": "2024"}, {"week": 1, "season": "2024"}, {"week": 2, "season": "no year"}]
    put(tmp_path, "state/part-0", json.dumps(states[0]) + "\r\n\n" + json.dumps(states[1]) + "\n")
    put(tmp_path, "state/part-1", json.dumps(states[2]))
    rows = R.read_state(spark, str(tmp_path / "state"), lines=True).orderBy("week").collect()
    assert [(r.season, r.current_season, r.week) for r in rows] == [("2024", 2024, 1), ("2024", 2024, 1), ("no year", None, 2)]
    put(tmp_path, "players/part-0", '{"1": {"position": "QB"}, "2": {}}\n{"3": {}}\n')
    assert {r.player_id for r in R.read_players(spark, str(tmp_path / "players"), lines=True).collect()} == {"1", "2", "3"}
    assert R.read_players(spark, str(tmp_path / "none"), lines=True) is None
    with pytest.raises(AnalysisException):
        R.read_manifest(spark, str(tmp_path / "none"), lines=True)


def test_files_do_not_grow_with_documents(spark, tmp_path):
    """Neither one file for each document nor one row for equal documents."""
    spark.range(300).selectExpr("id % 299 AS s_suppkey").coalesce(2).write.parquet(str(tmp_path / "supplier.parquet"))
    states = files.q_state_files(spark, str(tmp_path))
    assert states.count() == 300 and len(states.inputFiles()) <= 8
    customers = spark.range(2000).selectExpr("id AS c_custkey", "'c' || id AS c_name", "1D AS c_acctbal", "'A' AS c_mktsegment")
    customers.coalesce(2).write.parquet(str(tmp_path / "customer.parquet"))
    orders = spark.range(4000).selectExpr("id AS o_orderkey", "id % 2000 AS o_custkey", "TIMESTAMP '1999-05-01' AS o_orderdate")
    orders.coalesce(2).write.parquet(str(tmp_path / "orders.parquet"))
    for made in (files.q_player_files, files.q_overlay_files, files.q_manifest_files):
        df = made(spark, str(tmp_path))
        assert df.count() == 2000 and len(df.inputFiles()) <= 8
