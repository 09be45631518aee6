import random
from collections import defaultdict

import pytest

from seasonframe import schemas as S
from seasonframe.operators.dedup import duplicate_counts, first_seen, later_copies
from seasonframe.operators.totals import league_points, season_totals
from seasonframe.operators.weekly import ENTRY_KEY, weekly_status


def entry(week, ord_, pid, team, stats, season=2024):
    return (season, week, ord_, pid, team, stats)


def frame(spark, rows):
    return spark.createDataFrame(rows, S.WEEKLY_ENTRIES)


ROWS = [
    entry(1, 0, "a", "SF", {"gp": 1.0, "gs": 1.0, "pts_half_ppr": 18.4, "rec": None, "rush": 2.0}),
    entry(1, 1, "b", "SF", {"gp": 0.0}),
    entry(1, 2, "c", "KC", {"gp": 0.0}),
    entry(1, 3, "d", None, {"gp": 0.0}),
    entry(1, 4, "e", "", {}),
    entry(1, 5, "f", "KC", {"gp": None}),
    entry(1, 6, "g", "SF", {"gp": 2.0, "pts_half_ppr": 9.0}),
    entry(1, 7, "a", "SF", {"gp": 0.0}),
    entry(1, 8, "", "SF", {"gp": 1.0}),
    entry(1, 9, "h", "SF", None),
    entry(2, 0, "a", "SF", {"gp": 0.0}),
    entry(2, 1, "a", "SF", {"gp": 1.0, "gs": 1.0}),
    entry(2, 2, "b", "SF", {"gp": 0.0}),
    entry(3, 0, "a", "SF", {"gp": 1.0, "gs": 0.0, "rush": -3.5}),
    entry(19, 0, "a", "SF", {"gp": 1.0}),
]


@pytest.fixture(scope="module")
def totals(spark):
    return {r.player_id: r for r in season_totals(frame(spark, ROWS)).collect()}


def test_players_without_id_or_stats_are_dropped(totals):
    assert sorted(totals) == ["a", "b", "c", "d", "e", "f", "g"]


@pytest.mark.parametrize(
    "pid, start",
    [
        ("a", "PBPX"),  # second copy of week 2 is ignored, so its team is on a bye
        ("b", "DBXX"),
        ("c", "BXXX"),
        ("d", "DXXX"),  # no team is never a bye
        ("e", "DXXX"),
        ("f", "BXXX"),
        ("g", "DXXX"),  # gp of 2 is not a game
    ],
)
def test_status(totals, pid, start):
    status = "".join(totals[pid].weeklyStatus)
    assert len(status) == 18
    assert status.startswith(start)


def test_sums(totals):
    a = totals["a"]
    assert (a.gamesPlayed, a.gamesStarted, a.byeWeeks, a.dnpWeeks) == (2, 1, 1, 0)
    assert a.stats == {"gp": 2.0, "gs": 1.0, "pts_half_ppr": 18.4, "rush": -1.5}
    assert a.weeklyPoints == {1: 18.4, 3: 0.0}
    assert a.fantasyPoints == 18.4
    assert a.scoringBasis == "half_ppr"
    assert a.availability.asDict(True) == {
        "longestAbsence": 0, "absenceSegments": [], "firstWeek": 1, "lastWeek": 3,
        "returnedFromAbsence": False, "absenceCause": "unknown",
    }


def test_never_played(totals):
    b = totals["b"]
    assert b.stats == {} and b.weeklyPoints == {} and b.fantasyPoints == 0
    assert b.availability.firstWeek is None and b.availability.lastWeek is None


def test_negative_half_rounds_up(spark):
    rows = [entry(1, 0, "a", "SF", {"gp": 1.0, "pts_half_ppr": -0.125})]
    assert season_totals(frame(spark, rows)).first().fantasyPoints == -0.12


def test_row_form_agrees_with_array_form(spark):
    df = frame(spark, ROWS)
    rows = {(r.player_id, r.week): r.status for r in weekly_status(df).collect()}
    arrays = {
        (t.player_id, i + 1): s
        for t in season_totals(df).collect()
        for i, s in enumerate(t.weeklyStatus)
        if s != "X"
    }
    assert rows == arrays


def test_league_points(spark):
    df = season_totals(frame(spark, ROWS))
    scored = league_points(df, {"rush": 2.0, "gp": 0.1, "unused": 5.0})
    assert {r.player_id: r.leaguePoints for r in scored.collect()}["a"] == -2.8


def brute(rows):
    """Per player: status text, points and stats, from sorted plain rows."""
    first = {}
    for season, week, ord_, pid, team, stats in sorted(rows, key=lambda r: r[2]):
        first.setdefault((season, week, pid), (team, stats))
    active = {(s, w, t) for (s, w, _), (t, st) in first.items() if st.get("gp") == 1 and t}
    status = defaultdict(lambda: ["X"] * 18)
    sums = defaultdict(lambda: defaultdict(float))
    for (s, w, pid), (team, stats) in sorted(first.items()):
        if stats.get("gp") == 1:
            code = "P"
            for k, v in stats.items():
                sums[s, pid][k] += v
        else:
            code = "B" if team and (s, w, team) not in active else "D"
        status[s, pid][w - 1] = code
    return {k: ("".join(v), dict(sums[k])) for k, v in status.items()}


def test_hot_player_and_team_match_brute_force(spark):
    """A third of all rows are copies of one player-week and another third one team."""
    rng = random.Random(7)
    rows = []
    for i in range(3000):
        hot = i % 3
        pid = "hot" if hot == 0 else f"p{rng.randrange(60)}"
        team = "BIG" if hot == 1 else rng.choice(["SF", "KC", None, ""])
        week = 4 if hot == 0 else rng.randrange(1, 19)
        stats = {"gp": float(rng.random() < 0.1), "pts_half_ppr": float(rng.randrange(100)), f"k{i % 4}": 1.0}
        rows.append(entry(week, i, pid, team, stats, season=2023 + i % 2))
    got = {
        (r.season, r.player_id): ("".join(r.weeklyStatus), r.stats)
        for r in season_totals(frame(spark, rows)).collect()
    }
    assert got == brute(rows)


def test_duplicates(spark):
    df = frame(spark, [r for r in ROWS if r[3] and r[5] is not None])
    assert first_seen(df, ENTRY_KEY, "ord").count() == 11
    assert [(r.week, r.n_dupes) for r in duplicate_counts(df, ENTRY_KEY, ["week"]).orderBy("week").collect()] == [(1, 1), (2, 1)]
    removed = later_copies(df, ENTRY_KEY, "ord").select("week", "player_id", "ord").orderBy("week")
    assert [tuple(r) for r in removed.collect()] == [(1, "a", 7), (2, "a", 1)]


def test_entries_are_read_once(spark, tmp_path):
    """Only one reader takes the stats; the bye look-up and the least order read keys alone."""
    frame(spark, ROWS).write.parquet(str(tmp_path / "e"))
    out = season_totals(spark.read.parquet(str(tmp_path / "e")))
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    scans = [line for line in plan.splitlines() if "FileScan" in line]
    assert len(scans) <= 4 and "SortAggregate" not in plan


def test_dropped_weeks_are_counted(spark):
    from seasonframe.operators.weekly import dropped_weeks

    rows = [(2024, w, 0, "a", "SF", {}) for w in (0, 1, 18, 19, 19)]
    df = spark.createDataFrame(rows, S.WEEKLY_ENTRIES)
    assert sorted((r.week, r.n) for r in dropped_weeks(df).collect()) == [(0, 1), (19, 2)]


def test_season_totals_sort_nothing_above_the_scan(spark):
    from seasonframe.operators.totals import season_totals

    df = spark.createDataFrame([(2024, 1, 0, "a", "SF", {"gp": 1.0})], S.WEEKLY_ENTRIES)
    plan = season_totals(df)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan
