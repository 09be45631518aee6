from datetime import date

import pytest
from pyspark.sql import functions as F

from seasonframe import constants as K
from seasonframe import schemas as S
from seasonframe.operators import quality as Q

DAY = date(2026, 5, 18)


def failed(df):
    return sorted((r.rule_id, r.key) for r in df.collect())


def rules(df):
    return sorted({r.rule_id for r in df.collect()})


# Season --------------------------------------------------------------------------------------


def season(spark, n=400, full=30, **changes):
    status = F.when(F.col("id") < full, F.array_repeat(F.lit("P"), 18)).otherwise(
        F.concat(F.array(F.lit("B"), F.lit("D")), F.array_repeat(F.lit("X"), 16))
    )
    good = F.col("id") < full
    df = spark.range(n).select(
        F.lit(2024).alias("season"),
        F.col("id").cast("string").alias("player_id"),
        F.when(good, 18).otherwise(0).alias("gamesPlayed"),
        F.when(good, 0).otherwise(1).alias("byeWeeks"),
        F.when(good, 0).otherwise(1).alias("dnpWeeks"),
        F.when(good, F.map_from_arrays(F.sequence(F.lit(1), F.lit(18)), F.array_repeat(F.lit(1.0), 18)))
        .otherwise(F.create_map().cast("map<int,double>")).alias("weeklyPoints"),
        status.alias("weeklyStatus"),
        F.struct(F.lit(0).alias("longestAbsence")).alias("availability"),
    )
    for name, value in changes.items():
        df = df.withColumn(name, value)
    return df


def test_season_limits(spark):
    assert rules(Q.season_rules(season(spark))) == []
    assert rules(Q.season_rules(season(spark, n=399))) == ["DQ-1"]
    assert rules(Q.season_rules(season(spark, full=29))) == ["DQ-2"]


def test_expected_season_without_rows(spark):
    seasons = spark.createDataFrame([(2030,)], "season INT")
    assert rules(Q.season_rules(season(spark), seasons=seasons)) == ["DQ-1", "DQ-2"]


def one(column, value):
    return F.when(F.col("player_id") == "7", value).otherwise(F.col(column))


@pytest.mark.parametrize("case", range(7))
def test_record_rules(spark, case):
    column, value, expected = [
        ("weeklyStatus", F.array_repeat(F.lit("P"), 17), ["DQ-3", "DQ-5", "DQ-8"]),
        ("weeklyStatus", F.lit(None), ["DQ-3", "DQ-5", "DQ-8"]),
        ("availability", F.lit(None), ["DQ-4"]),
        ("gamesPlayed", F.lit(17), ["DQ-5"]),
        ("byeWeeks", F.lit(1), ["DQ-6"]),
        ("dnpWeeks", F.lit(None), ["DQ-7"]),
        ("weeklyPoints", F.lit(None), ["DQ-8"]),
    ][case]
    df = season(spark)
    broken = df.withColumn(column, one(column, value))
    assert failed(Q.season_rules(broken)) == [(r, "7") for r in expected]


def test_first_failure_follows_document_order(spark):
    df = season(spark)
    broken = df.withColumn("byeWeeks", F.when(F.col("player_id").isin("10", "9"), 5).otherwise(F.col("byeWeeks")))
    first = Q.first_failures(Q.season_rules(broken)).first()
    assert (first.rule_id, first.key) == ("DQ-6", "9")
    with pytest.raises(Q.QualityError, match="byeWeeks=5"):
        Q.enforce(Q.season_rules(broken))


def test_sentinels(spark):
    listed = spark.createDataFrame(
        [(2024, "1", 18, "A"), (2024, "100", 1, "B"), (2024, "999", 1, "C"), (2023, "1", 1, "D")],
        "season INT, player_id STRING, min_games INT, name STRING",
    )
    assert failed(Q.sentinel_rules(season(spark), listed)) == [("DQ-10", "100"), ("DQ-9", "999")]
    warned = Q.sentinel_rules(season(spark), listed.filter("season = 2023"))
    assert [(r.rule_id, r.severity) for r in warned.collect()] == [("DQ-11", "warning")]
    Q.enforce(warned)
    assert Q.default_sentinels(spark).count() == len(K.SEASON_SENTINELS)


# College -------------------------------------------------------------------------------------


def college(spark, n=500, players=200, **changes):
    df = spark.range(n).select(
        F.lit(2023).alias("season"), F.lit("passing").alias("category"),
        (F.col("id") % players).cast("string").alias("playerId"), F.lit("YDS").alias("statType"), F.lit("1").alias("stat"),
    )
    for name, value in changes.items():
        df = df.withColumn(name, value)
    return df


def test_college(spark):
    assert rules(Q.college_rules(college(spark))) == []
    assert rules(Q.college_rules(college(spark, n=499))) == ["DQ-13"]
    assert rules(Q.college_rules(college(spark, players=199))) == ["DQ-15"]
    broken = college(spark).withColumn("stat", F.when(F.col("playerId") != "3", F.col("stat")))
    row = Q.college_rules(broken).first()
    assert (row.rule_id, row.observed, row.partition) == ("DQ-14", "3", "passing/2023")
    wanted = spark.createDataFrame([("rushing/2023",)], "partition STRING")
    assert rules(Q.college_rules(college(spark), partitions=wanted)) == ["DQ-13", "DQ-15"]


# Market --------------------------------------------------------------------------------------


def market(spark, n=300, sentinels=3, te=5, values=None):
    names = list(K.MARKET_SENTINELS)[:sentinels]
    rows = []
    for i in range(n):
        pos = "TE" if i < te else ("QB", "RB", "WR")[i % 3]
        name = names[i] if i < len(names) else f"n{i}"
        rows.append((DAY, i, name, None, (values or {}).get(i, 9000 - i), pos))
    return spark.createDataFrame(rows, S.MARKET_VALUES)


@pytest.mark.parametrize(
    "kwargs, expected",
    [
        ({}, []),
        ({"n": 250}, []),
        ({"n": 249}, ["DQ-17"]),
        ({"n": 600}, []),
        ({"n": 601}, ["DQ-17"]),
        ({"te": 4}, ["DQ-18"]),
        ({"values": {200: 9999, 201: 0}}, []),
        ({"values": {200: 10000}}, ["DQ-19"]),
        ({"values": {200: -1}}, ["DQ-19"]),
        ({"sentinels": 2}, ["DQ-20"]),
    ],
)
def test_market(spark, kwargs, expected):
    assert rules(Q.market_rules(market(spark, **kwargs))) == expected


def test_market_samples(spark):
    df = market(spark, values={50: -1, 60: 10000, 70: -2, 80: -3})
    row = Q.market_range_rules(df.withColumn("value", F.when(F.col("ord") != 40, F.col("value")))).first()
    assert row.observed == "5" and row.message.endswith("n40=null, n50=-1, n60=10000")


# Overlay -------------------------------------------------------------------------------------


def entries(spark, kind, *rows):
    names = [*S.OVERLAY_ENTRIES[kind], "ord"]
    data = [tuple({"id": f"e{i}", "ord": i, **r}.get(n) for n in names) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, S.ddl(S.OVERLAY_ENTRIES[kind]) + ", ord LONG")


COACH = {"year": 2024, "team": "SF", "role": "HC", "name": "A"}


def test_coaching_entries(spark):
    df = entries(
        spark, "coaching", COACH, {**COACH, "id": ""}, {**COACH, "name": None}, {**COACH, "team": "XX"},
        {**COACH, "year": 2011}, {**COACH, "year": 2027}, {**COACH, "role": "QB"}, {**COACH, "year": 2026},
    )
    got = failed(Q.overlay_entry_violations(df, "coaching", 2025))
    assert got == [("DQ-26", ""), ("DQ-27", "e2"), ("DQ-28", "e3"), ("DQ-29", "e4"), ("DQ-29", "e5"), ("DQ-30", "e6")]


def test_scheme_entries(spark):
    df = entries(spark, "scheme", {"year": 2024, "team": "SF", "offense": "", "defense": None}, {"year": 2024, "team": "SF", "tempo": "fast"})
    assert failed(Q.overlay_entry_violations(df, "scheme", 2025)) == [("DQ-31", "e0")]


def test_note_entries(spark):
    df = entries(
        spark, "notes", {"playerId": "1", "body": "x"}, {"body": "x"}, {"playerId": "1", "team": "SF", "body": "x"},
        {"team": "XX", "body": "x"}, {"team": "SF", "year": 2000, "body": "x"}, {"team": "SF", "body": "\t   "},
        {"team": "SF"}, {"playerId": "9", "body": "x"},
    )
    players = spark.createDataFrame([("1",)], "player_id STRING")
    got = failed(Q.overlay_entry_violations(df, "notes", 2025, players=players))
    assert got == [
        ("DQ-27", "e6"), ("DQ-35", "e1"), ("DQ-35", "e2"), ("DQ-36", "e3"), ("DQ-37", "e7"), ("DQ-38", "e4"),
        ("DQ-39", "e5"), ("DQ-39", "e6"),
    ]
    assert ("DQ-37", "e7") not in failed(Q.overlay_entry_violations(df, "notes", 2025))


def test_injury_entries(spark):
    totals = spark.createDataFrame(
        [(2024, "1", ([(2, 4, 3), (6, 6, 1)],)), (2024, "2", ([],))],
        "season INT, player_id STRING, availability STRUCT<absenceSegments: ARRAY<STRUCT<start: INT, end: INT, length: INT>>>",
    )
    base = {"playerId": "1", "year": 2024, "segmentStartWeek": 2}
    df = entries(spark, "injuries", base, {**base, "segmentStartWeek": 3}, {**base, "playerId": "2"}, {**base, "year": 2023})
    players = spark.createDataFrame([("1",)], "player_id STRING")
    out = Q.overlay_entry_violations(df, "injuries", 2025, totals=totals, players=players)
    assert failed(out) == [("DQ-32", "e2"), ("DQ-33", "e3"), ("DQ-34", "e1"), ("DQ-34", "e2")]
    messages = {r.key: r.message for r in out.filter("rule_id = 'DQ-34'").collect()}
    assert messages["e1"].endswith("available: w2, w6") and messages["e2"].endswith("available: none")


def test_duplicates_and_order(spark):
    coaching = entries(spark, "coaching", COACH, {**COACH, "name": "B"}, {**COACH, "role": "OC", "id": "e0"})
    scheme = entries(spark, "scheme", {"year": 2024, "team": "SF", "tempo": "x"}, {"year": 2024, "team": "SF", "tempo": "y"})
    out = Q.overlay_violations({"coaching": coaching, "scheme": scheme}, 2025)
    assert failed(out) == [("DQ-23", "e0"), ("DQ-24", "2024-SF-HC"), ("DQ-25", "2024-SF")]
    first = {r.partition: r.rule_id for r in Q.first_failures(out).collect()}
    assert first == {"coaching": "DQ-23", "scheme": "DQ-25"}


def test_documents(spark):
    docs = spark.createDataFrame(
        [("ok", '{"schemaVersion": 1, "entries": []}'), ("text", '{"schemaVersion": "1", "entries": []}'),
         ("half", '{"schemaVersion": 1.5, "entries": []}'), ("bare", '{"schemaVersion": 1}'),
         ("obj", '{"schemaVersion": 1, "entries": {}}'), ("list", "[]"), ("junk", "{"), ("none", None)],
        "overlay STRING, value STRING",
    )
    got = sorted(r.partition for r in Q.wrapper_rules(docs).collect())
    assert got == ["bare", "half", "junk", "list", "none", "obj", "text"]
    arrays = docs.withColumnRenamed("overlay", "partition")
    assert [r.partition for r in Q.array_document_rules(arrays, "market", "DQ-16").collect()].count("list") == 0


def test_unknown_players_with_a_hot_id(spark):
    refs = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("playerId"))
    known = spark.range(1000).select(F.col("id").cast("string").alias("player_id"))
    expected = sum(1 for i in range(3000) if i % 3 == 0 or i >= 1000)
    assert Q.unknown_players(refs, known).count() == expected


def test_first_failure_follows_the_document(spark):
    twice = [{**COACH, "role": r, "name": n} for r, n in (("OC", "A"), ("DC", "B"), ("DC", "C"), ("OC", "D"))]
    out = Q.overlay_violations({"coaching": entries(spark, "coaching", *[{**x, "id": f"i{k}"} for k, x in enumerate(twice)])}, 2025)
    assert Q.first_failures(out).first().key == "2024-SF-DC"
    note = entries(spark, "notes", {"playerId": "nobody", "year": 1990, "body": "x"})
    players = spark.createDataFrame([("1",)], "player_id STRING")
    assert Q.first_failures(Q.overlay_violations({"notes": note}, 2025, players=players)).first().rule_id == "DQ-37"
    bad = {k: entries(spark, k, {"year": 1990, "team": "SF", "tempo": "x"} if k == "scheme" else {"playerId": "1", "year": 1990, "segmentStartWeek": 1}) for k in ("scheme", "injuries")}
    with pytest.raises(Q.QualityError, match="overlay scheme"):
        Q.enforce(Q.overlay_violations(bad, 2025))


def test_sentinels_in_list_order(spark):
    totals = spark.createDataFrame([(2024, "x", 17)], "season INT, player_id STRING, gamesPlayed INT")
    out = Q.sentinel_rules(totals, Q.default_sentinels(spark))
    assert Q.first_failures(out).first().key == "6783"


def test_empty_snapshot_fails(spark):
    none = spark.createDataFrame([], "snapshot_date DATE, ord LONG, name STRING, team STRING, value INT, position STRING")
    day = spark.sql("SELECT DATE'2026-05-01' AS snapshot_date")
    assert [(r.rule_id, r.observed) for r in Q.market_rules(none, day).collect()] == [("DQ-17", "0")]
