from pyspark.sql import functions as F

from seasonframe.operators.diff import (
    diff_counts, diff_summary, diff_top, publish_action, season_diff,
)

SCHEMA = "season INT, player_id STRING, fantasyPoints DOUBLE, weeklyStatus ARRAY<STRING>, weeklyPoints MAP<INT, DOUBLE>"


def frame(spark, points, status="P", season=2024):
    rows = [(season, p, v, [status], {1: 1.0, 2: 2.0}) for p, v in points.items()]
    return spark.createDataFrame(rows, SCHEMA)


OLD = {"4034": 10.0, "SF": 5.0, "7": 1.0, "12": 1.0, "gone": 3.0, "same": 2.0, "tiny": 1.0, "n": None, "8": 4.0, "9": 4.0}
NEW = {"4034": 10.02, "SF": 15.0, "7": 3.0, "12": 3.0, "new": 3.0, "same": 2.0, "tiny": 1.005, "n": 0.0, "8": 6.0, "9": 2.0}


def test_diff(spark):
    diff = season_diff(frame(spark, OLD), frame(spark, NEW)).cache()
    counts = diff_counts(diff).first()
    assert (counts.added, counts.removed, counts.changed, counts.unchanged, counts.identical) == (1, 1, 6, 3, False)
    top = [(r["rank"], r.player_id) for r in diff_top(diff).orderBy("rank").collect()]
    assert top == [(1, "SF"), (2, "7"), (3, "8"), (4, "9"), (5, "12")]
    text = diff_summary(diff).first().text
    assert text.splitlines()[:3] == ["1 added, 1 removed, 6 changed", "Top diffs:", "  player SF: 5.00 → 15.00 (Δ10.00)"]
    assert len(text.splitlines()) == 7


def test_identical(spark):
    diff = season_diff(frame(spark, OLD), frame(spark, OLD, status="D"))
    assert diff_summary(diff).first().asDict() == {"season": 2024, "identical": True, "text": "no change"}


def test_compare_all_sees_other_fields(spark):
    old = frame(spark, {"a": 1.0, "b": 1.0})
    new = frame(spark, {"a": 1.0}).union(frame(spark, {"b": 1.0}, status="D"))
    rows = season_diff(old, new, compare="all").collect()
    assert {r.player_id: r.status for r in rows} == {"a": "unchanged", "b": "changed"}


def test_hot_season_keeps_top_rows_whole(spark):
    n = 5000
    old = spark.range(n).select(F.lit(1).alias("season"), F.col("id").cast("string").alias("player_id"), F.lit(0.0).alias("fantasyPoints"))
    new = old.withColumn("fantasyPoints", F.col("player_id").cast("double") + 1)
    diff = season_diff(old, new)
    assert [r.player_id for r in diff_top(diff).orderBy("rank").collect()] == [str(n - i) for i in range(1, 6)]
    plan = diff_top(diff)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_publish_action(spark):
    cases = [
        (False, False, None, "write"), (True, True, False, "skip"), (True, False, False, "refuse"),
        (True, False, True, "write"), (True, False, None, "write"), (False, False, False, "write"),
    ]
    df = spark.createDataFrame(cases, "o BOOLEAN, i BOOLEAN, p BOOLEAN, want STRING")
    got = df.select("want", publish_action(F.col("o"), F.col("i"), F.col("p")).alias("a")).collect()
    assert all(r.want == r.a for r in got)
    unrecorded = df.select("want", publish_action(F.col("o"), F.col("i"), F.col("p"), recorded=F.lit(False)).alias("a")).collect()
    assert all(r.a == {"skip": "index"}.get(r.want, r.want) for r in unrecorded)
    forced = df.filter("want = 'refuse'").select(publish_action(F.col("o"), F.col("i"), F.col("p"), True).alias("a"))
    assert forced.first().a == "write"
