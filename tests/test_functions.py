import math

from pyspark.sql import functions as F

from seasonframe import functions as fn
from seasonframe.functions.time import age_days, snapshot_date_of


def column(spark, values, type_, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i INT, v {type_}")
    return [r[1] for r in df.select("i", expr(F.col("v"))).orderBy("i").collect()]


def test_round_cents(spark):
    values = [1.115, -2.5, 0.005, -0.005, 2.675, 123.456, -7.125, 0.0]
    expected = [(math.floor(v * 100) + (v * 100 - math.floor(v * 100) >= 0.5)) / 100 for v in values]
    assert column(spark, values, "DOUBLE", fn.round_cents) == expected


def test_prefix_int(spark):
    values = ["1,234", "  42x", "x1", "", None, "-3", "99999999999"]
    assert column(spark, values, "STRING", fn.prefix_int) == [1234, 42, None, None, None, -3, None]


def test_trim_takes_every_blank(spark):
    values = [" \t a b  ﻿", "  ", "x"]
    assert column(spark, values, "STRING", fn.js_trim) == ["a b", "", "x"]


def test_position(spark):
    values = ["WR1", "kc RB1", "RDP", "xQB", "te2", "éK"]
    assert column(spark, values, "STRING", fn.position_code) == ["WR", "K", None, None, "TE", "K"]


def test_normalized_name(spark):
    values = ["D.J. Moore Jr.", "Kenneth Walker III", "Amon-Ra St. Brown", "Ivory"]
    assert column(spark, values, "STRING", fn.normalized_name) == ["djmoore", "kennethwalker", "amonrastbrown", "ivory"]


def test_document_order(spark):
    df = spark.createDataFrame([("SF",), ("10",), ("9",), ("007",), ("0",), ("4294967295",)], "k STRING")
    got = [r.k for r in df.orderBy(fn.document_key(F.col("k"))).collect()]
    assert got == ["0", "9", "10", "007", "4294967295", "SF"]


def test_snapshot_date_and_age(spark):
    df = spark.createDataFrame([("snapshot-2026-05-18.json",), ("snapshot-2026-99-18.json",), ("other.json",)], "f STRING")
    run = F.lit("2026-05-19 12:00:00").cast("timestamp")
    rows = df.select(snapshot_date_of(F.col("f")).alias("d"), age_days(run, snapshot_date_of(F.col("f"))).alias("a")).collect()
    assert str(rows[0].d) == "2026-05-18" and rows[0].a == 1.5
    assert rows[1].d is None and rows[2].a is None


def test_season_of_date(spark):
    got = column(spark, ["2026-01-31", "2026-02-28", "2026-03-01"], "STRING", lambda c: fn.season_of_date(c.cast("date")))
    assert got == [2025, 2025, 2026]
