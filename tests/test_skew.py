from pyspark.sql import functions as F

from seasonframe.operators.skew import salted_lookup

SPLIT = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "128k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.shuffle.partitions": "64",
}


def sides(spark, n=60_000):
    key = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.col("id").cast("string"))
    left = spark.range(0, n, 1, 8).select("id", key.alias("k"), F.sha2(F.col("id").cast("string"), 512).alias("pad"))
    right = left.groupBy("k").agg(F.max("id").alias("top")).filter("k = 'hot' OR top % 2 = 0")
    return left, right


def test_lookup_equals_plain_join(spark):
    left, right = sides(spark, 3000)
    for how in ("left", "inner", "left_semi", "left_anti"):
        plain = left.join(right, ["k"], how)
        salted = salted_lookup(left, right, ["k"], ["id"], how)
        assert sorted(map(tuple, salted.select(plain.columns).collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)


def test_adaptive_execution_splits_what_is_still_hot(spark):
    session = spark.newSession()
    for name, value in SPLIT.items():
        session.conf.set(name, value)
    joined = salted_lookup(*sides(session), ["k"], ["id"])
    rows = joined.collect()
    plan = joined._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert len(rows) == 60_000
    assert "skew=true" in plan
