"""Places in an order, counted over all partitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seasonframe.storage import materialize


def dense_ranks(df: DataFrame, by: Sequence[str], order: Sequence[str], out: str = "rank") -> DataFrame:
    """The rows with their place, from 0, in each group of ``by`` in the order of ``order``.

    The rows are sorted as a whole and stored, so that a group lies in consecutive partitions, in
    one stretch of each. A table with a row for each group and partition adds up what lies before;
    no task holds or sorts a group. Rows that are equal in all of the order have any of their places.
    """
    numbered = df.orderBy(*by, *order).withColumn("_id", F.monotonically_increasing_id())
    numbered = materialize(numbered).withColumn("_part", F.shiftrightunsigned("_id", 33))
    stretches = numbered.groupBy(*by, "_part").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    stretches = stretches.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    keys = [*by, "_part"]
    met = numbered.join(stretches.select(*keys, "_first", "_before"), keys)
    return met.withColumn(out, F.col("_before") + F.col("_id") - F.col("_first")).drop("_id", "_part", "_first", "_before")
