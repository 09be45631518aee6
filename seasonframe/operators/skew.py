"""Joins that stay even when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 8


def salted_lookup(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    spread: Sequence[str],
    how: str = "left",
    salts: int = SALTS,
) -> DataFrame:
    """Join many ``left`` rows to a small ``right`` that is unique on ``on``.

    Each key is split over ``salts`` partitions by a hash of the ``spread`` columns
    of the left side, and the right side is repeated once per salt. NULL keys of the
    left side are spread the same way. Meant for narrow, aggregated right sides, where the
    repetition is cheap.

    The salt also makes Spark shuffle the right side anew, and a join of two fresh shuffles
    is what adaptive execution can split: a partition that is still too large is cut
    further at run time, which it is not when one side keeps the partitioning of its
    aggregate.
    """
    salt = F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int")
    repeated = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.withColumn("_salt", salt).join(repeated, [*on, "_salt"], how).drop("_salt")
