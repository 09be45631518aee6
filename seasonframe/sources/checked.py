"""Documents in two steps: cut into records as text, then each record parsed and checked.

A document is one row, so cutting it up is the work of one task. Its records are many rows,
which can be spread and stored before anything else is done to them. A record that does not
have the types of its schema is told apart from one that lacks fields, and a document that
is cut off or of another kind is reported instead of being empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seasonframe import schemas as S
from seasonframe.constants import WEEKS

KEPT_CHARS = 1000
"""What the quarantine keeps of a text, to look at; the file is named beside it."""

RECORDS = ("partition", "file", "position", "key", "record")


def split_keyed(docs: DataFrame) -> DataFrame:
    """``partition, file, position, key, record`` from ``partition, file, value``, objects keyed by id.

    Only the top level is looked at. A document that is no object has one row without position,
    with the document's text as record; an empty object has none.
    """
    records = F.from_json("value", "MAP<STRING, STRING>")
    rows = docs.select("partition", "file", "value", F.posexplode_outer(records).alias("position", "key", "record"))
    whole = F.col("value").rlike(r"^\s*\{\s*\}\s*$")
    return _records(rows.filter(F.col("position").isNotNull() | ~F.coalesce(whole, F.lit(False))))


def split_array(docs: DataFrame) -> DataFrame:
    """The same for arrays; records have no key."""
    records = F.when(F.col("value").rlike(r"^\s*\["), F.from_json("value", "ARRAY<STRING>"))
    rows = docs.select("partition", "file", "value", F.posexplode_outer(records).alias("position", "record"))
    whole = F.col("value").rlike(r"^\s*\[\s*\]\s*$")
    rows = rows.filter(F.col("position").isNotNull() | ~F.coalesce(whole, F.lit(False)))
    return _records(rows.withColumn("key", F.lit(None).cast("string")))


def _records(rows: DataFrame) -> DataFrame:
    return rows.select(
        "partition", "file", F.col("position").cast("long").alias("position"), "key",
        F.when(F.col("position").isNull(), F.left("value", F.lit(KEPT_CHARS))).otherwise(F.col("record")).alias("record"),
    )


def checked_records(records: DataFrame, schema: str, misplaced: Column | None = None) -> DataFrame:
    """The records with ``r``, their fields, and ``reason``: why a record can't be used, else NULL.

    ``document``: it is the text of a document of another kind, or of one that is cut off.
    ``record``: it is no object. ``type``: a field has another type. ``place``: ``misplaced`` holds,
    so that nobody would ever look for it.
    """
    parsed = F.from_json("record", f"{schema}, _corrupt STRING", {"columnNameOfCorruptRecord": "_corrupt", "mode": "PERMISSIVE"})
    rows = records.withColumn("r", parsed)
    reason = (
        F.when(F.col("position").isNull(), "document")
        .when(F.col("record").isNull() | ~F.col("record").rlike(r"^\s*\{"), "record")
        .when(F.col("r._corrupt").isNotNull(), "type")
    )
    if misplaced is not None:
        reason = reason.when(F.coalesce(misplaced, F.lit(True)), "place")
    return rows.withColumn("reason", reason).withColumn("r", F.col("r").dropFields("_corrupt"))


def sound(checked: DataFrame) -> DataFrame:
    """``partition, ord, key`` and the fields of what can be used."""
    return checked.filter("reason IS NULL").select("partition", F.col("position").alias("ord"), "key", "r.*")


def quarantine(checked: DataFrame, dataset: str) -> DataFrame:
    """``dataset, partition, file, position, reason, record`` of what can't be used."""
    return checked.filter("reason IS NOT NULL").select(
        F.lit(dataset).alias("dataset"), "partition", "file", "position", "reason", F.left("record", F.lit(KEPT_CHARS)).alias("record")
    )


def week_of_partition() -> Column:
    """The week in ``season/week``; NULL if it is none of the season's."""
    week = F.regexp_extract("partition", r"^\d+/(\d+)$", 1).try_cast("int")
    return F.when(week.between(1, WEEKS), week)


QUARANTINE = "dataset STRING, partition STRING, file STRING, position LONG, reason STRING, record STRING"
WEEKLY, COLLEGE, MARKET, SEASON = S.WEEKLY_DOCUMENT, S.COLLEGE_STATS, S.MARKET_ROW, S.SEASON_DOCUMENT
