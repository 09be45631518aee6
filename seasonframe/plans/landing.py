"""Land JSON documents as partitioned Parquet, the form all other runs read.

A document is cut into records in one task, and its records are spread over all tasks before
they are parsed. What can't be used goes to the quarantine table with its file, position and
reason, and publishing refuses partitions that have anything there.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seasonframe import schemas as S
from seasonframe.functions import snapshot_date_of
from seasonframe.operators.quality import enforce, quarantine_rules
from seasonframe.operators.weekly import usable_entries
from seasonframe.plans.warehouse import Warehouse, materialize, write_partitions
from seasonframe.sources import checked as C
from seasonframe.sources.documents import college_documents, file_stem, numbered_files
from seasonframe.sources.tables import path_or_empty, read_or_empty


def _land(records: DataFrame, schema: str, wh: Warehouse, dataset: str, misplaced: Column | None = None) -> DataFrame:
    """Spread the records, parse them and set aside what can't be used; the rest, by its partition."""
    spread = records.repartition(F.xxhash64("partition", "file", "position"))
    checked = materialize(C.checked_records(spread, schema, misplaced))
    aside = C.quarantine(checked, dataset).withColumn("landed", F.lit(True))
    # A row that is not landed goes along, so that a run without any replaces the last one's.
    none = checked.sparkSession.range(1).select(F.lit(dataset).alias("dataset"), F.lit(False).alias("landed"))
    write_partitions(aside.unionByName(none, allowMissingColumns=True), wh.path("quarantine"), ["dataset"], ["partition", "file", "position"])
    return C.sound(checked)


def quarantined(spark: SparkSession, wh: Warehouse, dataset: str) -> DataFrame:
    """What the last landing of a data set put aside."""
    rows = read_or_empty(spark, wh.path("quarantine"), f"{C.QUARANTINE}, landed BOOLEAN")
    return rows.filter((F.col("dataset") == dataset) & F.col("landed")).drop("landed")


def refuse_quarantined(spark: SparkSession, wh: Warehouse, dataset: str, partitions: Sequence[str]) -> None:
    """Raise if anything of these partitions was put aside when it was landed."""
    own = quarantined(spark, wh, dataset).filter(F.col("partition").isin(*partitions))
    enforce(quarantine_rules(own, dataset))


def land_weekly(spark: SparkSession, landing: str, wh: Warehouse) -> None:
    """Replace the weeks that have entries; a week that failed to arrive keeps its last version.

    Entries of a week outside the season are put aside.
    """
    docs = path_or_empty(spark, landing)
    if "season" not in docs.columns:
        docs = docs.withColumns({"season": F.lit(None).cast("int"), "week": F.lit(None).cast("int")})
    place = F.concat_ws("/", F.col("season").cast("string"), F.col("week").cast("string")).alias("partition")
    numbers = numbered_files(docs.select(place, "file"), ["partition"])
    records = C.split_array(docs.select(place, "file", "value"))
    records = records.join(numbers, ["partition", "file"]).withColumn("position", F.col("nth").cast("long") * (1 << 32) + F.col("position"))
    rows = _land(records.drop("nth"), C.WEEKLY, wh, "weekly", C.week_of_partition().isNull())
    season = F.regexp_extract("partition", r"^(\d+)/", 1).try_cast("int").alias("season")
    rows = rows.select(season, C.week_of_partition().alias("week"), "ord", "player_id", "team", "stats")
    write_partitions(usable_entries(rows), wh.path("entries"), ["season", "week"], ["ord"])


def landed_entries(spark: SparkSession, wh: Warehouse) -> DataFrame:
    """Weekly entries; a filter on season or week prunes partitions."""
    return read_or_empty(spark, wh.path("entries"), S.WEEKLY_ENTRIES)


def land_college(spark: SparkSession, landing: str, wh: Warehouse) -> None:
    """Rows by what they say of themselves; the quarantine names category and season of the file."""
    docs = college_documents(spark, landing)
    rows = _land(C.split_array(docs), C.COLLEGE, wh, "college", F.col("r.season").isNull() | F.col("r.category").isNull())
    rows = rows.drop("partition", "ord", "key")
    write_partitions(rows, wh.path("landed", "college"), ["category", "season"], ["playerId", "statType"])


def land_snapshots(spark: SparkSession, landing: str, wh: Warehouse) -> None:
    """Snapshots whose file name tells no date are put aside."""
    day = snapshot_date_of(F.col("file")).cast("string").alias("partition")
    docs = path_or_empty(spark, landing).select(day, "file", "value")
    rows = _land(C.split_array(docs), C.MARKET, wh, "market", F.col("partition").isNull())
    rows = rows.select(F.col("partition").cast("date").alias("snapshot_date"), "ord", "name", "team", "value", "position")
    write_partitions(rows, wh.path("landed", "market"), ["snapshot_date"], ["ord"])


def land_season_totals(spark: SparkSession, landing: str, wh: Warehouse) -> None:
    """Totals from ``<season>.json`` documents; files of another name are put aside."""
    docs = path_or_empty(spark, landing).select(file_stem(F.col("file")).alias("partition"), "file", "value")
    season = F.col("partition").try_cast("int")
    rows = _land(C.split_keyed(docs), C.SEASON, wh, "season_totals", season.isNull())
    rows = rows.withColumn("season", season).withColumn("weeklyPoints", F.col("weeklyPoints").cast("map<int,double>"))
    rows = rows.withColumnRenamed("key", "player_id").drop("partition")
    write_partitions(rows, wh.path("landed", "season_totals"), ["season"], ["player_id"])
