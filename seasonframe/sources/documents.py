"""JSON documents to typed rows. Every schema is explicit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seasonframe import schemas as S
from seasonframe.constants import OVERLAY_TYPES
from seasonframe.functions import season_of_date, snapshot_date_of
from seasonframe.operators.weekly import usable_entries
from seasonframe.sources.tables import documents_at, path_or_empty


def file_stem(file: Column) -> Column:
    return F.regexp_extract(file, r"([^/]+)\.[^./]*$", 1)


def keyed_documents(docs: DataFrame, record: str, key: str) -> DataFrame:
    """Objects keyed by id to one row per key, with ``ord`` the position in the document."""
    keep = [c for c in docs.columns if c != "value"]
    parsed = F.from_json("value", S.map_of(record))
    rows = docs.select(*keep, F.posexplode(parsed).alias("ord", key, "record"))
    return rows.select(*keep, F.col("ord").cast("long").alias("ord"), key, "record.*")


def array_documents(docs: DataFrame, row: str) -> DataFrame:
    """Arrays of flat objects to one row per element, with ``ord`` the position.

    Text that is not an array gives no rows; ``from_json`` alone would take a single
    object for an array of one.
    """
    keep = [c for c in docs.columns if c != "value"]
    parsed = F.when(F.col("value").rlike(r"^\s*\["), F.from_json("value", S.array_of(row)))
    rows = docs.select(*keep, F.posexplode(parsed).alias("ord", "record"))
    return rows.select(*keep, F.col("ord").cast("long").alias("ord"), "record.*")


def numbered_files(docs: DataFrame, by: list[str]) -> DataFrame:
    """``by, file, nth``: the files of each partition counted from 0 in the order of their names."""
    order = Window.partitionBy(*by).orderBy("file")
    return docs.select(*by, "file").withColumn("nth", F.row_number().over(order) - 1)


def read_weekly(spark: SparkSession, path: str) -> DataFrame:
    """Weekly entries from ``path/season=Y/week=W/<files>``, each an array of entries.

    A week that is missing or does not parse gives no rows; it is not an error. Files of
    one week follow each other by name, so that ``ord`` tells all its entries apart.
    """
    docs = path_or_empty(spark, path)
    if "season" not in docs.columns:
        return spark.createDataFrame([], S.WEEKLY_ENTRIES)
    docs = docs.select("value", "file", F.col("season").cast("int"), F.col("week").cast("int"))
    names = numbered_files(docs, ["season", "week"])
    rows = array_documents(docs, S.WEEKLY_DOCUMENT).join(names, ["season", "week", "file"])
    rows = rows.withColumn("ord", F.col("nth").cast("long") * (1 << 32) + F.col("ord"))
    return usable_entries(rows).select("season", "week", "ord", "player_id", "team", "stats")


def read_season_totals(spark: SparkSession, path: str) -> DataFrame:
    """Season totals from ``<season>.json`` files, each an object keyed by player id."""
    docs = path_or_empty(spark, path).select(
        "value", file_stem(F.col("file")).try_cast("int").alias("season")
    )
    rows = keyed_documents(docs, S.SEASON_DOCUMENT, "player_id")
    return rows.withColumn("weeklyPoints", F.col("weeklyPoints").cast("map<int,double>"))


def read_college(spark: SparkSession, path: str) -> DataFrame:
    """College rows from ``<category>/<season>.json`` files. ``stat`` stays text."""
    docs = path_or_empty(spark, path).select("value")
    return array_documents(docs, S.COLLEGE_STATS).drop("ord")


def college_documents(spark: SparkSession, path: str) -> DataFrame:
    """``partition, file, value`` of the raw college files, for the shape rule."""
    part = F.regexp_extract("file", r"([^/]+/[^/]+)\.json$", 1)
    return path_or_empty(spark, path).select(part.alias("partition"), "file", "value")


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """Market snapshots; the date comes from the file name, NULL if that does not parse."""
    docs = path_or_empty(spark, path).select(
        "value", snapshot_date_of(F.col("file")).alias("snapshot_date")
    )
    return array_documents(docs, S.MARKET_ROW)


def read_overlay(spark: SparkSession, path: str, kind: str, lines: bool = False) -> DataFrame:
    """Entries of one overlay type from ``path/<kind>.json``; none when the file is missing.

    Here and below, ``lines`` tells that each line is a document, not each file.
    """
    entry = S.ddl(S.OVERLAY_ENTRIES[kind])
    wrapper = f"schemaVersion INT, updatedAt TIMESTAMP, entries {S.array_of(entry)}"
    docs = path_or_empty(spark, f"{path}/{kind}.json", lines)
    rows = docs.select(F.from_json("value", wrapper).alias("doc")).select(
        F.posexplode("doc.entries").alias("ord", "entry")
    )
    return rows.select(F.col("ord").cast("long").alias("ord"), "entry.*")


def read_overlays(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {kind: read_overlay(spark, path, kind) for kind in OVERLAY_TYPES}


def overlay_documents(spark: SparkSession, path: str) -> DataFrame:
    """``overlay, value`` of the raw overlay files, for the wrapper rule."""
    docs = path_or_empty(spark, f"{path}/*.json")
    stem = file_stem(F.col("file"))
    return docs.select(stem.alias("overlay"), "value").filter(F.col("overlay").isin(*OVERLAY_TYPES))


def read_manifest(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Manifest entries, one row per data path. A missing manifest is an error."""
    docs = documents_at(spark, path, lines)
    files = F.from_json("value", f"files {S.map_of(S.MANIFEST_RECORD)}")["files"]
    return docs.select(F.explode(files).alias("path", "record")).select("path", "record.*")


def manifest_header(spark: SparkSession, path: str) -> DataFrame:
    """When the manifest was made and what it was exported from: ``generatedAt, exportedAt``."""
    docs = documents_at(spark, path)
    header = F.from_json("value", "generatedAt TIMESTAMP, exportedAt TIMESTAMP")
    return docs.select(header.alias("h")).select("h.*")


def current_season(spark: SparkSession, path: str, today: Column) -> DataFrame:
    """One row, ``current_season``: as the state document says, else by the date."""
    state = read_state(spark, path).agg(F.max("current_season").alias("said"))
    return state.select(F.coalesce("said", season_of_date(today)).alias("current_season"))


def read_state(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Season state with ``current_season`` as a number; a row for each document."""
    docs = path_or_empty(spark, path, lines)
    state = docs.select(F.from_json("value", S.STATE).alias("s")).select("s.*")
    return state.withColumn("current_season", F.col("season").try_cast("int"))


def read_players(spark: SparkSession, path: str, lines: bool = False) -> DataFrame | None:
    """Player dimension keyed by id, or None when the file is missing."""
    docs = path_or_empty(spark, path, lines)
    if docs.isEmpty():
        return None
    return keyed_documents(docs.select("value"), S.PLAYER, "player_id")
