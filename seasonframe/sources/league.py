"""League documents: league, rosters, users and drafts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seasonframe import schemas as S
from seasonframe.sources.documents import array_documents
from seasonframe.sources.tables import path_or_empty


def league_documents(docs: DataFrame) -> DataFrame:
    """A league of each document in ``value``."""
    return docs.select(F.from_json("value", S.LEAGUE).alias("l")).select("l.*")


def read_leagues(spark: SparkSession, path: str) -> DataFrame:
    return league_documents(path_or_empty(spark, path))


def _rows(spark: SparkSession, path: str, row: str) -> DataFrame:
    return array_documents(path_or_empty(spark, path).select("value"), row)


def read_rosters(spark: SparkSession, path: str) -> DataFrame:
    return _rows(spark, path, S.ROSTER)


def read_users(spark: SparkSession, path: str) -> DataFrame:
    return _rows(spark, path, S.USER)


def read_drafts(spark: SparkSession, path: str) -> DataFrame:
    """Drafts with ``created_at`` and ``last_message_at`` as timestamps."""
    return _rows(spark, path, S.DRAFT).withColumns(
        {
            "created_at": F.timestamp_millis("created"),
            "last_message_at": F.timestamp_millis("last_message_time"),
        }
    )


ROSTER_LISTS = ("players", "starters", "taxi", "reserve")


def roster_players(rosters: DataFrame) -> DataFrame:
    """``league_id, roster_id, owner_id, list, slot, player_id``; a NULL list gives no rows."""
    lists = F.array(
        *[F.struct(F.lit(name).alias("list"), F.col(name).alias("ids")) for name in ROSTER_LISTS]
    )
    unfolded = rosters.select("league_id", "roster_id", "owner_id", F.inline(lists))
    return unfolded.select(
        "league_id", "roster_id", "owner_id", "list", F.posexplode("ids").alias("slot", "player_id")
    )


def scoring_weights(leagues: DataFrame) -> DataFrame:
    """``league_id, stat_key, weight`` of each league's scoring settings."""
    return leagues.select("league_id", F.explode("scoring_settings").alias("stat_key", "weight"))
