"""Queries over JSON documents that Spark renders from the tables and parses back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seasonframe import schemas as S
from seasonframe.analog import views as V
from seasonframe.analog.registry import query
from seasonframe.functions import position_code, prefix_int
from seasonframe.operators import quality as Q
from seasonframe.operators.totals import season_totals
from seasonframe.operators.weekly import usable_entries
from seasonframe.sources.documents import array_documents, keyed_documents


@query(f"""WITH {V.ENTRIES}
SELECT season, week, ord AS doc, CAST(0 AS BIGINT) AS ord, player_id, team, gp, pts FROM en""")
def q_source_weekly(spark: SparkSession, sf: str) -> DataFrame:
    """Weekly documents of one entry each; a second one without an id is dropped."""
    entry = F.struct("player_id", "team", "stats")
    nobody = F.struct(F.lit("").alias("player_id"), F.lit("T1").alias("team"), F.col("stats"))
    docs = V.entries(spark, sf).select(
        "season", "week", F.col("ord").alias("doc"), F.to_json(F.array(entry, nobody)).alias("value")
    )
    rows = usable_entries(array_documents(docs, S.WEEKLY_DOCUMENT))
    return rows.select(
        "season", "week", "doc", "ord", "player_id", "team",
        F.col("stats")["gp"].cast("int").alias("gp"), F.col("stats")["pts_half_ppr"].alias("pts"),
    )


@query(f"""WITH {V.TOTALS}
SELECT per.season, per.player_id, games_played, floor(raw_points * 100 + 0.5) / 100 AS fantasy_points, status, longest
FROM per JOIN avail USING (season, player_id) JOIN shown USING (season, player_id)""")
def q_source_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Season totals written as keyed documents, one player each, and read back."""
    totals = season_totals(V.entries(spark, sf))
    record = F.struct(*[c for c in totals.columns if c not in ("season", "player_id")])
    docs = totals.select("season", F.to_json(F.create_map("player_id", record)).alias("value"))
    back = keyed_documents(docs, S.SEASON_DOCUMENT, "player_id")
    return back.select(
        "season", "player_id", F.col("gamesPlayed").alias("games_played"),
        F.col("fantasyPoints").alias("fantasy_points"), F.array_join("weeklyStatus", "").alias("status"),
        F.col("availability.longestAbsence").alias("longest"),
    )


@query("""SELECT CAST(doc_id AS VARCHAR) AS doc, 'DQ-22' AS rule_id FROM documents WHERE lang <> 'en' OR n_chars < 100""")
def q_dq_wrapper(spark: SparkSession, sf: str) -> DataFrame:
    """Wrapper rule on documents whose language decides what is wrong with them."""
    version = F.lit('"schemaVersion":')
    size = F.col("n_chars").cast("string")
    entries = F.concat(F.lit(',"entries":['), F.to_json(F.struct("text")), F.lit("]}"))
    lang = F.col("lang")
    value = (
        F.when(F.col("n_chars") < 100, F.concat(F.lit("["), F.to_json(F.struct("text")), F.lit("]")))
        .when(lang == "de", F.concat(F.lit("{"), version, F.lit('"'), size, F.lit('"'), entries))
        .when(lang == "fr", F.concat(F.lit('{"version":'), size, entries))
        .when(lang == "es", F.concat(F.lit("{"), version, size, F.lit(',"entries":{}}')))
        .otherwise(F.concat(F.lit("{"), version, size, entries))
    )
    docs = V.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("overlay"), value.alias("value"))
    return Q.wrapper_rules(docs).select(F.col("partition").alias("doc"), "rule_id")


@query("""SELECT doc_id,
       nullif(upper(regexp_extract(text, '(?i)\\b(QB|RB|WR|TE|K)', 1)), '') AS position,
       TRY_CAST(nullif(regexp_extract(replace(text, ',', ''), '^\\s*([+-]?[0-9]+)', 1), '') AS INTEGER) AS number
FROM documents""")
def q_field_parsers(spark: SparkSession, sf: str) -> DataFrame:
    """First position code and leading number of whole texts."""
    text = F.col("text")
    return V.table(spark, sf, "documents").select(
        "doc_id", position_code(text).alias("position"), prefix_int(text).alias("number")
    )
