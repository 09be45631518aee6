"""Reads that tolerate a path that does not exist yet."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seasonframe.functions.text import is_blank


def _missing(error: AnalysisException) -> bool:
    return error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


def read_or_empty(spark: SparkSession, path: str, schema: str, fmt: str = "parquet") -> DataFrame:
    """The table at ``path``; no rows of ``schema`` when nothing is there."""
    try:
        return spark.read.schema(schema).format(fmt).load(path)
    except AnalysisException as error:
        if not _missing(error):
            raise
        return spark.createDataFrame([], schema)


def documents_at(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """``value`` plus partition columns: a document of each file or, with ``lines``, of each line.

    Many small documents belong on lines, whose number costs no more than their text; a file of
    each costs some 20 ms to write and list. A blank line is none.
    """
    if not lines:
        return spark.read.option("wholetext", True).text(path)
    return spark.read.option("lineSep", "\n").text(path).filter(~is_blank(F.col("value")))


def path_or_empty(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Text documents at ``path``: ``value, file`` plus partition columns.

    Documents of this data model are one JSON value per file, so a file is one row; it is
    parsed into typed rows right away and landed as Parquet by the publishing plans. ``lines``
    is for documents that share files, one on each line.
    """
    try:
        df = documents_at(spark, path, lines)
    except AnalysisException as error:
        if not _missing(error):
            raise
        return spark.createDataFrame([], "value STRING, file STRING")
    return df.selectExpr("*", "_metadata.file_path AS file")
