"""Documents to a training mixture: five stages, each on all that the one before kept.

A stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame. It is written as Parquet and
read again as the next stage's documents. All but the last return the columns of documents;
columns beyond these are not passed on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seasonframe.llm.common import stored
from seasonframe.llm.decontamination import decontaminate
from seasonframe.llm.line_dedup import MIN_WORDS
from seasonframe.llm.line_dedup import line_dedup as without_repeated_lines
from seasonframe.llm.mixing import mixture
from seasonframe.llm.near_dedup import near_duplicates
from seasonframe.llm.toxicity import score, train

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

ORACLE_SQL = None
"""A classifier, sketches and an exponent found by search: SQL doesn't express them. The stages are tested one by one."""


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = score(docs, train(docs, labels), carry=("lang", "source", "n_chars"))
    return scored.filter("predicted = 0").select(COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of runs of lines and of long lines go, and documents that were nothing else."""
    found = without_repeated_lines(docs, carry=("lang", "source"), min_words=MIN_WORDS)
    return _resized(found.filter("n_removed = 0 OR n_removed < n_lines"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id stays of each group linked at 0.8 of five-word shingles."""
    found = near_duplicates(docs)
    return docs.select(COLUMNS).join(found.filter("NOT kept").select("doc_id"), "doc_id", "left_anti").select(COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of the benchmark are cut out, and documents that were nothing else go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _resized(decontaminate(docs, benchmark, carry=("lang", "source")))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The uses of each document in the mixture; in the order of ``position`` they are it."""
    return mixture(docs)


def _resized(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
