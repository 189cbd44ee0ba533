"""Corpus pipeline: quality rules, line dedup, near-dedup, decontamination, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run``
writes each result as Parquet to the shared folder and hands the reread table
to the next stage. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from respanel.llm import decontaminate, linededup, neardup, packing, quality
from respanel.llm.common import drop_scratch, drop_stored, scratch_mark, stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: Statistical votes, content-defined chunks, similarity groups and a linear programme have no SQL form.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose posterior probability of being good is under a half, or that fail the fixed limits, go.

    A null text has no words and goes; rows without an id are judged like others.
    """
    return quality.keep_good(docs).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stay, repeated line runs go; n_chars follows the text (null for a null text)."""
    out = linededup.dedup(docs, whole=True).drop("__removed")
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word similarity 0.8 or more, verified) the document of smallest id stays.

    Covering SimHash tables propose pairs, a prefix filter those that a
    fingerprint cannot reach. Wordless texts are one group; rows without an
    id stay.
    """
    return neardup.keep_one(docs).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap a benchmark item go; rows without an id stay."""
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences; a null or empty text is its end id alone."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, from a table in the shared folder. Everything else written there on the way is deleted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        mark = scratch_mark()
        done = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        drop_scratch(spark, mark, keep=done)
        if name != STAGES[0][0]:
            drop_stored(docs)
        docs = done
    return docs
