"""A training corpus from documents: toxicity, exact and near duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's documents. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import exact, jaccard, packing, repeats, shared, toxicity

#: Bytes from which a repeated passage goes. Prose of over 50 words is longer (about 236 bytes and more); a stock phrase or
#: line is shorter, and cutting those would take pieces out of clean documents.
PASSAGE_BYTES = 200


def _with_lengths(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length(F.coalesce("text", F.lit(""))).cast("long")) if "n_chars" in docs.columns else docs


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents whose expected severity reaches the threshold; the model is fitted on the labelled ones here.

    Null and empty texts have no words and stay. Each row is judged by itself, whatever repeats; an empty table gives none.
    """
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.filter(toxicity.severity(spark, model, F.col("text")) < toxicity.THRESHOLD)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts stays (the largest id); nulls, ties and repeated rows as in ``exact_dedup``."""
    return exact.exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of five-word shingles at 80 per cent stays: the least id; other cases as in ``near_dedup``."""
    return jaccard.near_dedup(docs, words=5, percent=80)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents keep the first of each repeated passage; n_chars follows. Null and empty texts stay as they are, and a text
    that repeats others as a whole becomes empty; ties and repeated rows as in ``remove_repeats``."""
    return _with_lengths(repeats.remove_repeats(docs, PASSAGE_BYTES))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all documents' pieces in sequences; null and empty texts are one end id, each row has its own place."""
    return packing.best_fit_pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("ngram_jaccard", drop_near_copies),
    ("suffix_dedup", cut_repeats),
    ("packing", pack),
]

#: No stage but the second is SQL; tests/llm/test_pipeline.py holds each stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = shared.stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
