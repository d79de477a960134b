"""Exact duplicates by progressive refinement, with Spark expressions alone: length, prefix hash, full hash."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.shared import fresh, stored

PREFIX = 64
BROADCAST_GROUPS = 500_000  # groups up to which a side is broadcast: prefixes of 16 bytes or digests of 64 with an id; counted first


def normal(text: Column) -> Column:
    """A-Z lower-cased, null as empty."""
    return F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def _keys(text_col: str) -> tuple[Column, Column]:
    """What the first two refinements group by; neither looks at more than the length and the first characters."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return F.octet_length(text), F.xxhash64(normal(F.substring(text, 1, PREFIX)))


def _near(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_GROUPS else df


def _digest(text_col: str) -> Column:
    return F.sha2(normal(F.col(text_col)), 256)


def shared_prefixes(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(length, prefix) that more than one row has: by length, then by prefix hash within the lengths that are left.

    Counts are pre-aggregated before each shuffle, so a hot group is one row per task.
    """
    length, prefix = _keys(text_col)
    keys = stored(docs.select(length.alias("length"), prefix.alias("prefix")), "exact-keys")
    pairs = keys.groupBy("length", "prefix").agg(F.count("*").alias("n"))
    lengths = pairs.groupBy("length").agg(F.sum("n").alias("all")).filter("all > 1").select("length")
    return stored(pairs.filter("n > 1").join(lengths, "length", "left_semi").select("length", "prefix"), "exact-prefixes")


def _digested(docs: DataFrame, prefixes: DataFrame, text_col: str) -> tuple[DataFrame, str]:
    """The rows with one more column, the full hash, and its name; null for rows that are alone by now, which aren't read whole."""
    full = fresh("full", *docs.columns)
    length, prefix, left = (fresh(c, *docs.columns, full) for c in ("length", "prefix", "left"))
    keyed = docs.withColumns(dict(zip((length, prefix), _keys(text_col))))
    marks = prefixes.select(F.col("length").alias(length), F.col("prefix").alias(prefix), F.lit(True).alias(left))
    marked = keyed.join(_near(marks), [length, prefix], "left")
    return marked.select(*(F.col(f"`{c}`") for c in docs.columns), F.when(F.col(left), _digest(text_col)).alias(full)), full


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Leaves one row of each group of equal texts: the largest id (a null one is the least); of repeated rows of it, one.

    Texts are equal when identical after lower-casing A-Z. Null and empty texts are one group. Rows keep their columns,
    whatever their names and types; of rows that repeat both id and text the one with the largest JSON form stays. Only
    texts whose length and prefix hash occur again are read whole, and rows are moved only where an id repeats.
    """
    rows, full = _digested(docs, shared_prefixes(docs, text_col), text_col)
    kept = rows.filter(F.col(full).isNotNull()).groupBy(F.col(full).alias("h")).agg(F.max(id_col).alias("keep"), F.count("*").alias("n")).filter("n > 1")
    copies = rows.filter(F.col(full).isNotNull()).groupBy(F.col(full).alias("h"), F.col(id_col).alias("keep")).agg(F.count("*").alias("same"))
    kept = kept.join(copies, kept["h"].eqNullSafe(copies["h"]) & kept["keep"].eqNullSafe(copies["keep"])).select(kept["h"], kept["keep"], "same")
    groups = stored(kept, "exact-groups")
    keep, same, h = (fresh(c, *rows.columns) for c in ("keep", "same", "h"))
    near = _near(groups.select(F.col("h").alias(h), F.col("keep").alias(keep), F.col("same").alias(same)))
    joined = rows.join(near, F.col(full) == F.col(h), "left")
    left = joined.filter(F.col(h).isNull() | F.col(id_col).eqNullSafe(F.col(keep)) & (F.col(same) == 1)).select(*(F.col(f"`{c}`") for c in docs.columns))
    if groups.filter("same > 1").isEmpty():
        return left
    # Rows that repeat id and text: an aggregate takes one, so many of them don't meet in a task.
    again = joined.filter(F.col(id_col).eqNullSafe(F.col(keep)) & (F.col(same) > 1))
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    one = again.groupBy(full).agg(F.max_by(row, F.to_json(row)).alias("row")).select("row.*")
    return left.unionByName(one)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags of every row. Rows that repeat both doc_id and text share their flags. An empty table gives no rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows, full = _digested(docs, shared_prefixes(docs), "text")
    groups = stored(rows.filter(F.col(full).isNotNull()).groupBy(full).agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")).filter("group_size > 1"), "exact-groups")
    digests = docs.select("doc_id", _digest("text").alias("text_sha256"))
    joined = digests.join(_near(groups.withColumnRenamed(full, "text_sha256")), "text_sha256", "left")
    single = F.col("group_size").isNull()
    keep = F.when(single, F.col("doc_id")).otherwise(F.col("keep_id"))
    return joined.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256")


OP9_SQL = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents
)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
