"""The document of unit costs, one JSON object with a list of parts."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "block_bytes long, bucket_rule string, parts array<struct<name string, owner string, unit string, bytes long>>"


def publish(spark: SparkSession, parts: list[tuple], path: str, block_bytes: int = 4096, bucket_rule: str = "next_power_of_two(entries * 8 / 7)") -> None:
    rows = [{"name": n, "owner": o, "unit": u, "bytes": b} for n, o, u, b in parts]
    text = json.dumps({"block_bytes": block_bytes, "bucket_rule": bucket_rule, "parts": rows}, indent=1)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    """The parts; a document without them, or a part without a cost, fails."""
    rows = spark.read.schema(SCHEMA).json(path, multiLine=True)
    checked = F.when(F.size("parts") > 0, F.col("parts")).otherwise(F.raise_error(F.lit("no parts in the document")))
    one = rows.select("block_bytes", F.explode(checked).alias("p")).select("block_bytes", "p.name", "p.owner", "p.unit", F.col("p.bytes").alias("unit_bytes"))
    cost = F.when(F.col("unit_bytes") > 0, F.col("unit_bytes")).otherwise(F.raise_error(F.concat(F.lit("no unit cost: "), F.col("name"))))
    return one.withColumn("unit_bytes", cost)
