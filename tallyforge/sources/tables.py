"""The driver's tables as views, and ledger relations derived from them. SQL texts are built for a dialect."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


@dataclass(frozen=True)
class Dialect:
    """The few expressions whose spelling differs between Spark and DuckDB."""

    name: str

    @property
    def spark(self) -> bool:
        return self.name == "spark"

    def micros(self, ts: str) -> str:
        return f"unix_micros(CAST({ts} AS TIMESTAMP))" if self.spark else f"epoch_us({ts})"

    def day(self, ts: str) -> str:
        return f"CAST(unix_date(CAST({ts} AS DATE)) AS BIGINT)" if self.spark else f"CAST(date_diff('day', DATE '1970-01-01', CAST({ts} AS DATE)) AS BIGINT)"

    def div(self, a: str, b: str) -> str:
        return f"(({a}) div ({b}))" if self.spark else f"(({a}) // ({b}))"

    def land(self, a: str, b: int) -> str:
        return f"(({a}) & {b})"

    def shift_left(self, a: str, n: int) -> str:
        return f"shiftleft({a}, {n})" if self.spark else f"(({a}) << {n})"

    def shift_right(self, a: str, n: int) -> str:
        return f"shiftright({a}, {n})" if self.spark else f"(({a}) >> {n})"

    def numbers(self, n: int) -> str:
        return f"SELECT id AS i FROM range({n})" if self.spark else f"SELECT range AS i FROM range({n})"


SPARK, DUCKDB = Dialect("spark"), Dialect("duckdb")


def register(spark: SparkSession, sf_dir: str) -> None:
    for t in TABLES:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)


def near(df: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """For a join: broadcast if it is counted to be small."""
    return F.broadcast(df) if df.count() <= rows else df


def cents(x: str) -> str:
    return f"CAST(round({x} * 100) AS BIGINT)"


ACCOUNTS = """
  SELECT CAST(n_nationkey AS BIGINT) + 1 AS account_id, CAST(n_nationkey AS BIGINT) + 1 AS ledger, false AS constrained FROM nation
  UNION ALL SELECT CAST(n_nationkey AS BIGINT) + 101, CAST(n_nationkey AS BIGINT) + 1, false FROM nation
  UNION ALL SELECT 1000 + c_custkey, CAST(c_nationkey AS BIGINT) + 1, true FROM customer"""

HOLDS = f"""
  SELECT o_orderkey + 1 AS hold_id, 1000 + o_custkey AS debit_account, 101 + CAST(c_nationkey AS BIGINT) AS credit_account,
         {cents('o_totalprice')} AS amount, CAST(c_nationkey AS BIGINT) + 1 AS ledger, o_orderdate AS held_at, o_orderstatus AS status
  FROM orders JOIN customer ON o_custkey = c_custkey"""

SETTLES = f"SELECT l_orderkey + 1 AS hold_id, l_shipdate AS settled_at, l_linenumber AS line, l_partkey AS part, {cents('l_extendedprice')} AS amount FROM lineitem"
