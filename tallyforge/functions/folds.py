"""Folds over sorted rows: for what depends on all that came before in a group and isn't a running sum.

Rows stream through in Arrow batches, sorted within their partition, so a task holds one group's state and not its rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tallyforge.functions.shipping import ship

BATCH = 8192


class Fold:
    """One group's state. ``row`` gets a row's values and gives rows of the result, as does ``end``."""

    def row(self, *values) -> Iterable[tuple]:
        return ()

    def end(self, key: tuple) -> Iterable[tuple]:
        return ()


def fold(rows: DataFrame, keys: list[str], order: list[str], columns: list[str], new: Callable[[], Fold], schema: str) -> DataFrame:
    """The results of ``new()`` over each group of ``keys``, whose rows come sorted by ``order``. Null keys are one group."""
    spark = rows.sparkSession
    ship(spark)
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, now, out = None, None, []

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)
            out.clear()
            return batch

        for b in batches:
            for key, values in zip(zip(*(b.column(c).to_pylist() for c in keys)), zip(*(b.column(c).to_pylist() for c in columns))):
                if state is None or key != now:
                    if state is not None:
                        out.extend(state.end(now))
                    state, now = new(), key
                out.extend(state.row(*values))
                if len(out) >= BATCH:
                    yield flush()
        if state is not None:
            out.extend(state.end(now))
        if out:
            yield flush()

    needed = list(dict.fromkeys([*keys, *order, *columns]))
    return rows.select(*needed).repartition(n, *keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
