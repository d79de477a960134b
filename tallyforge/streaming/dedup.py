"""Verdicts on repeated requests in a stream: each body against the last one under its id.

State is keyed by id and lives in the state store: the last body and when it came. An id is forgotten once ``window`` has
passed without it, so state is bounded by the window's requests.

``at`` is when the queue took a request, not when its sender made it: it grows from batch to batch, so no request is late
and none is lost to the watermark, however old what it asks for is. Such a request is answered by the judge.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "tx_id long, arrival long, body string, at timestamp, verdict string"
STATE = "body string, known boolean, at_ms long"


def _step(window_ms: int):
    def run(key: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, known, at_ms = state.get if state.exists else (None, False, -1)
        rows = pd.concat(list(frames)).sort_values("arrival", kind="stable")
        mark = state.getCurrentWatermarkMs()
        out = []
        for arrival, body, at in zip(rows.arrival.tolist(), rows.body.tolist(), rows["at"]):
            ms = int(at.timestamp() * 1000)
            body = None if pd.isna(body) else body
            verdict = "Fresh" if not known else "DuplicateSameBody" if body == last else "DuplicateDifferentBody"
            last, known, at_ms = body, True, max(at_ms, ms)
            out.append((key[0], arrival, body, at, verdict))
        state.update((last, known, at_ms))
        state.setTimeoutTimestamp(max(at_ms + window_ms, mark + 1))
        yield pd.DataFrame(out, columns=["tx_id", "arrival", "body", "at", "verdict"])

    return run


def verdicts(requests: DataFrame, window: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """W3, 2.10f, 2.10h: (tx_id, arrival, body, at) with a verdict each. A null body is a body like others."""
    window_ms = int(pd.Timedelta(window).total_seconds() * 1000)
    marked = requests.select("tx_id", "arrival", "body", "at").withWatermark("at", lateness)
    return marked.groupBy("tx_id").applyInPandasWithState(_step(window_ms), OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def start(requests: DataFrame, out: str, checkpoint: str, window: str = "1 hour", lateness: str = "10 minutes"):
    """Runs over all that is there and stops (2.10m); a batch that is run again replaces what it wrote (2.10n)."""

    def step(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return verdicts(requests, window, lateness).writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sessions(requests: DataFrame, gap: str = "30 minutes", lateness: str = "10 minutes") -> DataFrame:
    """2.10d: runs of a submitter's requests with less than ``gap`` between them: begin, end, number."""
    marked = requests.withWatermark("at", lateness)
    return marked.groupBy("user_id", F.session_window("at", gap).alias("s")).agg(F.count("*").alias("n")).select("user_id", F.col("s.start").alias("begins"), F.col("s.end").alias("ends"), "n")


def daily(effects: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """2.10e: amounts of each calendar day and kind; a day is given out once the watermark has passed it."""
    marked = effects.withWatermark("at", lateness)
    return marked.groupBy(F.window("at", "1 day").alias("w"), "kind").agg(F.count("*").alias("n"), F.sum("amount").alias("amount")).select(F.col("w.start").cast("date").alias("day"), "kind", "n", "amount")
