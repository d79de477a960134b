"""Expiry of holds in a stream, by timers.

State is keyed by hold: what is left of it and when it was made. A timer goes off once its retention and grace are over in
event time: a void of the rest is proposed, to be judged like any request. While it isn't among the effects it is offered
again. ``at`` is when an effect was committed; effects come in that order, so none is late for the watermark.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

DAY_MS = 86_400_000
OUT = "hold_id long, tx_id long, amount long, offer int"
STATE = "remaining long, due_ms long, offers int"


def _step(life_ms: int, retry_ms: int):
    def offer(hold: int, state: GroupState, now_ms: int) -> pd.DataFrame:
        remaining, _, offers = state.get
        state.update((remaining, now_ms + retry_ms, offers + 1))
        state.setTimeoutTimestamp(now_ms + retry_ms)
        return pd.DataFrame([(hold, -hold, remaining, offers + 1)], columns=["hold_id", "tx_id", "amount", "offer"])

    def run(key: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentWatermarkMs()
        if state.hasTimedOut:
            yield offer(key[0], state, now)
            return
        remaining, due, offers = state.get if state.exists else (0, 0, 0)
        for kind, amount, at in pd.concat(list(frames)).sort_values("at", kind="stable")[["kind", "amount", "at"]].itertuples(index=False):
            if kind == "Hold":
                remaining, due = remaining + int(amount), int(at.timestamp() * 1000) + life_ms
            else:  # settlements and voids, expiry's own too
                remaining -= int(amount)
        if remaining <= 0:
            state.remove()
            return
        state.update((remaining, due, offers))
        state.setTimeoutTimestamp(max(due, now + 1))
        return

    return run


def voids(effects: DataFrame, retention_days: int = 30, grace_days: int = 1, retry_days: int = 1, lateness: str = "1 hour") -> DataFrame:
    """2.10g, J11, P5, P12: (hold_id, kind, amount, at) of committed effects on holds; gives the voids to submit, each with its number of offer."""
    marked = effects.select("hold_id", "kind", "amount", "at").withWatermark("at", lateness)
    step = _step((retention_days + grace_days) * DAY_MS, retry_days * DAY_MS)
    return marked.groupBy("hold_id").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def start(effects: DataFrame, out: str, checkpoint: str, **options):
    """Runs over all that is there and stops; a batch that is run again replaces what it wrote."""

    def step(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return voids(effects, **options).writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
