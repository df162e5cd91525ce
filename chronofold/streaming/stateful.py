"""Incremental versions of stateful operators, on Structured Streaming.

Each keeps one small state per entity and gives what the batch version gives for the same rows. The
log is arrival-ordered, so rows of an entity must arrive in order within a batch or over batches;
within a batch they are sorted here.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def transitions(events: DataFrame) -> DataFrame:
    """(user_id, event_id, from_state, to_state, dur_us) of a stream of (user_id, event_id, event_type, us)."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(["us", "event_id"], kind="stable")
        last = state.get if state.exists else None
        out = []
        for r in rows.itertuples(index=False):
            if last is not None:
                out.append((key[0], last[0], last[1], r.event_type, r.us - last[2]))
            last = (int(r.event_id), r.event_type, int(r.us))
        state.update(last)
        yield pd.DataFrame(out, columns=["user_id", "event_id", "from_state", "to_state", "dur_us"])

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id long, event_id long, from_state string, to_state string, dur_us long", "event_id long, event_type string, us long", "append", GroupStateTimeout.NoTimeout)


def pending(events: DataFrame, opens: str, confirms: str, ttl_us: int) -> DataFrame:
    """(user_id, event_id, start_us, end_us, confirmed): what `opens` starts ends with the next `confirms`, or after its time to live.

    An entry leaves the state as soon as its end is known, that is at the first row of its entity past it.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(["us", "event_id"], kind="stable")
        ids, starts = (list(x) for x in state.get) if state.exists else ([], [])
        out = []
        for r in rows.itertuples(index=False):
            while starts and r.us > starts[0] + ttl_us:
                out.append((key[0], ids.pop(0), starts[0], starts.pop(0) + ttl_us, False))
            if r.event_type == opens:
                ids.append(int(r.event_id))
                starts.append(int(r.us))
            elif r.event_type == confirms:
                out += [(key[0], i, s, int(r.us), True) for i, s in zip(ids, starts, strict=True)]
                ids, starts = [], []
        state.update((ids, starts))
        yield pd.DataFrame(out, columns=["user_id", "event_id", "start_us", "end_us", "confirmed"])

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id long, event_id long, start_us long, end_us long, confirmed boolean", "ids array<long>, starts array<long>", "append", GroupStateTimeout.NoTimeout)


def running_counts(events: DataFrame, by: list[str], ts: str, window: str, late: str) -> DataFrame:
    """Counts by key and tumbling window, final once the watermark has passed. An extension: the log itself knows no lateness."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, window), *by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *by, "n")
