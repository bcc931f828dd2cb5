"""Admission of a limited number of requests a minute, in batch and as a stream.

Only admitted requests count, so each verdict hangs on those before it: the
times of the last minute's admitted requests are the state of a key.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

WINDOW_S = 60.0
_OUT = "event_id long, visitor string, ts double, admitted boolean, wait_s int"


def verdict(times: list[float], now: float, most: int) -> tuple[bool, int, list[float]]:
    """Whether a request is admitted, how long to wait if not, and the times to keep."""
    if most == 0:
        return True, 0, times
    times = [t for t in times if now - t < WINDOW_S]
    if len(times) >= most:
        return False, max(1, int(WINDOW_S - (now - times[0])) + 1), times
    return True, 0, [*times, now]


def _judged(rows: pd.DataFrame, times: list[float], most: int) -> tuple[pd.DataFrame, list[float]]:
    rows = rows.sort_values(["ts", "event_id"])
    admitted, waits = [], []
    for now in rows["ts"]:
        ok, wait, times = verdict(times, now, most)
        admitted.append(ok)
        waits.append(wait)
    return rows.assign(admitted=admitted, wait_s=waits)[["event_id", "visitor", "ts", "admitted", "wait_s"]], times


def limited(events: DataFrame, most: int) -> DataFrame:
    """Events (event_id, visitor, ts in seconds) with ``admitted`` and ``wait_s``; ``most`` 0 admits all.

    Each visitor's events are streamed in order through one state, in Arrow
    batches of a partition sorted by visitor, so no visitor's events have to fit in memory.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        who, times = None, []
        for batch in batches:
            admitted, waits = [], []
            for visitor, now in zip(batch["visitor"], batch["ts"], strict=True):
                if visitor != who:
                    who, times = visitor, []
                ok, wait, times = verdict(times, now, most)
                admitted.append(ok)
                waits.append(wait)
            yield batch.assign(admitted=admitted, wait_s=waits)

    rows = events.select("event_id", "visitor", "ts")
    return rows.repartition("visitor").sortWithinPartitions("visitor", "ts", "event_id").mapInPandas(run, _OUT)


def limited_stream(events: DataFrame, most: int) -> DataFrame:
    """The same for a stream; a visitor's state goes when a minute of processing time passes without requests."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        times = list(state.get[0]) if state.exists else []
        out, times = _judged(pd.concat(list(batches)), times, most)
        state.update((times,))
        state.setTimeoutDuration(int(WINDOW_S * 1000))
        yield out

    return events.groupBy("visitor").applyInPandasWithState(run, _OUT, "times array<double>", "append", GroupStateTimeout.ProcessingTimeTimeout)
