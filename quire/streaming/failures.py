"""Runs of failures over a stream: consecutive failures by key, and a cooldown after several of them that ends by itself."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "run long, until_ms long"
OUTPUT = "key string, run long, cooling boolean"


def failure_runs(events: DataFrame, limit: int = 3, cooldown_s: float = 1800) -> DataFrame:
    """Keys with their current run, for a stream of ``events(key string, ts timestamp, failed boolean)``.

    From ``limit`` failures in a row on a key is cooling for ``cooldown_s`` seconds of processing time, counted from its last failure; a
    success ends a run, not a cooldown that has begun. A key gives a row when it has events, and one more when its cooldown ends, by the state's
    timeout and without a new event; its run then starts again. State is one small row a key, and a timer while it cools. Timers want a trigger
    that goes on, as ``processingTime`` does: one for available data only never ends.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"key": [key[0]], "run": [0], "cooling": [False]})
            return
        run, until = state.get if state.exists else (0, 0)
        now = state.getCurrentProcessingTimeMs()
        for failed in pd.concat(list(batches)).sort_values("ts")["failed"]:
            run = run + 1 if failed else 0
            if run >= limit:
                until = now + int(cooldown_s * 1000)
        state.update((run, until))
        if now < until:
            state.setTimeoutDuration(until - now)
        yield pd.DataFrame({"key": [key[0]], "run": [run], "cooling": [now < until]})

    return events.groupBy("key").applyInPandasWithState(step, OUTPUT, STATE, "update", GroupStateTimeout.ProcessingTimeTimeout)
