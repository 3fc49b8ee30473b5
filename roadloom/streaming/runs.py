"""Runs of equal event types over a stream of events: our own addition, the batch form is ``relational.equal_runs``."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from roadloom.session import ship


def stream_runs(events: DataFrame) -> DataFrame:
    """user_id, event_type, length of runs as they end, from a stream of events (user_id, event_id, ts, event_type).

    Within a micro-batch a user's events are taken by (ts, event_id); the open run is the only state."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kind, n = state.get if state.exists else (None, 0)
        out = []
        for f in [pd.concat(list(frames))]:
            for t in f.sort_values(["ts", "event_id"])["event_type"].tolist():
                if t == kind:
                    n += 1
                    continue
                if n:
                    out.append((key[0], kind, n))
                kind, n = t, 1
        state.update((kind, n))
        yield pd.DataFrame(out, columns=["user_id", "event_type", "length"])

    ship(events.sparkSession)
    return events.groupBy("user_id").applyInPandasWithState(step, "user_id long, event_type string, length long", "kind string, n long", "append", GroupStateTimeout.NoTimeout)
