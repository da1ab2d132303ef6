"""Agent health as it happens: silences from timers on keyed state."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SILENCE = "agent_id STRING, previous_ts BIGINT, ts BIGINT, silent_seconds BIGINT"
_STATE = "last BIGINT, told BOOLEAN, waiting ARRAY<BIGINT>"


def silences(beats: DataFrame, interval: int, delay: int = 0) -> DataFrame:
    """Silences longer than two intervals of a stream of heartbeats: a row without ``ts`` once one has begun, and a row with both ends
    when the agent is heard again.

    The clock is event time: the newest heartbeat of all agents less ``delay`` seconds. Heartbeats ahead of it wait in the state of their agent, so
    the order within ``delay`` does not matter; later ones are dropped, since what was told is not taken back. A timer per agent
    runs out at its next waiting heartbeat or at the moment its silence begins, so agents that send nothing are found as well. State
    per agent is its last heartbeat and those of the last ``delay`` seconds. Rows without an agent or a time take no part.
    """
    limit = 2 * interval

    def step(key: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, told, waiting = state.get if state.exists else (None, False, [])
        waiting = set(waiting).union(*[] if state.hasTimedOut else [frame["ts"].tolist() for frame in frames])
        clock = state.getCurrentWatermarkMs() // 1000
        out = []
        for ts in sorted(t for t in waiting if t <= clock):
            if last is not None and ts - last > limit:
                out += [] if told else [(key[0], last, None, None)]
                out.append((key[0], last, ts, ts - last))
            last, told = ts if last is None else max(last, ts), False
        waiting = sorted(t for t in waiting if t > clock)
        if last is not None and not told and clock - last > limit:
            out.append((key[0], last, None, None))
            told = True
        state.update((last, told, waiting))
        due = waiting[:1] + ([last + limit + 1] if last is not None and not told else [])
        if due:
            state.setTimeoutTimestamp(min(due) * 1000)
        if out:
            told_of = pd.DataFrame(out, columns=["agent_id", "previous_ts", "ts", "silent_seconds"])
            yield told_of.astype({c: "Int64" for c in ("previous_ts", "ts", "silent_seconds")})

    timed = beats.where("agent_id is not null and ts is not null").select("agent_id", "ts", F.timestamp_seconds("ts").alias("at"))
    return (
        timed.withWatermark("at", f"{delay} seconds")
        .groupBy("agent_id")
        .applyInPandasWithState(step, SILENCE, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
    )
