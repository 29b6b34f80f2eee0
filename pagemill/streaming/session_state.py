"""Session identities: a state machine for each key, in batch and in Structured Streaming.

A session opens with an event while none is open, and ends with a stop that leaves
no active device. Stops while no session is open change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.functions.timing import millis

OUT = "user_id long, session_id string, event_id long, elapsed long, ended boolean"


class Session:
    """The state of one key: the number of sessions so far, the open one's devices and last time."""

    def __init__(self, count: int = 0, last_ms: int = 0, is_open: bool = False, devices: dict[str, int] | None = None):
        self.count, self.last_ms, self.is_open, self.devices = count, last_ms, is_open, devices or {}

    def apply(self, ms: int, device: str, stop: bool, idle_ms: int) -> tuple[int, int, bool] | None:
        """(session, elapsed seconds, ended), or None for an event that is ignored."""
        if not self.is_open:
            if stop:
                return None
            self.count, self.is_open, self.devices, self.last_ms = self.count + 1, True, {}, ms
        self.devices = {d: seen for d, seen in self.devices.items() if seen >= ms - idle_ms}
        elapsed = max(0, (ms - self.last_ms + 500) // 1000) if self.devices else 0
        self.last_ms = ms
        if stop:
            self.devices.pop(device, None)
        else:
            self.devices[device] = ms
        ended = stop and not self.devices
        self.is_open = not ended
        return self.count, elapsed, ended


def _rows(key: int, pdf: pd.DataFrame, state: Session, idle_ms: int) -> Iterator[tuple]:
    for ms, event, device in zip(pdf["ms"], pdf["event_id"], pdf["event_type"]):
        told = state.apply(int(ms), device, device == "error", idle_ms)
        if told:
            yield key, f"{key}-{told[0]}", int(event), told[1], told[2]


def _frame(rows) -> pd.DataFrame:
    return pd.DataFrame(list(rows), columns=["user_id", "session_id", "event_id", "elapsed", "ended"])


def session_log(events: DataFrame, idle_ms: int) -> DataFrame:
    """Batch: every event of a session with its session id. A key's events go to one
    task in batches, in order; only its state is held. Events without a user belong
    to no session and are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, Session()
        for pdf in batches:
            out = []
            for user, part in pdf.groupby("user_id", sort=False):
                if user != key:
                    key, state = user, Session()
                out += _rows(int(user), part, state, idle_ms)
            yield _frame(out)

    rows = events.where("user_id is not null").select("user_id", millis(F.col("ts")).alias("ms"), "event_id", "event_type")
    return rows.repartition("user_id").sortWithinPartitions("user_id", "ms", "event_id").mapInPandas(run, OUT)


def stream_sessions(events: DataFrame, idle_ms: int) -> DataFrame:
    """Streaming: the same log, with the state kept between micro-batches. Events are put
    in order within a batch; between batches their order is that of arrival. The state
    of a user has no time limit, since session ids count on: it is a number of sessions
    and the devices seen within `idle_ms` of the last event."""

    def step(key, frames: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        count, last_ms, is_open, names, seen = held.get if held.exists else (0, 0, False, [], [])
        state = Session(count, last_ms, is_open, dict(zip(names, seen)))
        pdf = pd.concat(list(frames)).sort_values(["ms", "event_id"])
        out = _frame(_rows(int(key[0]), pdf, state, idle_ms))
        held.update((state.count, state.last_ms, state.is_open, list(state.devices), list(state.devices.values())))
        yield out

    rows = events.where("user_id is not null").select("user_id", millis(F.col("ts")).alias("ms"), "event_id", "event_type")
    return rows.groupBy("user_id").applyInPandasWithState(step, OUT, "count long, last_ms long, is_open boolean, names array<string>, seen array<long>", "append", "NoTimeout")
