"""Reading sessions with client ids: reopening, adoption and a time to live, in batch and as a stream.

A client starts a session with an id of its own, or without one. A start whose id
is known resumes that session, even one that has ended (it is reopened); else it joins
the session that is open for the item; else it creates one. So of several devices that
create at once the first wins and the others adopt its session. Later actions go to the session
of their client id, or else to the open one of their item; what is sent to a session that has ended
changes nothing. A stop ends a session when no device is left that acted within `idle_ms`.

A session that nothing has touched for `ttl_ms` is forgotten, whatever its state:
lookups don't see it from then on, so that results don't depend on when it is removed. In the stream
an event-time timer removes it; a user without any session left has no state at all. A session's
id is that of its user and of the event that created it, so that no counter has to stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from pagemill.functions.timing import millis

OUT = "user_id long, event_id long, session_id string, outcome string, elapsed long, ended boolean"
#: What a stream keeps of a session, under the number of the event that created it.
KEPT = "item string, client string, last_ms long, ended boolean, devices array<string>, seen array<long>"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass
class Open:
    """A session: its item, the client id it was created with, and the devices that act in it."""

    item: str | None
    client: str | None
    last_ms: int
    ended: bool = False
    devices: dict[str, int] = field(default_factory=dict)

    def act(self, ms: int, device: str, stop: bool, idle_ms: int) -> int:
        """Seconds since the last action, if a device was active before this one."""
        self.devices = {d: seen for d, seen in self.devices.items() if seen >= ms - idle_ms}
        elapsed = max(0, (ms - self.last_ms + 500) // 1000) if self.devices else 0
        if stop:
            self.devices.pop(device, None)
        else:
            self.devices[device] = ms
        self.last_ms, self.ended = ms, stop and not self.devices
        return elapsed


class Sessions:
    """The sessions of one user, by the number of the event that created them."""

    def __init__(self, idle_ms: int, ttl_ms: int, held: dict[int, Open] | None = None):
        self.idle_ms, self.ttl_ms, self.held = idle_ms, ttl_ms, held or {}
        self.touched: set[int] = set()

    def _find(self, ms: int, fits) -> int | None:
        """The newest session that fits and is not forgotten."""
        return max((n for n, s in self.held.items() if s.last_ms + self.ttl_ms >= ms and fits(s)), default=None)

    def apply(self, event: int, ms: int, item: str | None, action: str, device: str, client: str | None) -> tuple[int | None, str, int, bool]:
        """(session, outcome, elapsed seconds, ended). An action that comes late counts at the session's last time."""
        own = self._find(ms, lambda s: s.client == client) if client is not None else None
        active = self._find(ms, lambda s: s.item == item and not s.ended)
        if action != "start":
            n = own if own is not None else active
            if n is None or self.held[n].ended:
                return n, "ignored", 0, n is not None
            outcome = "continued"
        elif own is not None and (not self.held[own].ended or active is None or self.held[own].item != item):
            n, outcome = own, "reopened" if self.held[own].ended else "resumed"
        elif active is not None:  # an item has one open session, so that an ended one can't be reopened beside it
            n, outcome = active, "adopted"
        else:
            n, outcome = event, "created"
            self.held[n] = Open(item, client, ms)
        session = self.held[n]
        elapsed = session.act(max(ms, session.last_ms), device, action == "stop", self.idle_ms)
        self.touched.add(n)
        return n, outcome, elapsed, session.ended

    def forget(self, ms: int) -> list[int]:
        """Removes what lookups from this time on don't see."""
        gone = [n for n, s in self.held.items() if s.last_ms + self.ttl_ms < ms]
        for n in gone:
            del self.held[n]
        return gone


def _told(user: int, rows: pd.DataFrame, sessions: Sessions) -> list[tuple]:
    out = []
    for event, ms, item, action, device, client in zip(*[rows[c].tolist() for c in ("event_id", "ms", "item", "action", "device", "client")]):
        n, outcome, elapsed, ended = sessions.apply(event, ms, item, action, device, client if isinstance(client, str) else None)
        out.append((user, event, None if n is None else f"{user}-{n}", outcome, elapsed, ended))
    return out


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in OUT.split(", ")])


def _columns(actions: DataFrame) -> DataFrame:
    known = actions.where("user_id is not null and ts is not null and event_id is not null")
    return known.withColumns({"ms": millis(F.col("ts")), "device": F.coalesce("device", F.lit(""))})


def client_session_log(actions: DataFrame, idle_ms: int, ttl_ms: int) -> DataFrame:
    """Batch: what each action (event_id, user_id, ts, item, action, device, client) did. A user's
    actions go through one task in order; what is held are the sessions that aren't forgotten. Actions
    without user, time or number are left out; a null item is an item of its own."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, sessions = None, Sessions(idle_ms, ttl_ms)
        for pdf in batches:
            out: list[tuple] = []
            for user, part in pdf.groupby("user_id", sort=False):
                if user != key:
                    key, sessions = user, Sessions(idle_ms, ttl_ms)
                out += _told(int(user), part, sessions)
                sessions.forget(int(part["ms"].iloc[-1]))
            yield _frame(out)

    rows = _columns(actions).select("user_id", "ms", "event_id", "item", "action", "device", "client")
    return rows.repartition("user_id").sortWithinPartitions("user_id", "ms", "event_id").mapInPandas(run, OUT)


class SessionProcessor(StatefulProcessor):
    """Keeps a map from the creating event to its session, and one timer a user: for the oldest session."""

    def __init__(self, idle_ms: int, ttl_ms: int):
        self.idle_ms, self.ttl_ms = idle_ms, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getMapState("sessions", "event long", KEPT)

    def _held(self) -> dict[int, Open]:
        if not self.kept.exists():
            return {}
        return {key[0]: Open(s[0], s[1], s[2], s[3], dict(zip(s[4], s[5]))) for key, s in self.kept.iterator()}

    def _remind(self, sessions: Sessions) -> None:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        if sessions.held:
            self.handle.registerTimer(min(s.last_ms for s in sessions.held.values()) + self.ttl_ms + 1)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        sessions = Sessions(self.idle_ms, self.ttl_ms, self._held())
        part = pd.concat(list(rows)).sort_values(["ms", "event_id"])
        out = _told(int(key[0]), part, sessions)
        for n in sorted(sessions.touched):
            s = sessions.held[n]
            self.kept.updateValue((n,), (s.item, s.client, s.last_ms, s.ended, list(s.devices), list(s.devices.values())))
        self._remind(sessions)
        yield _frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        sessions = Sessions(self.idle_ms, self.ttl_ms, self._held())
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        for n in sessions.forget(now):
            self.kept.removeKey((n,))
        self._remind(sessions)
        yield _frame([])

    def close(self) -> None:
        pass


def use_rocksdb(spark: SparkSession) -> None:
    """Maps and timers need this state store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def stream_client_sessions(actions: DataFrame, idle_ms: int, ttl_ms: int, late: str = "1 hour") -> DataFrame:
    """Streaming: the same log. Actions are put in order within a micro-batch; those that are late
    between batches count at their session's last time, and later than `late` they are dropped. The session needs use_rocksdb()."""
    rows = _columns(actions).withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    rows = rows.select("user_id", "at", "ms", "event_id", "item", "action", "device", "client")
    return rows.groupBy("user_id").transformWithStateInPandas(statefulProcessor=SessionProcessor(idle_ms, ttl_ms), outputStructType=OUT, outputMode="append", timeMode="eventTime")
