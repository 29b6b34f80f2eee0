"""Sessions with client ids: brute force, stream against batch, state that shrinks; the exactly-once sink."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from pagemill.operators.sessions import replayed
from pagemill.plans.sessions import client_actions, offline
from pagemill.functions.timing import split_by_day
from pagemill.streaming.client_sessions import Sessions, client_session_log, stream_client_sessions, use_rocksdb
from pagemill.streaming.ledger import Ledger

SCHEMA = "event_id long, user_id long, ts timestamp_ntz, item string, action string, device string, client string"
IDLE, TTL = 90_000, 3_600_000


def script(*actions):
    """(ms, action, device, client[, item]) for one user; events are numbered from 1."""
    s = Sessions(IDLE, TTL)
    return [s.apply(n, ms, (rest or ["i"])[0], action, device, client) for n, (ms, action, device, client, *rest) in enumerate(actions, 1)]


def test_adoption_reopening_and_late_actions():
    got = script(
        (0, "start", "a", "c1"), (0, "start", "b", "c2"),  # a race: the second adopts
        (30_000, "heartbeat", "a", "c1"), (40_000, "stop", "a", "c1"),  # b is still there
        (50_000, "stop", "b", None), (51_000, "heartbeat", "b", None), (52_000, "stop", "a", "c1"),  # the last device has gone
        (60_000, "start", "a", "c1"), (61_000, "start", "b", "c2"),  # reopened; c2 never had one of its own
        (62_000, "stop", "a", None), (63_000, "stop", "b", None),
        (64_000, "start", "b", "c2"), (65_000, "start", "a", "c1"), (65_500, "start", "a", "c2"),  # an open one is not reopened beside
    )
    assert [g[:2] for g in got] == [(1, "created"), (1, "adopted"), (1, "continued"), (1, "continued"), (1, "continued"), (None, "ignored"), (1, "ignored"), (1, "reopened"), (1, "adopted"), (1, "continued"), (1, "continued"), (12, "created"), (12, "adopted"), (12, "resumed")]
    assert [g[2] for g in got[:5]] == [0, 0, 30, 10, 10] and [g[3] for g in got] == [False, False, False, False, True, False, True, False, False, False, True, False, False, False]


def test_time_to_live_and_items():
    got = script((0, "start", "a", "c"), (TTL, "heartbeat", "a", "c"), (2 * TTL + 1, "start", "a", "c"), (2 * TTL + 2, "start", "a", "c", "other"), (2 * TTL + 3, "start", "b", None, "other"), (2 * TTL + 4, "heartbeat", "b", None, None))
    assert [g[:2] for g in got] == [(1, "created"), (1, "continued"), (3, "created"), (3, "resumed"), (5, "created"), (None, "ignored")]
    s = Sessions(IDLE, TTL)
    s.apply(1, 0, "i", "start", "a", None)
    assert s.forget(TTL) == [] and s.forget(TTL + 1) == [1] and s.held == {}


def events(n, users, seed):
    rng = random.Random(seed)
    at = 0
    rows = []
    for i in range(n):
        at += rng.choice([0, 1_000, 40_000, 100_000, 400_000])
        rows.append((i, rng.randrange(users), at, rng.choice(["x", "y", None]), rng.choice(["start", "start", "heartbeat", "stop"]), rng.choice("ab"), rng.choice(["c1", "c2", None])))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "event_id long, user_id long, ms long, item string, action string, device string, client string").withColumn("ts", F.timestamp_millis("ms").cast("timestamp_ntz")).drop("ms")


def test_batch_against_the_plain_machine(spark):
    rows = events(600, 7, 3)
    want = []
    for user in range(7):
        s = Sessions(IDLE, TTL)
        for e, u, ms, item, action, device, client in rows:
            if u == user:
                n, outcome, elapsed, ended = s.apply(e, ms, item, action, device, client)
                want.append((user, e, None if n is None else f"{user}-{n}", outcome, elapsed, ended))
    odd = [(9_001, None, 5, "x", "start", "a", None), (9_002, 3, None, "x", "start", "a", None), (None, 3, 5, "x", "start", "a", None)]
    got = client_session_log(frame(spark, rows + odd), IDLE, TTL).collect()
    assert sorted(map(tuple, got)) == sorted(want, key=lambda r: r[:2])
    assert client_session_log(frame(spark, []), IDLE, TTL).collect() == []


def test_stream_equals_batch_and_its_state_shrinks(spark, tmp_path):
    rows = events(400, 5, 4)
    end = rows[-1][2]
    rows += [(1_000 + k, 99, end + TTL * (2 + k), "x", "start", "a", None) for k in range(4)]  # only user 99 goes on
    df = frame(spark, rows)
    batch = sorted(map(tuple, client_session_log(df, IDLE, TTL).collect()))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    use_rocksdb(spark)
    try:
        cuts = [0, 150, 300, 400, 401, 402, 403, 404]
        for k, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
            frame(spark, rows[lo:hi]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            stream = stream_client_sessions(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), IDLE, TTL)
            q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
            q.awaitTermination()
        assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == batch
        state = spark.read.format("statestore").option("path", str(tmp_path / "cp")).option("stateVarName", "sessions").load()
        users = {r[0] for r in state.select("key.user_id").distinct().collect()}
        assert users == {99} and state.count() <= 3
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def test_query_runs_the_same_machine(spark, sf_dir):
    from pagemill.plans import sessions as plans

    actions = sorted((r.user_id, r.ms, r.event_id, r["item"], r.action, r.device, r.client) for r in client_actions(spark, sf_dir).withColumn("ms", F.unix_millis(F.col("ts").cast("timestamp"))).collect())
    machines, want = {}, []
    for user, ms, event, item, action, device, client in actions:
        s = machines.setdefault(user, Sessions(plans.CLIENT_IDLE_MS, plans.CLIENT_TTL_MS))
        n, outcome, elapsed, ended = s.apply(event, ms, item, action, device, client)
        want.append((user, event, None if n is None else f"{user}-{n}", outcome, elapsed, ended))
    assert sorted(map(tuple, plans.client_sessions(spark, sf_dir).collect())) == sorted(want)
    assert {"created", "adopted", "resumed", "reopened", "continued", "ignored"} == {w[3] for w in want}


class Failing(Ledger):
    """Stops at a given place of a given batch, once."""

    fail_at: set = set()

    def _write(self, fresh, number):
        super()._write(fresh, number)
        if (number, "written") in self.fail_at:
            self.fail_at.discard((number, "written"))
            raise RuntimeError("lost before the commit")

    def _commit(self, number):
        super()._commit(number)
        if (number, "committed") in self.fail_at:
            self.fail_at.discard((number, "committed"))
            raise RuntimeError("lost after the commit")


def test_sink_adds_each_session_once(spark, sf_dir, tmp_path):
    sent = replayed(offline(spark, sf_dir), ["event_id"], "start_ms", "end_ms", "event_id").select("user_id", F.col("client_key").cast("long").alias("client_key"), "start_ms", "seconds", F.col("event_id").alias("seq"))
    for part in range(3):
        sent.where(F.col("seq") % 3 == part).coalesce(1).write.mode("append").parquet(str(tmp_path / f"part{part}"))
    ledger = Failing(spark, str(tmp_path / "sums"))
    Failing.fail_at = {(1, "written"), (2, "committed")}
    stops = 0
    for part in (0, 1, 0, 2):  # one is sent twice
        spark.read.parquet(str(tmp_path / f"part{part}")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        for _ in range(3):
            q = spark.readStream.schema(sent.schema).parquet(str(tmp_path / "in")).writeStream.foreachBatch(ledger.add).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
            try:
                q.awaitTermination()
                break
            except Exception:
                stops += 1
    assert stops == 2 and ledger.batches() == [0, 1, 2, 3]
    # In order of arrival: part 0 first, then 1, then 2.
    first = {}
    for r in sorted(sent.collect(), key=lambda r: (r.seq % 3, r.seq)):
        first.setdefault((r.user_id, r.client_key), r)
    assert sorted((r.user_id, r.client_key, r.seq) for r in ledger.sessions().collect()) == sorted((*k, r.seq) for k, r in first.items())
    spans = spark.createDataFrame([(r.user_id, r.start_ms, r.seconds) for r in first.values()], "user_id long, start_ms long, seconds long").select("user_id", F.explode(split_by_day(F.floor(F.col("start_ms") / 1000), F.col("seconds"))).alias("s"))
    want = spans.groupBy("user_id", F.col("s.day").alias("day")).agg(F.sum("s.seconds").alias("seconds"))
    assert sorted(map(tuple, ledger.totals().collect())) == sorted(map(tuple, want.collect()))


def test_sink_in_one_batch_equals_the_replay(spark, sf_dir, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "sums"))
    assert ledger.totals().collect() == [] and ledger.sessions() is None
    rows = replayed(offline(spark, sf_dir), ["event_id"], "start_ms", "end_ms", "event_id").select("user_id", F.col("client_key").cast("long").alias("client_key"), "start_ms", "seconds", F.col("event_id").alias("seq"))
    ledger.add(rows, 0)
    ledger.add(rows, 0)
    ledger.add(rows, 1)
    want = replayed(offline(spark, sf_dir), ["user_id", "client_key"], "start_ms", "end_ms", "event_id").select("event_id", "seconds")
    assert sorted((r.seq, r.seconds) for r in ledger.sessions().collect()) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("rows", [[(None, None, 0, 5, 1), (None, None, 0, 6, 2), (1, None, 0, 7, 3)]])
def test_sink_takes_null_keys(spark, tmp_path, rows):
    ledger = Ledger(spark, str(tmp_path / "sums"))
    df = spark.createDataFrame(rows, "user_id long, client_key long, start_ms long, seconds long, seq long")
    for n in range(2):
        ledger.add(df, n)
    assert sorted((r.user_id, r.seconds) for r in ledger.sessions().collect() if r.user_id) == [(1, 7)] and ledger.sessions().count() == 2
