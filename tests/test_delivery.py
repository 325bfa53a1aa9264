"""Golden cases and twins; the registered queries are held against DuckDB in test_queries.py."""

from __future__ import annotations

import hashlib
import hmac
import random
import time
import zlib

import pytest
from pyspark.sql import functions as F

from pushflow.functions import scalars as S
from pushflow.operators import catalog, cluster, delivery, inspect, lanes, log, resolve, schedule
from pushflow.sources import frames
from pushflow.streaming import twins


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


def test_priority_lane(spark):
    df = spark.createDataFrame([("q", "k", False, 1, 0, 1), ("q", "k", False, 9, 1, 2), ("q", "k", False, 5, 2, 3)], "owner string, flow_key string, backfill boolean, priority int, log_offset long, message_id long")
    assert rows(lanes.lane_order(df), "place", "message_id") == [(1, 2), (2, 3), (3, 1)]


def test_backoff(spark):
    df = spark.range(1, 8).select(S.backoff_ms(F.lit("exponential"), F.lit(500), F.lit(30_000), F.lit(2.0), F.col("id")).alias("d"))
    assert [r.d for r in df.collect()] == [1000, 2000, 4000, 8000, 16000, 30000, 30000]


def test_delayed_order_places_every_message(spark):
    at = lambda i: i * 7919 % 251
    df = spark.range(1000).repartition(7).select(F.col("id").alias("message_id"), (F.col("id") * 7919 % 251).alias("deliver_at_ms"))
    want = sorted(range(1000), key=lambda i: (at(i), i))
    assert rows(schedule.delayed_order(df), "place", "message_id") == [(n + 1, i) for n, i in enumerate(want)]
    assert schedule.delayed_order(df.limit(0)).count() == 0


def test_cursor(spark):
    """An owner's cursor goes on from where it stands; acks before it, and those behind a gap, move nothing."""
    df = spark.createDataFrame([("t", 0, o) for o in (0, 1, 2, 4, 5)] + [("t", 1, 3), ("u", 0, 0), ("u", 0, 7), ("u", 0, 8), ("v", 0, 1)], "owner string, partition long, log_offset long")
    stored = spark.createDataFrame([("u", 0, 7), ("v", 0, 4), ("w", 2, 9)], "owner string, partition long, cursor long")
    assert rows(log.dispatch_cursor(df, stored)) == [("t", 0, 3), ("t", 1, 0), ("u", 0, 9), ("v", 0, 4), ("w", 2, 9)]
    assert rows(log.dispatch_cursor(df, stored.limit(0)), "owner", "cursor") == [("t", 0), ("t", 3), ("u", 1), ("v", 0)]


def test_backfill_cap(spark):
    """The cap is on what is listed, before urls and cursors are looked at; the direct topic is always listed."""
    kind = "topic string, partition long, log_offset long, url string, owner string"
    df = spark.createDataFrame([(t, p, o, None if (t, o) == ("b", 1) else "u", t) for t in ("a", "b", "c", S.DIRECT, "a.__dlq") for p in (0, 1) for o in range(3)], kind)
    cursors = spark.createDataFrame([("a", 0, 2)], "owner string, partition long, cursor long")
    topics = spark.createDataFrame([("a",), ("b",), ("a.__dlq",)], "topic string")
    assert rows(log.backfill(df, cursors, topics, 4), "topic", "partition", "log_offset") == [(S.DIRECT, 0, 0), (S.DIRECT, 0, 1), (S.DIRECT, 0, 2), (S.DIRECT, 1, 0), ("a", 0, 2), ("a", 1, 0), ("b", 0, 0), ("b", 0, 2), ("b", 1, 0)]
    assert len(rows(log.backfill(df, cursors, topics))) == 6 + 4 + 4
    long = spark.range(50_003).select(F.lit("b").alias("topic"), F.lit(0).cast("long").alias("partition"), F.col("id").alias("log_offset"), F.lit("u").alias("url"), F.lit("b").alias("owner"))
    assert log.backfill(long, cursors, topics).count() == 50_000


def test_purge_by_owner(spark):
    """The record that closes its owner's prefix is purged; without owner or url there is nothing to wait for."""
    df = spark.createDataFrame([("a", 0, 0, 2, "u"), ("a", 0, 1, 1, "u"), ("a", 0, 2, 3, ""), ("b", 0, 1, 1, "u"), (None, 0, 9, 1, "u")], "owner string, partition long, log_offset long, ack_seq long, url string")
    got = {(r.owner, r.log_offset): r.purged for r in log.purge_after_delivery(df).collect()}
    assert got == {("a", 0): True, ("a", 1): False, ("a", 2): True, ("b", 1): True, (None, 9): True}
    assert rows(log.no_destination(df), "log_offset") == [(2,)]


def test_flow_limits(spark):
    """Given limits, the queue's one at a time, and the defaults outside flow control."""
    df = spark.createDataFrame([("k", False, None, None, None, None), ("k", True, None, None, None, None), ("k", True, "own", None, None, None), ("k", False, None, 0, None, 9), ("k", True, None, None, 5, 0)], "routing_key string, flow_controlled boolean, flow_key_in string, parallelism_in long, rate_in long, period_in long")
    got = [tuple(r) for r in resolve.resolve_flow_limits(df).select("flow_key", "parallelism", "rate", "period_secs").collect()]
    assert got == [("k", 4, 0, 1), ("k", 1, 0, 1), ("own", 4, 0, 1), ("k", 1, 0, 9), ("k", 4, 5, 1)]


def test_fanout(spark):
    """A member's lane is its own key or the base's routing key; the base's payload and retries go along."""
    groups = spark.createDataFrame([(1, False), (2, True), (3, False)], "group_id long, group_paused boolean")
    members = spark.createDataFrame([(1, 7, "u7", False, 2, 0, 1, None), (1, 8, "u8", False, 1, 5, 60, "own"), (1, 9, "u9", True, 1, 0, 1, None), (2, 5, "u5", False, 1, 0, 1, None)], "group_id long, member_id long, url string, paused boolean, parallelism long, rate long, period_secs long, member_flow_key string")
    kind = "message_id long, group_id long, routing_key string, idempotency_key string, flow_key_in string, payload string, priority_in long, max_retries_in long"
    requests = spark.createDataFrame([(1, 1, "r", "i", "f", "p", 9, 2), (2, 1, "", None, "f", "p", None, None), (3, 2, "r", None, None, "p", None, None), (4, 3, "r", None, None, "p", None, None), (5, None, "r", None, None, "p", None, None)], kind)
    got = rows(resolve.group_fanout(requests, groups, members), "message_id", "member_id", "routing_key", "flow_key", "idempotency_key", "topic", "payload", "priority_in", "max_retries_in")
    assert got == [(1, 7, "r:7", "r", "i:7", "__group.1", "p", 9, 2), (1, 8, "r:8", "own", "i:8", "__group.1", "p", 9, 2), (2, 7, "7", None, None, "__group.1", "p", None, None), (2, 8, "8", "own", None, "__group.1", "p", None, None)]
    assert rows(resolve.fanout_errors(requests, groups, members), "message_id") == [(3,), (4,)]


def test_lease_and_manual_blocks(spark):
    """A dead holder's lease is free; the last command of a host counts, under its key."""
    df = spark.createDataFrame([("s", 0, 1, 1, None), ("s", 10, 2, 2, None), ("s", 20, 3, 2, [1]), ("s", 30, 4, 1, [3]), ("s", 5020, 5, 1, None)], "name string, at_ms long, attempt_id long, node long, dead array<long>")
    assert rows(cluster.lease(df), "attempt_id", "granted") == [(1, True), (2, False), (3, True), (4, False), (5, True)]
    commands = spark.createDataFrame([("https://A.com/x", 0, 1, "block", 50), ("https://b.com", 0, 2, "block", 9000), ("https://b.com/y", 5, 3, "unblock", None), (" h ", 0, 4, "block", 5000), ("https://a.com:443", 100, 5, "block", 10)], "host string, at_ms long, command_id long, action string, duration_ms long")
    assert rows(delivery.manual_blocks(commands, F.lit(600))) == [("h", 4400), ("https://a.com:443", 500)]


def test_long_lanes(spark):
    """100 000 events of one host or lane, in time that grows with them."""
    events = spark.range(100_000).select(F.lit("h").alias("host"), (F.col("id") * 7).alias("at_ms"), F.col("id").alias("event_id"), (F.col("id") % 100 > 0).alias("failed"))
    began = time.monotonic()
    assert delivery.breaker(events).where("blocked").count() == sum(i % 100 >= 3 for i in range(100_000))
    lane = events.select(F.col("host").alias("lane"), "at_ms", F.col("event_id").alias("message_id"))
    assert lanes.rate_window_admit(lane, "lane", 2, 70).where("admitted").count() == 20_000
    assert lanes.rate_window_start(lane, "lane", 2, 14).agg(F.max("start_ms")).first()[0] == 699_993
    assert time.monotonic() - began < 60


def plain_starts(jobs, most):
    """From moment to moment: what has ended leaves, what has come in waits, and the best of those that wait start."""
    todo, waiting, busy, out, now = sorted(jobs), [], [], {}, None
    while todo or waiting:
        moments = [end for end in busy if now is None or end > now] + ([todo[0][0]] if todo else [])
        now = min(moments)
        busy = [end for end in busy if end > now]
        while todo and todo[0][0] <= now:
            waiting.append(todo.pop(0))
        waiting.sort(key=lambda j: (-j[1], j[2]))
        while waiting and len(busy) < most:
            _, _, message, service = waiting.pop(0)
            out[message] = now
            busy.append(now + service)
    return out


@pytest.mark.parametrize("most", [1, 2, 5])
def test_parallel_starts(spark, most):
    rng = random.Random(most)
    jobs = [(lane, rng.randint(0, 200), rng.randint(0, 3), 100 * n + lane, rng.randint(1, 30)) for n in range(60) for lane in range(3)]
    df = spark.createDataFrame(jobs, "lane long, at_ms long, priority long, message_id long, service_ms long")
    want = [(lane, m, at) for lane in range(3) for m, at in plain_starts([j[1:] for j in jobs if j[0] == lane], most).items()]
    assert rows(lanes.parallel_starts(df, "lane", most)) == sorted(want)


def test_checksums(spark):
    texts = ["", "a", "schlüssel", "x" * 10_000]
    got = spark.createDataFrame([(t,) for t in texts], "payload string").select(F.crc32(F.col("payload").cast("binary")).alias("crc")).collect()
    assert [r.crc for r in got] == [zlib.crc32(t.encode()) for t in texts]


def test_upsert_by_id_or_name(spark):
    kind = "tenant_id string, id long, name string, updated_at_ms long"
    stored = spark.createDataFrame([("t", 1, "a", 5), ("t", 2, "b", 9), ("u", 3, "c", 5)], kind)
    given = spark.createDataFrame([("t", 8, "a", 5), ("t", 2, "z", 8), ("t", 3, "c", 1), ("u", 3, "d", 7)], kind)
    assert rows(catalog.upsert_lww(stored, given)) == [("t", 2, "b", 9), ("t", 3, "c", 1), ("t", 8, "a", 5), ("u", 3, "d", 7)]


def test_purge_and_recover(spark):
    df = spark.createDataFrame([("t", 0, 0, 0, True), ("t", 0, 0, 1, False), ("t", 0, 0, 2, True), ("t", 0, 1, 0, True)], "topic string, partition long, file_no int, pos int, ok boolean")
    assert rows(log.recover(df), "file_no", "pos", "log_offset") == [(0, 0, 0), (1, 0, 1)]
    log_ = spark.createDataFrame([("t", 0, 0), ("t", 0, 1)], "topic string, partition long, log_offset long")
    assert rows(log.visible(log_, log_.limit(1)), "log_offset") == [(1,)]


def test_idempotent_pair(spark):
    df = spark.createDataFrame([("d", 1, "k"), ("d", 2, "k"), ("d", 3, None), ("d", 4, None), ("d", 5, "m3")], "tenant_id string, message_id long, idempotency_key string")
    assert rows(log.accept(df), "message_id", "original_id", "duplicate") == [(1, 1, False), (2, 1, True), (3, 3, False), (4, 4, False), (5, 5, False)]


def test_retry_to_dead_letter(spark):
    m = spark.createDataFrame([(1, "jobs", 1, "x")], "message_id long, topic string, max_retries long, payload string")
    a = spark.createDataFrame([(1, 0, 500), (1, 1, 500), (1, 2, 200)], "message_id long, attempt long, status long")
    q = spark.createDataFrame([("jobs", "https://h")], "topic string, url string")
    out = delivery.outcomes(m, a)
    assert rows(out) == [(1, "jobs", "exhausted", 500, 2)]
    assert delivery.dead_letters(out, m, q).first().dlq_topic == "jobs.__dlq"


def test_breaker(spark):
    events = spark.createDataFrame([("h", 0, 1, True), ("h", 1, 2, True), ("h", 100, 3, True), ("h", 101, 4, False), ("h", 102, 5, True)], "host string, at_ms long, event_id long, failed boolean")
    assert rows(delivery.breaker(events, 2, 50, 1), "event_id", "blocked") == [(1, False), (2, True), (3, True), (4, False), (5, False)]


def test_election(spark):
    nodes = spark.createDataFrame([(i, i, i != 1) for i in range(3)], "node long, idx long, alive boolean")
    shards = spark.range(3).withColumnRenamed("id", "shard")
    assert rows(cluster.leaders(nodes, shards), "shard", "preferred", "leader", "failover") == [(0, 0, 0, False), (1, 1, 2, True), (2, 2, 2, False)]
    dead = nodes.withColumn("alive", F.lit(False))
    assert rows(cluster.leaders(dead, shards), "shard", "leader") == [(0, 0), (1, 1), (2, 2)]


@pytest.mark.parametrize("key", ["", "k", "schlüssel", "x" * 64, "y" * 65, "z" * 200])
def test_signature(spark, key):
    got = spark.range(1).select(S.signature(key, F.lit('{"a":1}'), F.lit(1700000000000)).alias("s")).first().s
    assert got == "t=1700000000000,v1=" + hmac.new(key.encode(), b'1700000000000.{"a":1}', hashlib.sha256).hexdigest()


def test_cron():
    nine = 1_700_006_400_000 - 1_700_006_400_000 % 86_400_000 + 9 * 3_600_000
    assert schedule.cron_next("0 9 * * *", nine - 1000) == nine
    assert schedule.cron_next("0 9 * * *", nine) == nine + 86_400_000
    assert schedule.cron_next("*/10 * * * * *", 5000) == 10_000
    assert schedule.cron_next("0 0 31 feb *", 0) is None
    assert schedule.cron_next("bad", 0) is None


def test_parallel_is_serial_for_one(spark):
    df = spark.createDataFrame([("l", 0, 1, 1, 10), ("l", 1, 1, 2, 10), ("l", 50, 1, 3, 10)], "lane string, at_ms long, priority long, message_id long, service_ms long")
    want = [(1, 0), (2, 10), (3, 50)]
    assert rows(lanes.parallel_starts(df, "lane", 1), "message_id", "start_ms") == want == rows(lanes.serial_starts(df, "lane"), "message_id", "start_ms")


def test_catalogue(spark):
    e = spark.createDataFrame([(1, 0, 5, "a", 1), (1, 1, 5, "b", 2), (2, 0, 4, "c", 3)], "id long, source long, updated_at_ms long, name string, version long")
    t = spark.createDataFrame([(2, 4), (1, 4)], "id long, deleted_at_ms long")
    assert rows(catalog.merge(e, t), "id", "name") == [(1, "b")]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "dlq_topic string")
    sources = inspect.dlq_sources(spark.createDataFrame([("__direct.__dlq",)], "dlq_topic string"), none, spark.createDataFrame([], "group_id long, name string"))
    assert rows(sources) == [("__direct.__dlq", "direct", "Direct publish", "__direct", 0)]
    assert rows(resolve.lane_owner(spark.createDataFrame([], "member_id long, queue_id string, profile_id string, message_id long"))) == []


def test_frames(spark, tmp_path):
    good = frames.encode({"a": 1}, b"one") + frames.encode({"a": 2}, b"two")
    (tmp_path / "x.log").write_bytes(good + b"junk that is no frame at all")
    assert [(h["a"], p) for h, p, _ in frames.decode(good)] == [(1, b"one"), (2, b"two")]
    assert [bytes(r.payload) for r in frames.read_frames(spark, str(tmp_path)).orderBy("pos").collect()] == [b"one", b"two"]
    with pytest.raises(ValueError, match="checksum"):
        list(frames.decode(good[:-1] + b"\0"))
    assert frames.json_recover([("main", "{"), ("tmp", None), ("bak", "[1]")]) == ([1], ["main"])
    with pytest.raises(ValueError):
        frames.json_recover([("main", "")])


def _stream(spark, df, path):
    df.coalesce(1).write.parquet(str(path))
    return spark.readStream.schema(df.schema).parquet(str(path))


def _run(stream, spark, name, tmp_path):
    stream.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"cp-{name}")).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)


def test_streaming_twins(spark, tmp_path):
    m = spark.createDataFrame([("d", i, f"k{i % 4}" if i % 2 else None) for i in range(12)], "tenant_id string, message_id long, idempotency_key string")
    got = _run(twins.idempotent_accept(_stream(spark, m, tmp_path / "m")), spark, "accepted", tmp_path)
    assert got.count() == log.accepted(m).count()
    a = spark.createDataFrame([(f"l{i % 3}", i * 7, i) for i in range(60)], "lane string, at_ms long, message_id long")
    got = _run(twins.rate_windows(_stream(spark, a, tmp_path / "a"), 2, 50), spark, "admitted", tmp_path)
    assert rows(got, "message_id", "admitted") == rows(lanes.rate_window_admit(a, "lane", 2, 50), "message_id", "admitted")
    e = spark.createDataFrame([(f"h{i % 2}", i * 1000, i, i % 7 < 5) for i in range(40)], "host string, at_ms long, event_id long, failed boolean")
    got = _run(twins.breaker(_stream(spark, e, tmp_path / "e")), spark, "blocked", tmp_path)
    assert rows(got, "event_id", "blocked", "until_ms") == rows(delivery.breaker(e), "event_id", "blocked", "until_ms")


def test_push_sink(spark, tmp_path):
    m = spark.createDataFrame([(i, "x") for i in range(5)], "message_id long, payload string")
    kept = []
    twins.push(_stream(spark, m, tmp_path / "p"), lambda batch: [200 if x["message_id"] % 2 else None for x in batch], lambda df: kept.extend(df.collect()), str(tmp_path / "cp")).awaitTermination()
    assert sorted((r.message_id, r.status) for r in kept) == [(0, None), (1, 200), (2, None), (3, 200), (4, None)]
