"""Structured Streaming forms of operators that keep state between messages.

Each one is the streaming twin of a batch operator: over the same rows, in the same order,
it gives the same answer.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def idempotent_accept(stream: DataFrame, horizon: str | None = None) -> DataFrame:
    """First message of each idempotency key.

    Without a horizon the state keeps every key for ever, as the batch form does. With one,
    keys are forgotten once the event time column published_at has moved past it: bounded
    state, and a duplicate that comes later than that is accepted.
    """
    rows = stream.withColumn("dedup_key", F.coalesce("idempotency_key", F.concat(F.lit("m"), F.col("message_id").cast("string"))))
    if horizon is None:
        return rows.dropDuplicates(["tenant_id", "dedup_key"]).drop("dedup_key")
    return rows.withWatermark("published_at", horizon).dropDuplicatesWithinWatermark(["tenant_id", "dedup_key"]).drop("dedup_key")


def rate_windows(stream: DataFrame, rate: int, period_ms: int) -> DataFrame:
    """stream(lane, at_ms, message_id): admitted or not, with the window of each lane as state."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        anchor, used = state.get if state.exists else (None, 0)
        rows = pd.concat(list(batches)).sort_values(["at_ms", "message_id"])
        admitted = []
        for at in rows["at_ms"]:
            at = int(at)
            if anchor is None or at - anchor >= period_ms:
                anchor, used = at, 0
            admitted.append(used < rate)
            used += used < rate
        state.update((anchor, used))
        yield pd.DataFrame({"lane": key[0], "message_id": rows["message_id"], "admitted": admitted})

    return stream.groupBy("lane").applyInPandasWithState(step, "lane string, message_id long, admitted boolean", "anchor long, used long", "append", GroupStateTimeout.NoTimeout)


def breaker(stream: DataFrame, threshold: int = 3, cooldown: int = 30_000, growth: int = 2, most: int = 900_000) -> DataFrame:
    """stream(host, at_ms, event_id, failed): whether the host is blocked after each event."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        failures, until, pause = state.get if state.exists else (0, 0, cooldown)
        rows = pd.concat(list(batches)).sort_values(["at_ms", "event_id"])
        out = []
        for at, event, failed in zip(rows["at_ms"], rows["event_id"], rows["failed"], strict=True):
            if not failed:
                failures, until, pause = 0, 0, cooldown
            else:
                failures += 1
                if failures >= threshold:
                    until, pause = int(at) + pause, min(pause * growth, most)
            out.append((key[0], event, until > at, until))
        state.update((failures, until, pause))
        yield pd.DataFrame(out, columns=["host", "event_id", "blocked", "until_ms"])

    return stream.groupBy("host").applyInPandasWithState(step, "host string, event_id long, blocked boolean, until_ms long", "failures long, until long, pause long", "append", GroupStateTimeout.NoTimeout)


def delayed_release(stream: DataFrame, now_ms: int) -> DataFrame:
    """Messages that are due at a logical now; the rest come with a later one."""
    return stream.where(F.col("deliver_at_ms") <= now_ms)


def ingest_hourly(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """Messages of each tenant and hour of published_at, with late ones up to a bound."""
    return stream.withWatermark("published_at", late).groupBy("tenant_id", F.window("published_at", "1 hour")).agg(F.count("*").alias("messages")).select("tenant_id", F.col("window.start").alias("hour"), "messages")


def push(stream: DataFrame, send: Callable[[list[dict]], list[int | None]], outcomes: Callable[[DataFrame], None], checkpoint: str):
    """A push sink: each micro-batch is sent from its partitions and the statuses go to `outcomes`.

    send takes a list of messages and returns a status, or null, for each. A batch that is
    run again sends again: delivery is at least once.
    """

    def deliver(batch: DataFrame, batch_id: int) -> None:
        names = batch.columns

        def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in parts:
                status = send(pdf[names].to_dict("records"))
                yield pd.DataFrame({"message_id": pdf["message_id"], "batch_id": batch_id, "status": pd.array(status, "Int64")})

        outcomes(batch.mapInPandas(work, "message_id long, batch_id long, status long"))

    return stream.writeStream.foreachBatch(deliver).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
