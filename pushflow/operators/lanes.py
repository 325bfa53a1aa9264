"""Dispatch lanes: order, rate windows, parallelism, fairness."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pushflow.operators.walk import walked


def lane_order(rows: DataFrame) -> DataFrame:
    """Place of each waiting message in its lane: live before backfill, high priority first, then offset."""
    order = Window.partitionBy("owner", "flow_key").orderBy("backfill", F.desc("priority"), "log_offset", "message_id")
    return rows.withColumn("place", F.row_number().over(order).cast("long"))


def rate_window_admit(rows: DataFrame, lane: str, rate: int, period_ms: int) -> DataFrame:
    """rows(lane, at_ms, message_id): whether a token is free at each instant.

    A window begins at the first admission after the last one has run out.
    """
    if rate == 0:
        return rows.select(lane, "message_id", F.lit(True).alias("admitted"))

    def step(state: list, at: int) -> bool:
        if state[0] is None or at - state[0] >= period_ms:
            state[:] = [at, 0]
        admitted = state[1] < rate
        state[1] += admitted
        return admitted

    return walked(rows, lane, ["at_ms", "message_id"], ["at_ms"], lambda: [None, 0], step, ["message_id"], "admitted boolean")


def rate_window_start(rows: DataFrame, lane: str, rate: int, period_ms: int) -> DataFrame:
    """When each message starts if a denied one waits for the next window, one priority for all."""

    def step(state: list, at: int) -> int:
        anchor, used, last = state
        at = max(at, last)
        if anchor is None or at - anchor >= period_ms:
            state[:] = [at, 1, at]
        elif used < rate:
            state[:] = [anchor, used + 1, at]
        else:
            state[:] = [anchor + period_ms, 1, anchor + period_ms]
        return state[2]

    return walked(rows, lane, ["at_ms", "message_id"], ["at_ms"], lambda: [None, 0, 0], step, ["message_id"], "start_ms long")


def serial_starts(rows: DataFrame, lane: str) -> DataFrame:
    """One at a time: rows(lane, at_ms, message_id, service_ms) to start_ms.

    start = max over earlier arrivals of (arrival + work since then): a running maximum of
    arrival less the work before it, plus that work.
    """
    order = Window.partitionBy(lane).orderBy("at_ms", "message_id")
    before = F.sum("service_ms").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("service_ms")
    rows = rows.withColumn("_before", before)
    peak = F.max(F.col("at_ms") - F.col("_before")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("start_ms", peak + F.col("_before")).drop("_before")


def parallel_starts(rows: DataFrame, lane: str, parallelism: int) -> DataFrame:
    """At most so many in flight in a lane; of those that have arrived the highest priority starts first.

    rows(lane, at_ms, priority, message_id, service_ms). A discrete-event walk of one lane
    at a time, over Arrow batches.
    """
    import heapq

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        jobs = sorted(pdf[["at_ms", "priority", "message_id", "service_ms"]].itertuples(index=False, name=None))
        busy: list[int] = []
        waiting: list[tuple] = []
        out, i, now = [], 0, 0
        while i < len(jobs) or waiting:
            if not waiting:
                now = max(now, jobs[i][0])
            if len(busy) >= parallelism:
                now = max(now, heapq.heappop(busy))
            while i < len(jobs) and jobs[i][0] <= now:
                at, priority, message, service = jobs[i]
                heapq.heappush(waiting, (-priority, message, service))
                i += 1
            if waiting:
                _, message, service = heapq.heappop(waiting)
                out.append((pdf[lane].iloc[0], message, now))
                heapq.heappush(busy, now + service)
        return pd.DataFrame(out, columns=[lane, "message_id", "start_ms"])

    kind = rows.schema[lane].dataType.simpleString()
    return rows.groupBy(lane).applyInPandas(walk, f"{lane} {kind}, message_id long, start_ms long")


def fair_score(rows: DataFrame, lane: str) -> DataFrame:
    """Virtual time of a lane's nth call with weight w."""
    nth = F.row_number().over(Window.partitionBy(lane).orderBy("message_id"))
    return rows.withColumn("score", ((nth - 1) * F.floor(F.lit(1000) / F.col("weight"))).cast("long"))


def lane_info(rows: DataFrame) -> DataFrame:
    """Waiting and active messages of each lane; limits are part of a lane, so changed limits are a lane of their own."""
    return rows.groupBy("owner", "flow_key", "parallelism", "rate").agg(F.count_if("waiting").alias("waiting"), F.count_if(~F.col("waiting")).alias("active"))


def control_replay(events: DataFrame) -> DataFrame:
    """events(lane, seq, action, limit): a lane's state after all of its control events.

    pause, resume, pin (with a limit), unpin, reset_rate; unpin brings the lane's own limit back.
    """

    last = lambda wanted, value: F.max_by(F.when(F.col("action").isin(*wanted), value), F.when(F.col("action").isin(*wanted), F.col("seq")))
    return events.groupBy("lane").agg(
        F.coalesce(last(("pause", "resume"), F.col("action") == "pause"), F.lit(False)).alias("paused"),
        last(("pin", "unpin"), F.when(F.col("action") == "pin", F.col("limit"))).alias("pinned_limit"),
        F.max(F.when(F.col("action") == "reset_rate", F.col("seq"))).alias("rate_reset_at"),
    )
