"""Delayed and recurring messages on a logical clock."""

from __future__ import annotations

from datetime import UTC, datetime, timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def delayed_release(rows: DataFrame, now_ms: Column) -> DataFrame:
    """rows(deliver_at_ms): those that are due."""
    return rows.where(F.col("deliver_at_ms") <= now_ms)


def delayed_order(rows: DataFrame) -> DataFrame:
    """rows(message_id, deliver_at_ms): the place of every row in order of delivery, from 1 on; message_id breaks ties.

    A range-partitioned sort, whose partitions are counted and then numbered each from its own offset.
    """
    order = rows.orderBy("deliver_at_ms", "message_id").select("message_id").rdd.zipWithIndex()
    return rows.sparkSession.createDataFrame(order.map(lambda x: (x[0][0], x[1] + 1)), "message_id long, place long")


def _next_from(jobs: DataFrame, now_ms: int, which: Column) -> DataFrame:
    """jobs(job, expression, every_seconds, next_run_ms, ..): the next run after now of those that `which` marks."""
    cron = jobs.where(which & F.col("every_seconds").isNull()).select("job", "expression", F.lit(now_ms).alias("after_ms"))
    found = next_runs(cron).select("job", F.col("next_run_ms").alias("_cron"))
    every = F.lit(now_ms) + F.col("every_seconds") * 1000
    return jobs.join(found, "job", "left").withColumn("next_run_ms", F.when(which, F.coalesce(every, "_cron")).otherwise(F.col("next_run_ms"))).drop("_cron")


def tick(jobs: DataFrame, now_ms: int) -> DataFrame:
    """jobs(job, expression, every_seconds, next_run_ms, paused): due ones fire once, whatever they missed, and go on from now."""
    due = ~F.col("paused") & (F.col("next_run_ms") <= now_ms)
    return _next_from(jobs.withColumn("fired", due), now_ms, F.col("fired"))


def resume(jobs: DataFrame, now_ms: int) -> DataFrame:
    """Paused jobs go on, from now; what they missed is not made up for."""
    return _next_from(jobs, now_ms, F.col("paused")).withColumn("paused", F.lit(False))


def valid_schedule(expression: Column, every_seconds: Column) -> Column:
    """Exactly one of a cron expression and an interval of a second or more."""
    cron = F.coalesce(F.trim(expression) != "", F.lit(False))
    return F.when(cron & every_seconds.isNull(), True).when(~cron & (every_seconds >= 1), True).otherwise(False)


_DAYS = {d: i for i, d in enumerate(("sun", "mon", "tue", "wed", "thu", "fri", "sat"))}
_MONTHS = {m: i + 1 for i, m in enumerate(("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"))}


def _field(text: str, low: int, high: int, names: dict[str, int]) -> set[int]:
    out: set[int] = set()
    for part in text.lower().split(","):
        span, _, step = part.partition("/")
        a, _, b = span.partition("-")
        number = lambda x: names[x] if x in names else int(x)
        first, last = (low, high) if a in ("*", "?") else (number(a), number(b) if b else (high if step else number(a)))
        out.update(range(first, last + 1, int(step or 1)))
    return out


def cron_next(expression: str, after_ms: int, years: int = 5) -> int | None:
    """First match strictly after an instant, in UTC; all fields must match; days of the week count from Sunday, 0.

    None for an expression that is not valid or has no match within the next years.
    """
    fields = expression.split()
    fields = ["0", *fields] if len(fields) == 5 else fields
    if len(fields) not in (6, 7):
        return None
    try:
        sec, minute, hour, day, month = (_field(f, lo, hi, names) for f, lo, hi, names in zip(fields, (0, 0, 0, 1, 1), (59, 59, 23, 31, 12), ({}, {}, {}, {}, _MONTHS), strict=False))
        week = {d % 7 for d in _field(fields[5], 0, 6, _DAYS)}
    except (KeyError, ValueError):
        return None
    at = datetime.fromtimestamp(after_ms // 1000, UTC) + timedelta(seconds=1)
    end = at + timedelta(days=366 * years)
    while at < end:
        if at.month not in month or at.day not in day or (at.weekday() + 1) % 7 not in week:
            at = datetime(at.year, at.month, at.day, tzinfo=UTC) + timedelta(days=1)
        elif at.hour not in hour:
            at = at.replace(minute=0, second=0) + timedelta(hours=1)
        elif at.minute not in minute:
            at = at.replace(second=0) + timedelta(minutes=1)
        elif at.second not in sec:
            at += timedelta(seconds=1)
        else:
            return int(at.timestamp()) * 1000
    return None


def next_runs(jobs: DataFrame) -> DataFrame:
    """jobs(expression, after_ms) with next_run_ms, by Arrow batches."""

    def work(batches):
        for pdf in batches:
            yield pdf.assign(next_run_ms=pd.array([cron_next(e, int(a)) for e, a in zip(pdf["expression"], pdf["after_ms"], strict=True)], "Int64"))

    return jobs.mapInPandas(work, jobs.withColumn("next_run_ms", F.lit(None).cast("long")).schema)
