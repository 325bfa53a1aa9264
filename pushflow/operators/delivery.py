"""Attempts, retries, outcomes and dead letters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pushflow.functions import scalars as S


def retry_timeline(rows: DataFrame, kind: str = "exponential", initial: int = 500, most: int = 30_000, multiplier: float = 2.0) -> DataFrame:
    """rows(message_id, max_retries): each attempt's delay before it and the time since the first."""
    tries = rows.select("message_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("max_retries"))).alias("attempt"))
    delay = F.when(F.col("attempt") == 0, F.lit(0).cast("long")).otherwise(S.backoff_ms(F.lit(kind), F.lit(initial), F.lit(most), F.lit(multiplier), F.col("attempt")))
    order = Window.partitionBy("message_id").orderBy("attempt").rowsBetween(Window.unboundedPreceding, 0)
    return tries.withColumn("delay_ms", delay).withColumn("at_ms", F.sum("delay_ms").over(order))


def outcomes(rows: DataFrame, attempts: DataFrame) -> DataFrame:
    """rows(message_id, topic, max_retries) with outcome, status and number of attempts.

    The first attempt with a 2xx or a permanent status ends delivery; without one the last
    allowed attempt sends the message to its dead-letter topic.
    """
    tried = attempts.join(rows.select("message_id", "topic", "max_retries"), "message_id").where(F.col("attempt") <= F.col("max_retries"))
    delivered = F.col("status").between(200, 299)
    final = delivered | F.col("status").isin(*S.PERMANENT) | (F.col("attempt") == F.col("max_retries"))
    kind = F.when(delivered, "delivered").when(F.col("status").isin(*S.PERMANENT), "rejected").otherwise("exhausted")
    ends = tried.where(F.coalesce(final, F.col("attempt") == F.col("max_retries")))
    return ends.groupBy("message_id", "topic").agg(F.min_by(F.struct(F.coalesce(kind, F.lit("exhausted")).alias("outcome"), "status", (F.col("attempt") + 1).alias("attempts")), "attempt").alias("_e")).select("message_id", "topic", "_e.*")


def dead_letters(outcome: DataFrame, rows: DataFrame, queues: DataFrame) -> DataFrame:
    """A record in the dead-letter topic for each undelivered message; the original id is its routing key."""
    failed = outcome.where("outcome <> 'delivered'").select("message_id", "outcome")
    own = F.broadcast(queues.select("topic", "url"))
    return failed.join(rows.select("message_id", "topic", "payload"), "message_id").join(own, "topic", "left").select(
        S.dlq_topic(F.col("topic")).alias("dlq_topic"),
        F.col("message_id").cast("string").alias("routing_key"),
        F.to_json(F.struct(F.col("topic").alias("source_queue"), F.col("message_id"), F.col("url").alias("destination_url"), F.lit("POST").alias("method"), F.col("payload").alias("body"))).alias("body"),
        "message_id",
    )


def blocked_filter(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """Messages whose host is not blocked at their time; the others are deferred."""
    keyed = rows.withColumn("host", S.host_key(F.col("url")))
    # hosts grow with the data: Spark picks the join by their size
    joined = keyed.join(blocks.groupBy("host").agg(F.max("until_ms").alias("until_ms")), "host", "left")
    return joined.withColumn("deferred", F.coalesce(F.col("until_ms") > F.col("published_at_ms"), F.lit(False))).drop("until_ms")


def breaker(events: DataFrame, threshold: int = 3, cooldown: int = 30_000, growth: int = 2, most: int = 900_000) -> DataFrame:
    """events(host, at_ms, event_id, failed): after each event, whether the host is blocked and until when.

    At the threshold and at every failure beyond it the host is blocked and its cooldown grows;
    a success clears all. Successes cut a host's events into runs, and a failure's place in its
    run gives its cooldown: two running sums over one sort, and no state.
    """
    order = Window.partitionBy("host").orderBy("at_ms", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    in_run = Window.partitionBy("host", "_run").orderBy("at_ms", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = events.withColumn("_run", F.count_if(~F.col("failed")).over(order)).withColumn("_failures", F.count_if("failed").over(in_run))
    wait = F.least(F.lit(cooldown) * F.pow(F.lit(float(growth)), F.col("_failures") - threshold), F.lit(float(most))).cast("long")
    until = F.when(F.col("failed") & (F.col("_failures") >= threshold), F.col("at_ms") + wait).otherwise(F.lit(0).cast("long"))
    return rows.withColumn("until_ms", until).select("host", "event_id", (F.col("until_ms") > F.col("at_ms")).alias("blocked"), "until_ms")


#: Shortest manual block.
LEAST_BLOCK_MS = 1_000


def manual_blocks(commands: DataFrame, now_ms: Column) -> DataFrame:
    """commands(host, at_ms, command_id, action, duration_ms): hosts blocked at now and for how much longer.

    A host is a URL or its key. The last command of a host counts: block, or unblock.
    """
    key = F.when(F.col("host").contains("://"), F.coalesce(S.host_key(F.col("host")), F.trim("host"))).otherwise(F.trim("host"))
    last = commands.withColumn("host", key).groupBy("host").agg(F.max_by(F.struct("action", "at_ms", "duration_ms"), F.struct("at_ms", "command_id")).alias("_c"))
    left = F.col("_c.at_ms") + F.greatest("_c.duration_ms", F.lit(LEAST_BLOCK_MS)) - now_ms
    return last.where((F.col("_c.action") == "block") & (left > 0)).select("host", left.cast("long").alias("remaining_ms"))
