"""Reports on the log and its dead letters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pushflow.functions import scalars as S

#: Count at which a topic's dead letters are reported as that many.
DLQ_CAP = 10_000


def dlq_candidates(queues: DataFrame, members: DataFrame, stored: DataFrame) -> DataFrame:
    """Dead-letter topics that can exist: direct, each queue's, each member's, and what is stored."""
    spark = queues.sparkSession
    direct = spark.range(1).select(F.lit(S.DIRECT + S.DLQ).alias("dlq_topic"))
    own = queues.select(S.dlq_topic(F.col("topic")).alias("dlq_topic"))
    of_members = members.select(S.group_topic(F.col("group_id"), F.col("member_id")).alias("dlq_topic"))
    return direct.union(own).union(of_members).union(stored.select("dlq_topic")).distinct()


def dlq_sources(candidates: DataFrame, letters: DataFrame, groups: DataFrame) -> DataFrame:
    """Capped count, kind, label and queue of every candidate, those without letters too; most letters first, then by label."""
    counts = letters.groupBy("dlq_topic").agg(F.count("*").alias("n"))
    topic, kind = F.col("dlq_topic"), S.source_kind(F.col("dlq_topic"))
    queue = F.when(kind == "direct", S.DIRECT).when(kind == "queue", F.regexp_replace(topic, r"\.__dlq$", ""))
    ids = F.split(F.regexp_extract(topic, r"^__group\.(.*)\.__dlq$", 1), r"\.", 2)
    names = groups.select(F.col("group_id").cast("string").alias("_group"), F.col("name").alias("_name"))
    rows = candidates.join(counts, "dlq_topic", "left").withColumn("_group", F.get(ids, F.lit(0))).withColumn("_member", F.get(ids, F.lit(1))).join(names, "_group", "left")
    label = F.when(kind == "direct", "Direct publish").when(kind == "group_member", F.concat(F.lit("Group "), F.coalesce("_name", "_group"), F.lit(" → "), "_member")).when(kind == "queue", F.concat(F.lit("Queue: "), queue)).otherwise(topic)
    count = F.least(F.coalesce("n", F.lit(0)), F.lit(DLQ_CAP)).cast("long")
    return rows.select("dlq_topic", kind.alias("kind"), label.alias("label"), queue.alias("queue"), count.alias("count")).orderBy(F.desc("count"), "label")


def dlq_list(letters: DataFrame, topic: str, limit: int = 10) -> DataFrame:
    """The first letters of a topic in log order, with fields of their body."""
    rows = letters.where(F.col("dlq_topic") == topic).orderBy("partition", "log_offset").limit(limit)
    field = lambda name: F.get_json_object("body", f"$.{name}")
    return rows.select("partition", "log_offset", F.col("routing_key").alias("original_message_id"), field("source_queue").alias("source_queue"), field("destination_url").alias("destination_url"))


def dashboard(sources: DataFrame, scheduled: DataFrame) -> DataFrame:
    totals = sources.agg(F.sum("count").cast("long").alias("dead_letters"), F.count_if(F.col("count") > 0).alias("sources"))
    return totals.join(F.broadcast(scheduled.agg(F.count("*").alias("scheduled"))))


def ingest_hourly(rows: DataFrame) -> DataFrame:
    hour = (F.col("published_at_ms") - F.col("published_at_ms") % 3_600_000).alias("hour_ms")
    return rows.groupBy("tenant_id", hour).agg(F.count("*").alias("messages"), F.sum(F.octet_length("payload")).cast("long").alias("bytes"))


def metrics(blocked: DataFrame, nodes: DataFrame, log: DataFrame) -> DataFrame:
    """One row: blocked hosts, nodes that are alive, and stored messages."""
    each = [blocked.agg(F.count("*").alias("blocked_hosts")), nodes.agg(F.count_if("alive").alias("healthy_peers")), log.agg(F.count("*").alias("stored_messages"))]
    return each[0].join(F.broadcast(each[1])).join(F.broadcast(each[2]))
