"""The partitioned log: acceptance, offsets, scans, purges, cursors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pushflow.functions import scalars as S


def accept(requests: DataFrame) -> DataFrame:
    """First writer of an idempotency key wins, whatever the topic; duplicates point at the winner.

    The first of each key is a minimum, combined before the shuffle, and joined back, so that a
    key of very many requests is no task of its own. Requests without a key never meet.
    """
    keyed = requests.where("idempotency_key is not null")
    first = keyed.groupBy("tenant_id", "idempotency_key").agg(F.min("message_id").alias("original_id"))
    rows = keyed.join(first, ["tenant_id", "idempotency_key"]).select(*requests.columns, "original_id")
    alone = requests.where("idempotency_key is null").withColumn("original_id", F.col("message_id"))
    return rows.unionByName(alone).withColumn("duplicate", F.col("message_id") != F.col("original_id"))


def accepted(requests: DataFrame) -> DataFrame:
    return accept(requests).where("not duplicate").drop("duplicate", "original_id")


def assign_offsets(rows: DataFrame) -> DataFrame:
    """Dense offsets of each partition in order of acceptance."""
    order = Window.partitionBy("topic", "partition").orderBy("message_id")
    return rows.withColumn("log_offset", (F.row_number().over(order) - 1).cast("long"))


def read_range(log: DataFrame, purged: DataFrame, topic: str, partition: int, start: int, most: int) -> DataFrame:
    """Visible records of one partition from an offset on, at most so many."""
    own = log.where((F.col("topic") == topic) & (F.col("partition") == partition) & (F.col("log_offset") >= start))
    return visible(own, purged).orderBy("log_offset").limit(most)


def visible(log: DataFrame, purged: DataFrame) -> DataFrame:
    return log.join(purged.select("topic", "partition", "log_offset"), ["topic", "partition", "log_offset"], "left_anti")


def scan_topic(log: DataFrame, purged: DataFrame, topic: str, most: int) -> DataFrame:
    return visible(log.where(F.col("topic") == topic), purged).orderBy("partition", "log_offset").limit(most)


def high_watermark(log: DataFrame) -> DataFrame:
    """Next offset of each partition; purged records count."""
    return log.groupBy("topic", "partition").agg((F.max("log_offset") + 1).alias("next_offset"))


def recover(frames: DataFrame) -> DataFrame:
    """Records of a file up to its first bad frame, with offsets by position over files in order."""
    within = Window.partitionBy("topic", "partition", "file_no").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    good = frames.withColumn("_ok", F.min(F.col("ok").cast("int")).over(within)).where("_ok = 1").drop("_ok")
    return good.withColumn("log_offset", (F.row_number().over(Window.partitionBy("topic", "partition").orderBy("file_no", "pos")) - 1).cast("long"))


#: Offsets beyond the stored one in which recovery looks for records.
RECOVERED = 4096


def recover_next(log: DataFrame, stored: DataFrame) -> DataFrame:
    """stored(topic, partition, next_offset): the next offset of each partition of the log.

    The stored one (0 where there is none), or one past the last record below it or in the
    RECOVERED offsets from it on, which were written after it was stored.
    """
    start = F.coalesce("next_offset", F.lit(0).cast("long"))
    rows = log.join(stored.select("topic", "partition", "next_offset"), ["topic", "partition"], "left")
    last = F.max(F.when(F.col("log_offset") < start + RECOVERED, F.col("log_offset")))
    return rows.groupBy("topic", "partition").agg(F.greatest(F.max(start), F.coalesce(last + 1, F.lit(0).cast("long"))).alias("next_offset"))


def dispatch_cursor(acks: DataFrame, stored: DataFrame) -> DataFrame:
    """acks(owner, partition, log_offset), stored(owner, partition, cursor): the cursors after the acks.

    A cursor goes on from where it stands (0 where nothing is stored) over the unbroken run of
    acknowledged offsets; acks before it change nothing.
    """
    keys = ["owner", "partition"]
    rows = acks.select(*keys, "log_offset").distinct().join(stored, keys, "left").withColumn("_from", F.coalesce("cursor", F.lit(0).cast("long"))).where(F.col("log_offset") >= F.col("_from"))
    order = Window.partitionBy(*keys).orderBy("log_offset")
    runs = rows.withColumn("_rn", F.row_number().over(order) - 1)
    moved = runs.groupBy(*keys).agg(F.coalesce(F.max(F.when(F.col("log_offset") - F.col("_from") == F.col("_rn"), F.col("log_offset"))) + 1, F.max("_from")).cast("long").alias("_now"))
    known = stored.select(*keys, "cursor").unionByName(acks.select(*keys).distinct().withColumn("cursor", F.lit(0).cast("long"))).groupBy(*keys).agg(F.max("cursor").alias("cursor"))
    return known.join(moved, keys, "left").select(*keys, F.coalesce("_now", "cursor").alias("cursor"))


def purge_after_delivery(acks: DataFrame) -> DataFrame:
    """acks(owner, partition, log_offset, ack_seq, url): which ack's record is purged.

    The cursor of an owner after an ack is the smallest offset not yet acknowledged: the offset o
    is reached when all offsets up to o are, so at the largest ack_seq among them. A record with a
    url and an owner is purged if the cursor has passed it at its own ack, that is if it closes its
    prefix; one without owner or url is purged at once.
    """
    upto = Window.partitionBy("owner", "partition").orderBy("log_offset").rowsBetween(Window.unboundedPreceding, 0)
    held = F.col("owner").isNotNull() & (F.coalesce("url", F.lit("")) != "")
    owned = acks.where("owner is not null").withColumn("purged", ~held | (F.col("ack_seq") == F.max("ack_seq").over(upto)))
    return owned.unionByName(acks.where("owner is null").withColumn("purged", F.lit(True)))


def no_destination(rows: DataFrame) -> DataFrame:
    """Records that are purged undelivered: their destination url is empty or missing."""
    return rows.where(F.coalesce("url", F.lit("")) == "")


def backfill(log: DataFrame, cursors: DataFrame, topics: DataFrame, most: int | None = 50_000) -> DataFrame:
    """log(topic, partition, log_offset, url, owner, ..): what a restart puts back into the lanes.

    Of each queue's topic and the direct one, but no dead-letter topic, the first `most` records
    are listed, or all for None; of these, records with a url at or behind their owner's cursor are taken.
    """
    own = topics.select("topic").union(topics.sparkSession.range(1).select(F.lit(S.DIRECT))).distinct()
    listed = log.where(~S.is_dlq(F.col("topic"))).join(own, "topic", "left_semi")
    if most is not None:
        order = Window.partitionBy("topic").orderBy("partition", "log_offset")
        listed = listed.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).drop("_n")
    rows = listed.join(cursors, ["owner", "partition"], "left").where(F.col("log_offset") >= F.coalesce("cursor", F.lit(0)))
    return rows.where(F.coalesce("url", F.lit("")) != "").drop("cursor")


def split_blobs(rows: DataFrame, limit: int) -> DataFrame:
    """Payloads over the limit leave a reference; inline bytes are then empty."""
    large = F.octet_length("payload") > limit
    return rows.select(
        "message_id",
        F.when(large, F.lit("")).otherwise(F.col("payload")).alias("inline"),
        F.when(large, F.concat_ws("/", F.lit("payloads"), "tenant_id", F.col("message_id").cast("string"))).alias("blob_key"),
        F.when(large, F.octet_length("payload").cast("long")).alias("blob_bytes"),
        F.when(large, F.sha2(F.col("payload").cast("binary"), 256)).alias("sha256"),
    )


def hydrate(rows: DataFrame, blobs: DataFrame) -> DataFrame:
    """Loads referenced payloads; `intact` says whether the digest fits."""
    joined = rows.join(blobs.select("blob_key", "body"), "blob_key", "left")
    body = F.when(F.col("blob_key").isNull(), F.col("inline")).otherwise(F.col("body"))
    return joined.select("message_id", body.alias("payload"), F.when(F.col("blob_key").isNull(), True).otherwise(F.coalesce(F.sha2(F.col("body").cast("binary"), 256) == F.col("sha256"), F.lit(False))).alias("intact"))
