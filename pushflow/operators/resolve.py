"""From publish requests to resolved messages: destinations, policies, fan-out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pushflow.functions import scalars as S

#: Retry default of the broker itself.
BROKER_RETRIES = 3
BROKER_BACKOFF = "exponential"
DEFAULT_PARALLELISM = 4


def resolve_destination(requests: DataFrame, queues: DataFrame) -> DataFrame:
    """requests(topic, url, secret, snapshot_queue, has_snapshot) get dest_topic, dest_queue, error.

    In order: a dead-letter topic has no destination; a snapshot names its queue's topic, or
    the direct topic; url and secret together are direct; else a queue by id, then by name.
    """
    by_id = F.broadcast(queues.select(F.col("queue_id").alias("_id"), F.col("topic").alias("_id_topic")))
    by_name = F.broadcast(queues.select(F.col("topic").alias("_name"), F.col("queue_id").alias("_name_id")))
    snap = F.broadcast(queues.select(F.col("queue_id").alias("_snap"), F.col("topic").alias("_snap_topic")))
    rows = requests.join(by_id, F.col("queue_ref") == F.col("_id"), "left").join(by_name, F.col("topic") == F.col("_name"), "left").join(snap, F.col("snapshot_queue") == F.col("_snap"), "left")
    direct = F.col("url").isNotNull() & F.col("secret").isNotNull()
    topic = (
        F.when(S.is_dlq(F.col("topic")), F.col("topic"))
        .when(F.col("has_snapshot"), F.coalesce("_snap_topic", F.lit(S.DIRECT)))
        .when(direct, F.lit(S.DIRECT))
        .otherwise(F.coalesce("_id_topic", "_name"))
    )
    queue = F.when(S.is_dlq(F.col("topic")), None).when(F.col("has_snapshot"), F.col("_snap")).when(direct, None).otherwise(F.coalesce("_id", "_name_id"))
    return rows.withColumn("dest_topic", topic).withColumn("dest_queue", queue).withColumn("error", topic.isNull()).drop("_id", "_id_topic", "_name", "_name_id", "_snap", "_snap_topic")


def snapshot_destination(requests: DataFrame, versions: DataFrame) -> DataFrame:
    """The catalogue version in force when a request was accepted: the latest valid_from at or before it.

    A union of both sides ordered by time, and the last version carried forward: one shuffle
    by key and no range join.
    """
    cols = [c for c in versions.columns if c not in ("id", "valid_from")]
    left = requests.select("*", F.lit(1).alias("_side"), F.col("accepted_at").alias("_at"), *(F.lit(None).cast(versions.schema[c].dataType).alias(c) for c in cols))
    right = versions.select(*(F.lit(None).cast(f.dataType).alias(f.name) if f.name != "id" else F.col("id") for f in requests.schema), F.lit(0).alias("_side"), F.col("valid_from").alias("_at"), *cols)
    latest = Window.partitionBy("id").orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    rows = left.unionByName(right).withColumns({c: F.last(F.when(F.col("_side") == 0, F.struct(c)), ignorenulls=True).over(latest).getField(c) for c in cols})
    return rows.where("_side = 1").drop("_side", "_at")


def resolve_retry(requests: DataFrame, queues: DataFrame) -> DataFrame:
    """Request, then queue, then broker default: for the retries, and for the backoff where requests and queues have one."""
    backoff = "retry_backoff_in" in requests.columns
    own = F.broadcast(queues.select("topic", "default_max_retries", *(["retry_backoff"] if backoff else [])))
    rows = requests.join(own, "topic", "left").withColumn("max_retries", F.coalesce("max_retries_in", "default_max_retries", F.lit(BROKER_RETRIES)).cast("long")).drop("default_max_retries")
    return rows.withColumn("retry_backoff", F.coalesce("retry_backoff_in", "retry_backoff", F.lit(BROKER_BACKOFF))) if backoff else rows


def resolve_flow_limits(requests: DataFrame) -> DataFrame:
    """Limits of the lane, from rows(routing_key, flow_controlled, *_in).

    Given limits count where any is given. Without any, a message under flow control goes one at a
    time, and one outside it has the defaults. Without a key of its own a lane has the message's.
    """
    inline = F.col("flow_key_in").isNotNull() | F.col("parallelism_in").isNotNull() | F.col("rate_in").isNotNull()
    pick = lambda given, default, least: F.greatest(F.coalesce(F.when(inline, given), default), F.lit(least)).cast("long")
    alone = F.when(~inline & F.col("flow_controlled"), 1).otherwise(DEFAULT_PARALLELISM)
    return requests.withColumns(
        {
            "flow_key": F.coalesce("flow_key_in", "routing_key"),
            "parallelism": pick(F.col("parallelism_in"), alone, 1),
            "rate": pick(F.col("rate_in"), F.lit(0), 0),
            "period_secs": pick(F.col("period_in"), F.lit(1), 1),
        }
    )


def lane_owner(rows: DataFrame) -> DataFrame:
    return rows.withColumn("owner", F.coalesce(F.col("member_id").cast("string"), F.col("queue_id"), F.col("profile_id"), F.col("message_id").cast("string")))


def uses_flow_control(rows: DataFrame) -> DataFrame:
    told = [F.col(c).isNotNull() for c in ("member_id", "queue_id", "profile_id", "flow_key_in", "parallelism_in", "rate_in")]
    any_ = told[0]
    for t in told[1:]:
        any_ = any_ | t
    return rows.withColumn("flow_controlled", any_)


def merge_http_spec(rows: DataFrame) -> DataFrame:
    """Top-level values override nested ones, headers name by name; a blank method does not count; POST, unsigned by default."""
    if {"header_map", "request_headers"} <= set(rows.columns):
        none = F.create_map().cast("map<string,string>")
        given = F.coalesce("header_map", none)
        nested = F.map_filter(F.coalesce("request_headers", none), lambda k, _: ~F.map_contains_key(given, k))
        rows = rows.withColumn("header_map", F.map_concat(nested, given)).drop("request_headers")
    clean = lambda c: F.nullif(F.upper(F.trim(c)), F.lit(""))
    return rows.withColumn("http_method", F.coalesce(clean(F.col("method")), clean(F.col("request_method")), F.lit("POST"))).withColumn("signed", F.coalesce("sign", "request_sign", F.lit(False)))


#: Methods that have no body, and those that are known; another one is a POST.
BODILESS, METHODS = ("GET", "HEAD"), ("GET", "HEAD", "POST", "PUT", "PATCH", "DELETE", "OPTIONS")


def outbound(rows: DataFrame) -> DataFrame:
    """rows(http_method, payload, ..) as they are pushed: GET and HEAD carry no body."""
    method = F.when(F.col("http_method").isin(*METHODS), F.col("http_method")).otherwise("POST")
    return rows.withColumn("http_method", method).withColumn("body", F.when(~F.col("http_method").isin(*BODILESS), F.col("payload"))).drop("payload")


def not_paused(rows: DataFrame, queues: DataFrame, members: DataFrame) -> DataFrame:
    """rows(topic, member_id, ..) of queues and members that are not paused."""
    still = queues.where("paused").select("topic")
    quiet = members.where("paused").select("member_id")
    return rows.join(F.broadcast(still), "topic", "left_anti").join(F.broadcast(quiet), "member_id", "left_anti").select(rows.columns)


def parse_headers(rows: DataFrame) -> DataFrame:
    """headers as JSON, an object or an array of pairs or "K: v" lines, to rows (.., name, value); the last of equal names counts."""
    text = F.trim("headers")
    as_map = F.map_entries(F.from_json(text, "map<string,string>"))
    items = F.from_json(text, "array<string>")

    def pair(x):
        own = F.from_json(x, "array<string>")
        line = F.split(x, ":", 2)
        return F.when(x.startswith("["), F.struct(F.get(own, F.lit(0)).alias("key"), F.get(own, F.lit(1)).alias("value"))).otherwise(F.struct(F.trim(F.get(line, F.lit(0))).alias("key"), F.trim(F.get(line, F.lit(1))).alias("value")))

    found = F.when(text.startswith("{"), F.transform(as_map, lambda x: F.struct(x.key.alias("key"), x.value.alias("value")))).otherwise(F.transform(items, pair))
    # of a name that comes again the last one counts
    found = F.filter(found, lambda x, i: ~F.exists(F.slice(found, i + 2, F.size(found)), lambda y: y.key == x.key))
    return rows.select("*", F.explode(found).alias("_h")).select(*rows.columns, F.col("_h.key").alias("name"), F.col("_h.value").alias("value"))


def group_fanout(requests: DataFrame, groups: DataFrame, members: DataFrame) -> DataFrame:
    """One message for each active member of the group, with what the base request has; see fanout_errors.

    A member's lane is its own flow key, or the base's routing key where that is not empty.
    The member side is a catalogue and is broadcast by Spark's own size rule.
    """
    rows = requests.join(_active(groups, members), "group_id")
    member = F.col("member_id").cast("string")
    base = F.nullif(F.coalesce("routing_key", F.lit("")), F.lit(""))
    carried = [c for c in ("payload", "priority_in", "max_retries_in", "retry_backoff_in", "headers", "method") if c in requests.columns]
    return rows.select(
        "message_id", "group_id", "member_id",
        F.when(base.isNull(), member).otherwise(F.concat_ws(":", base, member)).alias("routing_key"),
        F.coalesce("member_flow_key", base).alias("flow_key"),
        F.when(F.col("idempotency_key").isNotNull(), F.concat_ws(":", "idempotency_key", member)).alias("idempotency_key"),
        "parallelism", "rate", "period_secs", S.group_topic(F.col("group_id")).alias("topic"), "url", *carried,
    )


def _active(groups: DataFrame, members: DataFrame) -> DataFrame:
    return members.where(~F.col("paused")).join(groups.where(~F.col("group_paused")).select("group_id"), "group_id")


def fanout_errors(requests: DataFrame, groups: DataFrame, members: DataFrame) -> DataFrame:
    """Requests to a group that has no active member, or that is not there: nobody would get them."""
    return requests.where("group_id is not null").join(_active(groups, members).select("group_id").distinct(), "group_id", "left_anti")
