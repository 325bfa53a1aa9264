"""The registered queries and, for each that SQL can express, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pushflow.functions import scalars as S
from pushflow.operators import catalog, cluster, delivery, inspect, lanes, log, resolve, schedule
from pushflow.sources import frames
from pushflow.sources import tables as T

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: Logical now of the queries that need one.
NOW = 1_700_000_000_000


def _query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = f"WITH RECURSIVE {T.CTES.strip()} {sql}" if "WITH" not in sql.split("(")[0] else sql
        return f

    return put


def _requests(spark, d):
    """Messages with references to every kind of destination."""
    i = F.col("message_id")
    m = T.messages(spark, d)
    return m.select(
        "message_id",
        F.when(i % 11 == 0, F.concat("topic", F.lit(S.DLQ))).when(i % 7 == 1, F.lit("nowhere")).otherwise(F.col("topic")).alias("topic"),
        F.when(i % 5 == 0, F.lit("https://a.example.com")).alias("url"),
        F.when(i % 10 == 0, F.lit("s")).alias("secret"),
        F.when(i % 13 == 0, F.lit("view")).alias("queue_ref"),
        F.when(i % 17 == 0, F.lit("click")).alias("snapshot_queue"),
        (i % 17 < 2).alias("has_snapshot"),
    )


_REQUESTS = """, requests AS (SELECT message_id,
  CASE WHEN message_id % 11 = 0 THEN topic || '.__dlq' WHEN message_id % 7 = 1 THEN 'nowhere' ELSE topic END AS topic,
  CASE WHEN message_id % 5 = 0 THEN 'https://a.example.com' END AS url, CASE WHEN message_id % 10 = 0 THEN 's' END AS secret,
  CASE WHEN message_id % 13 = 0 THEN 'view' END AS queue_ref, CASE WHEN message_id % 17 = 0 THEN 'click' END AS snapshot_queue,
  message_id % 17 < 2 AS has_snapshot FROM messages)"""


# ---------------------------------------------------------------- log
def _log(spark, d):
    return log.assign_offsets(log.accepted(T.messages(spark, d)))


def _purged(rows):
    return rows.where(F.col("message_id") % 5 == 2).select("topic", "partition", "log_offset")


_VISIBLE = ", visible AS (SELECT * FROM log WHERE message_id % 5 <> 2)"


@_query("log_append", "SELECT topic, partition, log_offset, message_id FROM log")
def log_append(spark, d):
    return _log(spark, d).select("topic", "partition", "log_offset", "message_id")


_query("assign_offsets", "SELECT topic, partition, count(*) AS n, max(log_offset) AS last FROM log GROUP BY ALL")(lambda spark, d: _log(spark, d).groupBy("topic", "partition").agg(F.count("*").alias("n"), F.max("log_offset").alias("last")))


@_query("frame_codec", "SELECT message_id, payload FROM messages")
def frame_codec(spark, d):
    """Each payload through the frame writer and reader."""

    def work(batches):
        for pdf in batches:
            back = [next(frames.decode(frames.encode({"id": int(i)}, p.encode()))) for i, p in zip(pdf["message_id"], pdf["payload"], strict=True)]
            yield pdf.assign(message_id=[h["id"] for h, _, _ in back], payload=[b.decode() for _, b, _ in back])

    return T.messages(spark, d).select("message_id", "payload").mapInPandas(work, "message_id long, payload string")


@_query("scan_partition_range", f"{_VISIBLE} SELECT log_offset, message_id FROM visible WHERE topic = 'view' AND partition = 1 AND log_offset >= 20 ORDER BY log_offset LIMIT 50")
def scan_partition_range(spark, d):
    rows = _log(spark, d)
    return log.read_range(rows, _purged(rows), "view", 1, 20, 50).select("log_offset", "message_id")


@_query("point_read", f"{_VISIBLE} SELECT message_id, payload FROM visible WHERE topic = 'click' AND partition = 2 AND log_offset = 7")
def point_read(spark, d):
    rows = _log(spark, d)
    return log.read_range(rows, _purged(rows), "click", 2, 7, 1).where("log_offset = 7").select("message_id", "payload")


@_query("scan_topic", f"{_VISIBLE} SELECT partition, log_offset, message_id FROM visible WHERE topic = 'error' ORDER BY partition, log_offset LIMIT 100")
def scan_topic(spark, d):
    rows = _log(spark, d)
    return log.scan_topic(rows, _purged(rows), "error", 100).select("partition", "log_offset", "message_id")


@_query("limit_budget", f"{_VISIBLE} SELECT partition, count(*) AS n FROM (SELECT * FROM visible WHERE topic = 'view' ORDER BY partition, log_offset LIMIT 600) GROUP BY partition")
def limit_budget(spark, d):
    rows = _log(spark, d)
    return log.scan_topic(rows, _purged(rows), "view", 600).groupBy("partition").agg(F.count("*").alias("n"))


@_query("high_watermark", "SELECT topic, partition, max(log_offset) + 1 AS next_offset FROM log GROUP BY ALL")
def high_watermark(spark, d):
    return log.high_watermark(_log(spark, d))


_FRAMES = """, frames AS (SELECT topic, partition, message_id, message_id % 3 AS file_no, message_id AS pos, message_id % 997 <> 501 AS ok FROM messages),
 good AS (SELECT * FROM (SELECT *, min(ok::INT) OVER (PARTITION BY topic, partition, file_no ORDER BY pos) AS fine FROM frames) WHERE fine = 1)"""


@_query("scan_recovery", f"{_FRAMES} SELECT * FROM (SELECT topic, partition, message_id, row_number() OVER (PARTITION BY topic, partition ORDER BY file_no, pos) - 1 AS log_offset FROM good) WHERE log_offset % 6 <> 1")
def scan_recovery(spark, d):
    """What is found in the files, but for offsets that were purged."""
    i = F.col("message_id")
    frames = T.messages(spark, d).select("topic", "partition", "message_id", (i % 3).alias("file_no"), i.alias("pos"), (i % 997 != 501).alias("ok"))
    rows = log.recover(frames).select("topic", "partition", "message_id", "log_offset")
    return log.visible(rows, rows.where("log_offset % 6 = 1")).select("topic", "partition", "message_id", "log_offset")


@_query("append_raw_frame", "SELECT message_id, row_number() OVER (PARTITION BY topic, partition ORDER BY message_id) - 1 AS log_offset FROM log WHERE message_id % 3 <> 0")
def append_raw_frame(spark, d):
    replica = _log(spark, d).where("message_id % 3 <> 0").drop("log_offset")
    return log.assign_offsets(replica).select("message_id", "log_offset")


@_query("legacy_header_decode", "SELECT message_id, coalesce(priority_in, 5) AS priority, coalesce(max_retries_in, 3) AS max_retries, coalesce(idempotency_key, '') AS idempotency_key FROM messages")
def legacy_header_decode(spark, d):
    return T.messages(spark, d).select("message_id", F.coalesce("priority_in", F.lit(5).cast("long")).alias("priority"), F.coalesce("max_retries_in", F.lit(3).cast("long")).alias("max_retries"), F.coalesce("idempotency_key", F.lit("")).alias("idempotency_key"))


@_query("purge_offset", f"{_VISIBLE} SELECT topic, partition, log_offset FROM visible")
def purge_offset(spark, d):
    rows = _log(spark, d)
    return log.visible(rows, _purged(rows)).select("topic", "partition", "log_offset")


anti_purged = _query("anti_purged", f"{_VISIBLE} SELECT topic, count(*) AS n FROM visible GROUP BY topic")(lambda spark, d: purge_offset(spark, d).groupBy("topic").agg(F.count("*").alias("n")))


@_query("purge_guard", f"{_REQUESTS} SELECT message_id FROM requests WHERE topic NOT LIKE '%.\\_\\_dlq' ESCAPE '\\'")
def purge_guard(spark, d):
    return _requests(spark, d).where(~S.is_dlq(F.col("topic"))).select("message_id")


_BLOBS = """, blobs AS (SELECT message_id, octet_length(encode(payload)) > 9 AS large, payload, tenant_id FROM messages)"""


@_query("blob_split", f"{_BLOBS} SELECT message_id, CASE WHEN large THEN '' ELSE payload END AS inline, CASE WHEN large THEN 'payloads/' || tenant_id || '/' || message_id END AS blob_key, CASE WHEN large THEN octet_length(encode(payload))::BIGINT END AS blob_bytes, CASE WHEN large THEN sha256(payload) END AS sha256 FROM blobs")
def blob_split(spark, d):
    return log.split_blobs(T.messages(spark, d), 9)


@_query("blob_hydrate", f"{_BLOBS} SELECT message_id, CASE WHEN large AND message_id % 50 = 0 THEN 'broken' ELSE payload END AS payload, NOT (large AND message_id % 50 = 0) AS intact FROM blobs")
def blob_hydrate(spark, d):
    m = T.messages(spark, d)
    rows = log.split_blobs(m, 9)
    blobs = m.select(F.concat_ws("/", F.lit("payloads"), "tenant_id", F.col("message_id").cast("string")).alias("blob_key"), F.when(F.col("message_id") % 50 == 0, "broken").otherwise(F.col("payload")).alias("body"))
    return log.hydrate(rows, blobs)


join_blob_hydrate = _query("join_blob_hydrate", f"{_BLOBS} SELECT (NOT (large AND message_id % 50 = 0)) AS intact, count(*) AS n FROM blobs GROUP BY ALL")(lambda spark, d: blob_hydrate(spark, d).groupBy("intact").agg(F.count("*").alias("n")))
_query("blob_put", "SELECT message_id, 'payloads/default/' || message_id AS blob_key FROM messages")(lambda spark, d: T.messages(spark, d).select("message_id", F.concat_ws("/", F.lit("payloads"), "tenant_id", F.col("message_id").cast("string")).alias("blob_key")))
_STORED_NEXT = ", stored_next AS (SELECT DISTINCT topic, partition, partition * 40 AS next_offset FROM log WHERE partition < 3)"


@_query("object_store_recover", f"{_STORED_NEXT} SELECT topic, partition, greatest(coalesce(max(s.next_offset), 0), coalesce(max(log_offset) FILTER (WHERE log_offset < coalesce(s.next_offset, 0) + 4096) + 1, 0)) AS next_offset FROM log LEFT JOIN stored_next s USING (topic, partition) GROUP BY ALL")
def object_store_recover(spark, d):
    rows = _log(spark, d)
    stored = rows.where("partition < 3").select("topic", "partition", (F.col("partition") * 40).alias("next_offset")).distinct()
    return log.recover_next(rows, stored)


_query("catalog_source", "SELECT queue_id, url, default_max_retries FROM queues")(lambda spark, d: T.queues(spark, d).select("queue_id", "url", "default_max_retries"))


# ---------------------------------------------------------------- resolution
@_query("normalize_priority", "SELECT message_id, least(coalesce(priority_in, 5), 9) AS priority FROM messages")
def normalize_priority(spark, d):
    return T.messages(spark, d).select("message_id", S.priority(F.col("priority_in")).alias("priority"))


_DEST = f"""{_REQUESTS} SELECT r.message_id,
  CASE WHEN r.topic LIKE '%.\\_\\_dlq' ESCAPE '\\' THEN r.topic WHEN has_snapshot THEN coalesce(s.topic, '__direct')
    WHEN r.url IS NOT NULL AND r.secret IS NOT NULL THEN '__direct' ELSE coalesce(i.topic, n.topic) END AS dest_topic,
  CASE WHEN r.topic LIKE '%.\\_\\_dlq' ESCAPE '\\' THEN NULL WHEN has_snapshot THEN s.queue_id
    WHEN r.url IS NOT NULL AND r.secret IS NOT NULL THEN NULL ELSE coalesce(i.queue_id, n.queue_id) END AS dest_queue
  FROM requests r LEFT JOIN queues i ON r.queue_ref = i.queue_id LEFT JOIN queues n ON r.topic = n.topic LEFT JOIN queues s ON r.snapshot_queue = s.queue_id"""


@_query("resolve_destination", f"{_REQUESTS}, dest AS ({_DEST[len(_REQUESTS):]}) SELECT *, dest_topic IS NULL AS error FROM dest")
def resolve_destination(spark, d):
    return resolve.resolve_destination(_requests(spark, d), T.queues(spark, d)).select("message_id", "dest_topic", "dest_queue", "error")


@_query("join_queue_lookup", "SELECT message_id, url FROM messages LEFT JOIN queues USING (topic)")
def join_queue_lookup(spark, d):
    return T.messages(spark, d).join(F.broadcast(T.queues(spark, d).select("topic", "url")), "topic", "left").select("message_id", "url")


def _with_url(rows):
    """Some records have an empty url, and some none."""
    i = F.col("message_id")
    return rows.withColumn("url", F.when(i % 11 == 0, "").when(i % 13 != 0, F.concat(F.lit("https://"), "topic", F.lit(".example.com"))))


_query("no_destination_purge", "SELECT message_id FROM log WHERE message_id % 11 = 0 OR message_id % 13 = 0")(lambda spark, d: log.no_destination(_with_url(_log(spark, d))).select("message_id"))

_VERSIONS = ", versions AS (SELECT queue_id AS id, v * 86400000 * 40 + 1704067200000 AS valid_from, url || '/v' || v AS url FROM queues, range(1, 5) AS r(v))"


@_query("snapshot_destination", f"{_VERSIONS} SELECT message_id, (SELECT url FROM versions WHERE id = topic AND valid_from <= published_at_ms ORDER BY valid_from DESC LIMIT 1) AS url FROM messages")
def snapshot_destination(spark, d):
    v = F.col("v")
    versions = T.queues(spark, d).select("queue_id", "url", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(4).cast("long"))).alias("v"))
    versions = versions.select(F.col("queue_id").alias("id"), (v * 86_400_000 * 40 + 1_704_067_200_000).alias("valid_from"), F.concat("url", F.lit("/v"), v).alias("url"))
    requests = T.messages(spark, d).select(F.col("topic").alias("id"), "message_id", F.col("published_at_ms").alias("accepted_at"))
    return resolve.snapshot_destination(requests, versions).select("message_id", "url")


@_query("resolve_retry", "SELECT message_id, coalesce(max_retries_in, default_max_retries, 3) AS max_retries, CASE WHEN message_id % 6 = 0 THEN 'fixed' WHEN topic IN ('view', 'click') THEN 'linear' ELSE 'exponential' END AS retry_backoff FROM messages LEFT JOIN queues USING (topic)")
def resolve_retry(spark, d):
    rows = T.messages(spark, d).withColumn("retry_backoff_in", F.when(F.col("message_id") % 6 == 0, "fixed"))
    queues = T.queues(spark, d).withColumn("retry_backoff", F.when(F.col("topic").isin("view", "click"), "linear"))
    return resolve.resolve_retry(rows, queues).select("message_id", "max_retries", "retry_backoff")


def _flows(spark, d):
    return T.queues(spark, d).select(F.col("topic").alias("flow_id"), F.length("topic").cast("long").alias("parallelism"), F.lit(2).cast("long").alias("rate"))


_FLOW = "FROM messages LEFT JOIN queues q USING (topic)"


@_query("resolve_flow_spec", f"SELECT message_id, CASE WHEN flow_key_in IS NOT NULL THEN 1 WHEN message_id % 3 = 0 THEN length(topic) END::BIGINT AS parallelism {_FLOW}")
def resolve_flow_spec(spark, d):
    rows = T.messages(spark, d).withColumn("flow_id", F.when(F.col("message_id") % 3 == 0, F.col("topic")))
    rows = rows.join(F.broadcast(_flows(spark, d)), "flow_id", "left")
    return rows.select("message_id", F.when(F.col("flow_key_in").isNotNull(), F.lit(1).cast("long")).otherwise(F.col("parallelism")).alias("parallelism"))


_query("join_flow_lookup", f"SELECT message_id, length(topic)::BIGINT AS parallelism, 2::BIGINT AS rate {_FLOW}")(lambda spark, d: T.messages(spark, d).withColumnRenamed("topic", "flow_id").join(F.broadcast(catalog.keep_first(_flows(spark, d), ["flow_id"], "parallelism")), "flow_id", "left").select("message_id", "parallelism", "rate"))


def _limits(spark, d):
    i = F.col("message_id")
    return T.messages(spark, d).select("message_id", "routing_key", "flow_key_in", F.when(i % 7 == 0, i % 5).alias("parallelism_in"), F.when(i % 8 == 0, i % 3).alias("rate_in"), F.when(i % 9 == 0, i % 4).alias("period_in"))


_LIMITS = """, limits AS (SELECT message_id, routing_key, flow_key_in, CASE WHEN message_id % 7 = 0 THEN message_id % 5 END AS p, CASE WHEN message_id % 8 = 0 THEN message_id % 3 END AS r,
  CASE WHEN message_id % 9 = 0 THEN message_id % 4 END AS s FROM messages)"""


def _owned(spark, d):
    i = F.col("message_id")
    return _limits(spark, d).withColumns({"member_id": F.when(i % 6 == 0, i % 25), "queue_id": F.when(i % 4 == 1, F.lit("q")), "profile_id": F.when(i % 5 == 2, F.lit("p"))})


_OWNED = f"{_LIMITS}, owned AS (SELECT *, CASE WHEN message_id % 6 = 0 THEN message_id % 25 END AS member_id, CASE WHEN message_id % 4 = 1 THEN 'q' END AS queue_id, CASE WHEN message_id % 5 = 2 THEN 'p' END AS profile_id FROM limits)"


@_query("resolve_flow_limits", f"""{_OWNED}, flagged AS (SELECT *, flow_key_in IS NOT NULL OR p IS NOT NULL OR r IS NOT NULL AS inline, coalesce(member_id::VARCHAR, queue_id, profile_id) IS NOT NULL AS owned_by FROM owned)
  SELECT message_id, coalesce(flow_key_in, routing_key) AS flow_key, CASE WHEN inline THEN greatest(coalesce(p, 4), 1) WHEN owned_by THEN 1 ELSE 4 END AS parallelism, CASE WHEN inline THEN coalesce(r, 0) ELSE 0 END AS rate, CASE WHEN inline THEN greatest(coalesce(s, 1), 1) ELSE 1 END AS period_secs FROM flagged""")
def resolve_flow_limits(spark, d):
    return resolve.resolve_flow_limits(resolve.uses_flow_control(_owned(spark, d))).select("message_id", "flow_key", "parallelism", "rate", "period_secs")


_query("lane_owner", f"{_OWNED} SELECT message_id, coalesce(member_id::VARCHAR, queue_id, profile_id, message_id::VARCHAR) AS owner FROM owned")(lambda spark, d: resolve.lane_owner(_owned(spark, d)).select("message_id", "owner"))
_query("uses_flow_control", f"{_OWNED} SELECT message_id, coalesce(member_id::VARCHAR, queue_id, profile_id, flow_key_in, p::VARCHAR, r::VARCHAR) IS NOT NULL AS flow_controlled FROM owned")(lambda spark, d: resolve.uses_flow_control(_owned(spark, d)).select("message_id", "flow_controlled"))


@_query("merge_http_spec", """SELECT message_id, CASE WHEN message_id % 5 = 0 THEN 'PUT' WHEN message_id % 3 = 0 THEN 'GET' ELSE 'POST' END AS http_method, CASE WHEN message_id % 7 = 0 THEN message_id % 2 = 0 WHEN message_id % 4 = 0 THEN TRUE ELSE FALSE END AS signed,
  CASE WHEN message_id % 2 = 0 THEN 'given' ELSE 'nested' END AS a, CASE WHEN message_id % 3 = 0 THEN 'nested' END AS b FROM messages""")
def merge_http_spec(spark, d):
    i = F.col("message_id")
    header = lambda k, v: F.create_map(F.lit(k), F.lit(v))
    nested = F.when(i % 3 == 0, F.map_concat(header("a", "nested"), header("b", "nested"))).otherwise(header("a", "nested"))
    rows = T.messages(spark, d).select("message_id", F.when(i % 5 == 0, " put ").when(i % 5 == 1, "  ").alias("method"), F.when(i % 3 == 0, "get").alias("request_method"), F.when(i % 7 == 0, i % 2 == 0).alias("sign"), F.when(i % 4 == 0, F.lit(True)).alias("request_sign"), F.when(i % 2 == 0, header("a", "given")).alias("header_map"), nested.alias("request_headers"))
    return resolve.merge_http_spec(rows).select("message_id", "http_method", "signed", F.col("header_map")["a"].alias("a"), F.col("header_map")["b"].alias("b"))


@_query("webhook_sink", "SELECT message_id, CASE WHEN message_id % 4 = 0 THEN 'GET' WHEN message_id % 4 = 1 THEN 'HEAD' WHEN message_id % 4 = 2 THEN 'PUT' ELSE 'POST' END AS http_method, CASE WHEN message_id % 4 > 1 THEN payload END AS body FROM messages")
def webhook_sink(spark, d):
    """What the push sink sends."""
    i = F.col("message_id")
    rows = T.messages(spark, d).select("message_id", "payload", F.when(i % 4 == 0, "get").when(i % 4 == 1, " Head ").when(i % 4 == 2, "PUT").otherwise("brew").alias("method"), F.lit(None).cast("string").alias("request_method"), F.lit(None).cast("boolean").alias("sign"), F.lit(None).cast("boolean").alias("request_sign"))
    return resolve.outbound(resolve.merge_http_spec(rows)).select("message_id", "http_method", "body")


@_query("parse_headers", "SELECT message_id, 'Authorization' AS name, 'Bearer ' || message_id AS value FROM messages WHERE message_id % 2 = 0 UNION ALL SELECT message_id, 'X-Custom', message_id::VARCHAR FROM messages WHERE message_id % 2 = 1 UNION ALL SELECT message_id, 'Accept', 'a/b: c' FROM messages WHERE message_id % 2 = 1")
def parse_headers(spark, d):
    i = F.col("message_id")
    as_object = F.concat(F.lit('{"Authorization":"Bearer '), i, F.lit('"}'))
    as_array = F.concat(F.lit('[["X-Custom","'), i, F.lit('x"],"Accept: a/b: c","X-Custom: '), i, F.lit('"]'))
    rows = T.messages(spark, d).select("message_id", F.when(i % 2 == 0, as_object).otherwise(as_array).alias("headers"))
    return resolve.parse_headers(rows).select("message_id", "name", "value")


_query("flexible_payload", "SELECT message_id, CASE WHEN message_id % 2 = 0 THEN 'text ' || message_id ELSE payload END AS body FROM messages")(
    lambda spark, d: T.messages(spark, d).select("message_id", S.payload_text(F.when(F.col("message_id") % 2 == 0, F.concat(F.lit('"text '), F.col("message_id"), F.lit('"'))).otherwise(F.col("payload"))).alias("body"))
)
_query("decode_payload", "SELECT message_id, payload AS body FROM messages")(
    lambda spark, d: T.messages(spark, d).withColumn("enc", F.when(F.col("message_id") % 2 == 0, "base64").otherwise("utf8")).select("message_id", S.decode_payload(F.when(F.col("enc") == "base64", F.base64(F.col("payload").cast("binary"))).otherwise(F.col("payload")), F.col("enc")).cast("string").alias("body"))
)
_query("dlq_topic_predicates", f"{_REQUESTS} SELECT topic, topic LIKE '%.\\_\\_dlq' ESCAPE '\\' AS is_dlq, starts_with(topic, '__group.') AS is_group, count(*) AS n FROM requests GROUP BY ALL")(
    lambda spark, d: _requests(spark, d).groupBy("topic", S.is_dlq(F.col("topic")).alias("is_dlq"), S.is_group(F.col("topic")).alias("is_group")).agg(F.count("*").alias("n"))
)
_query("dispatchable_filter", "SELECT message_id FROM accepted WHERE partition IN (0, 3)")(lambda spark, d: log.accept(T.messages(spark, d)).where(~F.col("duplicate") & F.col("partition").isin(0, 3) & ~S.is_dlq(F.col("topic"))).select("message_id"))
_query("semi_led_shards", "SELECT topic, count(*) AS n FROM messages WHERE partition IN (1, 2) GROUP BY topic")(lambda spark, d: T.messages(spark, d).join(F.broadcast(spark.range(1, 3).withColumnRenamed("id", "partition")), "partition", "left_semi").groupBy("topic").agg(F.count("*").alias("n")))
_query("paused_filter", "SELECT message_id FROM messages LEFT JOIN members ON member_id = message_id % 25 WHERE topic <> 'error' AND NOT coalesce(paused, FALSE)")(
    lambda spark, d: resolve.not_paused(T.messages(spark, d).withColumn("member_id", F.col("message_id") % 25), T.queues(spark, d).withColumn("paused", F.col("topic") == "error"), T.members(spark, d)).select("message_id")
)
_PATHS = "CASE page_id % 5 WHEN 0 THEN replace(replace(url, ':', '%3A'), '/', '%2f') WHEN 1 THEN '  ' || url || ' ' WHEN 2 THEN replace(url, 'http', 'ftp') WHEN 3 THEN 'https%3' || page_id ELSE '' END"
_query("validate_destination_path", "SELECT page_id, CASE WHEN page_id % 5 < 2 THEN url END AS destination FROM pages")(
    lambda spark, d: T.read(spark, d, "pages").select("page_id", S.destination_of_path(F.expr(_PATHS)).alias("destination"))
)
# a payload at the limit, one byte below, and the page itself
_query("long_client_select", "SELECT page_id, page_id % 3 = 0 OR (page_id % 3 = 2 AND octet_length(encode(html)) >= 262144) AS long_client FROM pages")(
    lambda spark, d: T.read(spark, d, "pages").select("page_id", S.is_long(F.when(F.col("page_id") % 3 == 0, F.repeat(F.lit("x"), 262_144)).when(F.col("page_id") % 3 == 1, F.repeat(F.lit("x"), 262_143)).otherwise(F.col("html"))).alias("long_client"))
)
_query("schedule_kind_validate", "SELECT message_id, CASE WHEN message_id % 2 = 0 AND message_id % 3 <> 0 THEN TRUE WHEN message_id % 2 = 1 AND message_id % 3 = 0 THEN message_id % 5 >= 1 ELSE FALSE END AS valid FROM messages")(
    lambda spark, d: T.messages(spark, d).select("message_id", schedule.valid_schedule(F.when(F.col("message_id") % 2 == 0, "0 9 * * *"), F.when(F.col("message_id") % 3 == 0, F.col("message_id") % 5)).alias("valid"))
)


# ---------------------------------------------------------------- fan-out, dedup
_FAN = """ FROM messages m JOIN members b USING (group_id) JOIN groups_ g USING (group_id) WHERE NOT b.paused AND NOT g.group_paused"""


@_query("join_group_fanout", f"""SELECT m.message_id, b.member_id, CASE WHEN m.message_id % 10 > 0 THEN m.routing_key || ':' ELSE '' END || b.member_id AS routing_key,
  coalesce(b.member_flow_key, CASE WHEN m.message_id % 10 > 0 THEN m.routing_key END) AS flow_key, m.idempotency_key || ':' || b.member_id AS idempotency_key, b.parallelism, b.rate,
  '__group.' || m.group_id AS topic, m.payload, m.priority_in, m.max_retries_in {_FAN}""")
def join_group_fanout(spark, d):
    requests = T.messages(spark, d).withColumn("routing_key", F.when(F.col("message_id") % 10 > 0, F.col("routing_key")).otherwise(""))
    rows = resolve.group_fanout(requests, T.groups(spark, d), T.members(spark, d))
    return rows.select("message_id", "member_id", "routing_key", "flow_key", "idempotency_key", "parallelism", "rate", "topic", "payload", "priority_in", "max_retries_in")


_query("group_fanout_errors", f"SELECT message_id FROM messages WHERE group_id NOT IN (SELECT group_id {_FAN})")(lambda spark, d: resolve.fanout_errors(T.messages(spark, d), T.groups(spark, d), T.members(spark, d)).select("message_id"))
_query("agg_group_accepted", f"SELECT group_id, count(*) AS accepted {_FAN} AND m.message_id IN (SELECT message_id FROM accepted) GROUP BY group_id")(
    lambda spark, d: resolve.group_fanout(log.accepted(T.messages(spark, d)), T.groups(spark, d), T.members(spark, d)).groupBy("group_id").agg(F.count("*").alias("accepted"))
)
_ACCEPT = "SELECT message_id, first_value(message_id) OVER w AS original_id, message_id <> first_value(message_id) OVER w AS duplicate FROM messages WINDOW w AS (PARTITION BY tenant_id, coalesce(idempotency_key, 'm' || message_id), idempotency_key IS NULL ORDER BY message_id)"
_query("idempotent_accept", _ACCEPT)(lambda spark, d: log.accept(T.messages(spark, d)).select("message_id", "original_id", "duplicate"))
_query("anti_dedup", "SELECT message_id FROM accepted")(lambda spark, d: log.accepted(T.messages(spark, d)).select("message_id"))
_query("agg_batch_accepted", "SELECT message_id // 100 AS batch, count(*) AS ids FROM messages GROUP BY ALL")(lambda spark, d: T.messages(spark, d).groupBy(F.floor(F.col("message_id") / 100).alias("batch")).agg(F.count("message_id").alias("ids")))
_query("batch_cap", "SELECT message_id // 128 AS batch, count(*) <= 100 AS allowed FROM messages GROUP BY ALL")(lambda spark, d: T.messages(spark, d).groupBy(F.floor(F.col("message_id") / 128).alias("batch")).agg((F.count("*") <= 100).alias("allowed")))


# ---------------------------------------------------------------- cursors
def _acks(spark, d):
    i = F.col("message_id")
    order = F.row_number().over(log.Window.partitionBy("topic", "partition").orderBy((i * 7919) % 104_729, "message_id"))
    return _log(spark, d).select("topic", "partition", "log_offset", "message_id", order.cast("long").alias("ack_seq"))


_ACKS = ", acks AS (SELECT topic, partition, log_offset, message_id, row_number() OVER (PARTITION BY topic, partition ORDER BY (message_id * 7919) % 104729, message_id) AS ack_seq FROM log)"


_CURSORS = f"""{_ACKS}, seen AS (SELECT topic AS owner, partition, log_offset, CASE WHEN topic = 'view' THEN 5 ELSE 0 END AS start FROM acks WHERE message_id % 97 <> 50),
 moved AS (SELECT owner, partition, max(CASE WHEN log_offset - start = rn THEN log_offset END) + 1 AS cursor FROM (SELECT *, row_number() OVER (PARTITION BY owner, partition ORDER BY log_offset) - 1 AS rn FROM seen WHERE log_offset >= start) GROUP BY ALL),
 cursors AS (SELECT owner, partition, coalesce(cursor, CASE WHEN owner = 'view' THEN 5 ELSE 0 END) AS cursor FROM (SELECT owner, partition FROM seen UNION SELECT 'view', p FROM range(4) AS r(p)) LEFT JOIN moved USING (owner, partition))"""


@_query("dispatch_cursor", f"{_CURSORS} SELECT * FROM cursors")
def dispatch_cursor(spark, d):
    """From where the cursors of one owner stand already."""
    stored = spark.range(4).select(F.lit("view").alias("owner"), F.col("id").alias("partition"), F.lit(5).cast("long").alias("cursor"))
    return log.dispatch_cursor(_acks(spark, d).where("message_id % 97 <> 50").withColumnRenamed("topic", "owner"), stored)


@_query("purge_after_delivery", f"{_ACKS} SELECT message_id, message_id % 9 = 0 OR message_id % 11 = 0 OR message_id % 13 = 0 OR ack_seq = max(ack_seq) OVER (PARTITION BY message_id % 9 = 0, topic, partition ORDER BY log_offset) AS purged FROM acks")
def purge_after_delivery(spark, d):
    rows = _with_url(_acks(spark, d)).withColumn("owner", F.when(F.col("message_id") % 9 != 0, F.col("topic")))
    return log.purge_after_delivery(rows).select("message_id", "purged")


def _direct_log(spark, d):
    """A log in which some messages went to the direct topic, each its own owner."""
    i = F.col("message_id")
    rows = log.accepted(T.messages(spark, d)).withColumn("topic", F.when(i % 8 == 0, S.DIRECT).otherwise(F.col("topic")))
    return _with_url(log.assign_offsets(rows)).withColumn("owner", F.when(i % 8 == 0, i.cast("string")).otherwise(F.col("topic")))


_DIRECT_LOG = """, moved AS (SELECT * REPLACE (CASE WHEN message_id % 8 = 0 THEN '__direct' ELSE topic END AS topic) FROM accepted),
 direct_log AS (SELECT *, row_number() OVER (PARTITION BY topic, partition ORDER BY message_id) - 1 AS log_offset FROM moved),
 listed AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY partition, log_offset) AS n FROM direct_log)"""


def _standing(spark, d):
    """Cursors of the queues: behind 10 records in partition 1, 20 in partition 2, 30 in partition 3."""
    return T.queues(spark, d).select(F.col("queue_id").alias("owner"), F.explode(F.sequence(F.lit(1), F.lit(3)).cast("array<long>")).alias("partition")).withColumn("cursor", F.col("partition") * 10)


@_query("backfill_select", f"{_DIRECT_LOG} SELECT message_id FROM listed WHERE n <= 50000 AND message_id % 11 <> 0 AND message_id % 13 <> 0 AND (topic = '__direct' OR log_offset >= partition * 10)")
def backfill_select(spark, d):
    return log.backfill(_direct_log(spark, d), _standing(spark, d), T.queues(spark, d)).select("message_id")


_query("cap_backfill", f"{_DIRECT_LOG} SELECT topic, count(*) AS n FROM listed WHERE n <= 300 AND message_id % 11 <> 0 AND message_id % 13 <> 0 AND (topic = '__direct' OR log_offset >= partition * 10) GROUP BY topic")(
    lambda spark, d: log.backfill(_direct_log(spark, d), _standing(spark, d), T.queues(spark, d), 300).groupBy("topic").agg(F.count("*").alias("n"))
)
_query("leader_failover_backfill", f"{_DIRECT_LOG} SELECT message_id FROM listed WHERE partition = 2 AND message_id % 11 <> 0 AND message_id % 13 <> 0 AND (topic = '__direct' OR log_offset >= 20)")(
    lambda spark, d: log.backfill(_direct_log(spark, d).join(F.broadcast(spark.range(2, 3).withColumnRenamed("id", "partition")), "partition", "left_semi"), _standing(spark, d), T.queues(spark, d), None).select("message_id")
)


# ---------------------------------------------------------------- delivery
_RETRIES = ", resolved AS (SELECT message_id, topic, coalesce(max_retries_in, default_max_retries, 3) AS max_retries, payload, url FROM accepted LEFT JOIN queues USING (topic))"
_OUTCOMES = f"""{_RETRIES}, tried AS (SELECT r.*, attempt, status FROM resolved r JOIN attempts USING (message_id) WHERE attempt <= max_retries),
 ends AS (SELECT *, row_number() OVER (PARTITION BY message_id ORDER BY attempt) AS nth FROM tried
   WHERE coalesce(status BETWEEN 200 AND 299 OR status IN (400, 401, 403, 404, 422), FALSE) OR attempt = max_retries),
 outcomes AS (SELECT message_id, topic, payload, url, CASE WHEN status BETWEEN 200 AND 299 THEN 'delivered' WHEN status IN (400, 401, 403, 404, 422) THEN 'rejected' ELSE 'exhausted' END AS outcome, status, attempt + 1 AS attempts FROM ends WHERE nth = 1)"""


def _resolved(spark, d):
    return resolve.resolve_retry(log.accepted(T.messages(spark, d)), T.queues(spark, d))


def _outcomes(spark, d):
    return delivery.outcomes(_resolved(spark, d), T.attempts(T.messages(spark, d)))


_query("deliver_outcome", f"{_OUTCOMES} SELECT message_id, outcome, status, attempts FROM outcomes")(lambda spark, d: _outcomes(spark, d).select("message_id", "outcome", "status", "attempts"))


@_query("retry_timeline", f"{_RETRIES}, steps AS (SELECT message_id, a AS attempt, CASE WHEN a = 0 THEN 0 ELSE round(least(500 * pow(2, least(a, 16)), 30000))::BIGINT END AS delay_ms FROM resolved, range(6) AS r(a) WHERE a <= max_retries) SELECT message_id, attempt, delay_ms, sum(delay_ms) OVER (PARTITION BY message_id ORDER BY attempt)::BIGINT AS at_ms FROM steps")
def retry_timeline(spark, d):
    return delivery.retry_timeline(_resolved(spark, d))


_query("backoff_delay_ms", "SELECT a AS attempt, round(least(500 * pow(2, least(a, 16)), 30000))::BIGINT AS exponential, 2000::BIGINT AS fixed FROM range(1, 25) AS r(a)")(
    lambda spark, d: spark.range(1, 25).select(F.col("id").alias("attempt"), S.backoff_ms(F.lit("exponential"), F.lit(500), F.lit(30_000), F.lit(2.0), F.col("id")).alias("exponential"), S.backoff_ms(F.lit("fixed"), F.lit(2000), F.lit(1000), F.lit(2.0), F.col("id")).alias("fixed"))
)
_query("retry_after_wait", "SELECT a AS secs, least(a * 1000, 30000) AS wait_ms FROM range(60) AS r(a)")(lambda spark, d: spark.range(60).select(F.col("id").alias("secs"), S.retry_after_ms(F.col("id"), F.lit(30_000)).alias("wait_ms")))


def _letters(spark, d):
    return delivery.dead_letters(_outcomes(spark, d), T.messages(spark, d), T.queues(spark, d))


_query("dlq_move", f"{_OUTCOMES} SELECT topic || '.__dlq' AS dlq_topic, message_id::VARCHAR AS routing_key, topic AS source_queue, url AS destination_url FROM outcomes WHERE outcome <> 'delivered'")(
    lambda spark, d: _letters(spark, d).select("dlq_topic", "routing_key", F.get_json_object("body", "$.source_queue").alias("source_queue"), F.get_json_object("body", "$.destination_url").alias("destination_url"))
)


def _stored(spark, d):
    rows = _letters(spark, d).withColumn("partition", T.partition_of(F.lit(T.TENANT), F.col("dlq_topic"), F.col("routing_key")))
    order = log.Window.partitionBy("dlq_topic", "partition").orderBy("message_id")
    return rows.withColumn("log_offset", (F.row_number().over(order) - 1).cast("long"))


_STORED = f"""{_OUTCOMES}, letters AS (SELECT topic || '.__dlq' AS dlq_topic, message_id::VARCHAR AS routing_key, message_id, topic, url FROM outcomes WHERE outcome <> 'delivered'),
 placed AS (SELECT *, ('0x' || substr(md5('default|' || dlq_topic || '|' || routing_key), 1, 15))::BIGINT % 4 AS partition FROM letters),
 stored AS (SELECT *, row_number() OVER (PARTITION BY dlq_topic, partition ORDER BY message_id) - 1 AS log_offset FROM placed)"""


@_query("dlq_list", f"{_STORED} SELECT partition, log_offset, routing_key AS original_message_id, topic AS source_queue, url AS destination_url FROM stored WHERE dlq_topic = 'view.__dlq' ORDER BY partition, log_offset LIMIT 10")
def dlq_list(spark, d):
    return inspect.dlq_list(_stored(spark, d), "view.__dlq")


_CANDIDATES = "SELECT '__direct.__dlq' AS dlq_topic UNION SELECT topic || '.__dlq' FROM queues UNION SELECT '__group.' || group_id || '.' || member_id || '.__dlq' FROM members"


@_query("union_dlq_candidates", _CANDIDATES)
def union_dlq_candidates(spark, d):
    return inspect.dlq_candidates(T.queues(spark, d), T.members(spark, d), _letters(spark, d))


_SOURCES = f"""{_OUTCOMES}, candidates AS ({_CANDIDATES}), counts AS (SELECT topic || '.__dlq' AS dlq_topic, count(*) AS n FROM outcomes WHERE outcome <> 'delivered' GROUP BY ALL),
 sources AS (SELECT dlq_topic, CASE WHEN dlq_topic = '__direct.__dlq' THEN 'direct' WHEN starts_with(dlq_topic, '__group.') THEN 'group_member' ELSE 'queue' END AS kind,
   CASE WHEN dlq_topic = '__direct.__dlq' THEN 'Direct publish' WHEN starts_with(dlq_topic, '__group.') THEN 'Group ' || name || ' → ' || split_part(dlq_topic, '.', 3) ELSE 'Queue: ' || replace(dlq_topic, '.__dlq', '') END AS label,
   CASE WHEN NOT starts_with(dlq_topic, '__group.') THEN replace(dlq_topic, '.__dlq', '') END AS queue, least(coalesce(n, 0), 10000) AS count
  FROM candidates LEFT JOIN counts USING (dlq_topic) LEFT JOIN groups_ ON dlq_topic LIKE '\\_\\_group.' || group_id || '.%' ESCAPE '\\')"""


@_query("agg_dlq_sources", f"{_SOURCES} SELECT * FROM sources")
def agg_dlq_sources(spark, d):
    letters = _letters(spark, d)
    return inspect.dlq_sources(inspect.dlq_candidates(T.queues(spark, d), T.members(spark, d), letters), letters, T.groups(spark, d))


_query("agg_dashboard_totals", f"{_SOURCES} SELECT sum(count)::BIGINT AS dead_letters, count_if(count > 0) AS sources, (SELECT count(*) FROM messages WHERE delay_ms IS NOT NULL) + (SELECT count(*) FROM supplier) AS scheduled FROM sources")(
    lambda spark, d: inspect.dashboard(agg_dlq_sources(spark, d), T.messages(spark, d).where("delay_ms is not null").select("message_id").union(_jobs(spark, d).select("job")))
)
_query("agg_ingest_hourly", "SELECT tenant_id, published_at_ms - published_at_ms % 3600000 AS hour_ms, count(*) AS messages, sum(octet_length(encode(payload)))::BIGINT AS bytes FROM messages GROUP BY ALL")(lambda spark, d: inspect.ingest_hourly(T.messages(spark, d)))
_BLOCKS = ", blocks AS (SELECT 'https://' || event_type || '.example.com:443' AS host, max(epoch_us(ts) // 1000) - 86400000 AS until_ms FROM events WHERE event_type IN ('view', 'click') GROUP BY ALL)"


@_query("blocked_filter", f"{_BLOCKS} SELECT message_id, coalesce(until_ms > published_at_ms, FALSE) AS deferred FROM messages m JOIN queues q USING (topic) LEFT JOIN blocks b ON b.host = 'https://' || m.topic || '.example.com:443'")
def blocked_filter(spark, d):
    m = T.messages(spark, d).join(F.broadcast(T.queues(spark, d).select("topic", "url")), "topic")
    blocks = m.where("topic in ('view', 'click')").groupBy(S.host_key(F.col("url")).alias("host")).agg((F.max("published_at_ms") - 86_400_000).alias("until_ms"))
    return delivery.blocked_filter(m, blocks).select("message_id", "deferred")


_HOST_EVENTS = ", host_events AS (SELECT topic || (message_id % 3) AS host, published_at_ms AS at_ms, message_id AS event_id, message_id % 7 < 5 AS failed, row_number() OVER (PARTITION BY topic || (message_id % 3) ORDER BY published_at_ms, message_id) AS nth FROM messages)"


@_query("breaker_state", f"""{_HOST_EVENTS}, walk AS (
  SELECT host, event_id, nth, at_ms, failed::INT AS failures, 0::BIGINT AS until_ms, 30000::BIGINT AS cooldown FROM host_events WHERE nth = 1
  UNION ALL SELECT e.host, e.event_id, e.nth, e.at_ms, CASE WHEN e.failed THEN failures + 1 ELSE 0 END,
   CASE WHEN NOT e.failed THEN 0 WHEN failures + 1 >= 3 THEN e.at_ms + cooldown ELSE until_ms END,
   CASE WHEN NOT e.failed THEN 30000 WHEN failures + 1 >= 3 THEN least(cooldown * 2, 900000) ELSE cooldown END
  FROM walk w JOIN host_events e ON e.host = w.host AND e.nth = w.nth + 1)
  SELECT host, event_id, until_ms > at_ms AS blocked, until_ms FROM walk""")
def breaker_state(spark, d):
    i = F.col("message_id")
    events = T.messages(spark, d).select(F.concat("topic", i % 3).alias("host"), F.col("published_at_ms").alias("at_ms"), i.alias("event_id"), (i % 7 < 5).alias("failed"))
    return delivery.breaker(events)


#: A day of the tables on which some manual blocks are over.
_LATER = 1_735_000_000_000


def _commands(spark, d):
    i = F.col("message_id")
    return T.messages(spark, d).select(F.concat(F.lit("https://"), "topic", i % 40, F.lit(".Example.com/hook")).alias("host"), F.col("published_at_ms").alias("at_ms"), i.alias("command_id"), F.when(i % 7 < 5, "block").otherwise("unblock").alias("action"), (i % 61 * 30 * 86_400_000).alias("duration_ms"))


_MANUAL = f""", commands AS (SELECT 'https://' || topic || (message_id % 40) || '.example.com:443' AS host, published_at_ms AS at_ms, message_id, message_id % 7 < 5 AS blocks, greatest(message_id % 61 * 30 * 86400000, 1000) AS duration_ms FROM messages),
 manual AS (SELECT host, at_ms + duration_ms - {_LATER} AS remaining_ms FROM (SELECT * FROM commands QUALIFY row_number() OVER (PARTITION BY host ORDER BY at_ms DESC, message_id DESC) = 1) WHERE blocks AND at_ms + duration_ms > {_LATER})"""
_query("breaker_manual", f"{_MANUAL} SELECT * FROM manual")(lambda spark, d: delivery.manual_blocks(_commands(spark, d), F.lit(_LATER)))


# ---------------------------------------------------------------- lanes
def _waiting(spark, d):
    i = F.col("message_id")
    return _log(spark, d).select(F.col("topic").alias("owner"), F.coalesce("flow_key_in", F.lit("-")).alias("flow_key"), (i % 9 == 0).alias("backfill"), S.priority(F.col("priority_in")).alias("priority"), "log_offset", "message_id", (i % 4 > 0).alias("waiting"), (i % 3 + 1).alias("parallelism"), (i % 2).alias("rate"))


_WAITING = ", waiting AS (SELECT topic AS owner, coalesce(flow_key_in, '-') AS flow_key, message_id % 9 = 0 AS backfill, least(coalesce(priority_in, 5), 9) AS priority, log_offset, message_id, message_id % 4 > 0 AS waits, message_id % 3 + 1 AS parallelism, message_id % 2 AS rate FROM log)"
_query("lane_order", f"{_WAITING} SELECT message_id, row_number() OVER (PARTITION BY owner, flow_key ORDER BY backfill, priority DESC, log_offset, message_id) AS place FROM waiting")(lambda spark, d: lanes.lane_order(_waiting(spark, d)).select("message_id", "place"))
_query("agg_lane_info", f"{_WAITING} SELECT owner, flow_key, parallelism, rate, count_if(waits) AS waiting, count_if(NOT waits) AS active FROM waiting GROUP BY ALL")(lambda spark, d: lanes.lane_info(_waiting(spark, d)))
_query("lane_rebind", f"{_WAITING} SELECT owner, flow_key, count(DISTINCT (parallelism, rate)) AS lanes FROM waiting GROUP BY ALL")(lambda spark, d: lanes.lane_info(_waiting(spark, d)).groupBy("owner", "flow_key").agg(F.count("*").alias("lanes")))
_query("agg_global_parallelism", f"{_WAITING} SELECT count(*) AS active FROM waiting WHERE NOT waits")(lambda spark, d: lanes.lane_info(_waiting(spark, d)).agg(F.sum("active").alias("active")))


def _arrivals(spark, d):
    return T.messages(spark, d).select(F.col("routing_key").alias("lane"), F.col("published_at_ms").alias("at_ms"), "message_id", (F.col("message_id") % 50 * 60_000).alias("service_ms"), S.priority(F.col("priority_in")).alias("priority"))


_ARRIVALS = ", arrivals AS (SELECT routing_key AS lane, published_at_ms AS at_ms, message_id, message_id % 50 * 60000 AS service_ms, row_number() OVER (PARTITION BY routing_key ORDER BY published_at_ms, message_id) AS nth FROM messages)"
_DAY = 86_400_000


@_query("rate_window_admit", f"""{_ARRIVALS}, walk AS (
  SELECT lane, message_id, nth, at_ms AS anchor, 1 AS used, TRUE AS admitted FROM arrivals WHERE nth = 1
  UNION ALL SELECT a.lane, a.message_id, a.nth, CASE WHEN a.at_ms - anchor >= {_DAY} THEN a.at_ms ELSE anchor END,
    CASE WHEN a.at_ms - anchor >= {_DAY} THEN 1 WHEN used < 2 THEN used + 1 ELSE used END, a.at_ms - anchor >= {_DAY} OR used < 2
  FROM walk w JOIN arrivals a ON a.lane = w.lane AND a.nth = w.nth + 1) SELECT lane, message_id, admitted FROM walk""")
def rate_window_admit(spark, d):
    return lanes.rate_window_admit(_arrivals(spark, d), "lane", 2, _DAY)


@_query("rate_window_start", f"""{_ARRIVALS}, walk AS (
  SELECT lane, message_id, nth, at_ms AS anchor, 1 AS used, at_ms AS start_ms FROM arrivals WHERE nth = 1
  UNION ALL SELECT lane, message_id, nth,
    CASE WHEN t - anchor >= {_DAY} THEN t WHEN used < 2 THEN anchor ELSE anchor + {_DAY} END,
    CASE WHEN t - anchor >= {_DAY} OR used >= 2 THEN 1 ELSE used + 1 END,
    CASE WHEN t - anchor >= {_DAY} OR used < 2 THEN t ELSE anchor + {_DAY} END
  FROM (SELECT a.lane, a.message_id, a.nth, anchor, used, greatest(a.at_ms, start_ms) AS t FROM walk w JOIN arrivals a ON a.lane = w.lane AND a.nth = w.nth + 1))
  SELECT lane, message_id, start_ms FROM walk""")
def rate_window_start(spark, d):
    return lanes.rate_window_start(_arrivals(spark, d), "lane", 2, _DAY)


@_query("serial_admit", f"""{_ARRIVALS}, walk AS (SELECT lane, message_id, nth, at_ms AS start_ms, at_ms + service_ms AS done FROM arrivals WHERE nth = 1
  UNION ALL SELECT a.lane, a.message_id, a.nth, greatest(a.at_ms, done), greatest(a.at_ms, done) + a.service_ms FROM walk w JOIN arrivals a ON a.lane = w.lane AND a.nth = w.nth + 1)
  SELECT lane, message_id, start_ms FROM walk""")
def serial_admit(spark, d):
    return lanes.serial_starts(_arrivals(spark, d), "lane").select("lane", "message_id", "start_ms")


_query("parallel_admit")(lambda spark, d: lanes.parallel_starts(_arrivals(spark, d), "lane", 3))
_query("wfq_score", f"{_ARRIVALS} SELECT message_id, (row_number() OVER (PARTITION BY lane ORDER BY message_id) - 1) * (1000 // (message_id % 7 + 1)) AS score FROM arrivals")(lambda spark, d: lanes.fair_score(_arrivals(spark, d).withColumn("weight", F.col("message_id") % 7 + 1), "lane").select("message_id", "score"))
_CONTROL = """, control AS (SELECT routing_key AS lane, message_id AS seq, (['pause', 'resume', 'pin', 'unpin', 'reset_rate'])[message_id % 5 + 1] AS action, message_id % 9 AS cap FROM messages)"""
_query("lane_pause_resume", f"{_CONTROL} SELECT lane, coalesce(arg_max(action = 'pause', seq) FILTER (WHERE action IN ('pause', 'resume')), FALSE) AS paused, max(seq) FILTER (WHERE action = 'reset_rate') AS rate_reset_at FROM control GROUP BY lane")(
    lambda spark, d: lanes.control_replay(_control(spark, d)).select("lane", "paused", "rate_reset_at")
)


def _control(spark, d):
    i = F.col("message_id")
    action = F.element_at(F.array(*map(F.lit, ("pause", "resume", "pin", "unpin", "reset_rate"))), (i % 5 + 1).cast("int"))
    return T.messages(spark, d).select(F.col("routing_key").alias("lane"), i.alias("seq"), action.alias("action"), (i % 9).alias("limit"))


_query("pin", f"{_CONTROL} SELECT lane, arg_max_null(CASE WHEN action = 'pin' THEN cap END, seq) FILTER (WHERE action IN ('pin', 'unpin')) AS pinned_limit FROM control GROUP BY lane")(lambda spark, d: lanes.control_replay(_control(spark, d)).select("lane", "pinned_limit"))
_query("unpin", f"{_CONTROL} SELECT lane FROM control GROUP BY lane HAVING arg_max(action, seq) FILTER (WHERE action IN ('pin', 'unpin')) = 'unpin'")(
    lambda spark, d: lanes.control_replay(_control(spark, d)).where("pinned_limit is null").join(_control(spark, d).where("action in ('pin', 'unpin')").select("lane").distinct(), "lane", "left_semi").select("lane")
)
_query("reset_rate", f"{_CONTROL} SELECT lane, max(seq) FILTER (WHERE action = 'reset_rate') AS rate_reset_at FROM control GROUP BY lane")(lambda spark, d: lanes.control_replay(_control(spark, d)).select("lane", "rate_reset_at"))


# ---------------------------------------------------------------- schedules
_query("delayed_release", "SELECT message_id FROM messages WHERE published_at_ms + delay_ms <= (SELECT max(published_at_ms) FROM messages) - 86400000")(
    lambda spark, d: (m := T.messages(spark, d).withColumn("deliver_at_ms", F.col("published_at_ms") + F.col("delay_ms"))).join(F.broadcast(m.agg((F.max("published_at_ms") - 86_400_000).alias("now_ms")))).transform(lambda x: schedule.delayed_release(x, F.col("now_ms"))).select("message_id")
)
_query("delayed_order", "SELECT message_id, row_number() OVER (ORDER BY published_at_ms + delay_ms, message_id) AS place FROM messages WHERE delay_ms IS NOT NULL")(
    lambda spark, d: schedule.delayed_order(T.messages(spark, d).where("delay_ms is not null").withColumn("deliver_at_ms", F.col("published_at_ms") + F.col("delay_ms")))
)
_query("delayed_cancel", "SELECT message_id FROM messages WHERE delay_ms IS NOT NULL AND message_id % 12 <> 0")(lambda spark, d: T.messages(spark, d).where("delay_ms is not null").join(T.messages(spark, d).where("message_id % 12 = 0").select("message_id"), "message_id", "left_anti").select("message_id"))


def _jobs(spark, d):
    """Intervals, and every fourth a cron expression: daily at nine."""
    s = F.col("s_suppkey")
    cron = s % 4 == 0
    return T.read(spark, d, "supplier").select(s.alias("job"), F.when(cron, "0 9 * * *").alias("expression"), F.when(~cron, s % 30 + 1).alias("every_seconds"), (F.lit(NOW) - 50_000 + s * 1000).alias("next_run_ms"), (s % 6 == 0).alias("paused"))


_JOBS = f""", jobs AS (SELECT s_suppkey AS job, {NOW} - 50000 + s_suppkey * 1000 AS next_run_ms, s_suppkey % 6 = 0 AS paused,
  CASE WHEN s_suppkey % 4 > 0 THEN {NOW} + (s_suppkey % 30 + 1) * 1000 ELSE {NOW} // 86400000 * 86400000 + CASE WHEN {NOW} % 86400000 >= 32400000 THEN 86400000 ELSE 0 END + 32400000 END AS from_now FROM supplier)"""
_query("cron_tick", f"{_JOBS} SELECT job, NOT paused AND next_run_ms <= {NOW} AS fired, CASE WHEN NOT paused AND next_run_ms <= {NOW} THEN from_now ELSE next_run_ms END AS next_run_ms FROM jobs")(lambda spark, d: schedule.tick(_jobs(spark, d), NOW).select("job", "fired", "next_run_ms"))
_query("cron_pause_resume", f"{_JOBS} SELECT job, CASE WHEN paused THEN from_now ELSE next_run_ms END AS next_run_ms, FALSE AS paused FROM jobs")(lambda spark, d: schedule.resume(_jobs(spark, d), NOW).select("job", "next_run_ms", "paused"))
_query("next_run", f"SELECT s_suppkey AS job, ({NOW} + s_suppkey * 60000) // 86400000 * 86400000 + CASE WHEN ({NOW} + s_suppkey * 60000) % 86400000 >= 32400000 THEN 86400000 ELSE 0 END + 32400000 AS next_run_ms FROM supplier")(
    lambda spark, d: schedule.next_runs(T.read(spark, d, "supplier").select(F.col("s_suppkey").alias("job"), F.lit("0 9 * * *").alias("expression"), (F.lit(NOW) + F.col("s_suppkey") * 60_000).alias("after_ms"))).select("job", "next_run_ms")
)
_query("normalize_cron", "SELECT * FROM (VALUES ('0 9 * * *', '0 0 9 * * *'), ('0 0 9 * * *', '0 0 9 * * *'), ('bad', 'bad')) AS v(expression, normalized)")(lambda spark, d: spark.createDataFrame([("0 9 * * *",), ("0 0 9 * * *",), ("bad",)], "expression string").select("expression", S.normalize_cron(F.col("expression")).alias("normalized")))


# ---------------------------------------------------------------- catalogues
_LATEST = ", latest AS (SELECT * FROM entries QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at_ms DESC, source DESC, version DESC) = 1), dead AS (SELECT id, max(deleted_at_ms) AS deleted_at_ms FROM tombstones GROUP BY id)"
_query("lww_latest", f"{_LATEST} SELECT id, version, name FROM latest")(lambda spark, d: catalog.lww_latest(T.entries(spark, d)).select("id", "version", "name"))
_query("agg_tombstone_max", f"{_LATEST} SELECT * FROM dead")(lambda spark, d: catalog.tombstone_max(T.tombstones(spark, d)))
_query("anti_tombstone", f"{_LATEST} SELECT version FROM entries LEFT JOIN dead USING (id) WHERE deleted_at_ms IS NULL OR updated_at_ms > deleted_at_ms")(lambda spark, d: catalog.without_deleted(T.entries(spark, d), T.tombstones(spark, d)).select("version"))
_query("union_catalog_merge", f"{_LATEST} SELECT id, version FROM latest LEFT JOIN dead USING (id) WHERE deleted_at_ms IS NULL OR updated_at_ms > deleted_at_ms")(lambda spark, d: catalog.merge(T.entries(spark, d), T.tombstones(spark, d)).select("id", "version"))


def _catalogue(spark, d, rule):
    s = F.col("s_suppkey")
    rows = T.read(spark, d, "supplier").where(rule).select(s.alias("id"), F.concat(F.lit("n"), s).alias("name"), F.concat(F.lit("u"), s % 7).alias("url"), F.when(s % 3 == 0, s % 5).alias("retries"), (s % 11).alias("updated_at_ms"), s.cast("string").alias("key"), F.when(s % 4 > 0, s % 4 - 1).alias("parallelism"), (s % 9).alias("period_secs"))
    return rows


@_query("upsert_queue_by_name", """SELECT 't' || (s_suppkey % 2) AS tenant_id, 'n' || s_suppkey AS name, CASE WHEN f = 0 THEN s_suppkey + 100000 ELSE s_suppkey END AS id, CASE WHEN f < 2 THEN 'g' ELSE '' END || 'u' || (s_suppkey % 7) AS url, CASE WHEN f < 2 THEN 'new' ELSE 'old' END AS secret,
  CASE WHEN f < 2 AND s_suppkey % 9 = 0 THEN 9 WHEN f > 0 AND s_suppkey % 3 = 0 THEN s_suppkey % 5 END AS retries, CASE WHEN f < 2 AND s_suppkey % 9 = 0 THEN 'fixed' WHEN f > 0 THEN 'linear' END AS backoff
  FROM (SELECT *, s_suppkey % 4 AS f FROM supplier) WHERE f < 3""")
def upsert_queue_by_name(spark, d):
    s = F.col("s_suppkey")
    rows = T.read(spark, d, "supplier").select(s, F.concat(F.lit("t"), s % 2).alias("tenant_id"), F.concat(F.lit("n"), s).alias("name"), F.concat(F.lit("u"), s % 7).alias("url"))
    stored = rows.where(s % 4 > 0).where(s % 4 < 3).select("tenant_id", "name", s.alias("id"), "url", F.lit("old").alias("secret"), F.when(s % 3 == 0, s % 5).alias("retries"), F.lit("linear").alias("backoff"))
    given = rows.where(s % 4 < 2).select("tenant_id", "name", (s + 100_000).alias("id"), F.concat(F.lit("g"), "url").alias("url"), F.lit("new").alias("secret"), F.when(s % 9 == 0, F.lit(9).cast("long")).alias("retries"), F.when(s % 9 == 0, "fixed").alias("backoff"))
    return catalog.upsert_by_name(stored, given)


@_query("upsert_queue_lww", """SELECT 't' AS tenant_id, CASE WHEN f = 2 AND u <= 5 THEN s_suppkey + 100000 ELSE s_suppkey END AS id, CASE WHEN f IN (0, 1) AND (f = 0 OR u <= 5) THEN 'new' || s_suppkey ELSE 'n' || s_suppkey END AS name,
  CASE WHEN f = 0 OR (f < 3 AND u <= 5) THEN 5 ELSE u END AS updated_at_ms FROM (SELECT s_suppkey, s_suppkey % 5 AS f, s_suppkey % 11 AS u FROM supplier) WHERE f < 4""")
def upsert_queue_lww(spark, d):
    """Given ones that are new, that meet a stored id under another name, or a stored name under another id."""
    s = F.col("s_suppkey")
    rows = T.read(spark, d, "supplier")
    stored = rows.where(s % 5 > 0).where(s % 5 < 4).select(F.lit("t").alias("tenant_id"), s.alias("id"), F.concat(F.lit("n"), s).alias("name"), (s % 11).alias("updated_at_ms"))
    other = s % 5 == 2
    given = rows.where(s % 5 < 3).select(F.lit("t").alias("tenant_id"), F.when(other, s + 100_000).otherwise(s).alias("id"), F.concat(F.when(other, "n").otherwise("new"), s).alias("name"), F.lit(5).cast("long").alias("updated_at_ms"))
    return catalog.upsert_lww(stored, given)


@_query("upsert_flow_by_key", "SELECT s_suppkey::VARCHAR AS key, greatest(coalesce(CASE WHEN s_suppkey % 4 > 0 THEN s_suppkey % 4 - 1 END, 1), 1) AS parallelism, CASE WHEN s_suppkey % 4 < 2 THEN 7 ELSE s_suppkey % 7 END AS rate, greatest(s_suppkey % 9, 1) AS period_secs FROM supplier WHERE s_suppkey % 4 < 3")
def upsert_flow_by_key(spark, d):
    stored = _catalogue(spark, d, "s_suppkey % 4 between 1 and 2").select("key", "parallelism", (F.col("id") % 7).alias("rate"), "period_secs")
    return catalog.upsert_flow(stored, _catalogue(spark, d, "s_suppkey % 4 < 2").withColumn("rate", F.lit(7).cast("long")))


_query("apply_inline_flow", "SELECT s_suppkey::VARCHAR AS key, greatest(coalesce(CASE WHEN s_suppkey % 4 > 0 THEN s_suppkey % 4 - 1 END, 1), 1) AS parallelism FROM supplier WHERE s_suppkey % 4 < 2")(
    lambda spark, d: catalog.upsert_flow(spark.createDataFrame([], "key string, parallelism long, rate long, period_secs long"), _catalogue(spark, d, "s_suppkey % 4 < 2").withColumn("rate", F.lit(0).cast("long"))).select("key", "parallelism")
)
_query("compact_duplicates", "SELECT min(s_suppkey) AS id FROM supplier GROUP BY s_suppkey % 7, s_nationkey")(lambda spark, d: catalog.keep_first(T.read(spark, d, "supplier").withColumn("url", F.col("s_suppkey") % 7), ["url", "s_nationkey"], "s_suppkey").select(F.col("s_suppkey").alias("id")))
_query("unique_for_topic", "SELECT min(s_suppkey) AS id FROM supplier WHERE s_suppkey % 5 <> 0 GROUP BY s_suppkey % 7")(lambda spark, d: catalog.keep_first(T.read(spark, d, "supplier").where("s_suppkey % 5 <> 0").withColumn("url", F.col("s_suppkey") % 7), ["url"], "s_suppkey").select(F.col("s_suppkey").alias("id")))
_query("delete_cascade", "SELECT 'group' AS kind, group_id AS id FROM groups_ WHERE group_id < 2 UNION ALL SELECT 'member', member_id FROM members WHERE group_id < 2")(lambda spark, d: catalog.delete_cascade(T.groups(spark, d), T.members(spark, d), T.groups(spark, d).where("group_id < 2"))[2])
_query("member_patch", "SELECT member_id, CASE WHEN member_id % 4 = 0 THEN 9 ELSE parallelism END AS parallelism, CASE WHEN member_id % 12 = 0 THEN 3 ELSE rate END AS rate, CASE WHEN member_id % 4 = 0 THEN 'p' ELSE url END AS url, paused OR member_id % 4 = 0 AS paused, CASE WHEN member_id % 8 = 0 THEN NULL ELSE member_flow_key END AS member_flow_key FROM members")(
    lambda spark, d: catalog.member_patch(
        T.members(spark, d), T.members(spark, d).where("member_id % 4 = 0").select("member_id", F.lit(9).cast("long").alias("parallelism"), F.expr("CASE WHEN member_id % 12 = 0 THEN 3L END").alias("rate"), F.lit("p").alias("url"), F.lit(True).alias("paused"), F.expr("member_id % 8 = 0").alias("sets_flow_key"), F.lit(None).cast("string").alias("member_flow_key"))
    ).select("member_id", "parallelism", "rate", "url", "paused", "member_flow_key")
)


# ---------------------------------------------------------------- hashes, urls, strings
_query("partition_hash", "SELECT message_id, partition FROM messages")(lambda spark, d: T.messages(spark, d).select("message_id", "partition"))
_query("hmac_signature")(lambda spark, d: T.messages(spark, d).select("message_id", S.signature("sec", F.col("payload"), F.col("published_at_ms")).alias("signature")))
_query("payload_sha256", "SELECT message_id, sha256(payload) AS sha256 FROM messages")(lambda spark, d: T.messages(spark, d).select("message_id", F.sha2(F.col("payload").cast("binary"), 256).alias("sha256")))
_query("payload_crc32")(lambda spark, d: T.messages(spark, d).select("message_id", F.crc32(F.col("payload").cast("binary")).alias("crc32")))
_query("stable_node_id", "SELECT n_name AS node, md5(n_name || '|' || n_regionkey) AS node_id FROM nation")(lambda spark, d: T.read(spark, d, "nation").select(F.col("n_name").alias("node"), F.md5(F.concat_ws("|", "n_name", "n_regionkey").cast("binary")).alias("node_id")))
_query("host_key", "SELECT page_id, regexp_extract(url, '^(https?)://', 1) || '://' || lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)) || CASE WHEN starts_with(url, 'https') THEN ':443' ELSE ':80' END AS host FROM pages")(lambda spark, d: T.read(spark, d, "pages").select("page_id", S.host_key(F.col("url")).alias("host")))
_query("peer_url", "SELECT page_id, lower(regexp_replace(trim(url), '/+$', '')) AS peer FROM pages")(lambda spark, d: T.read(spark, d, "pages").select("page_id", S.peer_url(F.col("url")).alias("peer")))
_query("topic_builders", "SELECT member_id, '__group.' || group_id AS group_topic, '__group.' || group_id || '.' || member_id || '.__dlq' AS dlq_topic FROM members")(lambda spark, d: T.members(spark, d).select("member_id", S.group_topic(F.col("group_id")).alias("group_topic"), S.group_topic(F.col("group_id"), F.col("member_id")).alias("dlq_topic")))
_query("json_fields", "SELECT message_id, json_extract_string(payload, '$.k') AS k FROM messages")(lambda spark, d: T.messages(spark, d).select("message_id", F.get_json_object("payload", "$.k").alias("k")))


# ---------------------------------------------------------------- cluster
def _nodes(spark, d):
    n = F.col("r_regionkey").cast("long")
    rows = T.read(spark, d, "region").select(n.alias("node"), n.alias("idx"), F.when(n != 3, F.lit(NOW) - n * 4000).alias("last_seen_ms"))
    return cluster.alive(rows, NOW, 0)


_NODES = f", nodes AS (SELECT r_regionkey::BIGINT AS node, r_regionkey::BIGINT AS idx, r_regionkey = 0 OR coalesce(r_regionkey <> 3 AND r_regionkey * 4000 <= 10000, FALSE) AS alive FROM region)"
_LEADERS = f"""{_NODES}, ring AS (SELECT shard, node, idx, alive, (idx - shard % 5 + 5) % 5 AS step FROM nodes, range(16) AS r(shard)),
 led AS (SELECT shard, max(node) FILTER (WHERE step = 0) AS preferred, coalesce(arg_min(node, step) FILTER (WHERE alive), max(node) FILTER (WHERE step = 0)) AS leader FROM ring GROUP BY shard)"""


def _leaders(spark, d):
    return cluster.leaders(_nodes(spark, d), spark.range(16).withColumnRenamed("id", "shard"))


_query("peer_alive", f"{_NODES} SELECT node, alive FROM nodes")(lambda spark, d: _nodes(spark, d).select("node", "alive"))
_query("ring_leader", f"{_LEADERS} SELECT shard, leader FROM led")(lambda spark, d: _leaders(spark, d).select("shard", "leader"))
_query("preferred_leader", f"{_LEADERS} SELECT shard, preferred FROM led")(lambda spark, d: _leaders(spark, d).select("shard", "preferred"))
_query("failover_flag", f"{_LEADERS} SELECT shard, leader <> preferred AS failover FROM led")(lambda spark, d: _leaders(spark, d).select("shard", "failover"))
_query("led_shards", f"{_LEADERS} SELECT shard FROM led WHERE leader = 0")(lambda spark, d: _leaders(spark, d).where("leader = 0").select("shard"))
_query("agg_cluster_status", f"{_LEADERS} SELECT n.node, n.alive, count_if(leader = n.node) AS led, count_if(leader = n.node AND leader <> preferred) AS failovers, count_if(preferred = n.node) AS preferred_shards FROM nodes n, led GROUP BY ALL")(lambda spark, d: cluster.status(_leaders(spark, d), _nodes(spark, d)))
_query("cross_node_shard", f"{_NODES} SELECT node, shard, alive FROM nodes, range(16) AS r(shard)")(lambda spark, d: F.broadcast(_nodes(spark, d)).join(spark.range(16).withColumnRenamed("id", "shard")).select("node", "shard", "alive"))
_query("readiness", f"{_NODES} SELECT count_if(alive) >= count(*) // 2 + 1 AS ready FROM nodes")(lambda spark, d: _nodes(spark, d).agg((F.count_if("alive") >= F.floor(F.count("*") / 2) + 1).alias("ready")))
_query("agg_peer_health_max", "SELECT user_id % 7 AS node, max(epoch_us(ts) // 1000) AS last_seen_ms FROM events GROUP BY ALL")(lambda spark, d: cluster.gossip(T.messages(spark, d).select((F.col("routing_key").cast("long") % 7).alias("node"), F.col("published_at_ms").alias("last_seen_ms"))))
_ACKED = ", appends AS (SELECT message_id AS append_id, message_id % 3 AS generation FROM messages), acks3 AS (SELECT message_id AS append_id, peer, (message_id + peer) % 4 <> 0 AS ok, (message_id * 7 + peer) % 4 AS ack_generation FROM messages, range(1, 5) AS r(peer)), counted AS (SELECT a.append_id, count(peer) FILTER (WHERE ok AND ack_generation >= generation) AS acks FROM appends a LEFT JOIN acks3 USING (append_id) GROUP BY ALL)"


def _acked(spark, d):
    i, p = F.col("message_id"), F.col("peer")
    m = T.messages(spark, d)
    acks = m.select("message_id", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("peer")).select(i.alias("append_id"), "peer", ((i + p) % 4 != 0).alias("ok"), ((i * 7 + p) % 4).alias("ack_generation"))
    return m.select(i.alias("append_id"), (i % 3).alias("generation")), acks


@_query("replicate_quorum", f"{_ACKED} SELECT append_id, acks, acks + 1 >= 3 AS committed FROM counted")
def replicate_quorum(spark, d):
    return cluster.replicated(*_acked(spark, d), 5)


_query("agg_quorum", f"{_ACKED} SELECT acks + 1 >= 3 AS committed, count(*) AS n FROM counted GROUP BY ALL")(lambda spark, d: replicate_quorum(spark, d).groupBy("committed").agg(F.count("*").alias("n")))
_query("fence", f"{_ACKED} SELECT append_id, peer FROM acks3 JOIN appends USING (append_id) WHERE ack_generation < generation")(lambda spark, d: cluster.fenced(*_acked(spark, d)[::-1]).select("append_id", F.col("peer").cast("long").alias("peer")))
_query("generation_bump", "SELECT shard, node, count(*) AS generation FROM (SELECT user_id % 16 AS shard, event_id // 50 % 5 AS node, lag(event_id // 50 % 5) OVER (PARTITION BY user_id % 16 ORDER BY event_id) AS was FROM events) WHERE node IS DISTINCT FROM was GROUP BY ALL")(
    lambda spark, d: cluster.generations(T.messages(spark, d).select((F.col("routing_key").cast("long") % 16).alias("shard"), F.col("message_id").alias("seq"), (F.floor(F.col("message_id") / 50) % 5).alias("node")))
)
_LEASES = ", tries AS (SELECT topic AS name, published_at_ms // 200000 AS at_ms, message_id AS attempt_id, message_id % 4 AS node, CASE WHEN message_id % 3 = 0 THEN (message_id + 1) % 4 END AS dead, row_number() OVER (PARTITION BY topic ORDER BY published_at_ms // 200000, message_id) AS nth FROM messages)"


@_query("scheduler_lease", f"""{_LEASES}, walk AS (SELECT name, attempt_id, nth, node AS holder, at_ms + 5000 AS until, TRUE AS granted FROM tries WHERE nth = 1
  UNION ALL SELECT t.name, t.attempt_id, t.nth, CASE WHEN until <= t.at_ms OR holder = t.node OR holder = t.dead THEN t.node ELSE holder END, CASE WHEN until <= t.at_ms OR holder = t.node OR holder = t.dead THEN t.at_ms + 5000 ELSE until END, until <= t.at_ms OR holder = t.node OR coalesce(holder = t.dead, FALSE)
  FROM walk w JOIN tries t ON t.name = w.name AND t.nth = w.nth + 1) SELECT name, attempt_id, granted FROM walk""")
def scheduler_lease(spark, d):
    return cluster.lease(T.messages(spark, d).select(F.col("topic").alias("name"), F.floor(F.col("published_at_ms") / 200_000).alias("at_ms"), F.col("message_id").alias("attempt_id"), (F.col("message_id") % 4).alias("node"), F.when(F.col("message_id") % 3 == 0, F.array((F.col("message_id") + 1) % 4)).alias("dead")))


_query("forward_plan", f"{_LEADERS} SELECT message_id, leader, leader <> 0 AS forward FROM messages JOIN led ON shard = partition")(lambda spark, d: T.messages(spark, d).join(F.broadcast(_leaders(spark, d)), F.col("partition") == F.col("shard")).select("message_id", "leader", (F.col("leader") != 0).alias("forward")))
_query("membership_register", "SELECT n_name AS name FROM nation WHERE n_nationkey < 10 OR n_nationkey >= 12")(
    lambda spark, d: (n := T.read(spark, d, "nation").select(F.col("n_name").alias("name"), (F.col("n_nationkey") % 10).cast("string").alias("url"), "n_nationkey")).transform(
        lambda x: cluster.register(x.where("n_nationkey < 10").select("name", "url"), x.where("n_nationkey >= 10").select("name", F.when(F.col("n_nationkey") < 12, F.col("url")).otherwise(F.concat(F.lit("x"), "n_nationkey")).alias("url")))
    ).select("name")
)
_MERGE = ", config AS (SELECT n_nationkey AS id, 'http://' || lower(n_name) AS url FROM nation), runtime AS (SELECT n_nationkey AS id, CASE WHEN n_nationkey % 3 = 0 THEN 'http://new' || n_nationkey END AS url FROM nation WHERE n_nationkey % 2 = 0)"
_query("membership_merge", f"{_MERGE} SELECT id, coalesce(r.url, c.url) AS url FROM config c LEFT JOIN runtime r USING (id)")(
    lambda spark, d: (n := T.read(spark, d, "nation")).select(F.col("n_nationkey").cast("long").alias("id"), F.concat(F.lit("http://"), F.lower("n_name")).alias("url")).transform(
        lambda x: cluster.overlay(x, n.where("n_nationkey % 2 = 0").select(F.col("n_nationkey").cast("long").alias("id"), F.when(F.col("n_nationkey") % 3 == 0, F.concat(F.lit("http://new"), "n_nationkey")).alias("url")))
    )
)
_query("membership_remove", "SELECT n_name AS name FROM nation WHERE n_nationkey < 2 OR n_nationkey % 4 <> 0")(
    lambda spark, d: (n := T.read(spark, d, "nation").select(F.col("n_name").alias("name"), (F.col("n_nationkey") < 2).alias("is_seed"), "n_nationkey")).transform(lambda x: cluster.remove(x, x.where("n_nationkey % 4 = 0"), F.col("is_seed"))).select("name")
)
_query("agg_metrics", f"{_MANUAL}{_NODES} SELECT (SELECT count(*) FROM manual) AS blocked_hosts, (SELECT count_if(alive) FROM nodes) AS healthy_peers, (SELECT count(*) FROM log) AS stored_messages")(
    lambda spark, d: inspect.metrics(delivery.manual_blocks(_commands(spark, d), F.lit(_LATER)), _nodes(spark, d), _log(spark, d))
)
