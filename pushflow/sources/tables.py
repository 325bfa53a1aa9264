"""Message-model tables derived from the driver's tables, by integer arithmetic only.

Every function here has its SQL twin in CTES, so that a query and its check start from the
same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TENANT = "default"
PARTITIONS = 4


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch_ms(ts: Column) -> Column:
    """Milliseconds since 1970 of a timestamp without zone, whatever the session's zone."""
    day = F.unix_date(F.to_date(ts)).cast("long") * 86_400_000
    return day + F.hour(ts) * 3_600_000 + F.minute(ts) * 60_000 + F.floor(F.extract(F.lit("SECOND"), ts) * 1000).cast("long")


def partition_of(tenant: Column, topic: Column, key: Column, n: int = PARTITIONS) -> Column:
    """Partition of a routing key: a stable hash modulo n."""
    digest = F.substring(F.md5(F.concat_ws("|", tenant, topic, key).cast("binary")), 1, 15)
    return (F.conv(digest, 16, 10).cast("long") % n).cast("long")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Publish requests: one for each event."""
    e, i = read(spark, sf_dir, "events"), F.col("event_id")
    key = F.col("user_id").cast("string")
    return e.select(
        F.lit(TENANT).alias("tenant_id"),
        i.alias("message_id"),
        F.col("event_type").alias("topic"),
        key.alias("routing_key"),
        epoch_ms(F.col("ts")).alias("published_at_ms"),
        F.when(i % 10 != 0, i % 13).alias("priority_in"),
        F.when(i % 4 == 0, F.concat_ws(":", "user_id", i % 7)).alias("idempotency_key"),
        F.when(i % 3 != 0, i % 4).alias("max_retries_in"),
        F.when(i % 5 == 0, F.col("event_type")).alias("flow_key_in"),
        F.col("props").alias("payload"),
        F.when(i % 6 == 0, (i % 9) * 60_000).alias("delay_ms"),
        (F.col("user_id") % 5).alias("group_id"),
        partition_of(F.lit(TENANT), F.col("event_type"), key).alias("partition"),
    )


def queues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A queue for each topic: where to push, and its retry default."""
    topics = read(spark, sf_dir, "events").select(F.col("event_type").alias("topic")).distinct()
    t = F.col("topic")
    retries = F.when(t == "error", 5).when(t == "click", 1).when(t == "purchase", 3).cast("long")
    return topics.select(t.alias("queue_id"), "topic", F.concat(F.lit("https://"), t, F.lit(".example.com/hook")).alias("url"), F.concat(F.lit("sec-"), t).alias("secret"), retries.alias("default_max_retries"), F.lit(False).alias("paused"))


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of dispatch groups: nations of regions."""
    n = F.col("n_nationkey").cast("long")
    return read(spark, sf_dir, "nation").select(
        F.col("n_regionkey").cast("long").alias("group_id"),
        n.alias("member_id"),
        F.concat(F.lit("https://"), F.lower(F.replace("n_name", F.lit(" "), F.lit("-"))), F.lit(".example.com")).alias("url"),
        (n % 7 == 0).alias("paused"),
        (n % 3 + 1).alias("parallelism"),
        (n % 4).alias("rate"),
        F.lit(60).cast("long").alias("period_secs"),
        F.when(n % 2 == 1, F.col("n_name")).alias("member_flow_key"),
    )


def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.col("r_regionkey").cast("long")
    return read(spark, sf_dir, "region").select(r.alias("group_id"), F.col("r_name").alias("name"), (r == 4).alias("group_paused"))


def attempts(messages: DataFrame) -> DataFrame:
    """HTTP status of each possible attempt of each message; null is a transport error."""
    rows = messages.select("message_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(5).cast("long"))).alias("attempt"))
    case = (F.col("message_id") * 31 + F.col("attempt") * 17) % 10
    status = F.when(case.isin(4, 5), 500).when(case == 6, 404).when(case == 7, 429).when(case == 9, 503).when(case != 8, 200)
    return rows.withColumn("status", status.cast("long"))


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of catalogue entries from three sources."""
    s = F.col("s_suppkey")
    return read(spark, sf_dir, "supplier").select((s % 40).alias("id"), (s % 3).alias("source"), (s % 11 * 1000).alias("updated_at_ms"), F.col("s_name").alias("name"), s.alias("version"))


def tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("s_suppkey")
    return read(spark, sf_dir, "supplier").where(s % 13 == 0).select((s % 40).alias("id"), F.lit(5000).cast("long").alias("deleted_at_ms"))


#: The same tables in SQL.
CTES = f"""
messages AS (
  SELECT '{TENANT}' AS tenant_id, event_id AS message_id, event_type AS topic, user_id::VARCHAR AS routing_key,
    epoch_us(ts) // 1000 AS published_at_ms,
    CASE WHEN event_id % 10 <> 0 THEN event_id % 13 END AS priority_in,
    CASE WHEN event_id % 4 = 0 THEN user_id || ':' || (event_id % 7) END AS idempotency_key,
    CASE WHEN event_id % 3 <> 0 THEN event_id % 4 END AS max_retries_in,
    CASE WHEN event_id % 5 = 0 THEN event_type END AS flow_key_in,
    props AS payload, CASE WHEN event_id % 6 = 0 THEN (event_id % 9) * 60000 END AS delay_ms, user_id % 5 AS group_id,
    ('0x' || substr(md5('{TENANT}|' || event_type || '|' || user_id), 1, 15))::BIGINT % {PARTITIONS} AS partition
  FROM events),
queues AS (
  SELECT DISTINCT event_type AS queue_id, event_type AS topic, 'https://' || event_type || '.example.com/hook' AS url,
    'sec-' || event_type AS secret,
    (CASE event_type WHEN 'error' THEN 5 WHEN 'click' THEN 1 WHEN 'purchase' THEN 3 END)::BIGINT AS default_max_retries, FALSE AS paused
  FROM events),
members AS (
  SELECT n_regionkey::BIGINT AS group_id, n_nationkey::BIGINT AS member_id,
    'https://' || lower(replace(n_name, ' ', '-')) || '.example.com' AS url, n_nationkey % 7 = 0 AS paused,
    (n_nationkey % 3 + 1)::BIGINT AS parallelism, (n_nationkey % 4)::BIGINT AS rate, 60::BIGINT AS period_secs,
    CASE WHEN n_nationkey % 2 = 1 THEN n_name END AS member_flow_key
  FROM nation),
groups_ AS (SELECT r_regionkey::BIGINT AS group_id, r_name AS name, r_regionkey = 4 AS group_paused FROM region),
attempts AS (
  SELECT message_id, attempt, (CASE (message_id * 31 + attempt * 17) % 10 WHEN 4 THEN 500 WHEN 5 THEN 500 WHEN 6 THEN 404
    WHEN 7 THEN 429 WHEN 8 THEN NULL WHEN 9 THEN 503 ELSE 200 END)::BIGINT AS status
  FROM messages, range(6) AS r(attempt)),
entries AS (
  SELECT s_suppkey % 40 AS id, s_suppkey % 3 AS source, s_suppkey % 11 * 1000 AS updated_at_ms, s_name AS name, s_suppkey AS version
  FROM supplier),
tombstones AS (SELECT s_suppkey % 40 AS id, 5000::BIGINT AS deleted_at_ms FROM supplier WHERE s_suppkey % 13 = 0),
accepted AS (
  SELECT * EXCLUDE (nth) FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id, coalesce(idempotency_key, 'm' || message_id),
    idempotency_key IS NULL ORDER BY message_id) AS nth FROM messages) WHERE nth = 1),
log AS (SELECT *, row_number() OVER (PARTITION BY topic, partition ORDER BY message_id) - 1 AS log_offset FROM accepted)
"""
