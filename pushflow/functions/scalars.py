"""Scalar rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_PRIORITY, TOP_PRIORITY = 5, 9
DLQ, DIRECT, GROUP = ".__dlq", "__direct", "__group."
#: Payloads up to this size stay inline.
INLINE_BYTES = 256 * 1024
#: Statuses that end delivery at once.
PERMANENT = (400, 401, 403, 404, 422)


def priority(given: Column) -> Column:
    return F.least(F.coalesce(given, F.lit(DEFAULT_PRIORITY)), F.lit(TOP_PRIORITY)).cast("long")


def backoff_ms(kind: Column, initial: Column, most: Column, multiplier: Column, attempt: Column) -> Column:
    """Delay before attempt + 1, attempt counted from 1; a fixed delay ignores the maximum."""
    grown = F.least(initial * F.pow(multiplier, F.least(attempt, F.lit(16))), most.cast("double"))
    return F.when(kind == "fixed", initial).otherwise(F.round(grown)).cast("long")


def retry_after_ms(seconds: Column, most: Column) -> Column:
    return F.least(seconds * 1000, most)


def dlq_topic(topic: Column) -> Column:
    return F.concat(topic, F.lit(DLQ))


def group_topic(group: Column, member: Column | None = None) -> Column:
    base = F.concat(F.lit(GROUP), group.cast("string"))
    return base if member is None else F.concat(base, F.lit("."), member.cast("string"), F.lit(DLQ))


def is_dlq(topic: Column) -> Column:
    return topic.endswith(DLQ)


def is_group(topic: Column) -> Column:
    return topic.startswith(GROUP)


def source_kind(topic: Column) -> Column:
    """Kind of source that a dead-letter topic stands for."""
    return F.when(topic == DIRECT + DLQ, "direct").when(topic.startswith(GROUP), "group_member").when(topic.endswith(DLQ), "queue").otherwise("other")


def host_key(url: Column) -> Column:
    """scheme://host:port in lower case, with the scheme's port where none is given; null for what is no http URL."""
    scheme = F.lower(F.regexp_extract(url, r"^(?i)(https?)://[^/?#]+", 1))
    authority = F.regexp_extract(url, r"^(?i)https?://(?:[^/?#@]*@)?([^/?#]+)", 1)
    port = F.regexp_extract(authority, r":([0-9]+)$", 1)
    host = F.lower(F.regexp_replace(authority, r":[0-9]*$", ""))
    return F.when(scheme != "", F.concat(scheme, F.lit("://"), host, F.lit(":"), F.when(port != "", port).when(scheme == "https", "443").otherwise("80")))


def peer_url(url: Column) -> Column:
    """A peer's address for comparison: lower case, without trailing slashes."""
    return F.lower(F.regexp_replace(F.trim(url), "/+$", ""))


def destination_of_path(path: Column) -> Column:
    """The URL that a path spells, percent-encoded or not; null for what is no http URL or not well encoded."""
    url = F.try_url_decode(F.replace(F.trim(path), F.lit("+"), F.lit("%2B")))
    return F.when(url.rlike("^https?://"), url)


def normalize_cron(expression: Column) -> Column:
    """Five fields get a leading seconds field 0; anything else stays."""
    return F.when(F.size(F.split(F.trim(expression), r"\s+")) == 5, F.concat(F.lit("0 "), F.trim(expression))).otherwise(expression)


def signature(secret: str, body: Column, at_ms: Column) -> Column:
    """t=<ms>,v1=<hex HMAC-SHA256 of "<ms>.<body>">, from built-in hashes only. The key is a driver-side constant."""
    import hashlib

    key = secret.encode()
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytearray(b ^ pad for b in key)) for pad in (0x36, 0x5C))
    text = F.concat(at_ms.cast("string"), F.lit("."), body).cast("binary")
    digest = F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, text), 256))), 256)
    return F.concat(F.lit("t="), at_ms.cast("string"), F.lit(",v1="), digest)


def payload_text(body: Column) -> Column:
    """A JSON string is unwrapped; other JSON stays as text."""
    kind = F.schema_of_variant(F.try_parse_json(body))
    return F.when(kind == "STRING", F.variant_get(F.try_parse_json(body), "$", "string")).otherwise(body)


def decode_payload(body: Column, encoding: Column) -> Column:
    return F.when(encoding == "base64", F.try_to_binary(body, F.lit("base64"))).otherwise(body.cast("binary"))


def is_long(payload: Column) -> Column:
    """Whether the long-timeout client delivers the payload."""
    return F.octet_length(payload) >= INLINE_BYTES
