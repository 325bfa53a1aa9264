"""Replicated catalogues: merges, tombstones, upserts, deletes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def lww_latest(entries: DataFrame) -> DataFrame:
    """Of each id the version written last; ties go to the later source, then the later version."""
    cols = [c for c in entries.columns if c != "id"]
    best = F.max_by(F.struct(*cols), F.struct("updated_at_ms", "source", "version"))
    return entries.groupBy("id").agg(best.alias("_v")).select("id", *(F.col(f"_v.{c}").alias(c) for c in cols))


def tombstone_max(tombstones: DataFrame) -> DataFrame:
    return tombstones.groupBy("id").agg(F.max("deleted_at_ms").alias("deleted_at_ms"))


def without_deleted(entries: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Drops what was deleted at or after its last update."""
    joined = entries.join(tombstone_max(tombstones), "id", "left")
    return joined.where(F.col("deleted_at_ms").isNull() | (F.col("updated_at_ms") > F.col("deleted_at_ms"))).drop("deleted_at_ms")


def merge(entries: DataFrame, tombstones: DataFrame) -> DataFrame:
    return without_deleted(lww_latest(entries), tombstones)


def upsert_by_name(stored: DataFrame, given: DataFrame) -> DataFrame:
    """(tenant_id, name, id, url, secret, retries, backoff): one row per tenant and name.

    Keeps a stored id and overwrites url and secret; retry default and backoff only where one is given.
    """
    key = ["tenant_id", "name"]
    g = given.select(*key, *(F.col(c).alias(f"g_{c}") for c in ("id", "url", "secret", "retries", "backoff")))
    rows = stored.join(g, key, "full_outer")
    own = lambda c: F.when(F.col("g_id").isNotNull(), F.col(f"g_{c}")).otherwise(F.col(c)).alias(c)
    return rows.select(*key, F.coalesce("id", "g_id").alias("id"), own("url"), own("secret"), *(F.coalesce(f"g_{c}", c).alias(c) for c in ("retries", "backoff")))


def upsert_lww(stored: DataFrame, given: DataFrame) -> DataFrame:
    """stored and given(tenant_id, id, name, updated_at_ms): each given entry replaces the stored one of its
    tenant and id, or else the one of its tenant and name, unless that is strictly newer; or is added.

    Ids, and names, are distinct within a tenant on either side.
    """
    cols = stored.columns
    g = given.select(F.struct(*cols).alias("g"))
    s = stored.select(F.struct(*cols).alias("s"))
    by_id = g.join(s, (F.col("g.tenant_id") == F.col("s.tenant_id")) & (F.col("g.id") == F.col("s.id")), "left")
    rest = by_id.where(F.col("s").isNull()).select("g")
    by_name = rest.join(s, (F.col("g.tenant_id") == F.col("s.tenant_id")) & (F.col("g.name") == F.col("s.name")), "left")
    met = by_id.where(F.col("s").isNotNull()).unionByName(by_name)
    taken = met.where(F.col("s").isNull() | (F.col("s.updated_at_ms") <= F.col("g.updated_at_ms")))
    replaced = taken.where(F.col("s").isNotNull()).select("s.tenant_id", "s.id").distinct()
    return stored.join(replaced, ["tenant_id", "id"], "left_anti").select(cols).unionByName(taken.select("g.*"))


def upsert_flow(stored: DataFrame, given: DataFrame) -> DataFrame:
    """Profiles by key; parallelism and period have a floor of one, a rate of 0 is none."""
    g = given.select("key", *(F.col(c).alias(f"g_{c}") for c in ("parallelism", "rate", "period_secs")))
    rows = stored.join(g, "key", "full_outer")
    pick = lambda c, least: F.greatest(F.coalesce(f"g_{c}", c, F.lit(least)), F.lit(least)).cast("long").alias(c)
    return rows.select("key", pick("parallelism", 1), pick("rate", 0), pick("period_secs", 1))


def keep_first(rows: DataFrame, keys: list[str], position: str) -> DataFrame:
    """The first row of each key by position."""
    order = Window.partitionBy(*keys).orderBy(position)
    return rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def delete_cascade(groups: DataFrame, members: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Groups and members that stay, and tombstones for both kinds."""
    ids = gone.select("group_id").distinct()
    dead = groups.join(ids, "group_id").select(F.lit("group").alias("kind"), F.col("group_id").alias("id"))
    dead = dead.union(members.join(ids, "group_id").select(F.lit("member").alias("kind"), F.col("member_id").alias("id")))
    return groups.join(ids, "group_id", "left_anti"), members.join(ids, "group_id", "left_anti"), dead


def member_patch(members: DataFrame, patches: DataFrame) -> DataFrame:
    """Sparse update by member_id: each column that patches share with members, where a value is given.

    member_flow_key may also be set to nothing: sets_flow_key says that its value counts as it is.
    """
    fields = [c for c in patches.columns if c in members.columns and c != "member_id"]
    p = patches.select("member_id", "sets_flow_key", *(F.col(c).alias(f"p_{c}") for c in fields))
    rows = members.join(p, "member_id", "left")
    told = {c: F.coalesce(f"p_{c}", c) for c in fields}
    if "member_flow_key" in fields:
        told["member_flow_key"] = F.when(F.coalesce("sets_flow_key", F.lit(False)), F.col("p_member_flow_key")).otherwise(F.col("member_flow_key"))
    return rows.withColumns(told).select(members.columns)
