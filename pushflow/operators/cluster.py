"""Nodes and shards as tables: liveness, election, quorum, membership."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pushflow.operators.walk import walked

PEER_TTL_MS = 10_000
LEASE_MS = 5_000


def alive(nodes: DataFrame, now_ms: int, own: int) -> DataFrame:
    """This node always; others if seen within the time to live."""
    return nodes.withColumn("alive", (F.col("node") == own) | F.coalesce(F.lit(now_ms) - F.col("last_seen_ms") <= PEER_TTL_MS, F.lit(False)))


def leaders(nodes: DataFrame, shards: DataFrame) -> DataFrame:
    """Of each shard the preferred node and the first alive one round the ring from it; none alive: the preferred.

    nodes(node, idx, alive): node and shard tables are a cluster's configuration, small by nature.
    """
    n = nodes.agg(F.count("*").alias("n"))
    pairs = shards.join(F.broadcast(n)).withColumn("start", F.col("shard") % F.col("n")).join(F.broadcast(nodes))
    step = F.pmod(F.col("idx") - F.col("start"), F.col("n"))
    found = pairs.groupBy("shard").agg(
        F.max(F.when(F.col("idx") == F.col("start"), F.col("node"))).alias("preferred"),
        F.min_by(F.when(F.col("alive"), F.col("node")), F.when(F.col("alive"), step)).alias("elected"),
    )
    return found.withColumn("leader", F.coalesce("elected", "preferred")).withColumn("failover", F.col("leader") != F.col("preferred")).drop("elected")


def status(led: DataFrame, nodes: DataFrame) -> DataFrame:
    """Of each node whether it is alive, the shards that it leads, those of them that are another's by preference, and its own by preference."""
    leads = led.groupBy(F.col("leader").alias("node")).agg(F.count("*").alias("led"), F.count_if("failover").alias("failovers"))
    prefers = led.groupBy(F.col("preferred").alias("node")).agg(F.count("*").alias("preferred_shards"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return nodes.select("node", "alive").join(leads, "node", "left").join(prefers, "node", "left").select("node", "alive", zero("led"), zero("failovers"), zero("preferred_shards"))


def fenced(acks: DataFrame, appends: DataFrame) -> DataFrame:
    """Acks of a generation older than their append's: they do not count."""
    return acks.join(appends, "append_id").where("ack_generation < generation").select(acks.columns)


def quorum(acks: Column, nodes: Column) -> Column:
    return acks + 1 >= F.floor(nodes / 2) + 1


def replicated(appends: DataFrame, acks: DataFrame, nodes: int) -> DataFrame:
    """Whether each append has its quorum; acks of an older generation are fenced off."""
    joined = acks.join(appends, "append_id").where("ok and ack_generation >= generation")
    count = joined.groupBy("append_id").agg(F.count_distinct("peer").alias("acks"))
    rows = appends.join(count, "append_id", "left").withColumn("acks", F.coalesce("acks", F.lit(0)).cast("long"))
    return rows.select("append_id", "acks", quorum(F.col("acks"), F.lit(nodes)).alias("committed"))


def generations(leadership: DataFrame) -> DataFrame:
    """leadership(shard, seq, node): how often each node has gained each shard."""
    before = F.lag("node").over(Window.partitionBy("shard").orderBy("seq"))
    gained = leadership.withColumn("_was", before).where(~F.col("node").eqNullSafe(F.col("_was")))
    return gained.groupBy("shard", "node").agg(F.count("*").alias("generation"))


def lease(attempts: DataFrame) -> DataFrame:
    """attempts(name, at_ms, attempt_id, node, dead): granted if free, run out, already one's own, or held by a dead node.

    dead: the nodes that the one which tries sees as dead just then, as an array; null is none.
    """

    def step(state: list, at: int, node: int, dead: list | None) -> bool:
        holder, until = state
        granted = holder is None or until <= at or holder == node or holder in (dead or ())
        if granted:
            state[:] = [node, at + LEASE_MS]
        return granted

    return walked(attempts, "name", ["at_ms", "attempt_id"], ["at_ms", "node", "dead"], lambda: [None, 0], step, ["attempt_id"], "granted boolean")


def register(known: DataFrame, given: DataFrame) -> DataFrame:
    """Adds nodes whose name and url are both new."""
    new = given.join(known.select("name"), "name", "left_anti").join(known.select("url"), "url", "left_anti")
    return known.unionByName(new.select(known.columns))


def remove(known: DataFrame, gone: DataFrame, seed: Column) -> DataFrame:
    """Nodes without those that are taken out by name; seeds stay."""
    return known.where(seed).unionByName(known.where(~seed).join(gone.select("name").distinct(), "name", "left_anti").select(known.columns))


def overlay(configured: DataFrame, runtime: DataFrame) -> DataFrame:
    """Configured nodes with the url they run under now, where one is known."""
    now = runtime.select("id", F.col("url").alias("_url"))
    return configured.join(now, "id", "left").select("id", F.coalesce("_url", "url").alias("url"))


def gossip(views: DataFrame) -> DataFrame:
    return views.groupBy("node").agg(F.max("last_seen_ms").alias("last_seen_ms"))
