"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

Two permutations of the 32-bit words make the whole signature: every shingle is moved by
the first one, and coordinate k is the smallest value of the second one, circularly
shifted by k, over the set. Rows of a band make a bucket key. Documents that share a
bucket are candidates; every link is confirmed on the full shingle sets.

No bucket is expanded into all its pairs. Documents with equal sets are one class. In a
first step each class of a bucket is compared with the bucket's hub only, which is the
class that stands in most and largest buckets: of a group of copies, the one that the
others are nearest to. The links make components. In a second step those members of a
bucket that the hub's component does not hold are compared with the members of other
components, for a link between members of one component changes nothing. They are joined
on their rarest shingles, of which two linked sets must share one, early enough for what
follows to make up the link: exact, and few pairs where a frequent passage fills a bucket.
What is left out are pairs whose sizes already
rule the link out and pairs inside one component.

Cases: a text of fewer words than a shingle has its whole sequence as one shingle; null
and wordless texts have no set and are linked with nothing; rows repeated under one doc_id
are rows of their own that share their class; a null doc_id gets the smallest other doc_id
of its component, or null.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pushflow.llm.common import maybe_broadcast, mix, saved, shingles, slices, trim
from pushflow.llm.components import components

_U, _W = np.uint64, np.uint32


def _permute(x: np.ndarray, a: int, b: int) -> np.ndarray:
    """A permutation of the 32-bit words: odd multipliers and xor-shifts, each invertible."""
    x = x * _W(a)
    x ^= x >> _W(15)
    x *= _W(b)
    x ^= x >> _W(13)
    return x


#: Odd multipliers of the two permutations.
SIGMA, PI = (0x85EBCA6B, 0xC2B2AE35), (0x27D4EB2F, 0x165667B1)


def signatures(values: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """Circulant MinHash of the non-empty sets: `size` coordinates for each set with counts > 0."""
    first = np.concatenate([[0], np.cumsum(counts)])[:-1][counts > 0]
    out = np.empty((len(first), size), _W)
    moved = _permute((values >> _U(32)).astype(_W), *SIGMA)
    for k in range(size):
        out[:, k] = np.minimum.reduceat(_permute(moved - _W(k), *PI), first) if len(first) else 0
    return out


def set_keys(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A 64-bit key of each set, 0 for empty ones; independent of order."""
    out = np.zeros(len(counts), np.uint64)
    first = np.concatenate([[0], np.cumsum(counts)])[:-1][counts > 0]
    if len(first):
        out[counts > 0] = mix(np.add.reduceat(mix(values ^ _U(0x5851F42D4C957F2D)), first) + counts[counts > 0].astype(np.uint64))
    return out


def _sketch(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """doc_id, row (a hash of the text), n_shingles, key (null without a set) and band keys of every row."""

    def work(batches):
        for batch in slices(batches, most=1 << 20):
            values, counts = shingles(batch.column(1), width)
            signature = signatures(values, counts, bands * rows).reshape(-1, bands, rows)
            band = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), signature.shape[:2]).copy()
            for r in range(rows):
                band = mix(band * _U(0xD6E8FEB86659FD93) + signature[:, :, r])
            has = counts > 0
            ends = np.concatenate([[0], np.cumsum(has)]) * bands
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), batch.column(2), pa.array(counts, pa.int64()), pa.array(set_keys(values, counts).view(np.int64), mask=~has), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(band.ravel().view(np.int64)))],
                names=["doc_id", "row", "n_shingles", "key", "bands"],
            )
        trim()

    return docs.select("doc_id", "text", F.xxhash64("text").alias("row")).mapInArrow(work, "doc_id long, row long, n_shingles long, key long, bands array<long>")


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """key and sorted distinct shingles, as bytes."""

    def work(batches):
        for batch in slices(batches, most=1 << 20):
            values, counts = shingles(batch.column(1), width)
            ends = np.concatenate([[0], np.cumsum(counts)]) * 8
            raw = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(values.tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array(set_keys(values, counts).view(np.int64)), raw], names=["key", "shingles"])
        trim()

    return docs.select("doc_id", "text").mapInArrow(work, "key long, shingles binary")


def _linked(joined: DataFrame, percent: int) -> DataFrame:
    """(a, b, left, right) to the pairs with 100 * intersection >= percent * union."""

    def work(batches):
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                shared = len(x) + len(y) - len(np.union1d(x, y))
                keep[i] = 100 * shared >= percent * (len(x) + len(y) - shared)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), batch.column(1).filter(pa.array(keep))], names=["a", "b"])

    return joined.select("a", "b", "left", "right").mapInArrow(work, "a long, b long")


def _sets_of(keys: DataFrame, classes: DataFrame, docs: DataFrame, width: int, tag: str) -> DataFrame:
    """keys(key) to key and shingles, from the text of one document of each class."""
    wanted = keys.join(classes.select("key", "rep"), "key").select(F.col("rep").alias("doc_id")).distinct()
    texts = docs.select("doc_id", "text").join(maybe_broadcast(saved(wanted, f"{tag}-wanted")), "doc_id", "left_semi")
    # a class may have rows without doc_id only
    texts = texts.select("doc_id", "text").union(docs.select("doc_id", "text").where("doc_id is null"))
    # a doc_id may stand for several rows; keys that were not asked for fall out of the joins
    return _sets(texts, width).groupBy("key").agg(F.first("shingles").alias("shingles"))


def _verify(pairs: DataFrame, classes: DataFrame, docs: DataFrame, width: int, percent: int, tag: str) -> DataFrame:
    """Confirm pairs of class keys on the full sets."""
    ends = pairs.select(F.col("a").alias("key")).distinct().union(pairs.select(F.col("b").alias("key")).distinct()).distinct()
    sets = _sets_of(ends, classes, docs, width, tag)
    left = sets.select(F.col("key").alias("a"), F.col("shingles").alias("left"))
    right = sets.select(F.col("key").alias("b"), F.col("shingles").alias("right"))
    return saved(_linked(pairs.join(left, "a").join(right, "b"), percent), f"{tag}-links")


def _prefixes(nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of each node(node, n, ...) its rarest shingles, as many as a partner must share one of.

    A partner lacks at most n - ceil(percent / 100 * n) of the n shingles, so whatever the
    order, as long as it is one for all, the first of both sets up to one more than that
    have one in common. Rare ones first keeps apart what only shares a frequent passage.
    rank is a shingle's place: of the first common one of a pair, no more than what follows
    it in the shorter rest can be common.
    """

    def work(batches):
        for batch in batches:
            for key, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                values = np.frombuffer(raw.as_buffer(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), key)), pa.array(values)], names=["node", "shingle"])

    rows = sets.select("key", "shingles").mapInArrow(work, "node long, shingle long").join(nodes, "node")
    often = rows.groupBy("shingle").agg(F.count("*").alias("often"))
    rank = F.row_number().over(Window.partitionBy("node").orderBy("often", "shingle"))
    first = F.col("n") - F.floor((F.col("n") * percent + 99) / 100) + 1
    return rows.join(often, "shingle").withColumn("rank", rank).where((F.col("rank") <= first) & (F.col("often") > 1)).drop("often")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, bands: int = 25, rows: int = 5) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, n_shingles, component_id, kept.

    At similarity s a pair is missed with probability (1 - s**rows)**bands: 1e-6 at the
    default for 0.85, 5e-5 for 0.8.
    """
    judged = _judged(docs, width, percent, bands, rows)
    of_class = F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("least"))
    return judged.select("doc_id", "n_shingles", of_class.alias("component_id"), F.coalesce(F.col("doc_id") == of_class, F.lit(False)).alias("kept"))


def deduplicated(docs: DataFrame, width: int = 5, percent: int = 80, bands: int = 25, rows: int = 5) -> DataFrame:
    """docs(doc_id, text, ...) with one row of each component: that of smallest doc_id, those without one last,
    and of these that of smallest text hash. Rows without a set stay; rows equal in doc_id and text go or stay together.
    """
    judged = _judged(docs, width, percent, bands, rows).where("key is not null")
    gone = judged.where(~F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row").eqNullSafe(F.col("first"))).select(F.col("doc_id").alias("own_id"), F.col("row").alias("own_row")).distinct()
    gone = maybe_broadcast(saved(gone, "copies"))
    same_row = docs["doc_id"].eqNullSafe(gone["own_id"]) & (F.xxhash64(docs["text"]) == gone["own_row"])
    return docs.join(gone, same_row, "left_anti")


def _judged(docs: DataFrame, width: int, percent: int, bands: int, rows: int) -> DataFrame:
    """doc_id, row, n_shingles and key of every row, and of its component the smallest doc_id and the first row."""
    sketch = saved(_sketch(docs, width, bands, rows), "sketch")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")
    classes = saved(sketch.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("rep"), first, F.first("n_shingles").alias("n"), F.first("bands").alias("bands")), "classes")
    members = classes.select(F.explode("bands").alias("bucket"), F.col("key").alias("node"), "n")
    sizes = members.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    shared = saved(members.join(sizes, "bucket"), "buckets")  # members of buckets of two or more
    weights = shared.groupBy("node").agg(F.sum("size").alias("weight"))
    weighed = shared.join(weights, "node")
    hubs = weighed.groupBy("bucket").agg(F.max(F.struct("weight", "node", "n")).alias("hub")).select("bucket", F.col("hub.node").alias("hub"), F.col("hub.n").alias("hub_n"))
    shared = saved(shared.join(hubs, "bucket").drop("size"), "hubs")
    fits = lambda a, b: F.col(a) * 100 >= F.col(b) * percent  # noqa: E731  an intersection is no larger than the smaller set
    stars = saved(shared.where(fits("n", "hub_n") & fits("hub_n", "n") & (F.col("node") != F.col("hub"))).select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct(), "stars")
    links = _verify(stars, classes, docs, width, percent, "stars")
    part = components(links)
    # members that are not in their hub's component, against members of other components
    placed = shared.join(part.withColumnRenamed("node", "node_"), F.col("node") == F.col("node_"), "left").withColumn("part", F.coalesce("component", "node")).drop("node_", "component")
    placed = placed.join(part.select(F.col("node").alias("hub_"), F.col("component").alias("hub_part")), F.col("hub") == F.col("hub_"), "left").withColumn("hub_part", F.coalesce("hub_part", "hub")).drop("hub_")
    placed = saved(placed, "placed")
    open_buckets = placed.where("part <> hub_part").select("bucket").distinct()
    opened = placed.join(open_buckets, "bucket", "left_semi").groupBy("node").agg(F.first("n").alias("n"), F.first("part").alias("part"), F.max(F.col("part") != F.col("hub_part")).alias("apart"))
    opened = saved(opened, "opened")
    prefixes = saved(_prefixes(opened, _sets_of(opened.select(F.col("node").alias("key")), classes, docs, width, "opened"), percent), "prefixes")
    rest = prefixes.where("apart").select(F.col("shingle").alias("x_shingle"), F.col("node").alias("x"), F.col("n").alias("x_n"), F.col("rank").alias("x_rank"), F.col("part").alias("x_part"))
    common = F.least(F.col("n") - F.col("rank"), F.col("x_n") - F.col("x_rank")) + 1
    may = (F.col("part") != F.col("x_part")) & fits("n", "x_n") & fits("x_n", "n") & (common * (100 + percent) >= (F.col("n") + F.col("x_n")) * percent)
    pairs = prefixes.join(rest, (F.col("shingle") == F.col("x_shingle")) & may)
    pairs = saved(pairs.select(F.least("x", "node").alias("a"), F.greatest("x", "node").alias("b")).distinct(), "pairs")
    pairs = pairs.join(stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
    links = links.union(_verify(saved(pairs, "open-pairs"), classes, docs, width, percent, "pairs"))
    part = components(links)
    whole = classes.join(part, F.col("key") == F.col("node"), "left").select("key", "rep", "first", F.coalesce("component", "key").alias("part"))
    least = whole.groupBy("part").agg(F.min("rep").alias("least"), F.min("first").alias("first"))
    of_class = whole.select("key", "part").join(least, "part").select("key", "least", "first")
    return sketch.select("doc_id", "row", "n_shingles", "key").join(of_class, "key", "left")


def missed(similarity: float, bands: int = 25, rows: int = 5) -> float:
    """Probability that a pair of that similarity shares no bucket."""
    return math.pow(1 - similarity**rows, bands)
