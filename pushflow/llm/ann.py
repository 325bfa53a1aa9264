"""Approximate nearest neighbours by cross-polytope hashing with multiprobe tables.

A hash is a pseudo-random rotation (three rounds of random signs and a fast Hadamard
transform) of the unit vector, and the signed axis nearest to it; a table's bucket is made
of `axes` such hashes. A query visits, in each table, the `probes` buckets whose axes it is
nearest to. What the buckets hold is reranked by exact distance of the original vectors.

Rows with equal vectors are one class, which keeps its TOP + 1 smallest vec_ids: no other
row of the class can be among the TOP nearest of any query. Classes, not rows, are
indexed. A bucket of more than CHUNK classes is dealt out over several groups and the
queries that visit it are sent to each, and so is one that more than ASKED queries visit; a
group gives the best TOP + 1 of each query, so what is shuffled grows with queries and probes,
not with pairs.

The buckets nearest to a query are found without listing all: sums of one nearness an axis, of
which the k largest only take combinations whose places, counted from 1 on each axis, multiply
to at most k. The number of probes is fitted on FIT_QUERIES vectors that are not queries (where
there are any), whose true neighbours one pass over all vectors finds: the smallest that reaches
TARGET of them. The number of axes follows the number of vectors. A query for which the visited
buckets hold too few candidates visits MORE times as many, and so on until it has enough or has
visited all.

Cases: vectors that are null, empty, all zero or hold null or non-finite components take
no part; vectors are compared with those of their own length only; repeated rows of one
vec_id and vector are one; rows of the query's vec_id are never its neighbours; fewer
candidates than TOP give fewer rows; no queries give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pushflow.llm.common import maybe_broadcast, saved

TOP = 10
TABLES = 8
CHUNK = 4_000
#: Queries of a bucket in one group.
ASKED = 2_000
#: Vectors from which a bucket has one more axis: so many in a bucket of the smaller kind.
CROWDED = 4_000
FIT_QUERIES = 96
TARGET = 0.97
MORE = 8


def usable(vector: Column) -> Column:
    """Whether a vector takes part."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.exists(vector, lambda x: x != 0) & fine, F.lit(False))


def _hadamard(x: np.ndarray) -> np.ndarray:
    h, (n, d) = 1, x.shape
    while h < d:
        x = x.reshape(n, -1, 2, h)
        x = np.concatenate([x[:, :, :1] + x[:, :, 1:], x[:, :, :1] - x[:, :, 1:]], axis=2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def rotated(vectors: np.ndarray, table: int, axis: int) -> np.ndarray:
    """Nearness of each vector to the signed axes: d values for the positive ones, then the negative ones."""
    n, d = vectors.shape
    size = 1 << max(1, (d - 1).bit_length())
    x = np.zeros((n, size))
    x[:, :d] = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    rng = np.random.default_rng([d, table, axis])
    for _ in range(3):
        x = _hadamard(x * rng.choice([-1.0, 1.0], size))
    return np.concatenate([x, -x], axis=1)


def width(d: int) -> int:
    """Signed axes of a vector of length d."""
    return 2 << max(1, (d - 1).bit_length())


def bucket_of(vectors: np.ndarray, table: int, axes: int) -> np.ndarray:
    out = np.zeros(len(vectors), np.int64)
    for a in range(axes):
        near = rotated(vectors, table, a)
        out = out * near.shape[1] + near.argmax(1)
    return out


def combinations(k: int, axes: int, size: int) -> np.ndarray:
    """Places on each axis, from 0 on, of the combinations that the k largest sums may be of."""
    if axes == 0:
        return np.zeros((1, 0), np.int64)
    out = []
    for i in range(min(k, size)):
        rest = combinations(k // (i + 1), axes - 1, size)
        out.append(np.concatenate([np.full((len(rest), 1), i), rest], axis=1))
    return np.concatenate(out)


def probed(vectors: np.ndarray, table: int, axes: int, k: int) -> np.ndarray:
    """The k buckets of a table that each vector is nearest to, or all; memory grows with k, not with the buckets."""
    size = width(vectors.shape[1])
    k = min(k, size**axes)
    places = combinations(k, axes, size)
    total, bucket = np.zeros((len(vectors), len(places))), np.zeros((len(vectors), len(places)), np.int64)
    for a in range(axes):
        near = rotated(vectors, table, a)
        order = np.argsort(-near, axis=1, kind="stable")
        total += np.take_along_axis(near, order, axis=1)[:, places[:, a]]
        bucket = bucket * size + order[:, places[:, a]]
    best = np.argpartition(-total, k - 1, axis=1)[:, :k]
    return np.take_along_axis(bucket, best, axis=1)


def place_of(vector: np.ndarray, bucket: np.ndarray, table: int, axes: int) -> np.ndarray:
    """How many buckets of a table a vector is nearer to than to each of some: counted from sums over half of the axes."""
    size = width(len(vector))
    near = [rotated(vector[None], table, a)[0] for a in range(axes)]
    own, rest = np.zeros(len(bucket)), bucket
    for a in reversed(range(axes)):
        own, rest = own + near[a][rest % size], rest // size
    halves = []
    for half in (near[: axes // 2], near[axes // 2 :]):
        sums = np.zeros(1)
        for x in half:
            sums = (sums[:, None] + x).ravel()
        halves.append(np.sort(sums))
    few, many = halves
    return np.array([int((len(many) - np.searchsorted(many, x - few + 1e-12, "right")).sum()) for x in own], np.int64)


def _key(d: int, table: int, bucket: np.ndarray) -> np.ndarray:
    return (np.int64(d) << 46) | (np.int64(table) << 40) | bucket


def _vectors(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Rows of each length and their vectors in double precision."""
    lengths = np.asarray(pc.list_value_length(column))
    return [(at := np.flatnonzero(lengths == d), np.asarray(column.take(pa.array(at)).flatten(), np.float64).reshape(-1, d)) for d in np.unique(lengths)]


def classes_of(rows: DataFrame) -> DataFrame:
    """rows(vec_id, vector) to one row per vector: cls, first (its smallest vec_id), ids, vector."""
    order = Window.partitionBy("vector").orderBy("vec_id")
    few = rows.where(usable(F.col("vector")) & F.col("vec_id").isNotNull()).distinct().withColumn("at", F.row_number().over(order)).where(F.col("at") <= TOP + 1)
    return few.groupBy("vector").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).select(F.xxhash64("vector").alias("cls"), F.col("ids")[0].alias("first"), "ids", "vector")


def _points(classes: DataFrame, axes: int, tables: int) -> DataFrame:
    def work(batches):
        for batch in batches:
            for at, vectors in _vectors(batch.column(2)):
                part = batch.take(pa.array(at))
                for t in range(tables):
                    yield pa.RecordBatch.from_arrays([pa.array(_key(vectors.shape[1], t, bucket_of(vectors, t, axes))), *part.columns], names=["bucket", "cls", "first", "vector"])

    kind = classes.schema["vector"].dataType.simpleString()
    return classes.select("cls", "first", "vector").mapInArrow(work, f"bucket long, cls long, first long, vector {kind}")


def _probes(queries: DataFrame, axes: int, tables: int, probes: int) -> DataFrame:
    """A row for each bucket that a query visits."""

    def work(batches):
        for batch in batches:
            for at, vectors in _vectors(batch.column(1)):
                part = batch.take(pa.array(at))
                size = width(vectors.shape[1])
                few = max(1, min(64, (1 << 22) // len(combinations(min(probes, size**axes), axes, size))))
                for i in range(0, len(at), few):
                    for t in range(tables):
                        best = probed(vectors[i : i + few], t, axes, probes)
                        rows = pa.array(np.repeat(np.arange(i, i + len(best)), best.shape[1]))
                        yield pa.RecordBatch.from_arrays([pa.array(_key(vectors.shape[1], t, best.ravel())), *part.take(rows).columns], names=["bucket", "cls", "vector"])

    kind = queries.schema["vector"].dataType.simpleString()
    return queries.select("cls", "vector").mapInArrow(work, f"bucket long, cls long, vector {kind}")


def _best(query: np.ndarray, points: np.ndarray, first: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """The points nearest to one query, ties to the smaller first."""
    distance = np.sqrt(((points - query) ** 2).sum(1))
    if len(distance) > keep:
        near = np.flatnonzero(distance <= np.partition(distance, keep - 1)[keep - 1])
    else:
        near = np.arange(len(distance))
    near = near[np.lexsort((first[near], distance[near]))][:keep]
    return near, distance[near]


MATCHES = "query long, cls long, first long, score double"


def _search(points: DataFrame, probes: DataFrame) -> DataFrame:
    """The best classes of every query, from the buckets it visits."""
    sizes = points.groupBy("bucket").count().where(F.col("count") > CHUNK).select("bucket", F.ceil(F.col("count") / CHUNK).cast("int").alias("parts"))
    visits = probes.groupBy("bucket").count().where(F.col("count") > ASKED).select("bucket", F.ceil(F.col("count") / ASKED).cast("int").alias("lots"))
    crowded = maybe_broadcast(saved(sizes.join(visits, "bucket", "full_outer"), "crowded"))
    parts, lots = F.coalesce("parts", F.lit(1)), F.coalesce("lots", F.lit(1))
    own = lambda n, seed: F.pmod(F.xxhash64("cls", F.lit(seed)), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    left = points.join(crowded, "bucket", "left").withColumn("part", own(parts, 3)).withColumn("lot", every(lots)).drop("parts", "lots")
    right = probes.join(crowded, "bucket", "left").withColumn("lot", own(lots, 5)).withColumn("part", every(parts)).drop("parts", "lots")

    def match(a: pa.Table, b: pa.Table) -> pa.Table:
        out = []
        if a.num_rows and b.num_rows:
            (_, points), (_, queries) = _vectors(a["vector"].combine_chunks())[0], _vectors(b["vector"].combine_chunks())[0]
            first, cls, of = (t[c].to_numpy() for t, c in ((a, "first"), (a, "cls"), (b, "cls")))
            for q in range(len(queries)):
                near, distance = _best(queries[q], points, first, TOP + 1)
                out.append((np.full(len(near), of[q]), cls[near], first[near], distance))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0)] * 4
        return pa.table([pa.array(c.astype(k)) for c, k in zip(columns, ("i8", "i8", "i8", "f8"), strict=True)], names=["query", "cls", "first", "score"])

    found = left.groupBy("bucket", "part", "lot").cogroup(right.groupBy("bucket", "part", "lot")).applyInArrow(match, MATCHES)
    return _top(found.distinct())


def _top(found: DataFrame) -> DataFrame:
    order = Window.partitionBy("query").orderBy("score", "first", "cls")
    return found.withColumn("at", F.row_number().over(order)).where(F.col("at") <= TOP + 1).drop("at")


def fitted_probes(classes: DataFrame, queries: DataFrame, axes: int, tables: int) -> int:
    """The smallest number of probes that reaches TARGET of the true neighbours of a few queries."""
    others = classes.join(queries.select("cls"), "cls", "left_anti")
    pick = lambda rows: rows.select("cls", "vector").orderBy(F.xxhash64("cls", F.lit(1)), "cls").limit(FIT_QUERIES).collect()
    sample = pick(others) or pick(queries)
    own = [(r.cls, np.asarray(r.vector, np.float64)) for r in sample]
    kind = classes.schema["vector"].dataType.simpleString()

    def work(batches):
        held: dict[int, pa.RecordBatch] = {}  # of each query the nearest so far
        for batch in batches:
            for at, vectors in _vectors(batch.column(2)):
                part = batch.take(pa.array(at))
                first = part.column(1).to_numpy(zero_copy_only=False)
                for cls, q in own:
                    if len(q) == vectors.shape[1]:
                        near, distance = _best(q, vectors, first, TOP + 1)
                        rows = part.take(pa.array(near))
                        new = pa.RecordBatch.from_arrays([pa.array(np.full(len(near), cls)), rows.column(0), rows.column(1), pa.array(distance), rows.column(2)], names=["query", "cls", "first", "score", "vector"])
                        both = pa.Table.from_batches([held[cls], new] if cls in held else [new])
                        held[cls] = both.sort_by([("score", "ascending"), ("first", "ascending"), ("cls", "ascending")]).slice(0, TOP + 1).combine_chunks().to_batches()[0]
        yield from held.values()

    true = _top(classes.select("cls", "first", "vector").mapInArrow(work, f"{MATCHES}, vector {kind}")).where("query <> cls").collect()
    at, ranks, near = dict(own), [], {}
    for r in true:
        near.setdefault(r["query"], []).append(np.asarray(r.vector, np.float64))
    for t in range(tables):
        ranks.append(np.concatenate([np.zeros(0, np.int64), *(place_of(at[q], bucket_of(np.stack(x), t, axes), t, axes) for q, x in near.items())]))
    best = np.sort(np.min(np.array(ranks), axis=0)) if true else np.zeros(1)
    return int(best[min(len(best) - 1, int(np.ceil(TARGET * len(best))) - 1)]) + 1


def neighbours(rows: DataFrame, is_query: Column, tables: int = TABLES) -> DataFrame:
    """rows(vec_id, vector): query_id, rank, vec_id, score of the TOP nearest of every row that is_query marks."""
    rows = rows.select("vec_id", "vector")
    classes = saved(classes_of(rows), "classes")
    asked = rows.where(is_query & usable(F.col("vector"))).select(F.col("vec_id").alias("query_id"), F.xxhash64("vector").alias("cls"), "vector").distinct()
    queries = saved(asked.select("cls", "vector").distinct(), "queries")
    told = classes.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("d")).first()
    axes = 1
    while told.n and told.n / width(told.d) ** axes > CROWDED and width(told.d) ** (axes + 1) < 1 << 40:
        axes += 1
    probes = fitted_probes(classes, queries, axes, tables)
    points = _points(classes, axes, tables)
    found = saved(_search(points, _probes(queries, axes, tables, probes)), "found")
    ids = classes.select("cls", "ids")
    # a class has its own query's vec_id at most once, so TOP + 1 ids are TOP candidates
    while probes < width(told.d or 1) ** axes:
        have = found.join(ids, "cls").groupBy("query").agg(F.sum(F.size("ids")).alias("have"))
        short = saved(queries.join(have, F.col("cls") == F.col("query"), "left").where(F.coalesce("have", F.lit(0)) <= TOP).select("cls", "vector"), "short")
        if not short.limit(1).count():
            break
        probes *= MORE
        more = _search(points, _probes(short, axes, tables, probes))
        found = saved(found.join(short.select(F.col("cls").alias("query")), "query", "left_anti").unionByName(more), "found")
    each = found.join(ids, "cls").select(F.col("query").alias("cls"), "score", F.explode("ids").alias("vec_id"))
    few = Window.partitionBy("cls").orderBy("score", "vec_id")
    each = each.withColumn("at", F.row_number().over(few)).where(F.col("at") <= TOP + 1).drop("at")
    pairs = each.join(asked.select("query_id", "cls"), "cls").where("vec_id <> query_id")
    order = Window.partitionBy("query_id", "cls").orderBy("score", "vec_id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP).select("query_id", "rank", "vec_id", "score")
