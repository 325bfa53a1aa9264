"""Benchmark decontamination: size-partitioned MinHash containment search, DataFrame
functions only.

A test item is far smaller than the documents that may hold it, so the similarity of the
two whole sets says nothing; what counts is the share of the item's shingles that the
document has. Items are partitioned by the size of their shingle set (powers of two). The
MinHash sketch of an item is the k smallest of its hashed shingles, and each partition has
its own k: the least with which no document of containment >= t can miss the sketch, as
it lacks at most floor((1 - t) * n) of the item's n shingles and so cannot lack
floor((1 - t) * n) + 1 of them. k is taken at the partition's upper size. A document that
has a sketch value of an item is a candidate; every candidate pair is then confirmed on
the full sets: exact containment of the item's distinct shingles.

Cases: an item or document with fewer words than a shingle has its whole sequence as one
shingle; null and wordless ones have none and match nothing. Every row of documents is held
against every item by itself: rows that repeat a doc_id, or have none, are not merged, and a
pair (doc_id, item_id) is reported once, with the most that a row of the doc_id shares with a
text of the item; null ids are reported as null. Equal sets are searched once, whatever the
item_ids they come under. An empty table on either side gives no rows; other columns are not
looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pushflow.llm.common import SPACE_RE, maybe_broadcast, saved

#: Rows of sketches and of item shingles up to which they are broadcast.
BROADCAST_SHINGLES = 1_000_000


def word_shingles(text: Column, width: int = 5) -> Column:
    """Distinct hashed shingles of the lower-cased words; null for a null text, empty without words."""
    words = F.filter(F.split(F.lower(text), SPACE_RE), lambda w: w != "")
    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return F.array_distinct(_windows(hashed, width))


def _windows(hashed: Column, width: int) -> Column:
    """A hash of each run of `width` values, or of all where there are fewer."""

    def inner(h: Column) -> Column:
        full = F.transform(F.slice(h, 1, F.size(h) - (width - 1)), lambda x, i: F.xxhash64(x, *(F.get(h, i + k) for k in range(1, width))))
        return F.when(F.size(h) >= width, full).when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<long>"))

    # the words are bound once, as the element of an array of one
    return F.get(F.transform(F.array(hashed), inner), F.lit(0))


def sketch_size(n: Column, percent: int) -> Column:
    """k of the size partition of a set of n values: by the upper size 2**(p + 1) - 1, at most n."""
    upper = F.pow(F.lit(2), F.floor(F.log2(n)) + 1) - 1
    return F.least(n, (F.floor(upper * (100 - percent) / 100) + 1).cast("int"))


def _found(docs: DataFrame, items: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, row, number, n_item, n_shared) of the rows of docs that hold a set of the items, and (number, item_id).

    Items are the small side. Their sketches, and their shingles, are broadcast up to a
    counted bound; beyond it the joins shuffle on the shingle.
    """
    owned = items.select("item_id", F.array_sort(word_shingles(F.col("text"), width)).alias("set")).where(F.size("set") > 0).distinct()
    # a number for each distinct set, written down, so that it stays the set's
    sets = saved(owned.select("set").distinct().select(F.monotonically_increasing_id().alias("number"), "set", F.size("set").alias("n_item")), "items")
    # one more hash makes the order of the sketch independent of the shingle's own value
    ordered = F.array_sort(F.transform("set", lambda x: F.struct(F.xxhash64(x, F.lit(7)).alias("h"), x.alias("s"))))
    sketch = sets.select("number", F.explode(F.slice(ordered, F.lit(1), sketch_size(F.col("n_item"), percent))).alias("e")).select("number", F.col("e.s").alias("shingle"))
    # a row is its doc_id and its text
    rows = docs.select("doc_id", F.xxhash64("text").alias("row"), word_shingles(F.col("text"), width).alias("set"))
    candidates = rows.select("doc_id", "row", F.explode("set").alias("shingle")).join(maybe_broadcast(sketch, BROADCAST_SHINGLES), "shingle").select("doc_id", "row", "number").distinct()
    candidates = saved(candidates, "candidates")
    found = candidates.select(F.col("doc_id").alias("own_id"), F.col("row").alias("own_row")).distinct()
    same_row = F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("row") == F.col("own_row"))
    again = docs.select("doc_id", F.xxhash64("text").alias("row"), "text").join(maybe_broadcast(found), same_row, "left_semi")
    again = again.select("doc_id", "row", F.explode(word_shingles(F.col("text"), width)).alias("shingle"))
    full = sets.select("number", "n_item", F.explode("set").alias("shingle"))
    # repeated rows have their shingles several times
    shared = again.join(maybe_broadcast(full, BROADCAST_SHINGLES), "shingle").groupBy("doc_id", "row", "number", "n_item").agg(F.count_distinct("shingle").alias("n_shared"))
    shared = shared.where(F.col("n_shared") * 100 >= F.col("n_item") * percent)
    return shared, owned.join(sets, "set").select("number", "item_id")


def leaks(docs: DataFrame, items: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Pairs (doc_id, item_id, n_item, n_shared, containment) with n_shared / n_item >= percent / 100."""
    shared, names = _found(docs, items, width, percent)
    best = F.max(F.struct((F.col("n_shared") / F.col("n_item")).alias("containment"), F.col("n_item").cast("long").alias("n_item"), F.col("n_shared").alias("n_shared"))).alias("best")
    return shared.join(maybe_broadcast(names), "number").groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.n_item", "best.n_shared", "best.containment")


def clean(docs: DataFrame, items: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """docs without the rows that hold an item, those without doc_id among them."""
    found = _found(docs, items, width, percent)[0].select(F.col("doc_id").alias("own_id"), F.col("row").alias("own_row")).distinct()
    leaking = maybe_broadcast(saved(found, "leaking"))
    same_row = docs["doc_id"].eqNullSafe(leaking["own_id"]) & (F.xxhash64(docs["text"]) == leaking["own_row"])
    return docs.join(leaking, same_row, "left_anti")
