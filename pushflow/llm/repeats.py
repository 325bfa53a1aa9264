"""Exact repeats across documents: a depth-limited radix sort of suffixes.

Only the first DEPTH bytes of a suffix count, and the sort goes from the most significant
digit to the least, with groups that can hold no repeat dropped after each digit:

digit 1: ANCHOR bytes. Not every suffix is sorted: every DEPTH-byte window names one of
  its ANCHOR-byte grams, the one of least hash, so equal windows of two documents name
  equal grams at equal places. Only named grams (about one in 18 positions) are sorted.
digit 2: all bytes that share a window with the gram. A group of equal digits is a set of
  places whose windows around the gram are all equal, so all but its smallest doc_id lose
  them at once. Its members are not sorted further.
digit 3: what is left are grams that occur with several surroundings. One place of each
  surrounding sends its bytes, and its windows are sorted by them to the full depth, eight
  bytes a pass; the groups of equal windows are exactly the repeats.

Digits 1 and 2 are 64-bit hashes of the bytes. A block of documents sends each digit once, with
its smallest doc_id; a passage that all documents share is one row for each block.

Cases: null and empty texts have nothing to remove; texts shorter than DEPTH hold no
window; matches never cross documents; repeats inside one document, or between rows of one
doc_id, stay; a null doc_id counts as larger than all others.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pushflow.llm.blocks import bucketed, packed, release, total_bytes, unpack
from pushflow.llm.common import _P, _PINV, mix, powers, saved, utf8

DEPTH, ANCHOR = 50, 16
#: Bytes of text whose digits are sorted in one group: several groups to a task, so that tasks are even.
SORTED = 8 << 20

_U = np.uint64
_LAST = np.iinfo(np.int64).max


class Places:
    """The named grams of a block: one entry for each surrounding, ordered by (bucket, gram, surrounding)."""

    def __init__(self, rows: pa.RecordBatch, buckets: int):
        self.rows = rows
        ids = rows.column(0)
        self.ids = ids.fill_null(_LAST).to_numpy(zero_copy_only=False).astype(np.int64)
        self.data, self.offsets = utf8(rows.column(1))
        n = len(self.data)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + _U(1)) * powers(_P, n + 1)[:n], out=self.sums[1:])
        self.inverse = powers(_PINV, n + 1)
        at = self._named()
        doc = np.searchsorted(self.offsets, at, "right") - 1
        left = np.maximum(self.offsets[doc], at - (DEPTH - ANCHOR))
        right = np.minimum(self.offsets[doc + 1], at + DEPTH)
        gram = mix(self._hash(at, at + ANCHOR) + _U(1))  # named grams have small hashes: spread them again
        around = self._hash(left, right) ^ mix((at - left).astype(np.uint64) + _U(1))
        del self.sums, self.inverse
        bucket = ((gram >> _U(32)) * _U(buckets) >> _U(32)).astype(np.int64)
        # places of one surrounding together, its smallest doc_id first
        order = np.lexsort((self.ids[doc], around, gram, bucket))
        self.at, self.doc, self.left, self.right = at[order], doc[order], left[order], right[order]
        gram, around, bucket = gram[order], around[order], bucket[order]
        new = np.ones(len(at), bool)
        new[1:] = (gram[1:] != gram[:-1]) | (around[1:] != around[:-1])
        self.first = np.flatnonzero(new)  # of each entry its first place
        self.entry = np.cumsum(new) - 1  # of each place its entry
        self.gram, self.around, self.bucket = gram[self.first], around[self.first], bucket[self.first]
        self.starts = np.searchsorted(self.bucket, np.arange(buckets + 1))

    def _hash(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix((self.sums[b] - self.sums[a]) * self.inverse[a] + (b - a).astype(np.uint64))

    def _named(self) -> np.ndarray:
        """Places of the grams that the windows name."""
        n, size = len(self.data), np.diff(self.offsets)
        if n < DEPTH:
            return np.zeros(0, np.int64)
        grams = n - ANCHOR + 1
        low = max(24, n.bit_length())  # the place stands in the low bits, so that ties go to the left
        key = self.sums[ANCHOR:] - self.sums[:-ANCHOR]
        key *= self.inverse[:grams]
        key *= _U(0xD6E8FEB86659FD93)
        key ^= key >> _U(32)
        key *= _U(0xD6E8FEB86659FD93)
        key >>= _U(low)
        key <<= _U(low)
        key |= np.arange(grams, dtype=np.uint64)
        span, width = 1, DEPTH - ANCHOR + 1
        while 2 * span <= width:
            key = np.minimum(key[: len(key) - span], key[span:])
            span *= 2
        key = np.minimum(key[: len(key) - (width - span)], key[width - span :])
        inside = np.zeros(n + 1, np.int64)  # windows that end inside their text
        long = size >= DEPTH
        np.add.at(inside, self.offsets[:-1][long], 1)
        np.add.at(inside, self.offsets[1:][long] - DEPTH + 1, -1)
        valid = np.cumsum(inside[: len(key)]) > 0
        named = (key[valid] & _U((1 << low) - 1)).astype(np.int64)
        return named[np.concatenate([[True], named[1:] != named[:-1]])] if len(named) else named

    def smallest(self) -> np.ndarray:
        """Of each entry the smallest doc_id in this block."""
        return self.ids[self.doc[self.first]]


def _digits(blocks: DataFrame, buckets: int) -> DataFrame:
    """What each block sends for digits 1 and 2."""

    def work(batches):
        for batch in batches:
            for block, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                p = Places(unpack(body.as_buffer()), buckets)
                ids, index = np.unique(p.smallest(), return_inverse=True)
                index = index.astype(np.uint16 if len(ids) < 1 << 16 else np.uint32)
                rows = []
                for b in range(buckets):
                    i, j = p.starts[b], p.starts[b + 1]
                    if i < j:
                        # within a bucket 32 bits of the gram are enough: grams that agree in them are only compared in vain
                        used, own = np.unique(index[i:j], return_inverse=True)
                        rows.append((b, block, p.gram[i:j].astype(np.uint32).tobytes(), p.around[i:j].tobytes(), ids[used].tobytes(), own.astype(np.uint16 if len(used) < 1 << 16 else np.uint32).tobytes()))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), *[pa.binary()] * 4), strict=True)], names=["bucket", "block", "gram", "around", "ids", "own"])

    return blocks.select("block", "body").mapInArrow(work, "bucket int, block long, gram binary, around binary, ids binary, own binary")


_ANSWER = "block long, bucket int, kind int, entries binary, told binary"


def _answers(rows) -> pa.Table:
    """rows: (block, bucket, kind, entries, told)"""
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
    columns = list(zip(*rows, strict=True)) or [[]] * 5
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["block", "bucket", "kind", "entries", "told"])


def _own(row_ids: bytes, row_own: bytes, n: int) -> np.ndarray:
    return np.frombuffer(row_ids, np.int64)[np.frombuffer(row_own, np.uint16 if len(row_own) == 2 * n else np.uint32)]


def _sort_surroundings(t: pa.Table) -> pa.Table:
    """Of one bucket: entries that a smaller doc_id has too (kind 0), and first ones whose gram stands elsewhere too (kind 1)."""
    if not t.num_rows:
        return _answers([])
    gram = [np.frombuffer(x.as_buffer(), np.uint32) for x in t["gram"]]
    n = np.array(list(map(len, gram)))
    around = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in t["around"]])
    doc = np.concatenate([_own(a.as_py(), b.as_py(), k) for a, b, k in zip(t["ids"], t["own"], n, strict=True)])
    gram = np.concatenate(gram)
    order = np.lexsort((doc, around, gram))
    g, a, d = gram[order], around[order], doc[order]
    new_g = np.ones(len(g), bool)
    new_g[1:] = g[1:] != g[:-1]
    new_a = new_g.copy()
    new_a[1:] |= a[1:] != a[:-1]
    least = d[np.flatnonzero(new_a)][np.cumsum(new_a) - 1]
    covered = d > least
    group = np.cumsum(new_g) - 1
    several = np.bincount(group, new_a)[group] > 1
    start = np.flatnonzero(new_g)
    apart = (np.maximum.reduceat(d, start) > np.minimum.reduceat(d, start))[group]
    told = np.zeros(len(g), np.int8)
    told[order] = np.where(covered, 1, np.where(several & apart, 2, 0))
    out, at = [], 0
    for block, bucket, k in zip(t["block"].to_pylist(), t["bucket"].to_pylist(), n, strict=True):
        for kind in (1, 2):
            hit = np.flatnonzero(told[at : at + k] == kind).astype(np.uint32)
            if len(hit):
                out.append((block, bucket, kind - 1, hit.tobytes(), b""))
        at += k
    return _answers(out)


class _Told:
    """What the answers say of the entries of a block."""

    def __init__(self, places: Places, answers: pa.Table):
        self.covered = np.zeros(len(places.first), bool)
        self.open = np.zeros(len(places.first), bool)
        self.windows = np.zeros(len(places.first), np.uint64)  # bit i: the window that begins i bytes behind the leftmost one
        for bucket, kind, entries, told in zip(*(answers[c].to_pylist() for c in ("bucket", "kind", "entries", "told")), strict=True):
            at = places.starts[bucket] + np.frombuffer(entries, np.uint32)
            if kind == 0:
                self.covered[at] = True
            elif kind == 1:
                self.open[at] = True
            else:
                self.windows[at] = np.frombuffer(told, np.uint64)


_OPEN = "bucket int, block long, entries binary, ids binary, lefts binary, lengths binary, bytes binary, gram binary"


def _send_windows(blocks: DataFrame, answers: DataFrame, buckets: int) -> DataFrame:
    """The surroundings of open entries, for digit 3."""

    def work(key, bodies, told):
        rows = []
        if bodies.num_rows and told.num_rows:
            p = Places(unpack(bodies["body"][0].as_buffer()), buckets)
            entries = np.flatnonzero(_Told(p, told).open)
            bounds = np.searchsorted(entries, p.starts)
            for b in range(buckets):
                e = entries[bounds[b] : bounds[b + 1]]
                if len(e):
                    at = p.first[e]
                    left, right = p.left[at], p.right[at]
                    size = right - left
                    index = np.repeat(left - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
                    rows.append((b, key[0].as_py(), (e - p.starts[b]).astype(np.uint32).tobytes(), p.smallest()[e].tobytes(), (p.at[at] - left).astype(np.uint8).tobytes(), size.astype(np.uint8).tobytes(), p.data[index].tobytes(), p.gram[e].astype(np.uint32).tobytes()))
        kinds = (pa.int32(), pa.int64(), *[pa.binary()] * 6)
        columns = list(zip(*rows, strict=True)) or [[]] * 8
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in _OPEN.split(", ")])

    return blocks.select("block", "body").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(work, _OPEN)


def _equal(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the windows that begin at starts those that are not alone, and the number of the group of equal ones of each.

    A radix sort from the most significant digit on, eight bytes a digit; windows that are alone
    in their group go after each digit. What is left is equal byte by byte.
    """
    words = np.zeros(max(0, len(data) - 7), np.uint64)
    for k in range(8 if len(words) else 0):
        words |= data[k : k + len(words)].astype(np.uint64) << _U(8 * (7 - k))
    live, group = np.arange(len(starts)), np.zeros(len(starts), np.int64)
    for depth in (*range(0, DEPTH - 8, 8), DEPTH - 8):
        key = words[starts[live] + depth]
        order = np.lexsort((key, group))
        live, group, key = live[order], group[order], key[order]
        new = np.ones(len(live), bool)
        new[1:] = (group[1:] != group[:-1]) | (key[1:] != key[:-1])
        group = np.cumsum(new) - 1
        several = np.bincount(group, minlength=1)[group] > 1
        live, group = live[several], group[several]
    return live, group


def _sort_windows(t: pa.Table) -> pa.Table:
    """Of one bucket: for each entry the windows that a smaller doc_id has too (kind 2)."""
    if not t.num_rows:
        return _answers([])
    join = lambda name, kind: np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in t[name]])
    doc, left, size = join("ids", np.int64), join("lefts", np.uint8).astype(np.int64), join("lengths", np.uint8).astype(np.int64)
    data = join("bytes", np.uint8)
    end = np.cumsum(size)
    start = end - size
    # windows [s, s + DEPTH) inside the surrounding that hold the whole gram
    low = np.maximum(0, left + ANCHOR - DEPTH)
    count = np.maximum(0, np.minimum(left, size - DEPTH) - low + 1)
    entry = np.repeat(np.arange(len(size)), count)
    number = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    s = start[entry] + low[entry] + number
    live, group = _equal(data, s)
    least = np.full(len(s), _LAST)
    np.minimum.at(least, group, doc[entry[live]])
    hit = np.zeros(len(s), bool)
    hit[live] = doc[entry[live]] > least[group]
    mask = np.zeros(len(size), np.uint64)
    np.bitwise_or.at(mask, entry[hit], _U(1) << number[hit].astype(np.uint64))
    out, at = [], 0
    for block, bucket, entries in zip(*(t[c].to_pylist() for c in ("block", "bucket", "entries")), strict=True):
        entries = np.frombuffer(entries, np.uint32)
        own = mask[at : at + len(entries)]
        if own.any():
            out.append((block, bucket, 2, entries[own > 0].tobytes(), own[own > 0].tobytes()))
        at += len(entries)
    return _answers(out)


def _removed(p: Places, told: _Told) -> np.ndarray:
    """Which bytes of the block go."""
    edge = np.zeros(len(p.data) + 1, np.int64)
    here = p.smallest()[p.entry]  # the smallest doc_id of a place's surrounding in this block
    whole = told.covered[p.entry] | (p.ids[p.doc] > here)
    whole &= p.right - p.left >= DEPTH
    np.add.at(edge, p.left[whole], 1)
    np.add.at(edge, p.right[whole], -1)
    some = np.flatnonzero(~whole & (told.windows[p.entry] > 0))
    low = p.left[some] + np.maximum(0, p.at[some] - p.left[some] + ANCHOR - DEPTH)
    for i in range(DEPTH - ANCHOR + 1):
        s = low[(told.windows[p.entry[some]] >> _U(i)) & _U(1) > 0] + i
        np.add.at(edge, s, 1)
        np.add.at(edge, s + DEPTH, -1)
    return np.cumsum(edge[:-1]) > 0


REPORT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string"


def _apply(blocks: DataFrame, answers: DataFrame, buckets: int, texts: bool) -> DataFrame:
    def work(bodies: pa.Table, answered: pa.Table) -> pa.Table:
        rows = []
        for body in bodies["body"]:
            p = Places(unpack(body.as_buffer()), buckets)
            gone = _removed(p, _Told(p, answered))
            for i, doc_id in enumerate(p.rows.column(0).to_pylist()):
                a, b = p.offsets[i], p.offsets[i + 1]
                g = gone[a:b]
                kept = p.data[a:b][~g].tobytes()
                spans = int(np.count_nonzero(g[1:] & ~g[:-1]) + (g[0] if b > a else 0))
                rows.append((doc_id, int(b - a), int(b - a) - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept.decode("utf8", "replace") if texts else None))
        kinds = (*[pa.int64()] * 4, pa.string(), pa.string())
        columns = list(zip(*rows, strict=True)) or [[]] * 6
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in REPORT.split(", ")])

    return blocks.select("block", "body").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(work, REPORT)


def remove_repeats(docs: DataFrame, texts: bool = True) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if wanted, the text left.

    A cut may fall inside a character; the text has a replacement character there, the digest is of the bytes.
    """
    spark = docs.sparkSession
    blocks = bucketed(packed(docs.select("doc_id", "text")), "block", "repeats")
    buckets = max(1, -(-total_bytes(blocks) // SORTED))
    first = saved(_digits(blocks, buckets).groupBy("bucket").applyInArrow(_sort_surroundings, _ANSWER), "surroundings")
    release(spark)
    asked = first.where("kind = 1")
    second = saved(_send_windows(blocks, asked, buckets).groupBy("bucket").applyInArrow(_sort_windows, _ANSWER), "windows")
    release(spark)
    return _apply(blocks, first.where("kind = 0").unionByName(second), buckets, texts)
