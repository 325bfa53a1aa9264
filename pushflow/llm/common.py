"""Shared plumbing: the shared work folder, written tables, byte-sized slices of
Arrow batches and vectorised word hashing."""

from __future__ import annotations

import atexit
import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side of a join may be broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 500_000
#: Rows of a batch that goes to Python: rows may be as long as documents, and both sides hold some batches.
BATCH_ROWS = 1_000
#: A-Z to a-z and nothing else, as SQL translate() arguments.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What separates words.
SPACE_RE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the driver's; the session's Arrow batches get BATCH_ROWS rows at most from then on."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- shared folder
def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir where it is set.

    Without it a local session gets a temporary folder, and a cluster a RuntimeError: its executors
    would each write to a disk of their own.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found is None:
        got = sc._jsc.sc().getCheckpointDir()
        if got.isDefined():
            found = got.get()
        elif not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        else:
            found = "file://" + tempfile.mkdtemp(prefix="pushflow-")
            sc.setCheckpointDir(found)
    return found.rstrip("/")


def work_path(spark: SparkSession, tag: str) -> str:
    """A fresh path below the shared folder; the folder of this application goes at exit."""
    root = f"{shared_dir(spark)}/pushflow-{spark.sparkContext.applicationId}"
    if root not in _roots:
        _roots.add(root)
        atexit.register(_delete, spark, root)
    return f"{root}/{re.sub('[^a-z0-9]+', '-', tag)}-{uuid.uuid4().hex}"


_roots: set[str] = set()


def _delete(spark: SparkSession, root: str) -> None:
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the session is gone; the folder is left to its owner
        pass


@contextmanager
def freed_shuffles(spark: SparkSession):
    """Shuffle files of what runs inside go when it ends: a written table needs them no more."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def saved(df: DataFrame, tag: str) -> DataFrame:
    """Write and reread: cuts the lineage, so that no later loss of an executor repeats the work above it."""
    path = work_path(df.sparkSession, tag)
    with freed_shuffles(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete the files of a saved table that nothing reads any more."""
    for folder in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        _delete(df.sparkSession, folder)


def bounded(df: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """Whether df has at most limit rows; reads no more than limit + 1 of them."""
    return df.limit(limit + 1).count() <= limit


def maybe_broadcast(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if its counted rows allow it, else df for a shuffled join."""
    return F.broadcast(df) if bounded(df, limit) else df


def trim() -> None:
    """Give memory that Python and Arrow have freed back to the system; workers live on between stages."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


def rest(spark: SparkSession) -> None:
    """The executors give heap that nothing holds any more back to the system, by a full collection on each.

    A heap grows up to its limit over the steps of a long job and keeps what it has, beside which the
    Python workers of a later step need theirs. A task for each core reaches every idle executor.
    """
    tasks = max(1, spark.sparkContext.defaultParallelism)
    collect = F.call_function("java_method", F.lit("java.lang.System"), F.lit("gc"))
    spark.range(0, tasks, 1, tasks).select(collect.alias("done")).write.format("noop").mode("overwrite").save()


try:
    _libc = ctypes.CDLL("libc.so.6")
except OSError:  # another C library
    _libc = None


# ---------------------------------------------------------------- text in batches
def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds at most about `most` bytes of text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        total, at = np.cumsum(size), 0
        while at < batch.num_rows:
            base = total[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(total, base + most, "right")))
            yield batch.slice(at, end - at)
            at = end


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all rows end to end and the rows' offsets; a null row is empty."""
    column = pc.fill_null(column, "" if not pa.types.is_binary(column.type) else b"")
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        column = column.cast(pa.binary())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


# ---------------------------------------------------------------- hashing
_U = np.uint64
_P, _PINV = 0x9E3779B97F4A7C15 | 1, pow(0x9E3779B97F4A7C15 | 1, -1, 1 << 64)
_power: dict[int, np.ndarray] = {}
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the splitmix64 finaliser)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x = x * _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept between calls."""
    if len(_power.get(base, ())) < n:
        kept = n <= 1 << 21  # of much text at once the table is large, and soon made again
        size = 1 << max(16, (n - 1).bit_length()) if kept else n
        out = np.ones(size, np.uint64)
        done = 1
        while done < size:
            step = min(done, size - done)
            out[done : done + step] = out[:step] * _U(pow(base, done, 1 << 64))
            done += step
        if not kept:
            return out
        _power[base] = out
    return _power[base][:n]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit polynomial hash of each data[start:end], mixed; equal spans have equal hashes."""
    n = len(data)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + _U(1)) * powers(_P, n + 1)[:n], out=total[1:])
    return mix((total[ends] - total[starts]) * powers(_PINV, n + 1)[starts] + (ends - starts).astype(np.uint64))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row of every word; words never cross rows. data: lower-cased or not."""
    if not len(data):
        e = np.zeros(0, np.int64)
        return e, e, e
    space = _SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.ones(len(data), bool)
    before[1:] = space[:-1]
    after = np.ones(len(data), bool)
    after[:-1] = space[1:]
    starts = np.flatnonzero(~space & (before | edge[:-1]))
    ends = np.flatnonzero(~space & (after | edge[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def lowered(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every lower-cased word of a text column, and the number of words of each row."""
    data, offsets = utf8(column)
    data = lowered(data)
    starts, ends, row = words(data, offsets)
    return span_hashes(data, starts, ends), np.bincount(row, minlength=len(column))


def shingles(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, ordered by row and then value, and their number for each row.

    A row of fewer words than width has its whole word sequence as one shingle;
    a row without words has none.
    """
    h, n = word_hashes(column)
    first = np.concatenate([[0], np.cumsum(n)])[:-1]
    row = np.repeat(np.arange(len(n)), n)
    left = (first + n)[row] - np.arange(len(h))  # words from here to the end of the row
    whole = np.minimum(n, width)[row]
    at = np.flatnonzero(left >= whole)  # starts of full shingles, and of the one of a short row
    at = at[(left[at] >= width) | (at == first[row[at]])]
    value = np.zeros(len(at), np.uint64)
    for i in range(width):
        there = i < np.minimum(left[at], width)
        value = mix(value * _U(0xD6E8FEB86659FD93) + np.where(there, h[np.minimum(at + i, len(h) - 1)], _U(i + 1)))
    row = row[at]
    order = np.lexsort((value, row))
    value, row = value[order], row[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    return value[new], np.bincount(row[new], minlength=len(n))
