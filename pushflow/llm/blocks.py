"""Documents packed into blocks, kept as a table that is bucketed by block.

Operators that ask the whole corpus about what a document holds (its words, its windows)
ask once for each block: a block sends its distinct keys, gets the answers back and looks
up its own documents. The bodies lie bucketed by block, so cogrouping them with answers
moves the answers only, however often that is done.
"""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pushflow.llm.common import freed_shuffles, slices, trim, work_path

#: Bytes of text in a block; a longer text is a block by itself.
BLOCK = 4 << 20


def pack(rows: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as out:
        out.write_batch(rows)
    return sink.getvalue().to_pybytes()


def unpack(body) -> pa.RecordBatch:
    trim()  # what the block before has left
    return pa.ipc.open_stream(body).read_next_batch()


def packed(docs: DataFrame, block: int = BLOCK, note: Callable[[pa.RecordBatch], bytes] | None = None) -> DataFrame:
    """block, n_rows, n_bytes, body, from all columns of docs, of which text is one; and a note on the rows, if asked for."""

    def work(batches):
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        held, size = [], 0

        def emit():
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            values = [part << 32 | number, rows.num_rows, size, pack(rows), *([note(rows)] if note else [])]
            return pa.RecordBatch.from_arrays([pa.array([v]) for v in values], names=["block", "n_rows", "n_bytes", "body", "note"][: len(values)])

        for batch in slices(batches, most=block):
            more = batch.column(batch.schema.get_field_index("text")).nbytes
            if held and size + more > block * 5 // 4:
                yield emit()
                held, size, number = [], 0, number + 1
            held.append(batch)
            size += more
        if held:
            yield emit()
        held = []
        trim()

    return docs.mapInArrow(work, "block long, n_rows long, n_bytes long, body binary" + (", note binary" if note else ""))


def bucket_count(df: DataFrame, split: int = 2) -> int:
    """Buckets that bucketed() makes of df: `split` for each of its partitions, or as many as a shuffle has."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), split * df.rdd.getNumPartitions())


def bucketed(df: DataFrame, key: str, tag: str, buckets: int | None = None) -> DataFrame:
    """df written as a table bucketed by key, in `buckets`, or at least as many as a shuffle has partitions.

    Rows go to their bucket's files by a shuffle first, so that there are as many files as buckets.
    The catalogue has the table's name only while it is written: its files go with the work folder.
    """
    spark = df.sparkSession
    buckets = buckets or bucket_count(df)
    name = f"pushflow_{tag}_{uuid.uuid4().hex}"
    with freed_shuffles(spark):
        df.repartition(buckets, key).write.bucketBy(buckets, key).option("path", work_path(spark, tag)).format("parquet").saveAsTable(name)
    out = spark.table(name)
    out.schema  # noqa: B018  resolved while the name is there
    spark.sql(f"DROP TABLE {name}")
    release(spark)
    return out


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner remove shuffle files that no live plan can read any more."""
    gc.collect()
    spark._jvm.System.gc()


def total_bytes(blocks: DataFrame) -> int:
    return int(blocks.agg(F.sum("n_bytes")).first()[0] or 0)
