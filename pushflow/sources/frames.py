"""The framed log file: magic, header length, payload length, header, payload, CRC32, big-endian.

Only a reader and a writer for exchange with other programs; tables are Parquet.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: the first bytes of a frame.
MAGIC = b"SBK1"
_HEAD = struct.Struct(">4sII")


def encode(header: dict, payload: bytes) -> bytes:
    head = json.dumps(header, sort_keys=True).encode()
    body = _HEAD.pack(MAGIC, len(head), len(payload)) + head + payload
    return body + struct.pack(">I", zlib.crc32(body))


def decode(data: bytes) -> Iterator[tuple[dict, bytes, int]]:
    """Header, payload and position of each frame; ValueError at the first bad one."""
    at = 0
    while at < len(data):
        if at + _HEAD.size > len(data):
            raise ValueError("the file ends inside a frame")
        magic, n, m = _HEAD.unpack_from(data, at)
        if magic != MAGIC:
            raise ValueError("bad magic")
        end = at + _HEAD.size + n + m
        if end + 4 > len(data):
            raise ValueError("the file ends inside a frame")
        if struct.unpack_from(">I", data, end)[0] != zlib.crc32(data[at:end]):
            raise ValueError("bad checksum")
        head = at + _HEAD.size
        yield json.loads(data[head : head + n]), data[head + n : end], at
        at = end + 4


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """Frames of the files below a path: file, pos, header as JSON, payload; a file ends at its first bad frame."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    for header, payload, pos in decode(bytes(content)):
                        rows.append((name, pos, json.dumps(header, sort_keys=True), payload))
                except ValueError:  # the frames before the bad one count
                    pass
            yield pd.DataFrame(rows, columns=["file", "pos", "header", "payload"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(work, "file string, pos long, header string, payload binary")


def json_recover(candidates: list[tuple[str, str | None]], empty_allowed: bool = False):
    """The first of (name, text) that parses, in order; an empty list if allowed; else ValueError. Also the broken ones' names."""
    broken = []
    for name, text in candidates:
        if text is None:
            continue
        try:
            return json.loads(text), broken
        except ValueError:
            broken.append(name)
    if empty_allowed:
        return [], broken
    raise ValueError(f"no readable copy among {[n for n, _ in candidates]}")


def append(df: DataFrame, path: str, roll_records: int = 1_000_000) -> None:
    """Append accepted records as Parquet, a folder for each topic and partition, files rolled by records."""
    df.withColumn("topic_", F.col("topic")).withColumn("partition_", F.col("partition")).repartition("topic_", "partition_").sortWithinPartitions("topic_", "partition_", "log_offset").write.mode("append").option("maxRecordsPerFile", roll_records).partitionBy("topic_", "partition_").parquet(path)
