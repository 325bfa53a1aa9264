"""A training-corpus pipeline over the documents table, one operator a stage.

A document is a row: rows that repeat a doc_id, or have none, are judged by their own texts.
Rows equal in doc_id and text go or stay together.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pushflow.llm import decontaminate, minhash, pieces, quality, secrets
from pushflow.llm.common import rest, saved, table
from pushflow.llm.queries import PIECES

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _rested(stage: Stage) -> Stage:
    """The stage, begun with what the executors' heaps have kept of the stages before given back."""

    @wraps(stage)
    def begun(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        rest(spark)
        return stage(spark, docs, sf_dir)

    return begun


@_rested
def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose posterior of being acceptable is under one half."""
    labels = table(spark, sf_dir, "labels")
    judged = quality.score(docs, labels, F.col("source"), F.concat_ws("/", "source", "lang"))
    return judged.where("__quality.kept").select(docs.columns)


@_rested
def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates, that of smallest doc_id: five words, similarity 0.8."""
    return minhash.deduplicated(docs)


@_rested
def keep_unseen(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold four fifths or more of a benchmark item's five-word shingles."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


@_rested
def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts; n_chars is that of the new text."""
    hidden = secrets.redact(docs)
    return hidden.withColumn("n_chars", F.char_length("text").cast("long")).select(docs.columns)


@_rested
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, the text's ids, their number, and whether decoding gives the text back."""
    model = pieces.load(PIECES)
    rows = pieces.encode(docs.select("doc_id", "lang", "source", "text"), model, decoded=True)
    space = F.replace("text", F.lit(pieces.SPACE), F.lit(" "))
    return rows.select("doc_id", "lang", "source", "ids", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_tokens"), F.col("decoded").eqNullSafe(space).alias("round_trip"))


STAGES: list[tuple[str, Stage]] = [
    ("quality", keep_good),
    ("near_duplicates", keep_one),
    ("decontamination", keep_unseen),
    ("secrets", hide_secrets),
    ("encoding", encode),
]

#: No stage but the third has an SQL form; tests hold the pipeline against a plain version of each stage.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each one's rows written and read again for the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
