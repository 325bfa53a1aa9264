"""Language-model scores: a unigram base over the whole corpus and the context-mixing model.

Both learn from the documents that are not held out and score all. What is coded is a text's
lower-cased words, each with one space, and an end: other white space is not in the probability.

Blocks of documents name their distinct units (words, as the model cuts them) and what follows
them, cut by hash into spans. A span's units meet once, with their counts over the corpus: the
vocabulary. Its contexts are counted in spans of their own, so nothing of the model but the tree of
the bytes is broadcast, and no table has a fixed size. Each unit's cost under the weight sets is
found once for the corpus and sent back to the blocks that have it, with the count that the base
needs; there the texts are scored.

Cases: a null or empty text has the end token only; without training documents the base gives each
token probability 1 and the model one half to each bit; a null doc_id is not held out;
rows that repeat a doc_id are scored each.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pushflow.llm import mixing
from pushflow.llm import vocabulary as v
from pushflow.llm.blocks import bucketed, packed, total_bytes, unpack
from pushflow.llm.common import forget, trim

#: Bytes of text in a block: the more, the fewer units are asked for twice.
BLOCK = 8 << 20


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def _trained(rows: pa.RecordBatch) -> np.ndarray:
    return np.array([not held_out(i) for i in rows.column(0).to_pylist()], bool)


def _trained_bytes(rows: pa.RecordBatch) -> bytes:
    """Counts of the bytes of the training texts of a block."""
    texts = rows.column(1).filter(pa.array(_trained(rows))).cast(pa.binary()).drop_null().to_pylist()
    total = np.zeros(256, np.int64)
    for x in texts:
        total += np.bincount(np.frombuffer(x.lower(), np.uint8), minlength=256)
    return total.tobytes()


def _histogram(blocks: DataFrame) -> np.ndarray:
    def add(batches):
        total = np.zeros(256, np.int64)
        for batch in batches:
            for note in batch.column(0):
                total += np.frombuffer(note.as_buffer(), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(256)), pa.array(total)], names=["byte", "n"])

    out = np.zeros(256)
    for r in blocks.select("note").mapInArrow(add, "byte long, n long").groupBy("byte").agg(F.sum("n").alias("n")).collect():
        out[r.byte] = r.n
    return out


def _named(blocks: DataFrame, spans: int) -> DataFrame:
    """(block, span, chunk): the units of each block, in parts."""

    def work(batches):
        for batch in batches:
            for block, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = unpack(body.as_buffer())
                texts = mixing.laid(rows.column(1))
                own = mixing.named(texts, spans)
                count = mixing.counted(texts, own, _trained(rows))
                seals = [own.chunk(i, j, count).sealed() for _, i, j in own.spans]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(seals), block, np.int64)), pa.array([s for s, _, _ in own.spans], pa.int32()), pa.array(seals, pa.binary())], names=["block", "span", "chunk"])
                del rows, texts, own, count, seals
        trim()

    return blocks.select("block", "body").mapInArrow(work, "block long, span int, chunk binary")


def _vocabulary(parts: DataFrame) -> DataFrame:
    """(span, chunk, tokens, types): the corpus's units of each span; the words among them and how many are distinct."""

    def work(t: pa.Table) -> pa.Table:
        chunk = mixing.together([mixing.Chunk.opened(x) for x in t["chunk"]])
        total, distinct = mixing.tokens(chunk)
        out = pa.table({"span": t["span"][:1], "chunk": pa.array([chunk.sealed()], pa.binary()), "tokens": pa.array([total], pa.int64()), "types": pa.array([distinct], pa.int64())})
        del chunk
        trim()
        return out

    return parts.select("span", "chunk").groupBy("span").applyInArrow(work, "span int, chunk binary, tokens long, types long")


def _asked(vocabulary: DataFrame, t: mixing.Tree, bits: int) -> DataFrame:
    """(span, keys_span, keys): the contexts of each chunk of the vocabulary, in parts, with their counts."""

    def work(batches):
        for batch in batches:
            for span, chunk in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                seals = list(mixing.key_spans(mixing.asked(mixing.Chunk.opened(chunk), t), bits))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(seals), span, np.int32)), pa.array([s for s, _ in seals], pa.int32()), pa.array([x for _, x in seals], pa.binary())], names=["span", "keys_span", "keys"])
                del seals
                trim()

    return vocabulary.select("span", "chunk").mapInArrow(work, "span int, keys_span int, keys binary")


def _met(asked: DataFrame) -> DataFrame:
    """(span, keys_span, counts): the counts that the corpus has of each part's contexts."""

    def work(t: pa.Table) -> pa.Table:
        out = pa.table({"span": t["span"], "keys_span": t["keys_span"], "counts": pa.array(mixing.summed(list(t["keys"])) if t.num_rows else [], pa.binary())})
        trim()
        return out

    return asked.groupBy("keys_span").applyInArrow(work, "span int, keys_span int, counts binary")


def _costs(vocabulary: DataFrame, met: DataFrame, t: mixing.Tree) -> DataFrame:
    """(span, chunk, costs): the vocabulary with its costs."""

    def work(chunks: pa.Table, told: pa.Table) -> pa.Table:
        told = told.sort_by("keys_span")["counts"]
        seals = []
        for x in chunks["chunk"]:
            inside, first = mixing.costs(mixing.asked(mixing.Chunk.opened(x), t), list(told), t)
            seals.append(v.seal(*mixing.sealed_costs(inside), *mixing.sealed_costs(first)))
        del told
        trim()
        return pa.table({"span": chunks["span"], "chunk": chunks["chunk"], "costs": pa.array(seals, pa.binary())})

    return vocabulary.select("span", "chunk").groupBy("span").cogroup(met.groupBy("span")).applyInArrow(work, "span int, chunk binary, costs binary")


def _answers(parts: DataFrame, costs: DataFrame) -> DataFrame:
    """(block, span, told): of each part's units how often they are words, and the costs of units and pairs."""

    def work(asked: pa.Table, told: pa.Table) -> pa.Table:
        whole = mixing.Chunk.opened(told["chunk"][0])
        columns = v.unseal(told["costs"][0])
        total, pairs = whole.totals(), whole.pairs()
        out = []
        for x in asked["chunk"]:
            own = mixing.Chunk.opened(x)
            unit = v.places(own.units, whole.units)
            pair = np.searchsorted(pairs, np.repeat(unit, own.following) * 256 + own.byte)
            out.append(v.seal(total[unit], *[c[unit] for c in columns[: mixing.MIXES]], *[c[pair] for c in columns[mixing.MIXES :]]))
        del whole, columns, total, pairs
        trim()
        return pa.table({"block": asked["block"], "span": asked["span"], "told": pa.array(out, pa.binary())})

    return parts.groupBy("span").cogroup(costs.groupBy("span")).applyInArrow(work, "block long, span int, told binary")


SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"


def scores(docs: DataFrame) -> DataFrame:
    """One row per row of docs(doc_id, text); score is the model's log10 probability of the text's words and its end."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    trained = int(docs.where(~F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))).count())
    blocks = bucketed(packed(docs, BLOCK, _trained_bytes), "block", "scored")
    t = mixing.tree(_histogram(blocks))
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spans = v.span_count(total_bytes(blocks), least)
    parts = bucketed(_named(blocks, spans), "span", "named", least)
    vocabulary = bucketed(_vocabulary(parts), "span", "vocabulary", least)
    sums = vocabulary.agg(F.sum("tokens").alias("tokens"), F.sum("types").alias("types")).first()
    # the end token counts once for each training document
    total, distinct = int(sums.tokens or 0) + trained, int(sums.types or 0) + bool(trained)
    met = _met(_asked(vocabulary, t, (spans - 1).bit_length()))
    costs = bucketed(_costs(vocabulary, met, t), "span", "costs", least)
    forget(vocabulary)
    answers = _answers(parts, costs)

    def work(bodies: pa.Table, told: pa.Table) -> pa.Table:
        answered = [v.unseal(x) for x in told.sort_by("span")["told"]]
        out = []
        for body in bodies["body"]:
            rows = unpack(body.as_buffer())
            texts = mixing.laid(rows.column(1))
            own = mixing.named(texts, spans)
            columns = [np.concatenate(x) for x in zip(*answered, strict=True)]
            inside = mixing.opened_costs(columns[1 : 1 + mixing.MIXES])[own.place]
            bits = mixing.scored(texts, inside, mixing.opened_costs(columns[1 + mixing.MIXES :]), own.pair)
            count = columns[0][own.place][texts.word]
            row = np.repeat(np.arange(rows.num_rows), texts.words)
            base = np.bincount(row, np.log10((count + 1.0) / (total + distinct + 1)), rows.num_rows) + np.log10((trained + 1.0) / (total + distinct + 1))
            known = np.bincount(row, count > 0, rows.num_rows).astype(np.int64) + bool(trained)
            columns = [rows.column(0).cast(pa.int64()), pa.array(~_trained(rows)), pa.array(texts.words + 1), pa.array(known), pa.array(np.full(rows.num_rows, total)), pa.array(base), pa.array(-bits * np.log10(2)), pa.array(bits / np.maximum(texts.size - (texts.words > 0), 1))]
            out.append(pa.table(columns, names=[x.split()[0] for x in SCHEMA.split(", ")]))
            del rows, texts, own, columns, inside, bits, count, row
        trim()
        return pa.concat_tables(out)

    return blocks.select("block", "body").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(work, SCHEMA)
