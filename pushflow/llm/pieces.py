"""SentencePiece encoding and decoding over a relational lattice.

A text, its spaces replaced by the model's space sign and one put before it, is cut into words
wherever two characters meet that stand side by side in no piece: neither a merge nor a path
crosses there. Each distinct word of the corpus is encoded once: its substrings of at most the
longest piece's length are exploded and equi-joined to the piece table, the edges found are
grouped by word, and a higher-order aggregate folds each word's edges into its pieces:

viterbi: the path of largest summed score, for models whose scores are log probabilities.
bpe: the scores of a byte-pair model are merge ranks, for which the best path is not what
  the model encodes. Here the fold makes, step by step, the merge of best rank among the
  edges that join two neighbouring symbols, leftmost on ties. The state is one bit for
  each place in the word that is still a boundary.

Characters without piece become the pieces of their bytes. Words of over LONG characters, for
which the state has no room, are folded by the same rule in Python, once each. Blocks of
documents ask for their words span by span and get the ids back in the order of asking.

Cases: an empty text has no ids, a null text has null ones; decoding gives the text back
(the model's space sign in a text comes back as a space); rows are encoded each, also
when they repeat; docs must not have a column named ids, nor rows to decode one named
decoded (ValueError).
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from pushflow.llm import vocabulary as v
from pushflow.llm.blocks import bucketed, packed, total_bytes, unpack
from pushflow.llm.common import forget, saved, slices, trim

SPACE = "▁"
#: Characters of a word that the fold's state has room for: bits 0 to 62 are boundaries.
LONG = 60
#: Bytes of text in a block: the more, the fewer words are asked for twice.
BLOCK = 8 << 20
#: Words whose edges one task groups in memory.
FOLDED = 1 << 14


@dataclass(frozen=True)
class Pieces:
    """A piece table: id and score of each piece; the id of byte 0, whose 255 followers stand behind it."""

    ids: dict[str, int]
    scores: dict[str, float]
    byte: int
    fold: str = "bpe"

    @property
    def longest(self) -> int:
        return max(map(len, self.ids), default=1)

    @cached_property
    def beside(self) -> frozenset[str]:
        """Pairs of characters that stand side by side in a piece; no edge spans another pair."""
        return frozenset(p[i : i + 2] for p in self.ids for i in range(len(p) - 1))

    @cached_property
    def odd(self) -> frozenset[str]:
        """Pieces that, with a neighbour, make a piece of a better rank than their own: when such a
        one has been merged, a merge of a rank that was already passed may have become possible."""
        known = lambda x: len(x) == 1 or x in self.ids
        halves = ((x[:i], x[i:], x) for x in self.ids for i in range(1, len(x)))
        return frozenset(h for a, b, x in halves if known(a) and known(b) for h in (a, b) if len(h) > 1 and self.scores[h] <= self.scores[x])

    def names(self) -> dict[int, str]:
        return {i: p for p, i in self.ids.items()}


def load(path: str, fold: str = "bpe") -> Pieces:
    """The piece table of a model file. Raises ValueError for a model whose pieces cross words."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids, scores, bytes_ = {}, {}, []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            bytes_.append(i)
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            ids[piece], scores[piece] = i, model.get_score(i)
    if bytes_ != list(range(bytes_[0], bytes_[0] + 256)):
        raise ValueError("the byte pieces do not stand in order")
    if any(SPACE in p.lstrip(SPACE) or "\n" in p[1:] or p[0] == "\n" != p for p in ids):
        raise ValueError("a piece crosses words")
    return Pieces(ids, scores, bytes_[0], fold)


class Cutter:
    """Cuts texts into words."""

    def __init__(self, p: Pieces):
        kinds = sorted({c for pair in p.beside for c in pair})
        kind = {c: i + 1 for i, c in enumerate(kinds)}
        self.top = max(map(ord, kinds), default=0)
        self.kind = np.zeros(self.top + 2, np.int32)  # 0: a character that no piece has beside another
        self.kind[[ord(c) for c in kinds]] = np.arange(1, len(kinds) + 1)
        self.together = np.zeros((len(kinds) + 1, len(kinds) + 1), bool)
        for a, b in p.beside:
            self.together[kind[a], kind[b]] = True

    def cut(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """The number of words of each text; each word's place among the distinct ones; these, in order of first use."""
        counts, found = [np.zeros(0, np.int64)], []
        for part in slices([pa.RecordBatch.from_arrays([texts], names=["text"])], most=1 << 20):
            count, words = self._cut(part.column(0))
            counts.append(count)
            found.append(words.dictionary_encode())
        if not found:
            return counts[0], np.zeros(0, np.int32), pa.array([], pa.binary())
        whole = pa.chunked_array(found).unify_dictionaries()
        wide = whole.chunk(0).dictionary
        data, length = v.parts_of(wide)
        chars = data.view(np.uint32)
        bytes_ = (1 + (chars >= 0x80) + (chars >= 0x800) + (chars >= 0x10000)).astype(np.uint8)
        first = np.cumsum(length // 4, dtype=np.int64) - length // 4
        narrow = np.frombuffer(data.tobytes().decode("utf-32-le").encode(), np.uint8)
        words = v.words_of(narrow, np.add.reduceat(bytes_, first, dtype=np.uint32) if len(first) else np.zeros(0, np.uint32))
        return np.concatenate(counts), np.concatenate([c.indices.to_numpy() for c in whole.chunks]), words

    def _cut(self, texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
        """The number of words of each text, and the words, in UTF-32."""
        texts = [SPACE + t if t else "" for t in texts.to_pylist()]
        chars = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).copy()
        chars[chars == 32] = ord(SPACE)
        ends = np.cumsum(np.array(list(map(len, texts)), np.int64))
        edge = np.ones(len(chars) + 1, bool)
        if len(chars):
            kind = self.kind[np.minimum(chars, self.top + 1)]
            edge[1:-1] = ~self.together[kind[:-1], kind[1:]]
        edge[ends] = True
        starts = np.flatnonzero(edge)
        count = np.diff(np.concatenate([[0], np.searchsorted(starts, ends)]))
        return count, pa.Array.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(starts * 4), pa.py_buffer(chars)])


def words_in(text: str, p: Pieces) -> list[str]:
    """The words of a text; none for an empty one."""
    _, at, words = Cutter(p).cut(pa.array([text]))
    return words.cast(pa.string()).take(pa.array(at)).to_pylist()


# ---------------------------------------------------------------- one word in Python
def _bytes_of(char: str, p: Pieces) -> list[int]:
    return [p.byte + b for b in char.encode()]


def encode_bpe(word: str, p: Pieces) -> list[int]:
    """Merges in rank order with a heap; linear in memory, for words of any length."""
    right, left, end = list(range(1, len(word) + 1)), list(range(-1, len(word))), list(range(1, len(word) + 1))
    heap: list[tuple[float, int, int]] = []

    def offer(i: int) -> None:
        j = right[i]
        if j < len(word) and end[j] - i <= p.longest and (s := p.scores.get(word[i : end[j]])) is not None:
            heapq.heappush(heap, (-s, i, end[j]))

    for i in range(len(word)):
        offer(i)
    gone = [False] * len(word)
    while heap:
        _, i, e = heapq.heappop(heap)
        j = right[i] if not gone[i] else len(word)
        if j >= len(word) or end[j] != e:
            continue
        gone[j], end[i], right[i] = True, e, right[j]
        if right[i] < len(word):
            left[right[i]] = i
        offer(i)
        if left[i] >= 0:
            offer(left[i])
    out, i = [], 0
    while i < len(word):
        piece = word[i : end[i]]
        out += [p.ids[piece]] if piece in p.ids else _bytes_of(piece, p)
        i = end[i]
    return out


def encode_viterbi(word: str, p: Pieces) -> list[int]:
    """The best path, ties to the shorter last piece."""
    unknown = min(p.scores.values()) - 10
    best: list[tuple[float, int, list[int]]] = [(0.0, 0, [])]
    for e in range(1, len(word) + 1):
        found = [(best[s][0] + p.scores[word[s:e]], s, [p.ids[word[s:e]]]) for s in range(max(0, e - p.longest), e) if word[s:e] in p.ids]
        if word[e - 1] not in p.ids:
            found.append((best[e - 1][0] + unknown, e - 1, _bytes_of(word[e - 1], p)))
        best.append(max(found, key=lambda x: x[:2]))
    out: list[int] = []
    e = len(word)
    while e:
        out, e = best[e][2] + out, best[e][1]
    return out


# ---------------------------------------------------------------- the lattice
#: An edge is one number: rank of its score, start, end and whether its piece is an odd one, from the highest bits down.
RANK, START, END, ODD = 1 << 20, 1 << 14, 1 << 8, 1


def piece_table(spark: SparkSession, p: Pieces) -> DataFrame:
    """piece, edge: the edge's number but for its start and end; equal scores have one rank."""
    ranks = {x: i for i, x in enumerate(sorted(set(p.scores.values()), reverse=True))}
    return spark.createDataFrame([(k, ranks[p.scores[k]] * RANK + (ODD if k in p.odd else 0)) for k in p.ids], "piece string, edge long")


def lattice(words: DataFrame, p: Pieces) -> DataFrame:
    """words(.., word), distinct, to the same with edges, sorted; no edges: an empty array.

    Merges need no edge of a single character, paths do. A place sends the substrings that are
    no longer than the longest piece that begins as it does there. The piece table and its
    beginnings are broadcast: the model file bounds them. Rows that come partitioned by some of
    their columns are grouped where they are.
    """
    keys, spark = words.columns, words.sparkSession
    least = 1 if p.fold == "viterbi" else 2
    heads: dict[str, int] = {}
    for piece in p.ids:
        if len(piece) >= least:
            heads[piece[:least]] = max(heads.get(piece[:least], 0), len(piece))
    table = spark.createDataFrame(list(heads.items()), "head string, most int")
    s, e, n = F.col("s"), F.col("e"), F.char_length("word")
    starts = words.select(*keys, F.explode(F.sequence(F.lit(0), n - 1)).alias("s")).withColumn("head", F.substring("word", s + 1, F.lit(least)))
    starts = starts.join(F.broadcast(table), "head", "left").where(F.col("most").isNotNull() | (s == 0))
    last = F.least(s + F.col("most"), n)
    # the empty substring at the start keeps a word that has no edge
    ends = F.concat(F.when(s == 0, F.array(F.lit(0))).otherwise(F.array().cast("array<int>")), F.when(last >= s + least, F.sequence(s + least, last)).otherwise(F.array().cast("array<int>")))
    spans = starts.select(*keys, "s", F.explode(ends).alias("e"))
    spans = spans.select(*keys, "s", "e", F.when(e > 0, F.substring("word", s + 1, e - s)).alias("piece"))
    edges = spans.join(F.broadcast(piece_table(spark, p)), "piece", "left").where(F.col("edge").isNotNull() | (e == 0))
    # collect_list leaves nulls out
    return edges.groupBy(*keys).agg(F.sort_array(F.collect_list(F.col("edge") + s.cast("long") * START + e * END)).alias("edges"))


def _bit(i: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), i)


def _bound(value: Column, use) -> Column:
    """use(value), with value computed once for each row however often use names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _ends(edge: Column) -> tuple[Column, Column]:
    """Start and end of an edge."""
    return F.shiftright(edge, 14).bitwiseAND(63).cast("int"), F.shiftright(edge, 8).bitwiseAND(63).cast("int")


def _masks() -> tuple[Column, Column]:
    """For start * 64 + end the bits of both, and of all between: constants."""
    ends = [1 << s | 1 << e if s < e < 63 else 0 for s in range(64) for e in range(64)]
    inner = [(1 << e) - (1 << s + 1) if s < e < 63 else 0 for s in range(64) for e in range(64)]
    # an expression in SQL, as one call for each of thousands of literals takes seconds
    return tuple(F.expr(f"array({','.join(f'{x}L' for x in xs)})") for xs in (ends, inner))


def _fits(state: Column, merge: Column) -> Column:
    """Whether a merge joins two symbols that are there."""
    return (state.bitwiseAND(merge.ends) == merge.ends) & (F.bit_count(state.bitwiseAND(merge.inner)) == 1)


def _fold_bpe() -> Column:
    """Boundaries when no merge is left, as bits.

    The edges come by rank and place, and each is merged when its turn comes, if it fits. That is
    the model's order unless a merge makes one possible whose turn is over, which only those of odd
    pieces can do: where that happens, the word is folded again, with the best merge sought anew
    after each.
    """
    whole = _bit(F.char_length("word") + 1) - 1
    ends, inner = _masks()

    def merge(x: Column) -> Column:
        at = F.shiftright(x, 8).bitwiseAND(4095).cast("int")
        return F.struct(x.alias("edge"), F.get(ends, at).alias("ends"), F.get(inner, at).alias("inner"))

    merges = F.transform("edges", merge)

    def turn(acc: Column, x: Column) -> Column:
        after = acc.state.bitwiseAND(F.bitwise_not(x.inner))
        late = (x.edge.bitwiseAND(ODD) == 1) & _bound(after, lambda st: F.exists(acc.merges, lambda y: (y.edge < x.edge) & _fits(st, y)))
        return F.when(_fits(acc.state, x), F.struct(after.alias("state"), (acc.late | late).alias("late"), acc.merges.alias("merges"))).otherwise(acc)

    def again(acc: Column, _: Column) -> Column:
        best = F.get(F.filter(acc.merges, lambda x: _fits(acc.state, x)), F.lit(0))
        return F.struct(acc.state.bitwiseAND(F.bitwise_not(F.coalesce(best.inner, F.lit(0).cast("long")))).alias("state"), acc.merges.alias("merges"))

    def fold(m: Column) -> Column:
        once = F.aggregate(m, F.struct(whole.alias("state"), F.lit(False).alias("late"), m.alias("merges")), turn, lambda acc: F.struct(acc.state.alias("state"), acc.late.alias("late")))
        anew = F.aggregate(F.sequence(F.lit(1), F.char_length("word")), F.struct(whole.alias("state"), m.alias("merges")), again, lambda acc: acc.state)
        return _bound(once, lambda x: F.when(x.late, anew).otherwise(x.state))

    return _bound(merges, fold)


def _fold_viterbi(p: Pieces) -> Column:
    """Boundaries of the best path, as bits; ties to the shorter last piece."""
    n = F.char_length("word")
    scores = F.array(*[F.lit(float(x)) for x in sorted(set(p.scores.values()), reverse=True)])
    unknown = min(p.scores.values()) - 10
    edges = F.transform("edges", lambda x: F.struct(_ends(x)[0].alias("s"), _ends(x)[1].alias("e"), F.get(scores, F.shiftright(x, 20).cast("int")).alias("score")))
    first = F.struct(F.array(F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("s"))).alias("best"), edges.alias("edges"))

    def step(acc: Column, e: Column) -> Column:
        here = F.filter(acc.edges, lambda x: x.e == e)
        own = F.transform(here, lambda x: F.struct((F.get(acc.best, x.s).score + x.score).alias("score"), x.s.alias("s")))
        rare = F.array(F.struct((F.get(acc.best, e - 1).score + unknown).alias("score"), (e - 1).alias("s")))
        known = F.exists(here, lambda x: x.s == e - 1)
        return F.struct(F.concat(acc.best, F.array(F.array_max(F.when(known, own).otherwise(F.concat(own, rare))))).alias("best"), acc.edges.alias("edges"))

    best = F.aggregate(F.sequence(F.lit(1), n), first, step, lambda acc: acc.best)
    return F.aggregate(
        F.sequence(F.lit(1), n),
        F.struct(n.alias("at"), _bit(n).alias("bits"), best.alias("best")),
        lambda acc, _: F.when(acc.at == 0, acc).otherwise(_bound(F.get(acc.best, acc.at).s, lambda s: F.struct(s.alias("at"), acc.bits.bitwiseOR(_bit(s)).alias("bits"), acc.best.alias("best")))),
        lambda acc: acc.bits,
    )


def _spelled(word: str, bits: int, p: Pieces) -> list[int]:
    """Ids of the symbols between boundaries."""
    out: list[int] = []
    begin = 0
    for i in range(1, len(word) + 1):
        if bits >> i & 1:
            symbol = word[begin:i]
            out += [p.ids[symbol]] if symbol in p.ids else _bytes_of(symbol, p)
            begin = i
    return out


def encode_short(words: DataFrame, p: Pieces) -> DataFrame:
    """words(.., word), distinct, not empty and of at most LONG characters, with ids."""
    keys = words.columns
    folded = lattice(words, p).select(*keys, (_fold_viterbi(p) if p.fold == "viterbi" else _fold_bpe()).alias("bits"))
    place = keys.index("word")

    def spell(batches):
        for batch in batches:
            ids = [_spelled(w, b, p) for w, b in zip(batch.column(place).to_pylist(), batch.column(len(keys)).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], pa.array(ids, pa.list_(pa.int32()))], names=[*keys, "ids"])

    return folded.mapInArrow(spell, StructType([*words.schema.fields, StructField("ids", ArrayType(IntegerType()))]))


def encode_one(word: str, p: Pieces) -> list[int]:
    return (encode_viterbi if p.fold == "viterbi" else encode_bpe)(word, p)


# ---------------------------------------------------------------- documents
def _texts(rows: pa.RecordBatch) -> pa.Array:
    return rows.column(rows.schema.get_field_index("text"))


def _asked(blocks: DataFrame, p: Pieces, spans: int) -> DataFrame:
    """(block, span, words): the distinct words of each block, in parts."""

    def work(batches):
        cutter = Cutter(p)
        for batch in batches:
            for block, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = cutter.cut(_texts(unpack(body.as_buffer())))[2]
                order, parts = v.dealt(words, spans)
                words = words.take(pa.array(order))
                sealed = [v.seal(*v.parts_of(words.slice(i, j - i))) for _, i, j in parts]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(parts), block, np.int64)), pa.array([x for x, _, _ in parts], pa.int32()), pa.array(sealed, pa.binary())], names=["block", "span", "words"])
        trim()

    return blocks.select("block", "body").mapInArrow(work, "block long, span int, words binary")


def _words(parts: DataFrame) -> DataFrame:
    """(span, word): each distinct word once."""

    def work(t: pa.Table) -> pa.Table:
        words = v.distinct([v.words_of(*v.unseal(x)) for x in t["words"]])
        trim()
        return pa.table([pa.array(np.full(len(words), t["span"][0].as_py() if t.num_rows else 0, np.int32)), words.cast(pa.string())], names=["span", "word"])

    return parts.select("span", "words").groupBy("span").applyInArrow(work, "span int, word string")


def encode_words(words: DataFrame, p: Pieces) -> DataFrame:
    """words(.., word), distinct and not empty, with ids: by the lattice, or in Python where they are too long for its state."""
    spark = words.sparkSession
    size = F.char_length("word")
    short = words.where(size <= LONG)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-short.count() // FOLDED))
    place = words.columns.index("word")

    def fold(batches):
        for batch in batches:
            yield batch.append_column("ids", pa.array([encode_one(w, p) for w in batch.column(place).to_pylist()], pa.list_(pa.int32())))

    long = words.where(size > LONG).mapInArrow(fold, StructType([*words.schema.fields, StructField("ids", ArrayType(IntegerType()))]))
    return encode_short(short.repartition(parts, "word"), p).unionByName(long)


@contextmanager
def _grouped_in_memory(spark: SparkSession):
    """Tasks hold FOLDED words at most: their edges are grouped by hash and not sorted, which would spill."""
    key = "spark.sql.objectHashAggregate.sortBased.fallbackThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, str(4 * FOLDED))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _answers(parts: DataFrame, encoded: DataFrame) -> DataFrame:
    """(block, span, ids): the ids of each part's words, in the part's order."""

    def work(asked: pa.Table, told: pa.Table) -> pa.Table:
        known, ids = told["word"].combine_chunks().cast(pa.binary()), told["ids"].combine_chunks()
        out = []
        for x in asked["words"]:
            own = ids.take(pa.array(v.places(v.words_of(*v.unseal(x)), known)))
            out.append(v.seal(own.value_lengths().to_numpy().astype(np.uint32), own.flatten().to_numpy()))
        trim()
        return pa.table([asked["block"], asked["span"], pa.array(out, pa.binary())], names=["block", "span", "ids"])

    return parts.groupBy("span").cogroup(encoded.groupBy("span")).applyInArrow(work, "block long, span int, ids binary")


class Decoder:
    """Texts of ids. Bytes that are no character become replacement characters; ids that are no piece give nothing."""

    def __init__(self, p: Pieces):
        names = p.names()
        spelled = (names[i].replace(SPACE, " ").encode() if i in names else bytes([i - p.byte]) if p.byte <= i < p.byte + 256 else b"" for i in range(max([*names, p.byte + 255]) + 1))
        self.spelled = pa.array(spelled, pa.binary())

    def texts(self, ids: pa.ListArray) -> pa.Array:
        data, length = v.parts_of(self.spelled.take(ids.flatten()))
        ends = np.concatenate([[0], np.cumsum(length, dtype=np.int64)])[np.concatenate([[0], np.cumsum(ids.value_lengths().fill_null(0).to_numpy())])].tolist()
        raw = data.tobytes()
        return pa.array([None if null else raw[a:b].decode("utf8", "replace").removeprefix(" ") for a, b, null in zip(ends, ends[1:], ids.is_null().to_pylist(), strict=False)], pa.string())


def encode(docs: DataFrame, p: Pieces, decoded: bool = False) -> DataFrame:
    """docs(text, ...) with a column ids added, array<int>; and, if asked for, one named decoded, as decode() adds it."""
    added = [StructField("ids", ArrayType(IntegerType())), *([StructField("decoded", StringType())] if decoded else [])]
    if clash := {f.name for f in added} & set(docs.columns):
        raise ValueError(f"docs have a column named {min(clash)}")
    spark = docs.sparkSession
    blocks = bucketed(packed(docs, BLOCK), "block", "pieces")
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spans = v.span_count(total_bytes(blocks), least)
    parts = bucketed(_asked(blocks, p, spans), "span", "asked", least)
    words = saved(_words(parts), "words")
    with _grouped_in_memory(spark):
        encoded = bucketed(encode_words(words, p), "span", "encoded", least)
    forget(words)
    answers = _answers(parts, encoded)
    schema = StructType([*docs.schema.fields, *added])

    def work(bodies: pa.Table, told: pa.Table) -> pa.Table:
        told = told.sort_by("span")
        answered = [v.unseal(x) for x in told["ids"]]
        size = np.concatenate([np.zeros(0, np.uint32), *[x for x, _ in answered]])
        ids = np.concatenate([np.zeros(0, np.int32), *[x for _, x in answered]])
        del told, answered
        out, cutter, decoder = [], Cutter(p), Decoder(p)
        for body in bodies["body"]:
            rows = unpack(body.as_buffer())
            count, at, words = cutter.cut(_texts(rows))
            order, _ = v.dealt(words, spans)
            del words
            back = np.empty(len(order), np.int64)
            back[order] = np.arange(len(order))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(ids, pa.int32()))
            flat = back[at]
            ends = np.concatenate([[0], np.cumsum(size[flat])])[np.concatenate([[0], np.cumsum(count)])]
            each = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), lists.take(pa.array(flat)).flatten(), mask=_texts(rows).is_null())
            parts = slices([pa.RecordBatch.from_arrays([*rows.columns, each], names=[*rows.schema.names, "ids"])], most=1 << 20)
            out += [x.append_column("decoded", decoder.texts(x.column(x.num_columns - 1))) if decoded else x for x in parts]
            del count, at, order, back, lists, flat, ends, each
        trim()
        return pa.Table.from_batches(out)

    return blocks.select("block", "body").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(work, schema)


def decode(docs: DataFrame, p: Pieces, column: str = "ids") -> DataFrame:
    """docs with a column decoded, the text of the ids; null for null ids."""
    if "decoded" in docs.columns:
        raise ValueError("docs have a column named decoded")
    place = docs.columns.index(column)

    def work(batches):
        decoder = Decoder(p)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                yield part.append_column("decoded", decoder.texts(part.column(place)))
        trim()

    return docs.mapInArrow(work, StructType([*docs.schema.fields, StructField("decoded", StringType())]))
