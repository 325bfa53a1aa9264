"""The context-mixing model: bit predictors, gated mixing and its coding of texts.

What is coded of a text is its lower-cased words, each with one space behind it, and an end; which
white space stood between words is not in the probability. A byte is a walk down the Huffman tree
of all 256 bytes, and every step of the walk is one bit to predict.

Four predictors see a step, each in a context of its own: the last 2, 3 and 5 bytes, but nothing
before the word, and the word so far; at the first byte of a word no context, the last 2 and 3
bytes of the word before, and that whole word. A predictor says the log odds of the bit that it
has met in its context in the training texts. Contexts are kept by 64-bit hashes; those of up to 5
bytes are one to one.

The log odds are weighted, summed and squashed. Weights are gated: by whether the byte is a word's
first one, and by how often the longest context that was met at all was met at that node. At first
bytes and inside, the weights lie on a line of MIXES sets, from trust in short contexts to trust in
long ones, and every text has its two places on the line, which move down the gradient of the
coding cost after 4, 8, 16 and then every 16 words.
Between two sets the cost is interpolated: the geometric mean of two distributions never sums to
more than one, so that costs stay those of a code.

With such contexts the cost of a word's inside under a set is the word's own, and that of its first
byte is the pair's of the word before and the byte. Both are found once for each distinct word and
pair of the corpus (`asked`, `costs`); scoring a text (`scored`) adds them up and moves the places.

Words are cut where a character of three or four bytes stands, which is a unit by itself, and after
LIMIT bytes, so that unspaced scripts have units that come again. Units end in a sign, which is
coded with them: SPACE behind a word, MORE inside a cut word, LAST behind its last unit.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pushflow.llm import vocabulary as v
from pushflow.llm.common import _P, _PINV, _SPACE, lowered, mix, powers, slices, utf8

PREDICTORS = 4
MIXES = 5
LIMIT = 32
SPACE, MORE, LAST, WHOLE, END = 32, 9, 11, 12, 10
#: The unit before a text's first one.
START = b"\n"
#: How often a context was met: under 1, under 3 and so on.
MET = np.array([1, 3, 9, 40, 200])
#: Weights of the four predictors at the middle of the line, at first bytes and inside words, by how
#: often the second-longest context was met (six) where the longest was not, and by how often that was (five).
WEIGHTS = np.array([
    [[0.35, 0.4, 0.3, 0.3], [0.35, 0.4, 0.1, 0.3], [0.2, 0.3, 0.2, 0.3], [0.05, 0.15, 0.8, 0.3], [0.1, 0.1, 0.85, 0.3], [0.1, 0.0, 0.95, 0.3],
     [0.05, 0.0, 0.7, 0.4], [0.0, 0.0, 0.6, 0.4], [0.0, 0.0, 0.35, 0.65], [0.0, 0.0, 0.15, 0.85], [0.0, 0.0, 0.06, 0.94]],
    [[0.55, 0.35, 0.3, 0.3], [0.2, 0.5, 0.3, 0.3], [0.1, 0.5, 0.35, 0.3], [0.1, 0.35, 0.5, 0.3], [0.05, 0.25, 0.6, 0.3], [0.05, 0.25, 0.7, 0.3],
     [0.1, 0.35, 0.25, 0.55], [0.1, 0.25, 0.25, 0.5], [0.05, 0.15, 0.2, 0.6], [0.0, 0.1, 0.1, 0.75], [0.0, 0.0, 0.15, 0.82]],
])
#: How the weights lean at the line's ends, as powers of e, from the shortest to the longest context.
LEAN = np.array([1.0, 0.7, 0.2, -0.4])
#: What a count has besides what was met.
BESIDE = 0.1
RATE = 0.1
WINDOWS = (4, 8, 16)

_U = np.uint64


# ---------------------------------------------------------------- the tree
@dataclass
class Tree:
    """Leaves stand in order below the tree, so that a node is an interval of leaves."""

    leaf: np.ndarray  # of each byte
    middle: np.ndarray  # (depth, byte): where the node's one side begins
    bit: np.ndarray  # (depth, byte): the side taken
    length: np.ndarray  # of each byte's walk


def tree(histogram: np.ndarray) -> Tree:
    """The Huffman tree of the bytes, ties to the smaller byte."""
    heap = [(float(n) + 1, b, (b,)) for b, n in enumerate(histogram)]
    heapq.heapify(heap)
    sides: list[tuple[tuple, tuple]] = []
    while len(heap) > 1:
        (m, i, zero), (n, j, one) = heapq.heappop(heap), heapq.heappop(heap)
        sides.append((zero, one))
        heapq.heappush(heap, (m + n, min(i, j), zero + one))
    order = sides[-1][0] + sides[-1][1]
    leaf = np.empty(256, np.int64)
    leaf[list(order)] = np.arange(256)
    paths: list[list[tuple[int, int]]] = [[] for _ in range(256)]
    for zero, one in reversed(sides):
        for bit, side in enumerate((zero, one)):
            for b in side:
                paths[b].append((int(leaf[one[0]]), bit))
    deepest = max(map(len, paths))
    middle, bits = np.zeros((deepest, 256), np.int64), np.zeros((deepest, 256), bool)
    for b, path in enumerate(paths):
        for d, (m, bit) in enumerate(path):
            middle[d, b], bits[d, b] = m, bit
    return Tree(leaf, middle, bits, np.array(list(map(len, paths))))


# ---------------------------------------------------------------- texts to units
@dataclass
class Laid:
    """The units of some texts. Every text has, after its units, one more place for its end."""

    units: pa.Array  # distinct ones, START first; a cut word is one more, ending in WHOLE
    unit: np.ndarray  # of each place its unit, len(units) at an end
    pair: np.ndarray  # of each place the unit before times 256 plus the first byte
    places: np.ndarray  # of each text
    word: np.ndarray  # of each word its unit
    words: np.ndarray  # of each text
    size: np.ndarray  # bytes coded of each text, the end included


def _cut(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Of words the number of units, and these."""
    at = np.repeat(starts - (np.cumsum(ends - starts) - (ends - starts)), ends - starts) + np.arange(int((ends - starts).sum()))
    own, size = data[at], ends - starts  # the words end to end
    end = np.cumsum(size)
    edge = np.zeros(len(own) + 5, bool)
    edge[end - size] = True
    wide = np.flatnonzero(own >= 0xE0)
    edge[wide] = edge[wide + 3 + (own[wide] >= 0xF0)] = True
    begin = np.flatnonzero(edge[: len(own)])
    stop = np.append(begin[1:], len(own))
    pieces = -(-(stop - begin) // LIMIT)
    number = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = np.repeat(begin, pieces) + number * LIMIT
    stop = np.minimum(begin + LIMIT, np.repeat(stop, pieces))
    length = stop - begin + 1
    after = np.cumsum(length)
    out = np.append(own, np.uint8(0))[np.repeat(begin - (after - length), length) + np.arange(int(length.sum()))]
    out[after - 1] = np.where(np.isin(stop, end, assume_unique=True), LAST, MORE)
    return np.diff(np.searchsorted(begin, np.concatenate([[0], end]))), v.words_of(out, length)


def laid(texts: pa.Array) -> Laid:
    """The units of a column of texts; null is empty."""
    found, each = [pa.array([START], pa.binary()).dictionary_encode()], []
    for part in slices([pa.RecordBatch.from_arrays([texts], names=["text"])], most=2 << 20):
        # a line break behind each text: white space follows every word
        data, offsets = utf8(pc.binary_join_element_wise(pc.fill_null(part.column(0), ""), "", "\n"))
        data = lowered(data)
        space = _SPACE[data]
        turns = np.flatnonzero(space[1:] != space[:-1]) + 1
        if not space[0]:
            turns = np.append(0, turns)
        starts, ends = turns[::2], turns[1::2]
        space[ends] = False  # one white space stays behind each word, and becomes its sign
        own = data[~space]
        length = ends - starts + 1
        last = np.cumsum(length) - 1
        own[last] = SPACE
        odd = length > LIMIT + 1
        odd[np.searchsorted(ends, np.flatnonzero(data >= 0xE0), "right")] = True
        odd = np.flatnonzero(odd)
        own[last[odd]] = WHOLE
        units, pieces = np.ones(len(starts), np.int64), pa.array([], pa.binary())
        if len(odd):
            units[odd], pieces = _cut(data, starts[odd], ends[odd])
        found += [v.words_of(own, length).dictionary_encode(), pieces.dictionary_encode()]
        bounds = np.searchsorted(starts, offsets)
        each.append((bounds, np.add.reduceat(np.append(length, 0), bounds[:-1]) * (np.diff(bounds) > 0), units, odd))
    whole = pa.chunked_array(found).unify_dictionaries()
    distinct = whole.chunk(0).dictionary
    codes = [c.indices.to_numpy() for c in whole.chunks[1:]]
    lead, length = v.parts_of(distinct)
    lead = lead[np.cumsum(length, dtype=np.int64) - length]  # first byte of each unit
    unit, pair, word, places, count, size = [], [], [], [], [], []
    for (bounds, coded, units, odd), own, pieces in zip(each, codes[::2], codes[1::2], strict=True):
        seq = np.repeat(own, units)
        if len(odd):
            first = (np.cumsum(units) - units)[odd]
            seq[np.repeat(first - (np.cumsum(units[odd]) - units[odd]), units[odd]) + np.arange(len(pieces))] = pieces
        n = np.diff(np.concatenate([[0], np.cumsum(units)])[bounds])
        ends = np.cumsum(n)
        unit.append(np.insert(seq, ends, len(distinct)))
        before = np.insert(seq, ends - n, 0)  # START stands before a text's first unit
        pair.append(before * 256 + np.insert(lead[seq], ends, END).astype(np.int64))
        word.append(own.astype(np.int64))
        places.append(n + 1)
        count.append(np.diff(bounds))
        size.append(coded + 1)
    join = lambda xs, kind=np.int64: np.concatenate([np.zeros(0, kind), *xs])
    return Laid(distinct, join(unit, np.int32), join(pair), join(places), join(word), join(count), join(size))


def encoded(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in order of first use, and of each code its place among them."""
    out = pa.array(codes).dictionary_encode()
    return out.dictionary.to_numpy(), out.indices.to_numpy()


# ---------------------------------------------------------------- counts of units
@dataclass
class Chunk:
    """Some units, and of each the bytes that follow it, in order, with how often they do in training texts."""

    units: pa.Array
    following: np.ndarray  # number of each unit's followers
    byte: np.ndarray
    count: np.ndarray

    def sealed(self) -> bytes:
        return v.seal(*v.parts_of(self.units), self.following.astype(np.uint16), self.byte.astype(np.uint8), self.count.astype(np.int64))

    @staticmethod
    def opened(seal) -> Chunk:
        data, length, following, byte, count = v.unseal(seal)
        return Chunk(v.words_of(data, length), following.astype(np.int64), byte.astype(np.int64), count)

    def pairs(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.units)), self.following) * 256 + self.byte

    def totals(self) -> np.ndarray:
        """How often each unit stands in training texts."""
        return np.bincount(np.repeat(np.arange(len(self.units)), self.following), self.count, len(self.units)).astype(np.int64)


def _chunk(units: pa.Array, pairs: np.ndarray, count: np.ndarray) -> Chunk:
    """pairs: distinct, in order."""
    return Chunk(units, np.bincount(pairs // 256, minlength=len(units)), pairs % 256, count)


@dataclass
class Named:
    """What texts ask: their units and pairs, in the order of the spans that the units belong to."""

    units: pa.Array
    spans: list[tuple[int, int, int]]  # span, and begin and end of its units
    place: np.ndarray  # of each of the texts' units
    pairs: np.ndarray  # place of the unit times 256 plus the byte
    pair: np.ndarray  # of each of the texts' places the place of its pair

    def chunk(self, i: int, j: int, count: np.ndarray) -> Chunk:
        a, b = np.searchsorted(self.pairs, [i * 256, j * 256])
        return _chunk(self.units.slice(i, j - i), self.pairs[a:b] - i * 256, count[a:b])


def named(texts: Laid, spans: int) -> Named:
    order, parts = v.dealt(texts.units, spans)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    pairs, at = encoded(texts.pair)
    moved = place[pairs // 256] * 256 + pairs % 256
    # cut words have no followers: a byte of 0 carries their number
    cut = np.ones(len(place), bool)
    cut[texts.unit[texts.unit < len(place)]] = False
    cut[0] = False
    moved = np.concatenate([moved, place[cut] * 256])
    sort = np.argsort(moved)
    back = np.empty(len(sort), np.int64)
    back[sort] = np.arange(len(sort))
    return Named(texts.units.take(pa.array(order)), parts, place, moved[sort], back[at])


def counted(texts: Laid, own: Named, trained: np.ndarray) -> np.ndarray:
    """How often each pair stands in the texts that are trained on."""
    count = np.bincount(own.pair[np.repeat(trained, texts.places)], minlength=len(own.pairs))
    words = np.bincount(own.place[texts.word[np.repeat(trained, texts.words)]], minlength=len(own.place))
    cut = np.flatnonzero(own.pairs % 256 == 0)  # no text has a byte of 0 that is not a character's
    data, length = v.parts_of(own.units)
    cut = cut[data[np.cumsum(length, dtype=np.int64) - 1][own.pairs[cut] // 256] == WHOLE]
    count[cut] = words[own.pairs[cut] // 256]
    return count


def together(parts: list[Chunk]) -> Chunk:
    """The sum of some chunks."""
    units = v.distinct([x.units for x in parts])
    pairs = np.concatenate([np.zeros(0, np.int64), *[np.repeat(v.places(x.units, units), x.following) * 256 + x.byte for x in parts]])
    own, at = np.unique(pairs, return_inverse=True)
    return _chunk(units, own, np.bincount(at, np.concatenate([np.zeros(0, np.int64), *[x.count for x in parts]]), len(own)).astype(np.int64))


def tokens(chunk: Chunk) -> tuple[int, int]:
    """How many words the training texts have, and how many distinct ones, of those in a chunk."""
    data, length = v.parts_of(chunk.units)
    last = data[np.cumsum(length, dtype=np.int64) - 1]
    own = chunk.totals()[(last == SPACE) | (last == WHOLE)]
    return int(own.sum()), int(np.count_nonzero(own))


# ---------------------------------------------------------------- contexts
@dataclass
class Asked:
    """Every byte that a chunk predicts: inside its units, then behind them. `keys` and `pairs` are distinct and in order."""

    keys: np.ndarray
    pairs: np.ndarray  # place of the key times 256 plus the byte's leaf
    count: np.ndarray
    byte: np.ndarray  # of each prediction
    pair: np.ndarray  # (predictor, prediction): its place in pairs
    inside: np.ndarray  # number of predictions inside each unit
    followers: np.ndarray  # whether each pair of the chunk is one of a follower


def asked(chunk: Chunk, t: Tree) -> Asked:
    """The contexts of a chunk's predictions."""
    data, length = v.parts_of(chunk.units)
    length = length.astype(np.int64)
    end = np.cumsum(length)
    start = end - length
    whole = data[end - 1] == WHOLE
    inside = np.where(whole, 0, length - 1)
    of = np.repeat(np.arange(len(length)), inside)
    i = np.arange(int(inside.sum())) - np.repeat(np.cumsum(inside) - inside, inside) + 1  # bytes before, in the unit
    at = start[of] + i
    behind = np.repeat(np.arange(len(length)), np.where(whole, 0, chunk.following))
    followers = ~np.repeat(whole, chunk.following)
    wide = data.astype(np.uint64)
    before = np.zeros(len(data) + 1, np.uint64)  # the five bytes before a place, the last one lowest
    for k in range(1, 6):
        before[k:] |= wide[: len(data) - k + 1] << _U(8 * (k - 1))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((wide + _U(1)) * powers(_P, len(data) + 1)[: len(data)], out=sums[1:])

    def last(k: int, there: np.ndarray, have: np.ndarray) -> np.ndarray:
        """Key of the last k bytes, or of the unit so far where that is shorter."""
        n = np.minimum(have, k).astype(np.uint64)
        return mix((before[there] & ((_U(1) << _U(8) * n) - _U(1))) | (n << _U(48)) | ((have < k).astype(np.uint64) << _U(56)))

    def so_far(there: np.ndarray, begin: np.ndarray, have: np.ndarray, kind: int) -> np.ndarray:
        far = (sums[there] - sums[begin]) * powers(_PINV, len(data) + 1)[begin]
        return mix(mix(far + _U(kind)) + have.astype(np.uint64))

    short = i <= 5  # the unit so far, as last() has it
    inner = np.where(short, last(6, at, i), so_far(at, start[of], i, 1))
    there, have = end[behind], length[behind]
    keys = [
        np.concatenate([last(2, at, i), np.full(len(behind), mix(np.array([7], np.uint64))[0])]),
        np.concatenate([last(3, at, i), last(2, there, have)]),
        np.concatenate([last(5, at, i), last(3, there, have)]),
        np.concatenate([inner, so_far(there, start[behind], have, 2)]),
    ]
    byte = np.concatenate([data[at].astype(np.int64), chunk.byte[followers]])
    weight = np.concatenate([chunk.totals()[of], chunk.count[followers]])
    del wide, before, sums
    own, place = encoded(np.concatenate(keys))
    del keys
    order = np.argsort(own)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    pairs, pair = encoded(rank[place] * 256 + np.tile(t.leaf[byte], PREDICTORS))
    sort = np.argsort(pairs)
    back = np.empty(len(sort), np.int32)
    back[sort] = np.arange(len(sort))
    pair = back[pair].reshape(PREDICTORS, -1)
    # equal contexts of two predictors count once: their sums are the context's own
    twice = np.zeros(pair.shape, bool)
    for k in range(1, PREDICTORS):
        twice[k] = (pair[:k] == pair[k]).any(0)
    count = sum(np.bincount(pair[k][~twice[k]], weight[~twice[k]], len(pairs)) for k in range(PREDICTORS))
    return Asked(own[order], pairs[sort], np.asarray(count, np.float64).astype(np.int64), byte, pair, inside, followers)


def key_spans(a: Asked, bits: int):
    """(span, sealed keys, numbers of leaves, leaves and counts) of the spans of keys, for those that were met, and the rest."""
    span = (a.keys >> _U(64 - bits)).astype(np.int64) if bits else np.zeros(len(a.keys), np.int64)
    first = np.flatnonzero(np.diff(span, prepend=-1))
    for i, j in zip(first.tolist(), [*first[1:].tolist(), len(a.keys)], strict=True):
        x, y = np.searchsorted(a.pairs, [i * 256, j * 256])
        met = a.count[x:y] > 0
        pairs = a.pairs[x:y][met] - i * 256
        yield int(span[i]), v.seal(np.diff(a.keys[i:j], prepend=_U(0)), np.bincount(pairs // 256, minlength=j - i).astype(np.uint16), (pairs % 256).astype(np.uint8), a.count[x:y][met])


def summed(parts: list) -> list[bytes]:
    """Of each sealed part of one span of keys, the counts that all parts have of its keys."""
    opened = [v.unseal(x) for x in parts]
    keys = [np.cumsum(x[0], dtype=np.uint64) for x in opened]
    own = np.unique(np.concatenate(keys))
    place = [np.searchsorted(own, k) for k in keys]
    pairs = np.concatenate([np.repeat(p, x[1]) * 256 + x[2] for p, x in zip(place, opened, strict=True)])
    pairs, at = np.unique(pairs, return_inverse=True)
    count = np.bincount(at, np.concatenate([x[3] for x in opened]), len(pairs)).astype(np.int64)
    bounds = np.searchsorted(pairs, np.arange(len(own) + 1) * 256)
    out = []
    for p in place:
        size = bounds[p + 1] - bounds[p]
        take = np.repeat(bounds[p] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        out.append(v.seal(size.astype(np.uint16), (pairs[take] % 256).astype(np.uint8), count[take]))
    return out


# ---------------------------------------------------------------- costs
def _odds(a: Asked, told: list, t: Tree) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each depth, in each of the chunk's (context, byte): the log odds of the bit that comes; how often the context was met there, by MET."""
    parts = [v.unseal(x) for x in told]
    size = np.concatenate([np.zeros(0, np.int64), *[x[0] for x in parts]])
    codes = np.repeat(np.arange(len(size)), size) * 256 + np.concatenate([np.zeros(0, np.uint8), *[x[1] for x in parts]])
    sums = np.concatenate([[0], np.cumsum(np.concatenate([np.zeros(0, np.int64), *[x[2] for x in parts]]))])
    bounds = np.concatenate([[0], np.cumsum(size)])
    key = a.pairs // 256
    byte = np.empty(256, np.int64)
    byte[t.leaf] = np.arange(256)
    byte = byte[a.pairs % 256]
    low, high = bounds[key], bounds[key + 1]
    out, met = [], []
    on = np.flatnonzero(low < high)
    for d in range(len(t.middle)):
        on = on[(t.length[byte[on]] > d) & (low[on] < high[on])]
        own = byte[on]
        middle = np.searchsorted(codes, key[on] * 256 + t.middle[d][own])
        below, here, above = sums[low[on]], sums[middle], sums[high[on]]
        taken = t.bit[d][own]
        one = np.where(taken, above - here, here - below)
        odds, often = np.zeros(len(key), np.float32), np.zeros(len(key), np.int8)
        odds[on] = np.log((one + BESIDE) / (above - below - one + BESIDE))
        often[on] = np.searchsorted(MET, above - below, "right")
        low[on], high[on] = np.where(taken, middle, low[on]), np.where(taken, high[on], middle)
        out.append(odds)
        met.append(often)
    return out, met


def costs(a: Asked, told: list, t: Tree, few: int = 1 << 14) -> tuple[np.ndarray, np.ndarray]:
    """Bits of (unit, set), for each unit's inside, and of (pair, set), for the chunk's pairs; cut words have none.

    Some predictions at a time, whose numbers stay in the cache; those of long walks come first,
    so that the walks that go on are the first ones.
    """
    odds, met = _odds(a, told, t)
    n = int(a.inside.sum())
    lean = np.exp(-LEAN[:, None] * np.linspace(-1, 1, MIXES)).astype(np.float32).T.copy()
    bits = np.empty((len(a.byte), MIXES), np.float32)
    for gate, lo, hi in ((1, 0, n), (0, n, len(a.byte))):
        weight = np.ascontiguousarray(WEIGHTS[gate].T, np.float32)
        for i in range(lo, hi, few):
            j = min(hi, i + few)
            length = t.length[a.byte[i:j]]
            order = np.argsort(-length, kind="stable")
            pair = a.pair[:, i:j].take(order, axis=1)
            left = np.searchsorted(-length[order], -np.arange(len(t.middle)), "left")
            sums = np.zeros((MIXES, j - i), np.float32)
            for d, m in enumerate(left.tolist()):
                if not m:
                    break
                often = met[d].take(pair[3, :m])
                by = np.where(often > 0, often + len(MET), met[d].take(pair[2, :m]))
                said = np.empty((PREDICTORS, m), np.float32)
                for k in range(PREDICTORS):
                    np.multiply(odds[d].take(pair[k, :m]), weight[k].take(by), out=said[k])
                x = lean @ said
                np.negative(x, out=x)
                np.minimum(x, 80, out=x)
                np.exp(x, out=x)
                x += 1
                sums[:, :m] += np.log(x, out=x)
            bits[i + order] = sums.T
    bits /= np.float32(np.log(2))
    sums = np.concatenate([np.zeros((1, MIXES)), np.cumsum(bits[:n], axis=0, dtype=np.float64)])
    ends = np.cumsum(a.inside)
    first = np.zeros((len(a.followers), MIXES), np.float32)
    first[a.followers] = bits[n:]
    return (sums[ends] - sums[ends - a.inside]).astype(np.float32), first


#: Costs are sent in whole parts of a bit.
PART = 128


def sealed_costs(bits: np.ndarray) -> list[np.ndarray]:
    whole = np.rint(bits * PART).astype(np.int32)
    return [whole[:, 0], *(np.diff(whole, axis=1).T)]


def opened_costs(columns: list[np.ndarray]) -> np.ndarray:
    return np.cumsum(np.stack(columns, axis=1), axis=1).astype(np.float32) / PART


# ---------------------------------------------------------------- scoring
def scored(texts: Laid, inside: np.ndarray, first: np.ndarray, pair: np.ndarray, rate: float = RATE) -> np.ndarray:
    """Bits of each text. inside: bits of (unit, set); first: bits of (pair, set); pair: of each place its pair."""
    inside = np.concatenate([inside, np.zeros((1, MIXES), np.float32)])  # an end has no inside
    order = np.argsort(-texts.places, kind="stable")
    begin, size = (np.cumsum(texts.places) - texts.places)[order], texts.places[order]
    bits = np.zeros(len(order))
    at = np.full((2, len(order)), (MIXES - 1) / 2)
    c, windows = 0, iter(WINDOWS)
    step = WINDOWS[0]
    while len(size) and c < size[0]:
        until = next(windows, c + WINDOWS[-1])
        step = until - c
        live = int(np.searchsorted(-size, -c, "left"))
        count = np.minimum(size[:live] - c, step)
        head = np.cumsum(count) - count
        place = np.repeat(begin[:live] + c - head, count) + np.arange(int(count.sum()))
        for gate, table, row in ((0, first, pair[place]), (1, inside, texts.unit[place])):
            low = np.minimum(at[gate, :live].astype(np.int64), MIXES - 2)
            part = at[gate, :live] - low
            flat = row.astype(np.int64) * MIXES + np.repeat(low, count)
            a = np.add.reduceat(table.take(flat), head, dtype=np.float64)
            b = np.add.reduceat(table.take(flat + 1), head, dtype=np.float64)
            bits[:live] += a + (b - a) * part
            at[gate, :live] = np.clip(at[gate, :live] - rate * (b - a), 0, MIXES - 1)
        c = until
    out = np.empty(len(order))
    out[order] = bits
    return out
