"""Questions about words that blocks of documents ask the whole corpus.

A block names its distinct words once, cut by hash into spans; what is asked of a span by all
blocks meets in one group, is settled once for each distinct word, and goes back to the blocks
in the order in which they named the words. Spans hash whole words, so a word that every block
holds is one entry of a block's part and no key of its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from pushflow.llm.common import span_hashes

#: Bytes of text for each span: a group has the words that so much text adds to a part.
SPAN = 8 << 20

_CODEC = pa.Codec("zstd", 1)


def span_count(total_bytes: int, least: int) -> int:
    return max(least, -(-total_bytes // SPAN))


# ---------------------------------------------------------------- arrays in few bytes
def seal(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers as one compressed string. The numbers' first bytes stand together, then
    their second ones and so on: high bytes of small numbers compress to nothing."""
    head, body = [len(arrays)], []
    for x in arrays:
        x = np.ascontiguousarray(x)
        head += [ord(x.dtype.char), len(x)]
        body.append(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes() if x.itemsize > 1 else x.tobytes())
    raw = np.array(head, np.int64).tobytes() + b"".join(body)
    return len(raw).to_bytes(8, "little") + _CODEC.compress(raw, asbytes=True)


def unseal(sealed) -> list[np.ndarray]:
    """The arrays of a binary scalar or of bytes."""
    given = sealed.as_buffer() if isinstance(sealed, pa.Scalar) else pa.py_buffer(sealed)
    raw = _CODEC.decompress(given.slice(8), int.from_bytes(given.slice(0, 8).to_pybytes(), "little"))
    count = int(np.frombuffer(raw, np.int64, 1)[0])
    head = np.frombuffer(raw, np.int64, 2 * count, 8).tolist()
    at, out = 8 + 16 * count, []
    for char, n in zip(head[::2], head[1::2], strict=True):
        kind = np.dtype(chr(char))
        x = np.frombuffer(raw, np.uint8, n * kind.itemsize, at)
        out.append(np.ascontiguousarray(x.reshape(kind.itemsize, n).T).view(kind).ravel() if kind.itemsize > 1 else x.view(kind))
        at += n * kind.itemsize
    return out


# ---------------------------------------------------------------- words
def parts_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and lengths of words without nulls."""
    if pa.types.is_string(words.type):
        words = words.cast(pa.binary())
    _, offsets, data = words.buffers()
    off = np.frombuffer(offsets, np.int64 if pa.types.is_large_binary(words.type) else np.int32)[words.offset : words.offset + len(words) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], np.diff(off).astype(np.uint32)


def words_of(data: np.ndarray, lengths: np.ndarray) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
    if ends[-1] > np.iinfo(np.int32).max:
        raise ValueError("more than 2 GiB of words in one part")
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def spans_of(words: pa.Array, spans: int, few: int = 1 << 15) -> np.ndarray:
    """The span of each word, by its bytes; some words at a time, as their hashing takes many times their size."""
    out = np.empty(len(words), np.int32)
    for i in range(0, len(words), few):
        data, lengths = parts_of(words.slice(i, few))
        ends = np.cumsum(lengths, dtype=np.int64)
        hashed = span_hashes(data, ends - lengths, ends)
        out[i : i + few] = (hashed >> np.uint64(32)) * np.uint64(spans) >> np.uint64(32)
    return out


def dealt(words: pa.Array, spans: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """The order that brings words to their spans, and (span, begin, end) of what each span holds then."""
    span = spans_of(words, spans)
    order = np.argsort(span, kind="stable")
    first = np.flatnonzero(np.diff(span[order], prepend=-1))
    ends = [*first[1:].tolist(), len(order)][: len(first)]
    return order, list(zip(span[order[first]].tolist(), first.tolist(), ends, strict=True))


def distinct(parts: list[pa.Array]) -> pa.Array:
    return pa.chunked_array([p.unique() for p in parts], pa.binary()).unique() if parts else pa.array([], pa.binary())


def places(words: pa.Array, known: pa.Array) -> np.ndarray:
    """Of each word its place in known, which holds all of them."""
    import pyarrow.compute as pc

    return pc.index_in(words, value_set=known).to_numpy(zero_copy_only=False).astype(np.int64)
