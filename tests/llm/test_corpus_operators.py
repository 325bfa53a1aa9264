"""Scores, search, near duplicates, repeats, pieces and the pipeline against brute force and on odd rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pushflow.llm import ann, minhash, mixing, pieces, repeats, score, vocabulary
from pushflow.llm.components import components
from pushflow.llm.queries import PIECES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def corpus(rng: random.Random, n: int) -> list[tuple[int, str]]:
    """Texts with exact and near copies, shared passages and odd rows."""
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(150)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(40))
    texts: list[str] = []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 90))]
        if texts and i % 4 == 0:
            words = texts[rng.randrange(len(texts))].split()
            for _ in range(rng.randint(0, 3)):
                if words:
                    words[rng.randrange(len(words))] = rng.choice(vocabulary)
        if i % 5 == 0:
            words.insert(rng.randint(0, len(words)), passage)
        texts.append(" ".join(words) if i % 7 else " ".join(words).upper())
    return list(enumerate(texts))


ODD = [(900, None), (901, ""), (902, " \t\n"), (903, "one"), (904, "one"), (905, "one two"), (None, "one"), (3, "again under one id"), (3, "again under one id"), (906, "long " * 30_000), (907, "x" * 70_000)]
SCHEMA = "doc_id long, text string"


# ---------------------------------------------------------------- near duplicates
def sets(text: str | None, width: int) -> frozenset:
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def plain_groups(docs, width, percent):
    own = [sets(t, width) for _, t in docs]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(own):
        for j in range(i):
            b = own[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    ids = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            ids[find(i)] = min(ids.get(find(i), d), d)
    return [(d, len(own[i]), ids.get(find(i))) for i, (d, _) in enumerate(docs)]


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(spark, width, percent):
    docs = corpus(random.Random(width), 160) + ODD
    df = spark.createDataFrame([(*d, 1, 2) for d in docs], f"{SCHEMA}, component_id int, key int")
    got = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df, width, percent).collect()]
    want = [(d, n, c, d is not None and d == c) for d, n, c in plain_groups(docs, width, percent)]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert minhash.near_duplicates(df.limit(0), width, percent).count() == 0


def test_edited_copies_of_one_text(spark):
    """Many copies just under the threshold to the original: few pairs, no lost link."""
    rng = random.Random(8)
    base = [f"w{i}" for i in range(150)]
    docs = [(0, " ".join(base))]
    for i in range(1, 150):
        words = list(base)
        for k in rng.sample(range(150), 1 if i % 2 else 5):
            words[k] = f"e{i}x{k}"
        docs.append((i, " ".join(words)))
        if i % 10 == 0:
            docs.append((1000 + i, " ".join([*words[:-1], "tail"])))
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(docs, SCHEMA), 3, 85).collect()}
    assert got == {d: c for d, _, c in plain_groups(docs, 3, 85)}


def test_rows_without_doc_id_link_near_copies(spark):
    """Two documents that only a row without doc_id connects, which equals neither."""
    base = [f"w{i}" for i in range(100)]
    docs = [(1, " ".join([*(f"a{i}" for i in range(9)), *base])), (None, " ".join(base)), (2, " ".join([*base, *(f"b{i}" for i in range(9))])), (3, "else")]
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in minhash.near_duplicates(spark.createDataFrame(docs, SCHEMA), 3, 85).collect()]
    want = plain_groups(docs, 3, 85)
    assert sorted(got, key=str) == sorted(want, key=str)
    assert {d: c for d, _, c in want} == {1: 1, None: 1, 2: 1, 3: 3}


def test_missed():
    assert minhash.missed(0.85) < 1e-5


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 200 + i) for i in range(50)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(40)] + [(5, 5)]
    root: dict[int, int] = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in list(root)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---------------------------------------------------------------- repeats
def plain_repeats(docs):
    first: dict[bytes, int] = {}
    key = lambda d: 1 << 62 if d is None else d
    for d, t in docs:
        b = (t or "").encode()
        for s in range(len(b) - 49):
            w = b[s : s + 50]
            first[w] = min(first.get(w, key(d)), key(d))
    out = []
    for d, t in docs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - 49):
            if first[b[s : s + 50]] < key(d):
                gone[s : s + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((d, len(b), len(b) - len(kept), len(re.findall(b"\1+", gone)), hashlib.sha256(kept).hexdigest()))
    return out


def test_equal_windows_are_equal_bytes():
    """An alphabet of three letters, and windows that differ in their last byte only."""
    rng = random.Random(4)
    for _ in range(30):
        text = "".join(rng.choice("abc") for _ in range(400))
        text += text[10:90] + "x" + text[10:59] + "y" + text[200:250]
        data = np.frombuffer(text.encode(), np.uint8)
        starts = np.array(sorted(rng.sample(range(len(text) - 49), 300)))
        live, group = repeats._equal(data, starts)
        got: dict[int, set] = {}
        for i, g in zip(live.tolist(), group.tolist(), strict=True):
            got.setdefault(g, set()).add(i)
        want: dict[str, set] = {}
        for i, a in enumerate(starts.tolist()):
            want.setdefault(text[a : a + 50], set()).add(i)
        assert sorted(map(sorted, got.values())) == sorted(sorted(x) for x in want.values() if len(x) > 1)
    live, group = repeats._equal(np.zeros(0, np.uint8), np.zeros(0, np.int64))
    assert not len(live) and not len(group)


def test_repeats(spark, monkeypatch):
    docs = corpus(random.Random(6), 120) + [x for x in ODD if x[0] != 906] + [(950, "x" * 300), (None, corpus(random.Random(6), 120)[10][1]), (951, "é" * 40), (952, "aé" * 40 + "é" * 40), (953, "y" * 49)]
    df = spark.createDataFrame([(*d, 1) for d in docs], f"{SCHEMA}, n_bytes int").repartition(3)
    got = [tuple(r)[:5] for r in repeats.remove_repeats(df).collect()]
    assert sorted(got, key=str) == sorted(plain_repeats(docs), key=str)
    assert repeats.remove_repeats(df.limit(0)).count() == 0


# ---------------------------------------------------------------- scores
def test_scores(spark):
    docs = corpus(random.Random(9), 200) + ODD
    rows = score.scores(spark.createDataFrame([(*d, 1) for d in docs], f"{SCHEMA}, score int")).collect()
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    tokens = lambda t: [*WORD.findall((t or "").translate(LOWER)), None]
    count = Counter(w for d, t in docs if not held(d) for w in tokens(t))
    total, distinct = sum(count.values()), len(count)
    want = sorted(((d, held(d), len(tokens(t)), sum(count[w] > 0 for w in tokens(t)), total, round(sum(math.log10((count[w] + 1) / (total + distinct + 1)) for w in tokens(t)), 4)) for d, t in docs), key=str)
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in rows), key=str) == want
    assert all(r.score < 0 for r in rows)
    assert score.scores(spark.createDataFrame([], SCHEMA)).count() == 0


def plain_units(text: str | None) -> list[bytes]:
    """Words with a space; a character of three or four bytes by itself, other runs cut after 32 bytes."""
    out = []
    for word in WORD.findall((text or "").translate(LOWER)):
        runs: list[bytes] = []
        wide = True
        for char in word:
            own = char.encode()
            if wide or len(own) > 2:
                runs.append(b"")
            runs[-1] += own
            wide = len(own) > 2
        pieces = [r[i : i + 32] for r in runs for i in range(0, len(r), 32)]
        out += [pieces[0] + b" "] if len(pieces) == 1 else [x + b"\t" for x in pieces[:-1]] + [pieces[-1] + b"\v"]
    return out


def plain_predictions(units: list[bytes]):
    """(gate, unit number, contexts, byte) of every byte of a text, in order."""
    last = lambda k, x: ("in", x) if len(x) < k else ("last", x[-k:])
    before = b"\n"
    for n, unit in enumerate([*units, b"\n"]):
        yield 0, n, [("none",), last(2, before), last(3, before), ("whole", before)], unit[0]
        for i in range(1, len(unit)):
            yield 1, n, [last(2, unit[:i]), last(3, unit[:i]), last(5, unit[:i]), ("in", unit[:i])], unit[i]
        before = unit


def plain_mixing(docs) -> list[float]:
    """Bits of each text, bit by bit."""
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    lowered = lambda t: (t or "").translate(LOWER).encode()
    t = mixing.tree(np.bincount(np.frombuffer(b"".join(lowered(x) for d, x in docs if not held(d)), np.uint8), minlength=256))
    met: dict[tuple, Counter] = {}
    for d, x in docs:
        for _, _, contexts, byte in plain_predictions(plain_units(x)) if not held(d) else ():
            for c in set(contexts):
                met.setdefault(c, Counter())[int(t.leaf[byte])] += 1
    bits = []
    for _, x in docs:
        units = plain_units(x)
        each = list(plain_predictions(units))
        at, total, windows = [(mixing.MIXES - 1) / 2] * 2, 0.0, [0, 4, 8, 16]
        while windows[-1] <= len(units):
            windows.append(windows[-1] + 16)
        for lo, hi in zip(windows, windows[1:], strict=False):
            cost = np.zeros((2, mixing.MIXES))
            for gate, n, contexts, byte in each:
                if lo <= n < hi:
                    low, high = 0, 256
                    for depth in range(t.length[byte]):
                        middle, one = int(t.middle[depth, byte]), bool(t.bit[depth, byte])
                        sides = [(sum(m for leaf, m in met.get(c, {}).items() if low <= leaf < middle), sum(m for leaf, m in met.get(c, {}).items() if middle <= leaf < high)) for c in contexts]
                        own = [(b if one else a, a if one else b) for a, b in sides]
                        odds = np.array([math.log((a + 0.1) / (b + 0.1)) for a, b in own])
                        often = [sum(sum(s) >= m for m in (1, 3, 9, 40, 200)) for s in sides]
                        weight = mixing.WEIGHTS[gate][often[3] + 5 if often[3] else often[2]]
                        for s, lean in enumerate(np.linspace(-1, 1, mixing.MIXES)):
                            cost[gate, s] += math.log2(1 + math.exp(-float((weight * np.exp(-mixing.LEAN * lean) * odds).sum())))
                        low, high = (middle, high) if one else (low, middle)
            for gate in (0, 1):
                i = min(int(at[gate]), mixing.MIXES - 2)
                slope = cost[gate, i + 1] - cost[gate, i]
                total += cost[gate, i] + slope * (at[gate] - i)
                at[gate] = min(max(at[gate] - mixing.RATE * slope, 0), mixing.MIXES - 1)
        bits.append(total)
    return bits


@pytest.mark.parametrize("block", [score.BLOCK, 400])
def test_mixing_equals_a_plain_coder(spark, monkeypatch, block):
    monkeypatch.setattr(score, "BLOCK", block)
    rng = random.Random(6)
    docs = [*corpus(rng, 40), (60, None), (61, ""), (62, " \n"), (63, "東京 café abc東京def 🙂🙂ok 東"), (None, "one"), (3, "again under one id"), (64, "x" * 70 + " ab東 " + "é" * 40), (65, "東京 café abc東京def 🙂🙂ok")]
    rows = score.scores(spark.createDataFrame([(i, d, t) for i, (d, t) in enumerate(docs)], f"n long, {SCHEMA}").repartition(2)).collect()
    want = Counter((d, round(b)) for (d, _), b in zip(docs, plain_mixing(docs), strict=True))
    got = Counter((r.doc_id, round(-r.score / math.log10(2))) for r in rows)
    # costs are sent in parts of a bit, and texts of some 500 bytes have many of them
    assert sum((want - got).values()) <= 3 and sum(got.values()) == len(docs)
    near = {d: b for (d, _), b in zip(docs, plain_mixing(docs), strict=True) if d != 3}
    assert all(abs(-r.score / math.log10(2) - near[r.doc_id]) < 0.5 + near[r.doc_id] / 500 for r in rows if r.doc_id != 3)


def test_model_is_a_distribution(spark):
    """Bits of all texts of one byte add up to less than probability one."""
    docs = [(i, t) for i, t in enumerate(["the cat sat on the mat", "a cat and a hat"] * 20)]
    held = [d for d in range(1000, 5000) if zlib.crc32(str(d).encode()) % 7 == 2][:128]
    every = [bytes([b]).decode() for b in range(1, 128) if not bytes([b]).isspace() and not 65 <= b <= 90]
    rows = score.scores(spark.createDataFrame(docs + list(zip(held, ["", *every], strict=False)) + [(held[-1], "the cat sat"), (held[-2], "zqx vvk jjw")], SCHEMA)).collect()
    bits = {r.doc_id: -r.score / math.log10(2) for r in rows if r.doc_id in held[: len(every) + 1]}
    assert 0.5 < sum(2.0**-b for b in bits.values()) <= 1 + 1e-6 or sum(2.0**-b for b in bits.values()) < 1
    like, unlike = (next(r for r in rows if r.doc_id == d) for d in (held[-1], held[-2]))
    assert like.score > unlike.score / 2


def test_contexts_never_share_counts():
    """Contexts in one chunk, or in many whose counts are summed by spans of keys, have the same counts: each its own."""
    rng = random.Random(6)
    texts = pa.array([" ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(1, 9))) for _ in range(300)) for _ in range(8)])
    laid = mixing.laid(texts)
    t = mixing.tree(np.bincount(np.frombuffer("".join(texts.to_pylist()).encode(), np.uint8), minlength=256))
    trained = np.arange(8) % 3 > 0
    want: dict[tuple, Counter] = {}
    for x, y in zip(texts.to_pylist(), trained, strict=True):
        for _, _, contexts, byte in plain_predictions(plain_units(x)):
            for c in set(contexts):
                want.setdefault(c, Counter())[int(t.leaf[byte])] += int(y)

    def chunks(spans):
        own = mixing.named(laid, spans)
        count = mixing.counted(laid, own, trained)
        return [own.chunk(i, j, count) for _, i, j in own.spans]

    (whole,) = chunks(1)
    one = mixing.asked(whole, t)
    assert len(one.keys) == len(want)
    assert sorted(one.count.tolist()) == sorted(n for c in want.values() for n in c.values())
    parts = [mixing.asked(c, t) for c in chunks(5)]
    sealed = [dict(mixing.key_spans(a, 3)) for a in parts]
    answers: list[dict] = [{} for _ in parts]
    for span in sorted({s for x in sealed for s in x}):
        own = [i for i, x in enumerate(sealed) if span in x]
        for i, told in zip(own, mixing.summed([sealed[i][span] for i in own]), strict=True):
            answers[i][span] = told
    known = {(k, leaf): n for k, leaf, n in zip(one.keys[one.pairs // 256].tolist(), (one.pairs % 256).tolist(), one.count.tolist(), strict=True) if n}
    for a, told in zip(parts, answers, strict=True):
        size, leaf, count = (np.concatenate(x) for x in zip(*(vocabulary.unseal(told[s]) for s in sorted(told)), strict=True))
        got = dict(zip(zip(np.repeat(a.keys, size).tolist(), leaf.tolist(), strict=True), count.tolist(), strict=True))
        assert got == {k: n for k, n in known.items() if k[0] in set(a.keys.tolist())}
    together = mixing.together(chunks(5))
    assert together.units.to_pylist() and dict(zip(together.units.to_pylist(), together.totals().tolist(), strict=True)) == dict(zip(whole.units.to_pylist(), whole.totals().tolist(), strict=True))


def test_mixing_learns_syllables(spark):
    """On held-out documents of rare words made of known syllables: fewer bits than each byte's own frequency gives."""
    rng = random.Random(3)
    syllables = ["tha", "ing", "er", "on", "re", "ti", "wh", "en", "ed", "st"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(2, 6)))
    docs = [(i, " ".join(word() for _ in range(120))) for i in range(150)]
    rows = [r for r in score.scores(spark.createDataFrame(docs, SCHEMA)).collect() if r.held_out]
    count = Counter("".join(t for _, t in docs))
    entropy = -sum(n * math.log2(n / sum(count.values())) for n in count.values()) / sum(count.values())
    assert all(r.bits_per_byte < 0.75 * entropy for r in rows)


# ---------------------------------------------------------------- search
def plain_neighbours(vectors):
    fine = {i: np.array(v, float) for i, v in vectors if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = []
    for q in fine:
        if q % 100 == 0:
            near = sorted((float(np.sqrt(((fine[q] - v) ** 2).sum())), i) for i, v in fine.items() if i != q and len(v) == len(fine[q]))[:10]
            out += [(q, k + 1, i, round(s, 9)) for k, (s, i) in enumerate(near)]
    return sorted(out)


def found_neighbours(spark, vectors):
    df = spark.createDataFrame([(*v, 5) for v in vectors], "vec_id long, vector array<double>, score int")
    return sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in ann.neighbours(df, F.col("vec_id") % 100 == 0).collect())


@pytest.mark.parametrize("axes", [1, 2, 3, 4])
def test_probes_are_the_nearest_buckets(axes):
    """Against a list of all buckets, and of a hundred times as many as memory would hold the combinations are few."""
    rng = np.random.default_rng(axes)
    vectors = rng.normal(size=(5, 4))
    size = ann.width(4)
    total = np.zeros((5, 1))
    for a in range(axes):
        total = (total[:, :, None] + ann.rotated(vectors, 2, a)[:, None, :]).reshape(5, -1)
    for k in (1, 3, 17, size**axes):
        got = ann.probed(vectors, 2, axes, k)
        want = np.sort(total, axis=1)[:, ::-1][:, :k]
        assert got.shape == want.shape == (5, min(k, size**axes))
        assert all(len(set(g.tolist())) == len(g) for g in got)
        assert np.allclose(np.sort(np.take_along_axis(total, got, axis=1), axis=1)[:, ::-1], want)
    for q, t in zip(vectors, total, strict=True):
        buckets = rng.integers(0, size**axes, 20)
        assert ann.place_of(q, buckets, 2, axes).tolist() == [int((t > t[b] + 1e-12).sum()) for b in buckets]
    assert len(ann.combinations(1000, axes, 128)) < 1000 * 30**axes and len(ann.combinations(200, 3, 1 << 20)) < 6000


def test_recall_with_three_axes(spark, monkeypatch):
    """Hot buckets dealt out, queries too, and probes fitted on rows that are no queries."""
    for name, value in (("CROWDED", 0.5), ("CHUNK", 40), ("ASKED", 5)):
        monkeypatch.setattr(ann, name, value)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 6))
    vectors = [(i, (centres[i % 12] + 0.3 * rng.normal(size=6)).tolist()) for i in range(3000)]
    got = {x[:1] + x[2:3] for x in found_neighbours(spark, vectors)}
    want = {x[:1] + x[2:3] for x in plain_neighbours(vectors)}
    assert len(got & want) >= 0.9 * len(want)


def test_search_odd_rows(spark):
    rng = np.random.default_rng(0)
    vectors = [(i, rng.normal(size=8).tolist()) for i in range(150)]
    vectors += [(200, vectors[3][1]), (201, vectors[3][1]), (200, vectors[3][1]), (300, None), (400, []), (500, [0.0] * 8), (600, [float("nan")] * 8), (700, [None] * 8), (800, [1.0, 2.0]), (801, [1.0, 3.0]), (900, [float("inf")] * 8)]
    vectors += [(1000 + i, vectors[7][1]) for i in range(40)]
    clash = spark.createDataFrame([(*v, 5, 6) for v in vectors], "vec_id long, vector array<double>, cls int, bucket int")
    assert ann.neighbours(clash, F.col("vec_id") % 100 == 0).columns == ["query_id", "rank", "vec_id", "score"]
    got, want = found_neighbours(spark, vectors), plain_neighbours(vectors)
    assert {(q, i) for q, _, i, _ in got if q in (800, 1000)} == {(q, i) for q, _, i, _ in want if q in (800, 1000)}
    assert Counter(q for q, *_ in got) == Counter(q for q, *_ in want)
    assert len({x[:3] for x in got} & {x[:3] for x in want}) >= 0.9 * len(want)
    assert found_neighbours(spark, vectors[:0]) == []
    few = vectors[:5]
    assert found_neighbours(spark, few) == plain_neighbours(few)


def test_recall(spark):
    rng = np.random.default_rng(1)
    vectors = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(3000, 32)))]
    got = {x[:1] + x[2:3] for x in found_neighbours(spark, vectors)}
    want = {x[:1] + x[2:3] for x in plain_neighbours(vectors)}
    assert len(got & want) >= 0.9 * len(want)


# ---------------------------------------------------------------- pieces
@pytest.mark.parametrize("block", [pieces.BLOCK, 600])
def test_pieces_equal_the_library(spark, monkeypatch, block):
    import sentencepiece

    monkeypatch.setattr(pieces, "BLOCK", block)
    model = pieces.load(PIECES)
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = [t for _, t in corpus(random.Random(2), 60)] + ["", None, " ", "  a   b ", "\n\n x\n", "naïve café 東京 🙂", "the the", "a" * 300, "internationalization" * 9, "    " * 12 + "x", "tab\there", "\u0000"]
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], f"{SCHEMA}, block int")
    rows = {r.doc_id: r for r in pieces.decode(pieces.encode(df, model), model).collect()}
    for i, t in enumerate(texts):
        assert rows[i].ids == (None if t is None else library.encode(t)), t
        assert rows[i].decoded == t
        assert rows[i].block == 7
    assert {r.doc_id: r for r in pieces.encode(df, model, decoded=True).collect()} == rows
    assert pieces.encode(df.limit(0), model).count() == 0
    assert pieces.encode(df.where("text is null or text = ''"), model).count() == 2
    for name in ("ids", "decoded"):
        with pytest.raises(ValueError, match=name):
            pieces.decode(pieces.encode(df.withColumn(name, F.lit(1)), model), model)


@pytest.mark.parametrize("seed", range(4))
def test_merge_fold(spark, seed):
    """Random ranks, so that merges often make better ones possible whose turn is over."""
    rng = random.Random(seed)
    table = ["a", "b", "c"] + sorted({"".join(rng.choice("abc") for _ in range(rng.randint(2, 5))) for _ in range(40)})
    model = pieces.Pieces({p: i + 256 for i, p in enumerate(table)}, {p: float(-rng.randint(0, 30)) for p in table}, 0)
    words = sorted({"".join(rng.choice("abcx") for _ in range(rng.randint(1, 40))) for _ in range(300)} | {"abc" * 20, "abc" * 21})
    got = {r.word: r.ids for r in pieces.encode_words(spark.createDataFrame([(w,) for w in words], "word string"), model).collect()}
    assert got == {w: pieces.encode_bpe(w, model) for w in words}
    assert [x for w in pieces.words_in("".join(words), model) for x in pieces.encode_bpe(w, model)] == pieces.encode_bpe(pieces.SPACE + "".join(words), model)


def test_viterbi_fold(spark):
    rng = random.Random(1)
    table = ["a", "b", "ab", "ba", "abc", "c", "bc", "aa"]
    model = pieces.Pieces({p: i + 256 for i, p in enumerate(table)}, {p: -rng.random() * 5 for p in table}, 0, "viterbi")
    words = {"".join(rng.choice("abcx") for _ in range(rng.randint(1, 12))) for _ in range(200)} | {"é€", "ab" * 40}
    short = spark.createDataFrame([(w,) for w in words if len(w) <= pieces.LONG], "word string")
    got = {r.word: r.ids for r in pieces.encode_short(short, model).collect()} | {w: pieces.encode_one(w, model) for w in words if len(w) > pieces.LONG}
    assert got == {w: pieces.encode_viterbi(w, model) for w in words}


# ---------------------------------------------------------------- pipeline
def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(12)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(500)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    docs, labels = [], []
    for i in range(300):
        t = text(60)
        if i % 6 == 0:
            t = t.upper().replace(" ", "!! ")
        docs.append((i, t, "en", f"s{i % 4}", len(t)))
        if i < 200:
            labels.append((i, int(i % 6 > 0), 0))
    item = text(25)
    clean = len([i for i in range(300) if i % 6])
    docs.append((400, docs[7][1] + " end", "en", "s1", 1))  # a near copy
    docs.append((401, f"{text(40)} {item} {text(40)}", "en", "s1", 1))  # holds a benchmark item
    docs.append((402, f"{text(60)} password: hunter22x", "en", "s1", 1))
    docs.append((None, text(50), None, None, None))
    spark.createDataFrame(docs, f"{SCHEMA}, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    d = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, left = d.columns, []
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, d, str(tmp_path))
        path = f"{tmp_path}/stage{len(left)}"
        out.write.parquet(path)
        d = spark.read.parquet(path)
        left.append(d.count())
        if len(left) < len(corpus_pipeline.STAGES):
            assert d.columns == columns
    assert left == [clean + 4, clean + 3, clean + 2, clean + 2, clean + 2]
    hidden = spark.read.parquet(f"{tmp_path}/stage3").where("doc_id = 402").first()
    assert hidden.text.endswith("[SECRET]") and hidden.n_chars == len(hidden.text)
    assert d.where("not round_trip").count() == 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == clean + 2
