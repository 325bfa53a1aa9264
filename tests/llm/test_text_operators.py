"""WARC, personal data, secrets, decontamination and quality against plain versions and on odd rows."""

from __future__ import annotations

import base64
import hashlib
import io
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pushflow.llm import automaton, decontaminate, pii, quality, secrets, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ---------------------------------------------------------------- WARC
def test_warc_round_trip(spark):
    rows = [(3, "http://a/\r\nx", "same"), (1, None, "same"), (2, "u", None), (None, "v", "same"), (4, "w", ""), (1, "x", "same"), (9, "y", "é" * 200_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(1))
    got = sorted(((r.page_id or -1, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(pages).collect()), key=str)
    sha = lambda t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()
    want = [(-1, 4, sha("same"), "response", None), (1, 4, sha("same"), "response", None), (1, 4, sha("same"), "response", None), (2, 0, sha(""), "response", None), (3, 4, sha("same"), "revisit", 1), (4, 0, sha(""), "revisit", 2), (9, 400_000, sha("é" * 200_000), "response", None)]
    assert got == sorted(want, key=str)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_payloads_and_damage(spark):
    one = warc.record(1, "u", b"abc", warc.digest(b"abc"), None)
    two = warc.record(2, "u", b"abc", warc.digest(b"abc"), 1)
    found = list(warc.records(io.BytesIO(one + two)))
    assert [(h["warc-type"], p) for h, _, p in found] == [("response", b"abc"), ("revisit", b"")]
    with pytest.raises(warc.WarcError, match="inside a gzip"):
        list(warc.records(io.BytesIO(one[:-9])))
    with pytest.raises(warc.WarcError, match="digest"):
        list(warc.records(io.BytesIO(warc.record(1, "u", b"abc", warc.digest(b"abd"), None))))


# ---------------------------------------------------------------- personal data
def plain_pii(text):
    """The contract's expressions as they stand."""
    out = [(0, m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(1, m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        total = sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(reversed(d)))
        if 16 <= len(d) <= 19 and total % 10 == 0:
            out.append((2, m.start(), m.end()))
    out += [(3, m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def test_pii_base_equals_plain():
    rng = random.Random(3)
    for _ in range(4000):
        text = "".join(rng.choice("ab.@-+%1234 5()é\n") for _ in range(rng.randint(0, 60)))
        assert pii.base_spans(text) == plain_pii(text), text
    card = "4111 1111 1111 1111"
    assert pii.base_spans(f"x {card} y") == plain_pii(f"x {card} y") == [(2, 2, 21)]


@pytest.mark.parametrize(
    ("text", "kind", "part"),
    [
        ("write to joe [at] mail [dot] example (dot) com now", 0, "joe [at] mail [dot] example (dot) com"),
        ("write to joe at mail dot example dot com now", 0, "joe at mail dot example dot com"),
        ("jое@mail.example.com", 0, "jое@mail.example.com"),
        ("call plus one two one two five five five one two one two now", 3, "plus one two one two five five five one two one two"),
        ("host １９２．１６８．0．1 up", 1, "１９２．１６８．0．1"),
        ("card 4​111111111111111 ok", 2, "4​111111111111111"),
    ],
)
def test_pii_disguises(text, kind, part):
    base, added = pii.find(text)
    assert (kind, text.index(part), text.index(part) + len(part)) in added
    assert part not in pii.redact(text)


def test_pii_plus_before_digits():
    """A spelled plus is rewritten whatever else stands in the text."""
    text = "call plus 44 20 7946 0958 now"
    assert pii.find(text) == ([], [(3, 5, 25)])
    assert pii.find(f"{text}\u00a0")[1] == [(3, 5, 25)]
    assert pii.redact(text) == "call [PHONE] now"
    assert pii.find("surplus 44 20 7946 0958, plus 4x") == ([], [])


def test_pii_prefilter_accepts_what_rules_rewrite():
    rng = random.Random(7)
    bits = ["plus", "Plus", "one", "two", "oh", "at", "dot", "DOT", "@", ".", "[", "]", "(", ")", " ", " ", "  ", "-", "_", "4", "44", "x", "é", "\n", "０"]
    for _ in range(20_000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(1, 9)))
        assert pii._HINT.search(text) or not pii._RULES.search(text), text


def test_pii_clean_and_odd(spark):
    assert pii.find("meet me at noon, the dot on the map; one two three") == ([], [])
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "a@b.co"), (2, "a@b.co"), (5, "9" * 300_000), (6, "a" * 300_000 + "@")], "doc_id long, text string")
    got = sorted(((r.doc_id or -1, r.n_email, r.spans) for r in pii.scan(docs).collect()))
    assert got == [(-1, 1, "email:0:6"), (1, 0, ""), (2, 0, ""), (2, 1, "email:0:6"), (5, 0, ""), (6, 0, "")]


# ---------------------------------------------------------------- secrets
def plain_secrets(text):
    out = []
    for k, (rule, group, least) in enumerate(((r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6), (r"AKIA[A-Z0-9]+", 0, 20), (r"[0-9a-f]+", 0, 24))):
        out += [(m.start(), k, m.end()) for m in re.finditer(rule, text) if len(m[group]) >= least]
    return sorted(out)


def test_secret_spans_equal_plain():
    rng = random.Random(5)
    bits = ["password", "Token", "api_key", "APIKEY", "secret", "=", ":", " ", '"', "abcdef12", "0123456789abcdef01234567", "AKIA", "ABCDEFGHIJKLMNOP", "\n", "é", "x", "-----BEGIN RSA PRIVATE KEY-----"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 25))) for _ in range(3000)] + ["", None, "f" * 100_000, "token=" * 20_000]
    found = secrets.find_batch(pa.array(texts, pa.string()))
    for i, text in enumerate(texts):
        base, added = found.get(i, ([], []))
        assert sorted(base) == plain_secrets(text or ""), text
        for s, k, e in added:
            assert all(e <= a or b <= s for a, kk, b in base if kk == k)


def test_automaton_equals_search():
    rules = ["ab{2,3}c", "(?i:x|yz)+1", "a[^b]*d"]
    dfa = automaton.compile_rules(rules)
    rng = random.Random(1)
    data = "".join(rng.choice("abcdxyzXYZ1 ") for _ in range(3000))
    masks = automaton.scan(dfa, np.frombuffer(data.encode(), np.uint8), lane=16)
    for end in range(0, 400):
        want = sum(1 << i for i, r in enumerate(rules) if re.search(f"(?:{r})\\Z", data[: end + 1]))
        assert masks[end] == want
    whole = automaton.scan(dfa, np.frombuffer(data.encode(), np.uint8), lane=10_000)
    assert (masks == whole).all()


def test_more_rules_than_a_byte_has_bits():
    rules = [f"k{i:02}x+" for i in range(40)] + ["[0-9]{3}"]
    dfa = automaton.compile_rules(rules)
    rng = random.Random(8)
    for _ in range(50):
        text = "".join(rng.choice(["k", "0", "1", "2", "3", "x", " "]) for _ in range(300)) + "k39xk31x"
        masks = automaton.scan(dfa, np.frombuffer(text.encode(), np.uint8), 16, 4)
        for i, rule in enumerate(rules):
            ends = {e for e in range(1, len(text) + 1) if re.search(f"(?:{rule})\\Z", text[:e])}
            assert {int(x) + 1 for x in np.flatnonzero(masks >> masks.dtype.type(i) & masks.dtype.type(1))} == ends
    with pytest.raises(ValueError, match="64"):
        automaton.compile_rules(["a"] * 65)


def test_scans_of_odd_rows(spark):
    """Null, empty, repeated and very long texts, no rows at all, and columns that clash with the result's."""
    docs = [(1, None), (2, ""), (3, "x" * 60_000 + " token: abcdef123"), (3, "x" * 60_000 + " token: abcdef123"), (None, "mail a@b.co"), (4, "a" * 30), (5, "東京 password=hunter22 é")]
    for scan, want in (
        (secrets.scan_documents, lambda t: [f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in plain_secrets(t)]),
        (pii.scan, lambda t: [f"{('email', 'ip', 'card', 'phone')[k]}:{a}:{b}" for k, a, b in plain_pii(t)]),
    ):
        df = spark.createDataFrame([(*d, 1, "s") for d in docs], "doc_id long, text string, n_hex int, spans string")
        got = sorted(((r.doc_id, r.base_sha256) for r in scan(df).collect()), key=str)
        assert got == sorted(((i, hashlib.sha256(",".join(want(t or "")).encode()).hexdigest()) for i, t in docs), key=str)
        assert scan(df.limit(0)).count() == 0


def test_secrets_redacted(spark):
    docs = spark.createDataFrame([(1, "my password: hunter22 ok", 9), (2, None, 1), (3, "clean", 5)], "doc_id long, text string, extra int")
    got = {r.doc_id: (r.text, r.extra) for r in secrets.redact(docs).collect()}
    assert got == {1: ("my [SECRET] ok", 9), 2: (None, 1), 3: ("clean", 5)}


# ---------------------------------------------------------------- decontamination
def five(text):
    w = WORD.findall((text or "").lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_leaks_equal_plain(spark):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice((2, 5, 9, 40))))) for i in range(30)] + [(30, None), (31, "  "), (0, "w1 w2")]
    docs = []
    for i in range(60):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 200))]
        if i % 3:
            part = rng.choice(items[:30])[1].split()
            if i % 2 and len(part) > 12:
                part[rng.randrange(len(part))] = "changed"
            at = rng.randint(0, len(words))
            words[at:at] = part
        docs.append((i, " ".join(words)))
    docs += [(60, None), (61, ""), (1, docs[1][1]), (None, items[5][1])]
    d = spark.createDataFrame([(*x, 0) for x in docs], "doc_id long, text string, item_id int").select("doc_id", "text")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(d, spark.createDataFrame(items, "item_id long, text string")).collect()}
    leaking = lambda t, q: five(q) and len(five(q) & five(t)) >= 0.8 * len(five(q))
    assert got == {(i, j) for i, t in docs for j, q in items if leaking(t, q)}
    left = decontaminate.clean(d.withColumn("own_id", F.lit(1)), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted(((r.doc_id, r.text) for r in left), key=str) == sorted((x for x in docs if not any(leaking(x[1], q) for _, q in items)), key=str)
    assert decontaminate.leaks(d.limit(0), spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert decontaminate.leaks(d, spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_leaks_of_repeated_ids(spark):
    """Two texts under one item_id, or one doc_id, are held apart, and a long text holds one word's item."""
    one, two = "a b c d e f g h i j", "k l m n o p q r s t"
    items = spark.createDataFrame([(7, one), (7, two), (None, two), (8, "zzz")], "item_id long, text string")
    half = "a b c d e f g x k l m n o p q"
    docs = [(1, f"{one} {two}"), (2, half), (3, "a b c d e f g"), (3, "d e f g h i j"), (4, two), (None, one), (None, half), (5, "long " * 60_000 + "zzz"), (6, "zzz")]
    d = spark.createDataFrame([(*x, 0) for x in docs], "doc_id long, text string, item_id int").drop("item_id")
    rows = decontaminate.leaks(d, items).collect()
    assert sorted(((r.doc_id, r.item_id, r.n_item, r.n_shared, r.containment) for r in rows), key=str) == sorted([(1, 7, 6, 6, 1.0), (1, None, 6, 6, 1.0), (4, 7, 6, 6, 1.0), (4, None, 6, 6, 1.0), (None, 7, 6, 6, 1.0), (6, 8, 1, 1, 1.0)], key=str)


# ---------------------------------------------------------------- quality
def test_quality_held_out(spark):
    rng = random.Random(4)
    vocabulary = [f"word{i}" for i in range(400)]
    docs, labels = [], []
    for i in range(900):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(30, 120))]
        kind = i % 6
        if kind == 0:
            for _ in range(3):
                words.insert(rng.randint(0, len(words)), rng.choice(("vile", "nasty")))
        elif kind == 1:
            words = [w.upper() + "!!" for w in words]
        docs.append((i, " ".join(words), "en", f"host{i % 7}", 0))
        if i < 600:
            labels.append((i, int(kind != 1), int(kind == 0)))
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, kept int")
    got = {r.doc_id: r.kept for r in quality.classify(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    held = range(600, 900)
    assert np.mean([got[i] == (i % 6 > 1) for i in held]) > 0.97


def plain_rates(rows):
    """Rates of hosts and paths, shrunk level by level with strengths from the method of moments."""

    def strength(rate, sites):
        noise = max(rate * (1 - rate), 1e-6)
        if len(sites) < 2:
            return 100.0
        n, n2 = sum(x for x, _, _ in sites), sum(x * x for x, _, _ in sites)
        between = (sum(x * (s / x - r) ** 2 for x, s, r in sites) - (len(sites) - 1) * noise) / max(n - n2 / n, 1e-9)
        return min(max(noise / between - 1, 1.0), 1e4) if between > 0 else 1e4

    paths, hosts = {}, {}
    for h, p, x in rows:
        for key, into in (((h, p), paths), (h, hosts)):
            n, s = into.get(key, (0, 0.0))
            into[key] = n + 1, s + x
    rate = sum(s for _, s in hosts.values()) / len(rows)
    k = strength(rate, [(n, s, rate) for n, s in hosts.values() if n > 1])
    host = {h: (s + k * rate) / (n + k) for h, (n, s) in hosts.items()}
    k = strength(rate, [(n, s, host[h]) for (h, _), (n, s) in paths.items() if n > 1])
    return {(h, p): (host[h], (s + k * host[h]) / (n + k)) for (h, p), (n, s) in paths.items()}, rate


@pytest.mark.parametrize("seed", range(3))
def test_site_rates_equal_plain(spark, seed):
    rng = random.Random(seed)
    rows = []
    for h in [None, *"abcdefg"]:
        good = rng.random()
        for p in [None, *"xyz"]:
            rows += [(h, p, min(max(rng.gauss(good, 0.2), 0.0), 1.0)) for _ in range(rng.choice((0, 1, 3, 40)))]
    got, rate = quality.site_rates(spark.createDataFrame(rows, "host string, path string, p double"))
    want, plain_rate = plain_rates(rows)
    assert rate == pytest.approx(plain_rate)
    assert {(r.host, r.path): (pytest.approx(r.host_rate), pytest.approx(r.path_rate)) for r in got.collect()} == want


def test_posterior_equals_plain(spark):
    """Evidence with the path's rate in place of the global one, for rows that clash with the result's columns."""
    rng = random.Random(9)
    docs = [(i if i % 50 else None, rng.choice(("fine words here ", "BAD!! 99 ")) * rng.randint(1, 30), rng.choice(("en", None)), f"h{i % 5}" if i % 7 else None, 1.0) for i in range(300)]
    labels = [(i, int("fine" in t), 0) for i, t, *_ in docs[:200] if i is not None]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, posterior double")
    rows = quality.score(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), F.col("source"), F.concat_ws("/", "source", "lang")).collect()
    assert len(rows) == 300 and rows[0].posterior == 1.0
    logit = lambda p: np.log(p / (1 - p))
    rates, rate = plain_rates([(r.source, "/".join(x for x in (r.source, r.lang) if x is not None), 1 / (1 + np.exp(-r["__quality"].evidence))) for r in rows])
    for r in rows:
        q = r["__quality"]
        host, path = rates[r.source, "/".join(x for x in (r.source, r.lang) if x is not None)]
        assert (q.host_rate, q.path_rate) == (pytest.approx(host), pytest.approx(path))
        assert q.posterior == pytest.approx(1 / (1 + np.exp(-(q.evidence - logit(rate) + logit(path)))))
        assert q.kept == (q.posterior >= 0.5)


def test_quality_odd_rows(spark):
    d = spark.createDataFrame([(1, None, None, None), (2, "", "en", None), (2, "x " * 50_000, None, "h")], "doc_id long, text string, lang string, source string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    one_kind = spark.createDataFrame([(1, 1, None), (2, None, 1), (None, 0, 0)], "doc_id long, quality int, toxic int")
    for labels in (none, one_kind):
        assert [r.kept for r in quality.classify(d, labels).collect()] == [True] * 3
    assert quality.classify(d.limit(0), none).count() == 0
