"""Quality classifier: document evidence combined with hierarchical empirical-Bayes site rates.

A logistic model on shape features and on words that go with rejected labels gives each
document the log odds of being acceptable (quality 1 and not toxic). Every document, not
only the labelled ones, adds its probability to its host and to its path below the host;
these sums are grouped aggregations. The rate of a host is shrunk towards the global rate
and the rate of a path towards its host's, with strengths that come from how much the
rates differ between hosts, and between the paths of a host, beyond what their sizes
explain. The posterior of a document is its own evidence with the path's rate in place of
the global one, so that a document of a poor site needs more evidence than one of a good
site, and a site with few documents says little.

The model is fitted on at most FIT_ROWS labelled documents, those of the smallest hashed
doc_id; the statistics of sites are over all documents.

Cases: labels that repeat a doc_id are averaged; null labels are ignored; without labels,
or with labels of one kind only, all evidence is 0 and every document is kept. A null text
is an empty one. Null hosts or paths are a site of their own.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pushflow.llm.common import maybe_broadcast, saved, slices, trim, utf8

#: Labelled documents that the model is fitted on, at most.
FIT_ROWS = 20_000
#: Words that tell of rejected documents, at most; the strongest are taken.
WORDS = 2_000
#: Rejected documents, and different words before it, that such a word has at least.
SUPPORT = 5

_CLASSES = np.zeros((5, 256), np.float32)
_CLASSES[0, 65:91] = 1  # capitals
_CLASSES[1, 48:58] = 1  # digits
_CLASSES[2, [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 1  # signs
_CLASSES[3, [32, *range(9, 14)]] = 1  # white space
_CLASSES[4, [10]] = 1  # line breaks
FEATURES = 5 + 7


@dataclass
class Model:
    """Weights of the shape features and of the words; constant log odds without labels."""

    mean: np.ndarray = field(default_factory=lambda: np.zeros(FEATURES))
    scale: np.ndarray = field(default_factory=lambda: np.ones(FEATURES))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(FEATURES + 2))
    words: dict[bytes, float] = field(default_factory=dict)
    prior: float = 0.0  # log odds of the labels

    def log_odds(self, shape: np.ndarray, told: np.ndarray) -> np.ndarray:
        x = np.column_stack([(shape - self.mean) / self.scale, told])
        return np.clip(x @ self.weights[:-1] + self.weights[-1], -30, 30)


def features(column: pa.Array, words: dict[bytes, float]) -> tuple[np.ndarray, np.ndarray, list[set[bytes]]]:
    """Shape features of each text, the evidence of its known words, and its distinct words."""
    data, offsets = utf8(column)
    size = np.maximum(np.diff(offsets), 1)
    shape = np.zeros((len(column), FEATURES))
    for k in range(5):
        total = np.concatenate([[0], np.cumsum(_CLASSES[k][data], dtype=np.float64)])
        shape[:, k] = (total[offsets[1:]] - total[offsets[:-1]]) / size
    raw, told, sets = data.tobytes(), np.zeros(len(column)), []
    for i in range(len(column)):
        text = raw[offsets[i] : offsets[i + 1]]
        tokens = text.lower().split()
        distinct = set(tokens)
        sets.append(distinct)
        n = len(tokens)
        lines = text.split(b"\n")
        longest = max(map(len, tokens), default=0)
        again = sum(a == b for a, b in zip(tokens, tokens[1:], strict=False)) / max(n - 1, 1)
        shape[i, 5:] = (np.log1p(n), size[i] / (n + 1), len(distinct) / max(n, 1), np.log1p(longest), again, 1 - len(set(lines)) / len(lines), np.log1p(size[i] / len(lines)))
        if words:
            known = [words[w] for w in distinct if w in words]
            told[i] = min(sum(known), 20.0)
    return shape, told, sets


def _fit_logistic(x: np.ndarray, y: np.ndarray, rounds: int = 30, ridge: float = 1.0) -> np.ndarray:
    """Newton's method with a ridge on all weights but the constant."""
    x = np.column_stack([x, np.ones(len(x))])
    w, keep = np.zeros(x.shape[1]), np.r_[np.full(x.shape[1] - 1, ridge), 1e-6]
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(keep), x.T @ (y - p) - keep * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _labelled(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """(text, y, toxic) of the sample."""
    told = labels.groupBy("doc_id").agg(F.avg("quality").alias("q"), F.coalesce(F.avg("toxic"), F.lit(0)).alias("t")).where("doc_id is not null and q is not null")
    told = told.select("doc_id", ((F.col("q") >= 0.5) & (F.col("t") < 0.5)).cast("int").alias("y"), (F.col("t") >= 0.5).cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return docs.select("doc_id", "text").join(F.broadcast(told), "doc_id").select("text", "y", "toxic")


def fit(docs: DataFrame, labels: DataFrame, most: int = FIT_ROWS) -> Model:
    """Fit the document model on at most `most` labelled documents."""
    sample = saved(_labelled(docs, labels, most), "labelled")

    def count(batches):
        for batch in slices(batches, most=1 << 20):
            seen: Counter = Counter()
            bad: Counter = Counter()
            toxic: Counter = Counter()
            _, _, sets = features(batch.column(0), {})
            for words, y, t in zip(sets, batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                seen.update(words)
                if not y:
                    bad.update(words)
                if t:
                    toxic.update(words)
            yield pa.RecordBatch.from_arrays([pa.array(seen, pa.binary()), *(pa.array([c[w] for w in seen], pa.int64()) for c in (seen, bad, toxic))], names=["word", "n", "bad", "toxic"])

    n, good, poison = (float(x or 0) for x in sample.agg(F.count("*"), F.sum("y"), F.sum("toxic")).first())
    if not 0 < good < n:
        return Model()
    rate = (n - good) / n
    counts = sample.mapInArrow(count, "word binary, n long, bad long, toxic long").groupBy("word").agg(*(F.sum(c).alias(c) for c in ("n", "bad", "toxic")))
    # far more often in rejected documents, or in toxic ones, than chance gives
    score = F.greatest(F.lit(0.0), *((F.col(c) - F.col("n") * r) / F.sqrt(F.col("n") * (r * (1 - r))) for c, r in (("bad", rate), ("toxic", poison / n)) if 0 < r < 1))
    chosen = counts.where((F.col("bad") >= SUPPORT) & (F.col("bad") >= F.col("n") * 0.9)).withColumn("score", score).where("score > 5").orderBy(F.desc("score"), "word").limit(WORDS).collect()
    told = {bytes(r.word) for r in chosen}

    def surround(batches):
        for batch in slices(batches, most=1 << 20):
            pairs = set()
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not y and text:
                    tokens = text.encode().lower().split()
                    pairs.update((w, before) for before, w in zip([b"", *tokens], tokens, strict=False) if w in told)
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in pairs], pa.binary()), pa.array([b for _, b in pairs], pa.binary())], names=["word", "before"])

    # the words of one text that has many copies stand behind the same words each time
    varied = sample.mapInArrow(surround, "word binary, before binary").groupBy("word").agg(F.count_distinct("before").alias("k")).where(F.col("k") >= SUPPORT).collect()
    varied = {bytes(r.word) for r in varied}
    words = {bytes(r.word): float(np.log((r.bad + 0.5) / (r.n - r.bad + 0.5)) - np.log(rate / (1 - rate))) for r in chosen if bytes(r.word) in varied}

    def measure(batches):
        for batch in slices(batches, most=1 << 20):
            shape, told, _ = features(batch.column(0), words)
            yield pa.RecordBatch.from_arrays([pa.array(list(np.column_stack([shape, told, batch.column(1).to_numpy(zero_copy_only=False)])), pa.list_(pa.float64()))], names=["x"])

    rows = np.array([r.x for r in sample.mapInArrow(measure, "x array<double>").collect()])
    shape, told, y = rows[:, :FEATURES], rows[:, FEATURES], rows[:, -1]
    mean, scale = shape.mean(0), shape.std(0) + 1e-9
    w = _fit_logistic(np.column_stack([(shape - mean) / scale, told]), y)
    return Model(mean, scale, w, words, float(np.log(good / (n - good))))


def evidence(docs: DataFrame, model: Model) -> DataFrame:
    """docs with a column __evidence: the document's own log odds."""
    place = docs.columns.index("text")

    def work(batches):
        for batch in slices(batches, most=1 << 20):
            shape, told, _ = features(batch.column(place), model.words)
            yield batch.append_column("__evidence", pa.array(model.log_odds(shape, told), pa.float64()))
        trim()

    return docs.mapInArrow(work, docs.withColumn("__evidence", F.lit(0.0)).schema)


def _logit(p: Column) -> Column:
    p = F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6))
    return F.log(p / (1 - p))


def site_rates(scored: DataFrame) -> tuple[DataFrame, float]:
    """(host, path) rates shrunk level by level, from rows (host, path, p); and the global rate."""
    paths = saved(scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("s")), "paths")
    hosts = saved(paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("s").alias("host_s")), "hosts")
    total = hosts.agg(F.sum("host_n").alias("n"), F.sum("host_s").alias("s")).first()
    if not total.n:
        return paths.select("host", "path", F.lit(0.5).alias("host_rate"), F.lit(0.5).alias("path_rate")), 0.5
    rate = total.s / total.n
    spread = hosts.where("host_n > 1").agg(F.sum(F.col("host_n") * F.pow(F.col("host_s") / F.col("host_n") - rate, 2)).alias("ss"), F.count("*").alias("k"), F.sum("host_n").alias("n"), F.sum(F.pow("host_n", F.lit(2))).alias("n2")).first()
    strength = _strength(rate, spread)
    hosts = hosts.withColumn("host_rate", (F.col("host_s") + strength * rate) / (F.col("host_n") + strength))
    both = paths.join(maybe_broadcast(hosts.select(F.col("host").alias("host_"), "host_rate")), F.col("host").eqNullSafe(F.col("host_"))).drop("host_")
    spread = both.where("n > 1").agg(F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - F.col("host_rate"), 2)).alias("ss"), F.count("*").alias("k"), F.sum("n").alias("n"), F.sum(F.pow("n", F.lit(2))).alias("n2")).first()
    strength = _strength(rate, spread)
    return both.select("host", "path", "host_rate", ((F.col("s") + strength * F.col("host_rate")) / (F.col("n") + strength)).alias("path_rate")), rate


def _strength(rate: float, spread) -> float:
    """Prior documents that a rate is shrunk with: the method of moments for a beta-binomial."""
    noise = max(rate * (1 - rate), 1e-6)
    if not spread.k or spread.k < 2:
        return 100.0
    between = (spread.ss - (spread.k - 1) * noise) / max(spread.n - spread.n2 / spread.n, 1e-9)
    return float(np.clip(noise / between - 1, 1.0, 1e4)) if between > 0 else 1e4


def score(docs: DataFrame, labels: DataFrame, host: Column, path: Column, most: int = FIT_ROWS) -> DataFrame:
    """docs with evidence, host_rate, path_rate, posterior and kept (posterior at least 0.5) in struct __quality.

    One pass over the texts for the sites' sums, one for the result. Up to BROADCAST_ROWS sites no
    text is shuffled; more of them meet the documents in a shuffle, where Spark splits large sites.
    """
    model = fit(docs, labels, most)
    own = docs.select("text", host.alias("host"), path.alias("path"))
    rates, rate = site_rates(evidence(own, model).select("host", "path", (1 / (1 + F.exp(-F.col("__evidence")))).alias("p")))
    rates = rates.select(F.col("host").alias("__host_"), F.col("path").alias("__path_"), F.col("host_rate").alias("__host_rate"), F.col("path_rate").alias("__path_rate"))
    rows = evidence(docs.withColumns({"__host": host, "__path": path}), model)
    rows = rows.join(maybe_broadcast(rates), F.col("__host").eqNullSafe(F.col("__host_")) & F.col("__path").eqNullSafe(F.col("__path_")))
    posterior = 1 / (1 + F.exp(-(F.col("__evidence") - _logit(F.lit(rate)) + _logit(F.col("__path_rate")))))
    told = F.struct(F.col("__evidence").alias("evidence"), F.col("__host_rate").alias("host_rate"), F.col("__path_rate").alias("path_rate"), posterior.alias("posterior"), (posterior >= 0.5).alias("kept"))
    return rows.select(*docs.columns, told.alias("__quality"))


def classify(docs: DataFrame, labels: DataFrame, host: Column | None = None, path: Column | None = None, most: int = FIT_ROWS) -> DataFrame:
    """doc_id, evidence, host_rate, path_rate, posterior, kept of every document."""
    host = F.col("source") if host is None else host
    path = F.concat_ws("/", "source", "lang") if path is None else path
    return score(docs.select("doc_id", "text", "source", "lang"), labels, host, path, most).select("doc_id", "__quality.*")
