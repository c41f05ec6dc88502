"""A quality classifier with hierarchical empirical Bayes over sites.

A document's text gives evidence: the logit of a logistic model over hashed words and shape bins, less the base rate's. Hosts and their
paths give priors: expected good documents are added up by host and path, a host's rate is shrunk to the global one and a path's to its
host's, each with a strength fitted by moments, so a sparse site says little. A document's posterior is its evidence on top of
the rate of its path, its own share left out.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from catalograph.llm.tables import steps, text_or_empty, written

BUCKETS = 1 << 18
SAMPLE = 20_000  # labelled rows the text model is fitted on, in expectation
MIN_Z = 3.5  # standard errors a bucket's log odds must lie from 0 to be a feature
STRENGTH = (2.0, 1e4)  # bounds of a prior's strength, in documents
KEEP = 0.5
STEMS = (4, 5, 6, 7)  # letters of a beginning
_WORD = re.compile(r"[^\W\d_]+")
_SYMBOL = re.compile(r"[^\w\s]")


def features(text: str) -> np.ndarray:
    """Buckets of the distinct words, of their beginnings (a stem says more than its rare forms) and of bins of the text's shape."""
    words = _WORD.findall(text.lower())
    bins = [f"\0n{len(words).bit_length()}"]
    if words:
        n, counts = len(words), Counter(words)
        tokens = text.split()
        lines = [x for x in text.split("\n") if x.strip()]
        bins += [f"\0sym{int(20 * min(1, len(_SYMBOL.findall(text)) / len(tokens)))}", f"\0pipe{int(10 * min(1, text.count('|') / len(tokens)))}",
                 f"\0top{int(10 * max(counts.values()) / n)}", f"\0new{int(10 * len(counts) / n)}", f"\0line{int(10 * len(set(lines)) / len(lines))}",
                 f"\0upper{int(10 * sum(map(str.isupper, tokens)) / len(tokens))}"]
        words = [*counts, *{"^" + w[:k] for w in counts for k in STEMS if len(w) > k}]
    return np.unique(np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) % BUCKETS for w in [*words, *bins]), "i4"))


@dataclass(frozen=True)
class TextModel:
    weights: np.ndarray  # by bucket
    bias: float
    base: float  # logit of the base rate

    def evidence(self, text: str) -> float:
        return float(self.weights[features(text)].sum() + self.bias - self.base)


def train(rows: list[tuple[np.ndarray, bool]], epochs: int = 200, l2: float = 1e-3) -> TextModel:
    """Logistic regression on the buckets whose log odds differ from 0 by MIN_Z standard errors."""
    good = np.array([g for _, g in rows], bool)
    base = float(np.log((good.sum() + 1) / ((~good).sum() + 1))) if rows else 0.0
    weights = np.zeros(BUCKETS, "f4")
    if not rows or good.all() or not good.any():
        return TextModel(weights, base, base)
    k = [np.bincount(np.concatenate([a for a, g in rows if bool(g) == flag]), minlength=BUCKETS) for flag in (False, True)]
    n = [(~good).sum(), good.sum()]
    odds = np.log((k[1] + 0.5) / (n[1] - k[1] + 0.5)) - np.log((k[0] + 0.5) / (n[0] - k[0] + 0.5))
    error = np.sqrt(sum(1 / (k[i] + 0.5) + 1 / (n[i] - k[i] + 0.5) for i in (0, 1)))
    used = np.nonzero((np.abs(odds) > MIN_Z * error) & (k[0] + k[1] >= 5))[0]
    place = np.full(BUCKETS, -1)
    place[used] = np.arange(len(used))
    row = np.concatenate([np.full(len(a), i) for i, (a, _) in enumerate(rows)])
    col = place[np.concatenate([a for a, _ in rows])]
    row, col = row[col >= 0], col[col >= 0]
    w, bias, seen = np.zeros(len(used)), base, np.full(len(used), 1e-8)
    seen_bias = 1e-8
    for _ in range(epochs):  # AdaGrad over the whole sample
        p = 1 / (1 + np.exp(-(np.bincount(row, w[col], len(rows)) + bias)))
        g = p - good
        gw = np.bincount(col, g[row], len(used)) / len(rows) + l2 * w
        seen += gw * gw
        seen_bias += g.mean() ** 2
        w -= 0.5 * gw / np.sqrt(seen)
        bias -= 0.5 * g.mean() / np.sqrt(seen_bias)
    weights[used] = w
    return TextModel(weights, float(bias), base)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> TextModel:
    """Fit on about `sample` rows of `labels(key, good)`, picked by a hash of the key; null labels and unlabelled documents take no part.

    A picked key gives one row, its text of the least hash, however many rows repeat it. The picked rows are a written table whose count is
    checked, and only their feature buckets reach the driver.
    """
    known = labels.filter(F.col("good").isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.min(F.col("good").cast("int")).alias("good"))
    n = known.count()
    picked = written(known.filter(F.shiftrightunsigned(F.xxhash64("k"), 11) / float(1 << 53) < min(1.0, sample / max(1, n))), "labels")
    rows = docs.select(F.col(key).alias("k"), text_or_empty(text).alias("t")).withColumn("h", F.xxhash64("t"))
    # One row a key and distinct text, then the text of the least hash: copies of a row combine map-side and count once.
    least = rows.join(picked, "k", "left_semi").groupBy("k").agg(F.min(F.struct("h", "t")).alias("x"))
    rows = written(least.join(picked, "k").select("k", "good", "x.t"), "sample")
    if (found := rows.count()) > 2 * sample + 1000:  # twenty standard errors and more above what the draw gives
        raise ValueError(f"{found} sampled rows for a sample of {sample}")
    rows = rows.select("good", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([features(t) for t in b.column(1).to_pylist()], pa.list_(pa.int32()))], names=["good", "at"])

    got = rows.mapInArrow(run, "good int, at array<int>").toArrow()
    rows = [(a.values.to_numpy(), bool(g)) for g, a in zip(got["good"].to_pylist(), got["at"], strict=True)]
    return train(sorted(rows, key=lambda r: (r[1], len(r[0]), r[0].tobytes())))  # not the order tasks ended in


def _strength(groups: DataFrame, n: str, s: str) -> tuple[float, float]:
    """(mean, strength) of the beta prior of group rates, by moments weighted with the groups' sizes. One row reaches the driver."""
    r = groups.agg(F.sum(n).alias("n"), F.sum(s).alias("s"), F.sum(F.col(s) * F.col(s) / F.col(n)).alias("ss")).first()
    if not r.n:
        return 0.5, STRENGTH[1]
    mean = r.s / r.n
    var = r.ss / r.n - mean * mean
    return mean, float(min(STRENGTH[1], max(STRENGTH[0], mean * (1 - mean) / var - 1))) if var > 1e-9 else STRENGTH[1]


def posteriors(docs: DataFrame, model: TextModel, host, path, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, evidence, host_rate, path_rate, score, kept) for every row; `host` and `path` are columns, null is a site like any other.

    Only (key, site, evidence) rows are written and joined with the sites' sums. A hot host combines map-side and joins by the planner's choice.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS floats
    rows = docs.select(F.col(key).alias("key"), F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"), text_or_empty(text).alias("t"))
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in steps(batches):
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([m.evidence(t) for t in b.column(3).to_pylist()], pa.float64())],
                                             names=["key", "host", "path", "evidence"])

    scored = written(rows.mapInArrow(run, f"key {kind}, host string, path string, evidence double").withColumn(
        "p", 1 / (1 + F.exp(-(F.col("evidence") + model.base)))), "evidence")
    paths = written(scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("s")), "paths")
    hosts = written(paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs")), "sites")
    mean, strong = _strength(hosts, "hn", "hs")
    _, near = _strength(paths, "n", "s")
    sites = paths.join(hosts.withColumn("host_rate", (F.col("hs") + mean * strong) / (F.col("hn") + strong)), "host").select("host", "path", "n", "s", "host_rate")
    out = scored.join(sites, ["host", "path"])
    # The document's own share is left out of its path.
    rate = (F.col("s") - F.col("p") + F.col("host_rate") * near) / (F.col("n") - 1 + near)
    out = out.withColumn("path_rate", F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), rate)))
    score = 1 / (1 + F.exp(-(F.col("evidence") + F.log(F.col("path_rate") / (1 - F.col("path_rate"))))))
    return out.withColumn("score", score).select(F.col("key").alias(key), "evidence", "host_rate", "path_rate", "score", (F.col("score") >= KEEP).alias("kept"))
