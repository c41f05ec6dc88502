"""Language identification: averaged hashed subword embeddings and a linear softmax, trained by stochastic gradient descent in numpy.

A text is the mean of the embeddings of its hashed character n-grams; a linear layer and softmax follow. After training both are one table
of logits per bucket, so a prediction adds up table rows over the whole text. A temperature and a rejection threshold are set on
training rows held out of the descent.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from catalograph.llm.tables import steps, text_or_empty

BUCKETS = 1 << 15
GRAMS = (2, 3, 4)
SAMPLE = 800  # labelled rows a language the model is fitted on, in expectation
DIM, EPOCHS, RATE = 16, 6, 0.5
MAX_ERROR = 0.01  # of accepted rows; less certain ones are marked rejected
UNKNOWN = "und"
_CHUNK = 1 << 18


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def grams(text: str, buckets: int = BUCKETS) -> np.ndarray:
    """Hashed n-grams of the lower-case letters, every run of other characters being one blank; empty without a letter."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    is_letter = _letters()[codes]
    if not is_letter.any():
        return np.zeros(0, "u4")
    codes = np.where(is_letter, codes, 32).astype("u4")
    codes = np.concatenate([[32], codes[is_letter | np.concatenate([[True], is_letter[:-1]])], [32]]).astype("u4")
    out = []
    for n in GRAMS:
        h = np.full(max(0, len(codes) - n + 1), 2166136261 + n, "u4")
        for j in range(n):
            h = (h ^ codes[j: j + len(h)]) * np.uint32(16777619)
        out.append((h ^ (h >> np.uint32(15))) % np.uint32(buckets))
    return np.concatenate(out)


@dataclass(frozen=True)
class Model:
    languages: list[str]
    table: np.ndarray  # bucket, language
    bias: np.ndarray
    temperature: float
    threshold: float

    def logits(self, g: np.ndarray) -> np.ndarray:
        total = sum((self.table[g[i: i + _CHUNK]].sum(axis=0, dtype="f8") for i in range(0, len(g), _CHUNK)), np.zeros(len(self.languages)))
        return total / max(1, len(g)) + self.bias

    def predict(self, text: str) -> tuple[str, float]:
        """(language, calibrated probability); `und` and 0 without a letter or without a language learned."""
        g = grams(text)
        if not len(g) or not self.languages:
            return UNKNOWN, 0.0
        p = _softmax(self.logits(g)[None, :] / self.temperature)[0]
        at = int(p.argmax())
        return self.languages[at], float(min(1.0, p[at]))


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(rows: list[tuple[np.ndarray, np.ndarray, str]], seed: int = 13) -> Model:
    """From (bucket, share of the text's n-grams, language) rows; every fifth row calibrates."""
    languages = sorted({r[2] for r in rows})
    if not rows:
        return Model([], np.zeros((BUCKETS, 0), "f4"), np.zeros(0), 1.0, 0.0)
    rng = np.random.default_rng(seed)
    rows = [rows[i] for i in rng.permutation(len(rows))]
    fit, held = (rows[len(rows) // 5:], rows[: len(rows) // 5]) if len(rows) >= 50 else (rows, rows)
    of = {x: i for i, x in enumerate(languages)}
    e, w, bias = rng.normal(0, 0.1, (BUCKETS, DIM)), np.zeros((len(languages), DIM)), np.zeros(len(languages))
    w += rng.normal(0, 0.1, w.shape)
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for i in rng.permutation(len(fit)):
            at, share, lang = fit[i]
            x = share @ e[at]
            g = _softmax((w @ x + bias)[None, :])[0]
            g[of[lang]] -= 1
            back = w.T @ g
            w -= rate * np.outer(g, x)
            bias -= 0.1 * rate * g
            e[at] -= (rate * 50 * share)[:, None] * back  # shares are small: a step that moves the mean
    table = (e @ w.T).astype("f4")
    logits = np.array([share @ table[at] + bias for at, share, _ in held])
    truth = np.array([of[r[2]] for r in held])
    temperatures = np.geomspace(0.05, 5, 60)
    nll = [-np.log(np.maximum(_softmax(logits / t)[np.arange(len(truth)), truth], 1e-12)).mean() for t in temperatures]
    temperature = float(temperatures[int(np.argmin(nll))])
    p = _softmax(logits / temperature)
    order = np.argsort(-p.max(axis=1), kind="stable")
    wrong = np.cumsum(p.argmax(axis=1)[order] != truth[order]) / np.arange(1, len(order) + 1)
    ok = np.nonzero(wrong <= MAX_ERROR)[0]
    threshold = float(p.max(axis=1)[order[ok[-1]]]) if len(ok) and ok[-1] < len(order) - 1 else 0.0 if len(ok) else 1.0
    return Model(languages, table, bias, temperature, threshold)


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", sample: int = SAMPLE) -> Model:
    """Fit on about `sample` rows of each language, picked by a hash of key and text; a language with fewer gives all.

    Texts become bucket shares on the executors; only those of the sample reach the driver.
    """
    rows = labelled.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.col(key).alias("key"))
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row a language
    if not counts:
        return train([])
    share = F.element_at(F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, sample / n))]), F.col("lang"))
    draw = F.shiftrightunsigned(F.xxhash64("key", "text"), 11) / float(1 << 53)
    picked = rows.filter(draw < share).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches):
            at, shares = [], []
            for t in b.column(1).to_pylist():
                g = grams(t)
                x, n = np.unique(g, return_counts=True)
                at.append(x.astype("i4"))
                shares.append((n / max(1, len(g))).astype("f4"))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(at, pa.list_(pa.int32())), pa.array(shares, pa.list_(pa.float32()))],
                                             names=["lang", "at", "share"])

    got = picked.mapInArrow(run, "lang string, at array<int>, share array<float>").toArrow()
    rows = [(a.values.to_numpy(), s.values.to_numpy(), x) for x, a, s in zip(got["lang"].to_pylist(), got["at"], got["share"], strict=True) if len(a)]
    rows.sort(key=lambda r: (r[2], len(r[0]), r[0].tobytes()))  # not the order tasks ended in
    return train(rows)


def predict(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """(keep..., lang_pred, score, rejected) for every row, over whole texts; no shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # buckets x languages floats
    rows = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(keep)], text_or_empty(text).alias("_t"))
    kinds = ", ".join(f"c{i} {rows.schema[f'c{i}'].dataType.simpleString()}" for i in range(len(keep)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in steps(batches):
            got = [m.predict(t) for t in b.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[: len(keep)], pa.array([x for x, _ in got], pa.string()), pa.array([p for _, p in got], pa.float64()),
                 pa.array([p < m.threshold or x == UNKNOWN for x, p in got], pa.bool_())],
                names=[*b.schema.names[: len(keep)], "lang_pred", "score", "rejected"])

    return rows.mapInArrow(run, f"{kinds}, lang_pred string, score double, rejected boolean").select(
        *[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], "lang_pred", "score", "rejected")


def held_out(key: str = "doc_id") -> Column:
    """Rows kept from training: the checksum of the key's text, modulo 5, is 0; so is a null key."""
    return F.crc32(F.encode(F.coalesce(F.col(key).cast("string"), F.lit("")), "UTF-8")) % 5 == 0
