"""Language identification and the site quality model: held-out accuracy, edge rows, grouped posteriors by hand."""

import math
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from catalograph.llm import language_id, quality_model
from catalograph.llm.queries import QUERIES

BIG = "/root/testdata/sf0.01"


def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{BIG}/documents.parquet").select("doc_id", "lang", "text")
    got = QUERIES["op10_subword_language"](spark, BIG).join(docs, "doc_id").collect()
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)


def test_language_edges(spark):
    rows = [(1, "the cat and the dog", "en", 1), (2, "le chat et le chien", "fr", 2), (3, None, "en", 3), (4, "", None, 4), (None, "the bird", "en", 5), (6, "123 ?! 日", None, 6),
            (7, "1 2 3", "en", 7), (1, "the cat and the dog", "en", 1), (8, "the house " * 30_000, None, 8)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, score int")
    model = language_id.fit(docs)
    got = language_id.predict(docs, model).collect()
    assert len(got) == len(rows) and model.languages == ["en", "fr"]
    for r, (_, text, _, _) in zip(sorted(got, key=lambda r: str(r.doc_id)), sorted(rows, key=lambda r: str(r[0]))):
        letters = any(c.isalpha() for c in text or "")
        assert (r.lang_pred in ("en", "fr")) == letters and (r.lang_pred == "und") == (not letters) and (letters or r.score == 0 and r.rejected)
    nothing = language_id.fit(docs.limit(0))
    assert nothing.languages == [] and {r.lang_pred for r in language_id.predict(docs, nothing).collect()} == {"und"}
    assert language_id.predict(docs.limit(0), model).count() == 0


def test_uncertain_texts_are_rejected():
    rng = np.random.default_rng(0)
    row = lambda at, lang: (np.array(at, "i4"), np.full(len(at), 1 / len(at), "f4"), lang)
    clear = [row(rng.choice(50, 5, replace=False) + 100 * (x == "b"), x) for x in "ab" for _ in range(200)]
    mixed = [row(rng.choice(50, 5, replace=False) + 300, x) for x in "ab" for _ in range(60)]  # say nothing of the language
    assert language_id.train(clear).threshold == 0.0
    assert language_id.train(clear + mixed).threshold > 0.5


@pytest.fixture(scope="module")
def labelled(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").withColumn("good", (F.col("quality") == 1) & (F.col("toxic") == 0))
    fold = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return docs, labels.filter(~fold), labels.filter(fold)


def test_quality_of_held_out_documents(spark, labelled):
    docs, train, held = labelled
    model = quality_model.fit(docs, train.select("doc_id", "good"))
    got = quality_model.posteriors(docs.join(held.select("doc_id"), "doc_id"), model, F.col("source"), F.concat_ws("/", "source", "lang"))
    rows = got.join(held, "doc_id").collect()
    good, bad = [r.kept for r in rows if r.good], [r.kept for r in rows if not r.good]
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.3 * len(bad)


def test_posteriors_by_hand(spark):
    texts = ["good words here", "awful", None, "good words here", "", "good awful"]
    rows = [(i, texts[i % 6], ["a", "a", "b", None][i % 4], f"p{i % 3}", i) for i in range(40)] + [(None, "good", "c", None, 1), (3, texts[3], None, "p0", 3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, host string, path string, score int")
    w = np.zeros(quality_model.BUCKETS, "f4")
    w[zlib.crc32(b"good") % quality_model.BUCKETS] = 2
    w[zlib.crc32(b"awful") % quality_model.BUCKETS] = -3
    model = quality_model.TextModel(w, 0.5, 0.4)
    got = quality_model.posteriors(docs, model, F.col("host"), F.col("path")).collect()
    ev = lambda t: 0.1 + 2 * ("good" in (t or "")) - 3 * ("awful" in (t or ""))
    p = lambda t: 1 / (1 + math.exp(-(ev(t) + 0.4)))
    paths, hosts = defaultdict(list), defaultdict(list)
    for _, t, h, q, _ in rows:
        paths[(h or "", q or "")].append(p(t))
        hosts[h or ""].append(p(t))

    def strength(groups):
        n = sum(map(len, groups.values()))
        mean = sum(map(sum, groups.values())) / n
        var = sum(sum(g) ** 2 / len(g) for g in groups.values()) / n - mean * mean
        return mean, min(1e4, max(2.0, mean * (1 - mean) / var - 1)) if var > 1e-9 else 1e4
    mean, strong = strength(hosts)
    near = strength(paths)[1]
    want = []
    for i, t, h, q, _ in rows:
        site, path = hosts[h or ""], paths[(h or "", q or "")]
        host_rate = (sum(site) + mean * strong) / (len(site) + strong)
        rate = (sum(path) - p(t) + host_rate * near) / (len(path) - 1 + near)
        want.append((str(i), round(1 / (1 + math.exp(-(ev(t) + math.log(rate / (1 - rate))))), 6)))
    assert sorted((str(r.doc_id), round(r.score, 6)) for r in got) == sorted(want)
    assert all(r.kept == (r.score >= 0.5) for r in got)
    assert quality_model.posteriors(docs.limit(0), model, F.col("host"), F.col("path")).count() == 0


def test_a_fit_without_labels_says_nothing(spark):
    docs = spark.createDataFrame([(1, "x")], "doc_id bigint, text string")
    model = quality_model.fit(docs, spark.createDataFrame([], "doc_id bigint, good boolean"))
    assert model.evidence("anything") == 0.0


def test_registered_quality_query(spark, sf):
    got = QUERIES["op3_site_quality"](spark, sf)
    assert got.columns == ["doc_id", "evidence", "host_rate", "path_rate", "score", "kept"] and got.count() == 200


def test_a_repeated_key_gives_one_row_to_the_fit(spark, monkeypatch):
    """A third of the table under one labelled key, with equal and with different texts."""
    rows = [(i, f"plain text {i}") for i in range(60)] + [(5, "plain text 5")] * 20 + [(6, f"other {i}") for i in range(20)]
    labels = spark.createDataFrame([(i, i % 2 == 0) for i in range(60)], "doc_id bigint, good boolean")
    seen = []
    monkeypatch.setattr(quality_model, "train", seen.append)
    for n in (1, 7):
        quality_model.fit(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(n), labels)
    assert [len(x) for x in seen] == [60, 60] and sum(good for _, good in seen[0]) == 30
    assert [(a.tolist(), g) for a, g in seen[0]] == [(a.tolist(), g) for a, g in seen[1]]
