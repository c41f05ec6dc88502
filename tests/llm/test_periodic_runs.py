"""Periodic runs against brute force."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from catalograph.llm import periodic_runs as R, queries as Q


def brute(x):
    out = set()
    for q in range(1, len(x) // 3 + 1):
        i = 0
        while i + q < len(x):
            if x[i] != x[i + q]:
                i += 1
                continue
            s = i
            while i + q < len(x) and x[i] == x[i + q]:
                i += 1
            n = i + q - s
            if n >= max(24, 3 * q) and not any(x[s: s + n - p] == x[s + p: s + n] for p in range(1, q)):
                out.add((s, n, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def numbers(rng):
    n, kinds = rng.randrange(0, 170), rng.choice([1, 2, 3, 5, 50])
    x = [rng.randrange(kinds) for _ in range(n)]
    for _ in range(rng.randrange(5)):
        if n > 30:
            s, p = rng.randrange(n), rng.randrange(1, 25)
            for i in range(s + p, min(n, s + rng.randrange(10, 100))):
                x[i] = x[i - p]
    return x


@pytest.mark.parametrize("seed", range(8))
def test_runs_of_numbers(seed):
    rng = random.Random(seed)
    for _ in range(120):
        x = numbers(rng)
        assert R.runs_of(np.array(x, "i8")) == brute(x)


def test_bounds_of_a_run():
    """Just long enough, one short of it, runs that touch, runs inside a long document, and a run at each period of the window's bound."""
    for q in range(1, 30):
        n = max(24, 3 * q)
        for length, found in ((n, 1), (n - 1, 0)):
            x = [*range(1000, 1000 + 40), *[i % q for i in range(length)], *range(2000, 2040)]
            assert len(R.runs_of(np.array(x))) == found, (q, length)
    x = [0] * 24 + [1] * 30 + [1, 2] * 20
    assert R.runs_of(np.array(x)) == brute(x)


def test_stretches_hold_every_run_and_skip_far_repeats():
    passage = list(range(50))
    assert R.stretches(np.array([*passage, *range(100, 1100), *passage])) == []
    assert R.stretches(np.array([*range(100, 1100), *(passage * 3), *range(2000, 2100)])) == [(1000, 1150)]


def planted(i, words):
    h = zlib.crc32(str(i).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]


def want(i, text):
    words = planted(i, (text or "").encode().split())
    runs = brute(words)
    keep = [not any(s + q <= k < s + n for s, n, q in runs) for k in range(len(words))]
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    sha = lambda t: hashlib.sha256(t).hexdigest()
    return (len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()),
            sha(b" ".join(w for w, k in zip(words, keep, strict=True) if k)))


def rows_of(df):
    return sorted((r.doc_id if r.doc_id is not None else -1, (r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256)) for r in df.collect())


def test_registered_query_against_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if len((r.text or "").split()) < 1500]
    some = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = rows_of(R.digest(R.collapse(R.planted(some))))
    assert got == sorted((i, want(i, t)) for i, t in docs) and sum(g[1][0] > 0 for g in got) > 5
    assert Q.QUERIES["op13_periodic_runs"](spark, sf).columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_odd_rows(spark):
    """Nulls, blanks, repeated rows, a word repeated 20,000 times, other spaces, clashing columns and an empty table."""
    docs = [(1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (4, "a\x0bb\x0cc " * 12), (4, "a\x0bb\x0cc " * 12), (None, "é x " * 30), (6, "w " * 20_000),
            *[(i, " ".join(f"v{k % 11}" for k in range(7 * i))) for i in range(10, 60)]]
    df = spark.createDataFrame([(i, t, 0, "r", [1]) for i, t in docs], "doc_id bigint, text string, key int, runs string, words array<int>")
    got = rows_of(R.digest(R.collapse(R.planted(df))))
    small = [(i, t) for i, t in docs if t is None or len(t) < 10_000]
    expect = [(i, want(i, t)) for i, t in small if i is not None]
    line = hashlib.sha256(b"0,30,1\n").hexdigest()
    expect.append((-1, (1, 0, 30, 1, 30_000, line, hashlib.sha256("é x".encode()).hexdigest())))
    assert [g for g in got if g[0] != 6] == sorted(expect)
    assert [g[1][:5] for g in got if g[0] == 6] == [(1, 0, 20_000, 1, 20_000_000)]
    assert R.digest(R.collapse(R.planted(df.limit(0)))).count() == 0
