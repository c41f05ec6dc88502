"""SimHash groups against brute force."""

import random

import numpy as np
import pytest
import xxhash

from catalograph.llm import simhash
from catalograph.llm.queries import QUERIES


def fingerprint(text):
    out = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in out.replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    sh = [" ".join(words[i: i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(prints):
    """Least key of each row's component, by all pairs."""
    fps = sorted({f for _, f in prints})
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, a in enumerate(fps):
        for b in fps[i:]:
            if (a ^ b).bit_count() <= 4:
                root[find(a)] = find(b)
    least = {}
    for k, f in prints:
        if k is not None:
            least[find(f)] = min(k, least.get(find(f), k))
    return {(k, f): least.get(find(f)) for k, f in prints}


def test_fingerprints():
    random.seed(1)
    texts = ["", "one", "One two", "a b c d", "A\tb\nc  d e", "é ß É nbsp x", " ", "w " * 70_000,
             *[" ".join(random.choices("abcdefg", k=random.randrange(1, 900))) for _ in range(40)]]
    assert simhash.fingerprint_of(texts).tolist() == [fingerprint(t) for t in texts]


def test_query_against_all_pairs(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = brute([(r.doc_id, fingerprint(r.text)) for r in docs])
    got = QUERIES["op5_simhash_ball"](spark, sf).collect()
    assert {(r.doc_id, int(r.fingerprint, 16)): r.component_id for r in got} == want and len(got) == len(docs)
    assert all(len(r.fingerprint) == 16 and r.fingerprint == r.fingerprint.lower() for r in got)


@pytest.mark.parametrize("rounds", [1, 8])
def test_balls_link_every_pair_within_four_bits(spark, rounds):
    rng = random.Random(5)
    prints, key = [], 0
    for _ in range(60):
        at = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 9)):
            for b in rng.sample(range(64), rng.randrange(0, 6)):
                at ^= 1 << b
            prints.append((key, at))
            key += 1
    centre = rng.getrandbits(64)  # one large group of near copies
    for _ in range(700):
        f = centre
        for b in rng.sample(range(64), rng.randrange(0, 4)):
            f ^= 1 << b
        prints.append((key, f))
        key += 1
    prints += [(None, 0), (None, centre), (None, 2**64 - 1)]
    df = spark.createDataFrame([(k, int(np.uint64(f).astype("i8"))) for k, f in prints], "doc_id bigint, fp bigint")
    got = {r.fp: r.component_id for r in simhash.components(df, rounds=rounds).collect()}
    assert {(k, f): got[int(np.uint64(f).astype("i8"))] for k, f in prints} == brute(prints)


def test_keeps_one_of_each_group(spark):
    base = " ".join(f"word{i}" for i in range(300))
    near = base.replace("word7 ", "other ")
    far = " ".join(f"else{i}" for i in range(300))
    rows = [(5, base, "a", 1), (3, near, "b", 2), (9, base, "c", 3), (9, base, "c", 3), (None, base, "d", 4), (7, far, "e", 5), (None, None, "f", 6),
            (None, "", "g", 7), (11, far, None, None), (11, far, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, fp string, root int")
    got = simhash.keep_one(docs).collect()
    assert (fingerprint(base) ^ fingerprint(near)).bit_count() <= 4
    assert sorted(str(r.doc_id) for r in got) == ["3", "7", "None"]
    assert simhash.keep_one(docs.limit(0)).count() == 0 and simhash.report(docs.limit(0)).count() == 0


def test_odd_distances_are_refused(spark):
    with pytest.raises(ValueError):
        simhash.links(spark.createDataFrame([(1,)], "code bigint"), distance=3)


def test_tasks_take_records_by_small_batches_of_bytes(spark, monkeypatch):
    """Packed records come to a task in batches of about 4 MB, not as the whole task, and the session's setting is as before."""
    name, whole = "spark.sql.execution.arrow.maxBytesPerBatch", simhash._meet

    def watched(*args):
        inner = whole(*args)

        def run(batches):
            def seen():
                for b in batches:
                    if b.nbytes > 6_000_000:
                        raise ValueError(f"a batch of {b.nbytes} bytes")
                    yield b

            yield from inner(seen())

        return run

    monkeypatch.setattr(simhash, "_meet", watched)
    before = spark.conf.get(name)
    simhash.links(spark.range(4000).selectExpr("xxhash64(id) AS code")).count()
    assert spark.conf.get(name) == before
