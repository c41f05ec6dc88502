"""Near copies of the pipeline against all pairs."""

import random

import corpus_pipeline
from catalograph.llm import near_copies
from catalograph.operators.neighbours import connected_components


def sets(text):
    w = (text or "").lower().split()
    return {tuple(w[i: i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def least_of_groups(docs, similar=0.8):
    ids = sorted(docs)
    own = {i: sets(docs[i]) for i in ids}
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            x, y = own[a], own[b]
            if (len(x & y) / len(x | y) if x | y else 1.0) >= similar:
                ra, rb = find(a), find(b)
                root[max(ra, rb)] = min(ra, rb)
    return {i for i in ids if find(i) == i}


def test_the_stage_drops_every_copy_at_0_8(spark, sf):
    """Copies with words substituted that lie more than four SimHash bits apart, some short of 0.8, a group of copies of one text, and odd rows."""
    rng = random.Random(4)
    docs, at = {}, 0
    word = lambda: f"w{rng.randrange(10**6)}"

    def edited(words, k):
        out = list(words)
        for i in rng.sample(range(len(out)), k):
            out[i] = word()
        return " ".join(out)
    for n, k in [(100, 1), (200, 2), (200, 4), (200, 6), (400, 8), (400, 14)] * 6:
        base = [word() for _ in range(n)]
        docs[at], docs[at + 1], at = " ".join(base), edited(base, k), at + 2
    crowd = [word() for _ in range(150)]
    for _ in range(80):
        docs[at], at = edited(crowd, rng.randrange(1, 8)), at + 1
    for t in ["", None, "a b", "A  b", "one two three four five", "one two three four five six"]:
        docs[at], at = t, at + 1
    want = least_of_groups(docs)
    rows = spark.createDataFrame([(i, t) for i, t in docs.items()] + [(0, docs[0])], "doc_id bigint, text string")
    got = [r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, rows, sf).collect()]
    assert sorted(got) == sorted(want) and len(want) < len(docs) - 40


def test_links_between_roots_move_whole_components(spark):
    """Two components and two texts of their own become one; a third is left alone, and a link back to a greater root changes nothing."""
    roots = spark.createDataFrame([(1, 1), (2, 1), (5, 5), (6, 5), (8, 8), (9, 8)], "node bigint, root bigint")
    found = spark.createDataFrame([(5, 1), (1, 5), (7, 5), (3, 7)], "u bigint, v bigint")
    got = {(r.node, r.root) for r in near_copies._moved(roots, connected_components(found)).collect()}
    assert got == {(n, 1) for n in (1, 2, 3, 5, 6, 7)} | {(8, 8), (9, 8)}


def test_the_stage_on_the_shared_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = [r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, docs, sf).collect()]
    assert sorted(got) == sorted(least_of_groups({r.doc_id: r.text for r in docs.collect()}))


def test_the_stage_with_clashing_columns_long_texts_and_crowded_buckets(spark, sf, monkeypatch):
    """Columns named like the stage's own, a text of 20,000 words and its copy, and a template's texts that share buckets but no link."""
    from catalograph.llm import near_copies

    monkeypatch.setattr(near_copies, "BLOCK", 16)
    monkeypatch.setattr(near_copies, "STAR", 8)
    rng = random.Random(8)
    long = [f"l{rng.randrange(10**6)}" for _ in range(20_000)]
    form = [f"form{i}" for i in range(120)]
    docs = {0: " ".join(long), 1: " ".join([*long[:-3], "x", "y", "z"])}
    for i in range(60):
        docs[10 + i] = " ".join([*form, *[f"own{i}w{j}" for j in range(50)]])
    for i in range(40):
        docs[100 + i] = " ".join([*form, *[f"copy{j}" for j in range(45)], f"end{i}"])
    rows = spark.createDataFrame([(i, t, f"s{i}", i, f"r{i}", None) for i, t in docs.items()], "doc_id bigint, text string, _sha string, id int, row string, name string")
    got = corpus_pipeline.near_duplicate_stage(spark, rows, sf)
    kept = {r.doc_id: r for r in got.collect()}
    assert got.columns == rows.columns and set(kept) == least_of_groups(docs) and len(kept) == 62
    assert all(r._sha == f"s{i}" and r.id == i and r.row == f"r{i}" for i, r in kept.items())
