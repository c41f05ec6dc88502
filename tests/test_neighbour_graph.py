"""Graph-built neighbours, banded groups and the index on disk against exact answers, with copies, hot clusters and two stores."""

import numpy as np
import pytest

from catalograph.operators import neighbour_graph as NG, neighbours as NB, vectors as X
from catalograph.sources import cell_index as CI, versions as VS
from tests.test_neighbours import cosines, frame, groups_of

RNG = np.random.default_rng(5)


@pytest.fixture(scope="module")
def points():
    """A third copies of one vector, a third near copies of another, the rest in loose clusters, one of norm zero."""
    copies = np.repeat(RNG.normal(size=(1, 16)), 300, axis=0)
    near = RNG.normal(size=(1, 16)) + 0.02 * RNG.normal(size=(300, 16))
    loose = np.repeat(RNG.normal(size=(15, 16)), 20, axis=0) + 0.25 * RNG.normal(size=(300, 16))
    m = np.vstack([copies, near, loose])[RNG.permutation(900)]
    return np.vstack([m, np.zeros((1, 16))])


@pytest.fixture(scope="module")
def two(spark, points):
    """The same ids in two stores, the second one's vectors in another order."""
    rows = [("a", "m", i, [float(x) for x in v]) for i, v in enumerate(points)] + [("b", "m", i, [float(x) for x in v]) for i, v in enumerate(points[::-1])]
    return NB.cut_lineage(spark.createDataFrame(rows, "store string, model string, key_id long, vec array<double>"))


def test_graph_recalls_neighbours_of_their_own_store(spark, two, points):
    graph = NG.knn_graph(two, "m", 10)
    got = {}
    for r in graph.neighbours(10).collect():
        got.setdefault((r.store, r.key_id), []).append((r["rank"], r.neighbour, r.score))
    assert len(got) == 1800
    for store, m in (("a", points), ("b", points[::-1])):
        s = cosines(m + 1e-300, m + 1e-300)
        hits = 0
        for i in (j for j in range(901) if np.any(m[j]) and j % 20 == 1):
            best = np.sort(np.delete(s[i], [i, *np.nonzero(~m.any(axis=1))[0]]))[::-1][:10]
            mine = sorted(got[store, i])
            assert [r for r, *_ in mine] == list(range(1, 11)) and i not in [n for _, n, _ in mine]
            assert all(abs(x - s[i, n]) < 1e-9 for _, n, x in mine)
            hits += sum(x >= best[-1] - 1e-9 for *_, x in mine)
        assert hits >= 0.95 * 10 * 45
    assert graph.compared < 3 * graph.of


def test_lists_widen_until_they_hold_the_neighbours(spark):
    """Random vectors without clusters: lists of 6 hold too few of the 5 nearest."""
    m = np.random.default_rng(8).normal(size=(400, 32))
    graph = NG.knn_graph(frame(spark, m), "m", 5, width=6, leaf=24, trees=1, rounds=2)
    got = {}
    for r in graph.neighbours(5).collect():
        got.setdefault(r.key_id, set()).add(r.neighbour)
    s = cosines(m, m)
    np.fill_diagonal(s, -2)
    hits = sum(len(got[i] & set(np.argsort(-s[i])[:5].tolist())) for i in range(400))
    assert len(got) == 400 and all(len(x) == 5 for x in got.values())
    assert hits >= 0.9 * 5 * 400


def listed(graph, k):
    got = {}
    for r in graph.neighbours(k).collect():
        got.setdefault(r.key_id, set()).add(r.neighbour)
    return got


def test_graph_of_random_vectors_costs_no_more_than_all_pairs(spark, monkeypatch):
    """Without clusters vectors visit cells: fewer pairs than all, both ways round, in whole lists of exact scores that hold the neighbours."""
    monkeypatch.setattr(NG, "SEEDS", 64, raising=False)
    m = np.random.default_rng(9).normal(size=(3000, 64))
    graph = NG.knn_graph(frame(spark, m), "m", 10, width=11)
    assert graph.compared <= 1.8 * graph.of and graph.width == 11 and graph.recall >= 0.95
    got = listed(graph, 10)
    s = cosines(m, m)
    np.fill_diagonal(s, -2)
    assert len(got) == 3000 and all(len(x) == 10 for x in got.values())
    assert sum(len(got[i] & set(np.argsort(-s[i])[:10].tolist())) for i in range(3000)) >= 0.93 * 10 * 3000
    edges = graph.edges.join(graph.points.select(NG.F.col("nid").alias("u"), NG.F.col("first").alias("a")), "u").join(
        graph.points.select(NG.F.col("nid").alias("v"), NG.F.col("first").alias("b")), "v").collect()
    assert len({(r.a, r.b) for r in edges}) == len(edges) == 3000 * graph.width and all(r.a != r.b and abs(r.score - s[r.a, r.b]) < 2e-12 for r in edges)
    asked = {r.key_id for r in graph.neighbours(10, queries=spark.range(0, 3000, 20).withColumnRenamed("id", "key_id")).collect()}
    assert asked == set(range(0, 3000, 20))


def test_probe_in_parts_gives_the_same_lists(spark, two, monkeypatch):
    """Sides cut into several parts, hits dropped often, two stores with a crowd and copies: the lists of one part."""
    monkeypatch.setattr(NG, "WHOLE", 0.0)  # all pairs
    rows = lambda: sorted((r.store, r.key_id, r["rank"], round(r.score, 9)) for r in NG.knn_graph(two, "m", 10).neighbours(10).collect())
    whole = rows()
    monkeypatch.setattr(NG, "SEEDS", 16)
    monkeypatch.setattr(NG, "SETTLE", 500)
    monkeypatch.setattr(NG, "ASKING", 16 * 150)
    monkeypatch.setattr(NG, "HELD", 16 * 200)
    assert rows() == whole


@pytest.mark.parametrize("clusters", [True, False])
def test_descent_hands_over_what_it_does_not_find(spark, clusters, monkeypatch):
    """Descent first: near ones in clusters are found by it, those of random vectors by cells after it."""
    monkeypatch.setattr(NG, "PRICE", 0)
    r = np.random.default_rng(10)
    m = np.repeat(r.normal(size=(30, 16)), 40, axis=0) + 0.2 * r.normal(size=(1200, 16)) if clusters else r.normal(size=(1200, 32))
    met = []
    monkeypatch.setattr(NG, "_probed", lambda *a, f=NG._probed: met.append(1) or f(*a))
    graph = NG.knn_graph(frame(spark, m), "m", 5, width=24 if clusters else 6, leaf=24, trees=3 if clusters else 1)
    assert graph.rounds > 0 and bool(met) != clusters and graph.recall >= 0.95
    got = listed(graph, 5)
    s = cosines(m, m)
    np.fill_diagonal(s, -2)
    assert sum(len(got[i] & set(np.argsort(-s[i])[:5].tolist())) for i in range(1200)) >= 0.93 * 5 * 1200


def test_graph_of_nothing_and_of_one(spark):
    df = frame(spark, np.array([[1.0, 2.0]]))
    assert NG.knn_graph(df, "m").neighbours(5).count() == 0
    assert NG.knn_graph(df.limit(0), "m").neighbours(5).count() == 0
    assert [r.group for r in NG.near_dups_banded(df, "m").collect()] == [0] and NG.near_dups_banded(df.limit(0), "m").count() == 0


@pytest.mark.parametrize("t", [0.95])
def test_banded_groups_match_all_pairs(spark, two, points, t):
    got = {(r.store, r.key_id): r.group for r in NG.near_dups_banded(two, "m", t, block=64).collect()}
    for store, m in (("a", points), ("b", points[::-1])):
        there = [i for i in range(901) if m[i].any()]
        want = groups_of(cosines(m[there], m[there]), t)
        assert [got[store, i] for i in there] == [there[g] for g in want]
    assert len(got) == 1800


def test_graph_groups(spark, two):
    graph = NG.knn_graph(two, "m", 10)
    got = {(r.store, r.key_id): r.group for r in graph.groups(0.97).collect()}
    exact = {(r.store, r.key_id): r.group for r in NB.near_dups(two, "m", 0.97).collect()}
    assert sum(got[k] == g for k, g in exact.items()) >= 0.99 * len(exact)


@pytest.mark.parametrize("listed", [1, 512])
def test_index_is_exact_and_kept(spark, two, points, tmp_path, monkeypatch, listed):
    """Searches after building, adding and removing; few cells are a partition filter, many are joined."""
    monkeypatch.setattr(CI, "LISTED", listed)
    index = CI.write_index(two, "m", f"{tmp_path}/i", fit=300)
    plan = lambda cells: index.rows(cells)._jdf.queryExecution().toString()
    if listed > 1:
        text = plan(index.cells().filter("store = 'a'").orderBy("cell").limit(2))
        assert "PartitionFilters" in text and "cell" in text.split("PartitionFilters: [")[1].split("]")[0]
    assert index.rows().count() == 1802  # every row, the one of norm zero too
    ranked = lambda d: [(r.key_id, round(r.score, 6)) for r in d.collect()]
    q = [float(x) for x in points[7]]
    for store in "ab":
        assert ranked(index.search(q, 7, store)) == ranked(X.knn(two, "m", q, 7, store=store))
    near = [float(x) for x in points[7] + 1e-3]
    new = spark.createDataFrame([("a", "m", 5000, near, 0), ("a", "m", 5000, q, 1), ("a", "m", 5001, near[:4], 2), ("a", "m", 3, near, 3), ("b", "m", 5000, [0.0] * 16, 4)],
                                "store string, model string, key_id long, vec array<double>, seq long")
    gone = spark.createDataFrame([("a", int(i)) for i in range(0, 901, 3)], "store string, key_id long")
    version, report = index.update(new, gone)
    assert version == 2
    assert sorted((r.store, r.key_id, r.seq, r.status) for r in report.collect()) == [
        ("a", 3, 3, "present"), ("a", 5000, 0, "added"), ("a", 5000, 1, "present"), ("a", 5001, 2, "refused"), ("b", 5000, 4, "added")]
    after = X.remove_vectors(two, gone).unionByName(new.filter("seq in (0, 4)").drop("seq"))
    for store in "ab":
        assert ranked(index.search(q, 7, store)) == [(k, s) for k, s in ranked(X.knn(after, "m", q, 7, store=store))]
    gate = spark.createDataFrame([(5000,), (1,), (2,)], "key_id long")
    assert [r.key_id for r in index.search(q, 2, "a", gate=gate).collect()][0] == 5000
    assert index.search(q, 3, "a", effort=10).count() == 3 and index.search(q, 3, "none").count() == 0
    before = index._body(1)
    with pytest.raises(VS.Taken):
        index._write(index.rows(), None, before, 2)


def test_index_without_a_store(spark, tmp_path):
    m = RNG.normal(size=(60, 8))
    index = CI.write_index(frame(spark, m), "m", f"{tmp_path}/i")
    q = [float(x) for x in m[4]]
    assert [r.key_id for r in index.search(q, 5).collect()] == [r.key_id for r in X.knn(frame(spark, m), "m", q, 5).collect()]
