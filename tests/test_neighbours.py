"""Batch neighbours against brute force, with copies and a hot cluster."""

import numpy as np
import pytest

from catalograph.operators import neighbours as NB

RNG = np.random.default_rng(3)


def frame(spark, m):
    return spark.createDataFrame([("m", i, [float(x) for x in v]) for i, v in enumerate(m)], "model string, key_id long, vec array<double>")


@pytest.fixture(scope="module")
def points():
    """A third copies of one vector, a third in one tight cluster, the rest spread out."""
    copies = np.repeat(RNG.normal(size=(1, 8)), 60, axis=0)
    cluster = RNG.normal(size=(1, 8)) + 0.05 * RNG.normal(size=(60, 8))
    return np.vstack([copies, cluster, RNG.normal(size=(60, 8))])[RNG.permutation(180)]


def cosines(a, b):
    n = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    return np.round(n(a) @ n(b).T, 12)


def test_knn_join_is_exact_under_skew(spark, points):
    got = {}
    df = frame(spark, points)
    for r in NB.knn_join(df, df, "m", 4, block=16).collect():
        got.setdefault(r.key_id, []).append((r["rank"], r.neighbour))
    s = cosines(points, points)
    first = {tuple(v): i for i, v in reversed(list(enumerate(map(tuple, points))))}
    canon = [first[tuple(v)] for v in points]  # equal vectors score alike
    for i in range(len(points)):
        order = sorted((j for j in range(len(points)) if j != i), key=lambda j: (-s[canon[i], canon[j]], j))[:4]
        assert [j for _, j in sorted(got[i])] == order


def test_knn_join_of_two_tables(spark, points):
    left, right = points[:40], points[40:]
    rows = NB.knn_join(frame(spark, left), frame(spark, right), "m", 3, exclude_self=False, block=16).collect()
    s = cosines(left, right)
    for i in range(len(left)):
        mine = sorted((r["rank"], r.score) for r in rows if r.key_id == i)
        assert np.allclose([x for _, x in mine], np.sort(s[i])[::-1][:3])


def groups_of(s, t):
    n, lab = len(s), list(range(len(s)))
    for i in range(n):
        for j in range(i):
            if s[i, j] >= t:
                a, b = lab[i], lab[j]
                lab = [min(a, b) if x in (a, b) else x for x in lab]
    return lab


@pytest.mark.parametrize("t", [0.5, 0.8, 0.95])
def test_near_duplicates_match_all_pairs(spark, points, t):
    rows = {r.key_id: r.group for r in NB.near_dups(frame(spark, points), "m", t, block=16).collect()}
    assert [rows[i] for i in range(len(points))] == groups_of(cosines(points, points), t)


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5000, 5001)]
    df = spark.createDataFrame([e if i % 2 else e[::-1] for i, e in enumerate(edges)], "u long, v long")
    got = {r.node: r.root for r in NB.connected_components(df).collect()}
    assert {got[i] for i in range(301)} == {0} and {got[1000 + i] for i in range(300)} == {1000} and got[5001] == 5000


def test_components_write_no_round_for_stars_and_few_tasks_for_few_edges(spark, monkeypatch):
    """With the number of shuffle partitions held from outside, as a session may, a round of few edges made 11 tasks a partition."""
    cuts, cut, kind, name = [], NB.cut_lineage, type(spark.conf), "spark.sql.shuffle.partitions"
    monkeypatch.setattr(NB, "cut_lineage", lambda df: cuts.append(1) or cut(df))
    stars = spark.createDataFrame([(10 * (i % 3), 100 + i) for i in range(60)], "u long, v long")
    assert {(r.node, r.root) for r in NB.connected_components(stars).collect()} == {(100 + i, 10 * (i % 3)) for i in range(60)} | {(i, i) for i in (0, 10, 20)}
    assert len(cuts) == 2
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "u long, v long")
    before, put = spark.conf.get(name), kind.set
    held = {name: "96", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    sc = spark.sparkContext
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        monkeypatch.setattr(kind, "set", lambda self, key, value: None if key in held else put(self, key, value))
        cuts.clear()
        sc.setJobGroup("few_edges", "few edges")
        assert {(r.node, r.root) for r in NB.connected_components(chain).collect()} == {(i, 0) for i in range(41)}
        of = sc.statusTracker()
        stages = {s for j in of.getJobIdsForGroup("few_edges") for s in of.getJobInfo(j).stageIds}
        tasks = sum(i.numCompletedTasks for i in map(of.getStageInfo, stages) if i)
        assert len(cuts) > 3 and tasks < 96 * 8 * (len(cuts) - 1)
    finally:
        monkeypatch.undo()
        sc.setLocalProperty("spark.jobGroup.id", None)
        spark.conf.set(name, before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_approximate_search_recalls(spark):
    centres = RNG.normal(size=(20, 16))
    m = np.repeat(centres, 100, axis=0) + 0.3 * RNG.normal(size=(2000, 16))
    df = frame(spark, m)
    index = NB.build_cells(df, "m", 24)
    s, hits = cosines(m, m), 0
    for i in range(0, 2000, 250):
        got = {r.key_id for r in NB.knn_approx(index, "m", list(m[i]), 10, effort=400).collect()}
        hits += len(got & set(np.argsort(-s[i], kind="stable")[:10]))
    assert hits / 80 >= 0.95


def test_a_narrow_gate_and_a_large_k_are_answered_in_full(spark):
    m = RNG.normal(size=(1500, 16))
    df, far = frame(spark, m), np.argsort(m @ m[0])[:20]
    index, gate = NB.build_cells(df, "m"), spark.createDataFrame([(int(i),) for i in far], "key_id long")
    assert {r.key_id for r in NB.knn_approx(index, "m", list(m[0]), 20, gate=gate).collect()} == set(far.tolist())
    assert NB.knn_approx(index, "m", list(m[0]), 10, gate=gate).count() == 10
    assert NB.knn_approx(index, "m", list(m[0]), 1400).count() == 1400 and NB.knn_approx(index, "m", list(m[0]), 5000).count() == 1500


def test_approximate_join_over_all_cells_is_exact(spark):
    m = np.concatenate([RNG.normal(size=(200, 8)), np.repeat(RNG.normal(size=(1, 8)), 60, axis=0)])
    df = frame(spark, m)
    rows = lambda d: {(r.key_id, r.rank): r.neighbour for r in d.collect()}
    assert rows(NB.knn_join_approx(NB.build_cells(df, "m", 12), df, "m", 5, probes=12, block=32)) == rows(NB.knn_join(df, df, "m", 5, block=32))


def test_search_at_its_default_effort_misses_nothing(spark):
    """Vectors without clusters, and clustered ones with a vector of norm zero."""
    spread = RNG.normal(size=(800, 32))
    tight = np.vstack([np.repeat(RNG.normal(size=(20, 16)), 40, axis=0) + 0.1 * RNG.normal(size=(800, 16)), np.zeros((1, 16))])
    for m in (spread, tight):
        index = NB.build_cells(frame(spark, m), "m")
        for i in range(0, 800, 200):
            s = cosines(m[i: i + 1], m[:800])[0]
            got = [r.key_id for r in NB.knn_approx(index, "m", list(m[i]), 10).collect()]
            assert set(got) == set(np.argsort(-s, kind="stable")[:10].tolist())


def shuffled_rows(spark, monkeypatch, n, call):
    """Rows that `call` sends to tasks of parts, for n random vectors, whose bounds rule out no cell."""
    sent, met = [], NB._met_parts

    def counted(*args):
        args = list(args)
        run, tally = args[6], spark.sparkContext.accumulator(0)

        def counting(qt, ct, members):
            tally.add(len(qt) + len(ct))
            return run(qt, ct, members)

        args[6] = counting
        sent.append(tally)
        return met(*args)

    monkeypatch.setattr(NB, "_met_parts", counted)
    call(frame(spark, np.random.default_rng(n).normal(size=(n, 24)))).write.format("noop").mode("overwrite").save()
    monkeypatch.setattr(NB, "_met_parts", met)
    return sum(t.value for t in sent)


@pytest.mark.parametrize("call", [lambda d: NB.knn_join(d, d, "m", 3, block=16), lambda d: NB.near_dups(d, "m", 0.6, block=16)], ids=["knn", "dups"])
def test_rows_sent_grow_with_the_table_where_no_cell_is_ruled_out(spark, monkeypatch, call):
    few, many = (shuffled_rows(spark, monkeypatch, n, call) for n in (600, 2400))
    assert many <= 5 * few


def test_more_parts_than_sides_and_a_cut_cell(spark, points, monkeypatch):
    """Parts smaller than a sixteenth of the table, and a crowd of scaled copies in one cell."""
    monkeypatch.setattr(NB, "PART", 8 * 20)
    m = np.vstack([points, np.outer(np.arange(1, 61), RNG.normal(size=8))])
    df, s = frame(spark, m), cosines(m, m)
    rows = {r.key_id: r.group for r in NB.near_dups(df, "m", 0.8, block=8).collect()}
    assert [rows[i] for i in range(len(m))] == groups_of(s, 0.8)
    np.fill_diagonal(s, -2)
    got = {(r.key_id, r["rank"]): r.score for r in NB.knn_join(df, df, "m", 3, block=8).collect()}
    want = -np.sort(-s, axis=1)[:, :3]
    assert np.allclose([[got[i, k] for k in (1, 2, 3)] for i in range(len(m))], want, atol=1e-9)
