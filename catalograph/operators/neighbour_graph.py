"""Neighbours and groups without scanning cells: a k-neighbour graph by NN-descent or by probed cells, and links by hyperplane bands.

NN-descent (Dong et al., "Efficient k-nearest neighbor graph construction for generic similarity measures", 2011): every vector keeps a
bounded list of near ones; a round lets all members of a list, and a bounded draw of those that list it, meet, and keeps what is nearer. A list
travels as one row group of at most `2 * width` vectors, so neither a hub nor a crowd of copies makes a large task; what a task emits is bounded
by what can still enter a list. The first lists come from random hyperplane cells, cut by hash where they are crowded.

Descent needs clusters: lists of random vectors of many numbers must be so wide that their meetings cost more than all pairs. So the exact neighbours of a
bounded draw of vectors say beforehand how many cells of nearest pivots a vector must visit, if each is listed in several, to find the wanted share
of its neighbours (Lv et al., "Multi-Probe LSH", 2007, with pivots in place of hashes). Where visits cost no more than descent, or settled lists
hold too few of the draw's neighbours, vectors visit their cells: in parts cut by hash, multiplied cell by cell, a task keeping `width` hits a vector.

Bands: the signs of a vector against random hyperplanes agree for two vectors with probability 1 - angle / pi each, so vectors at the threshold share
one of enough bands of signs almost surely. All who share a band meet its head only, which is linear in a crowd; then those
still in different components meet, in blocks, and a block emits spanning links, never its pairs. Every link is an exact cosine.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from catalograph.operators.neighbours import (
    BLOCK, PAIRS, SLAB, _expand, _folded, _owner, _rows, _slack, connected_components, first_named, grouped, local_roots, sliced, unit_matrix)
from catalograph.operators.sizes import small
from catalograph.operators.vectors import top_per_key
from catalograph.session import cut_lineage

LEAF = 128  # vectors a hyperplane cell should hold at the start
TREES = 3
ROUNDS = 12
SETTLED = 0.001  # the share of list entries that may still change in the last round
RECALL = 0.95  # the share of exact neighbours that lists must hold, measured over DRAW vectors (standard error about 0.01)
DRAW = 400
STALLED = 0.01  # lists that gain less than this share in a round, and hold too little, are given up
PRICE = 16  # pairs of a probe that cost what one of descent does: its groups are small, its products in double precision
PIVOTS = (8192, 16)  # pivots of a probe at most (8192 vectors of 512 single floats are 16 MB), vectors a pivot at least
LISTED = 16  # cells that list a vector at most
WHOLE = 0.7  # where this share of all pairs must be visited, all are, without repeats
ASKING, HELD = 1 << 22, 1 << 24  # numbers a side of a probing task: 65,536 and 262,144 vectors of 64, 16 and 64 MB
SETTLE = 2_000_000  # hits a probing task gathers before it drops all but each asker's best
SEEDS = 4096  # held vectors that all in a probing task meet first, for a bound
FEW = 8  # rows of a bucket whose pairs are named one by one
MISS = 0.001  # the probability that no band of a pair at the threshold agrees


def planes(n: int, dim: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).normal(size=(n, dim))


def _signs(rows: DataFrame, sets: list[np.ndarray], keep: list[str]) -> DataFrame:
    """(keep..., band, bits): a row for each set of hyperplanes, its signs as a long."""
    schema = T.StructType([*[rows.schema[c] for c in keep], T.StructField("band", T.IntegerType()), T.StructField("bits", T.LongType())])
    weights = [np.int64(1) << np.arange(len(s), dtype="i8") for s in sets]

    def run(batches):
        for b in batches:
            u = unit_matrix(b.column(len(keep)))
            for i, (s, w) in enumerate(zip(sets, weights, strict=True)):
                bits = ((u @ s.T > 0) @ w if len(s) else np.zeros(b.num_rows, "i8")) if b.num_rows else np.zeros(0, "i8")
                yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(np.full(b.num_rows, i, "i4")), pa.array(bits)],
                                                 names=[*keep, "band", "bits"])

    return rows.select(*keep, "vec").mapInArrow(run, schema)


def _dim(rows: DataFrame) -> int:
    first = rows.select(F.size("vec").alias("n")).first()
    return first.n if first else 0


def _parts(keyed: DataFrame, key: list[str], most: int, by: str) -> DataFrame:
    """Add `parts` and `part`: groups of more than `most` rows are cut by hash."""
    sizes = keyed.groupBy(*key).agg(F.count("*").alias("n")).filter(F.col("n") > most)  # at most one row for `most` rows
    return keyed.join(small(cut_lineage(sizes)), key, "left").withColumn("parts", F.coalesce(F.ceil(F.col("n") / most), F.lit(1)).cast("int")).withColumn(
        "part", F.pmod(F.xxhash64(F.lit(5), F.col(by), *key), "parts").cast("int")).drop("n")


def _meet(most: int):
    """A group `(id, vec[, fresh, low])` to (u, v, score): for each member its `most` best others above its bound."""
    def best(ids: np.ndarray, vec, fresh: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        u = unit_matrix(vec)
        s = np.round(u @ u.T, 12)
        np.fill_diagonal(s, -2.0)
        s[~(fresh[:, None] | fresh[None, :])] = -2.0
        s[s <= low[:, None]] = -2.0
        m = min(most, len(ids) - 1)
        if m < 1:
            return ids[:0], ids[:0], low[:0]
        at = np.argpartition(-s, m - 1, axis=1)[:, :m]
        score = np.take_along_axis(s, at, axis=1)
        row, col = np.nonzero(score > -1.5)
        return ids[row], ids[at[row, col]], score[row, col]

    return best


EDGE = "u bigint, v bigint, score double"


def _table(u, v, score) -> pa.Table:
    return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64()), "score": pa.array(score, pa.float64())})


def _drawn(base: DataFrame, k: int, draw: int, seed: int) -> DataFrame:
    """(u, v): the exact k nearest others in the store of each of `draw` vectors; every task scores its vectors against the draw."""
    owner = _owner(base)
    picked = base.orderBy(F.xxhash64(F.lit(seed), "nid"), "nid").limit(draw).select("nid", "vec", *owner).toArrow()
    q, names = unit_matrix(picked["vec"]), picked["nid"].to_numpy()
    stores = np.array(picked["store"].to_pylist(), object) if owner else None

    def run(batches):
        for b in sliced(batches):
            ids = b.column(0).to_numpy()
            s = np.round(q @ unit_matrix(b.column(1)).T, 12)
            s[names[:, None] == ids[None, :]] = -2.0
            if stores is not None:
                s[stores[:, None] != np.array(b.column(2).to_pylist(), object)[None, :]] = -2.0
            order = np.lexsort((np.broadcast_to(ids, s.shape), -s), axis=1)[:, :k]
            score = np.take_along_axis(s, order, axis=1)
            row, col = np.nonzero(score > -1.5)
            yield pa.RecordBatch.from_arrays([pa.array(names[row]), pa.array(ids[order[row, col]]), pa.array(score[row, col])], names=["u", "v", "score"])

    near = base.select("nid", "vec", *owner).mapInArrow(run, EDGE) if len(names) else base.sparkSession.createDataFrame([], EDGE)
    return cut_lineage(top_per_key(near, ["u"], [F.desc("score"), F.col("v")], k).select("u", "v"))


@dataclass(frozen=True)
class _Probe:
    """A vector is listed in the cells of its `listed` nearest pivots and visits those of its `visits` nearest."""

    pivots: np.ndarray
    listed: int
    visits: int

    @property
    def share(self) -> float:
        """Of all ordered pairs, about so many are scored, repeats counted."""
        return self.listed * self.visits / len(self.pivots)


def _probe(base: DataFrame, exact: DataFrame, n: int, recall: float, seed: int) -> _Probe:
    """The cheapest probe that finds the share `recall` of the pairs `exact(u, v)`, of which there are draw * k at most."""
    picked = base.orderBy(F.xxhash64(F.lit(seed + 1), "nid"), "nid").limit(max(1, min(PIVOTS[0], n // PIVOTS[1]))).select("vec").toArrow()
    pivots = unit_matrix(picked["vec"]).astype("f4")
    vecs = base.select("nid", "vec")
    ends = exact.join(vecs.withColumnsRenamed({"nid": "u", "vec": "x"}), "u").join(vecs.withColumnsRenamed({"nid": "v", "vec": "y"}), "v").select("x", "y").toArrow()
    most, ranks = min(LISTED, len(pivots)), []
    for i in range(0, len(ends), 128):
        x, y = (unit_matrix(ends[c].slice(i, 128)).astype("f4") @ pivots.T for c in "xy")
        cos = np.take_along_axis(x, _nearest_first(y, most), axis=1)
        ranks.append((x[:, None, :] > cos[:, :, None]).sum(axis=2))
    first = np.sort(np.minimum.accumulate(np.concatenate(ranks), axis=1), axis=0)[math.ceil(recall * len(ends)) - 1] + 1
    best = int(np.argmin(first * np.arange(1, most + 1)))
    found = _Probe(pivots, best + 1, int(first[best]))
    return found if found.share < WHOLE else _Probe(pivots[:1], 1, 1)


def _nearest_first(cos: np.ndarray, most: int) -> np.ndarray:
    """The columns of the `most` greatest of each row, greatest first."""
    at = np.argpartition(-cos, most - 1, axis=1)[:, :most]
    return np.take_along_axis(at, np.argsort(-np.take_along_axis(cos, at, axis=1), axis=1, kind="stable"), axis=1)


def _by_cell(near: pa.ChunkedArray, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, rows): the rows whose list names cell c are rows[start[c]: start[c + 1]]."""
    flat = np.frombuffer(b"".join(near.to_pylist()), "<i2")
    at = np.argsort(flat, kind="stable")
    return np.searchsorted(flat[at], np.arange(cells + 1)), (at // (len(flat) // len(near))).astype("i4")


def _probing(cells: int, width: int):
    """A task of askers `(nid, vec, near)` and held vectors of the same form: each asker's `width` best of the cells in its list, and of the seeds, by exact
    scores. Then a row without `u`, whose `v` counts the scored pairs."""
    def run(qt: pa.Table, ct: pa.Table) -> pa.Table:
        if not len(qt) or not len(ct):
            return _table([], [], [])
        mine, theirs = qt["nid"].to_numpy(), ct["nid"].to_numpy()
        (u, u4), (v, v4) = _lengths(qt["vec"]), _lengths(ct["vec"])
        slack, low = _slack(u4), np.full(len(u4), -1.5)
        seeds = np.random.default_rng(len(v4)).permutation(len(v4))[:SEEDS].astype("i4")
        found, size, scored = [], 0, 0

        def hold(row: np.ndarray, col: np.ndarray, s: np.ndarray) -> None:
            nonlocal size, scored
            scored += s.size
            x, y = np.divmod(np.flatnonzero(s >= (low[row] - slack).astype("f4")[:, None]), len(col))
            x, y = row[x], col[y]
            for i in range(0, len(x), PAIRS):
                r, c = x[i: i + PAIRS], y[i: i + PAIRS]
                score, other = _cosines(u, v, r, c), mine[r] != theirs[c]
                ok = (score >= low[r]) & other
                found.append((r[ok], c[ok], score[ok]))
                size += int(ok.sum())
                if size > SETTLE:
                    settle()

        def settle() -> None:
            nonlocal found, size
            row, col, score = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (seeds[:0], seeds[:0], low[:0])
            pair = row.astype("i8") * len(v4) + col
            at = np.argsort(pair)
            at = at[np.append(True, np.diff(pair[at]) != 0)] if len(at) else at  # found in one cell of several
            row, col, score = row[at], col[at], score[at]
            at = np.argsort((row.astype("i8") << 40) + ((1.5 - score) * (1 << 38)).astype("i8"))
            row, col, score = row[at], col[at], score[at]
            rank = np.arange(len(row)) - np.searchsorted(row, row)
            last = rank == width - 1
            low[row[last]] = score[last]
            found, size = [(row[rank < width], col[rank < width], score[rank < width])], 0

        for i in range(0, len(u4), SLAB[1]):
            row = np.arange(i, min(i + SLAB[1], len(u4)), dtype="i4")
            s = u4[row] @ v4[seeds].T
            if len(seeds) > width:  # one of them may be the asker
                low[row] = np.fmax(-1.5, -np.partition(-s, width, axis=1)[:, width] - slack)
            hold(row, seeds, s)
        settle()
        if len(v4) > len(seeds):
            (start, rows), (begin, cols) = _by_cell(qt["near"], cells), _by_cell(ct["near"], cells)
            for c in range(cells):
                row, col = rows[start[c]: start[c + 1]], cols[begin[c]: begin[c + 1]]
                for y in range(0, len(col), SLAB[1]):
                    part = v4[col[y: y + SLAB[1]]].T
                    for x in range(0, len(row), SLAB[0]):
                        hold(row[x: x + SLAB[0]], col[y: y + SLAB[1]], u4[row[x: x + SLAB[0]]] @ part)
            settle()
        row, col, score = found[0]
        return pa.concat_tables([_table(mine[row], theirs[col], score), _table([None], [scored], [None])])

    return run


def _lengths(col: pa.ChunkedArray) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
    """((vectors as they came, their lengths), unit vectors in single precision), made a chunk at a time."""
    raw = [np.asarray(x.flatten()).reshape(len(x), -1) for x in col.chunks if len(x)]
    norm = [np.linalg.norm(x.astype("f8"), axis=1, keepdims=True) for x in raw]
    return (np.concatenate(raw), np.concatenate(norm)), np.concatenate([(x / n).astype("f4") for x, n in zip(raw, norm, strict=True)])


def _cosines(u: tuple[np.ndarray, np.ndarray], v: tuple[np.ndarray, np.ndarray], row: np.ndarray, col: np.ndarray) -> np.ndarray:
    """Cosines of pairs to 12 places, as `unit_matrix` and a product give them."""
    return np.round(np.einsum("ij,ij->i", u[0][row] / u[1][row], v[0][col] / v[1][col]), 12)


def _probed(base: DataFrame, probe: _Probe, width: int) -> tuple[DataFrame, int]:
    """((u, v, score), scored pairs): the `width` best others that each vector of `base` finds in the cells it visits."""
    owner, spark = _owner(base), base.sparkSession
    rows = int(base.groupBy(*owner).count().agg(F.max("count").alias("n")).first().n or 0)
    numbers, most = rows * _dim(base), max(probe.listed, probe.visits)
    parts = max(1, -(-numbers // HELD))
    sides = max(1, -(-numbers // ASKING), min(-(-3 * spark.sparkContext.defaultParallelism // parts), -(-rows // BLOCK)))
    schema = base.select(*owner, "nid", "vec").schema.add("near", T.BinaryType())

    def place(batches):
        for b in sliced(batches):
            near = _nearest_first(unit_matrix(b.column(b.num_columns - 1)).astype("f4") @ probe.pivots.T, most).astype("<i2")
            ends = np.arange(b.num_rows + 1, dtype="i4") * 2 * most
            lists = pa.Array.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(near.tobytes())])
            yield pa.RecordBatch.from_arrays([*b.columns, lists], names=[*b.schema.names, "near"])

    placed = cut_lineage(base.select(*owner, "nid", "vec").mapInArrow(place, schema))

    def side(cells: int, own: str, own_parts: int, other: str, other_parts: int) -> DataFrame:
        return placed.select(*owner, "nid", "vec", F.substring("near", 1, 2 * cells).alias("near"), F.pmod(F.xxhash64(F.lit(own), "nid"), F.lit(own_parts)).cast("int").alias(own),
                             F.explode(F.sequence(F.lit(0), F.lit(other_parts - 1))).alias(other)).groupBy(*owner, "asking", "held")

    found = cut_lineage(side(probe.visits, "asking", sides, "held", parts).cogroup(side(probe.listed, "held", parts, "asking", sides)).applyInArrow(
        _probing(len(probe.pivots), width), EDGE))
    edges = found.filter("u is not null")
    if parts > 1:
        edges = cut_lineage(top_per_key(edges, ["u"], [F.desc("score"), F.col("v")], width).select("u", "v", "score"))
    return edges, int(found.filter("u is null").agg(F.coalesce(F.sum("v"), F.lit(0)).alias("n")).first().n)


@dataclass(frozen=True)
class NeighbourGraph:
    """`rows` are the index rows with `gid`, `points` the distinct vectors (nid, gid, first, ids[, store]), `edges` (u, v, score) their lists by nid.
    `compared` counts the scored pairs (of a probe both ways round), `of` all pairs of distinct vectors; `rounds` are those of descent, `width` is that of the lists,
    `recall` what they hold of the draw's neighbours (None: not measured)."""

    rows: DataFrame
    points: DataFrame
    edges: DataFrame
    compared: int
    of: int
    rounds: int
    width: int
    recall: float | None

    def neighbours(self, k: int, exclude_self: bool = True, queries: DataFrame | None = None) -> DataFrame:
        """`([store,] key_id, neighbour, score, rank)` for every row, or those of `queries` (rows with their keys); exact scores, approximate lists.

        Copies of a row's vector come from the fold and are complete."""
        name = self.points.select(F.col("nid"), F.col("gid"), "first", "ids")
        rows = self.rows if queries is None else self.rows.join(queries, [c for c in ("store", "key_id") if c in queries.columns and c in self.rows.columns], "left_semi")
        mine = name if queries is None else name.join(rows.select("gid"), "gid", "left_semi")
        listed = lambda score: F.array(F.struct((-score).alias("neg"), "first", "ids")).alias("near")
        near = self.edges.join(mine.select(F.col("nid").alias("u"), F.col("gid").alias("q")), "u").join(
            name.select(F.col("nid").alias("v"), "first", "ids"), "v").select("q", listed(F.col("score")))
        own = mine.select(F.col("gid").alias("q"), listed(F.lit(1.0)))
        return _expand(near.unionByName(own), rows, k + 1 if exclude_self else k, k, exclude_self)

    def groups(self, threshold: float) -> DataFrame:
        """([store,] key_id, group) of the lists' links at the threshold or above; a link that no list holds is missed."""
        name = self.points.select("nid", F.struct(*_owner(self.points), F.col("first").alias("key_id")).alias("first"), "gid")
        links = self.edges.filter(F.col("score") >= threshold).join(name.select(F.col("nid").alias("u"), F.col("first").alias("a")), "u").join(
            name.select(F.col("nid").alias("v"), F.col("first").alias("b")), "v").select(F.col("a").alias("u"), F.col("b").alias("v"))
        return grouped(self.rows, name, links)


def knn_graph(vectors: DataFrame, model: str, k: int = 10, width: int | None = None, trees: int = TREES, leaf: int = LEAF, rounds: int = ROUNDS,
              settled: float = SETTLED, seed: int = 17, recall: float | None = RECALL, draw: int = DRAW) -> NeighbourGraph:
    """The graph of (approximately) the `width` nearest distinct vectors of every vector, at least k + 1; by default three times k, 24 at least.

    A round of descent shuffles at most 2 * width vectors a row; rounds end when less than the share `settled` of the entries changed. Vectors visit cells
    instead if that costs no more than `rounds` rounds, or if settled lists hold less than `recall` of the k nearest of `draw` vectors. A probe shuffles a
    vector once a part of the other side. Without clusters (random vectors of many numbers) its pairs stay a share of all, which falls slowly as
    the table grows. `recall` None: no such measure, and descent alone.
    """
    width = max(k + 1, width or max(24, 3 * k))
    rows = _rows(vectors, model, _owner(vectors))
    base = cut_lineage(_folded(rows, k + 1).withColumns({"first": F.element_at("ids", 1), "nid": F.monotonically_increasing_id()}))
    n = base.count()
    exact = _drawn(base, k, draw, seed) if recall is not None else None
    wanted = exact.count() if exact is not None else 0
    probe = _probe(base, exact, n, recall, seed) if wanted else None
    kept = lambda edges: edges.join(F.broadcast(exact), ["u", "v"], "left_semi").count()  # noqa: E731  at most draw * k rows
    graph, compared, turns, held = None, 0, 0, 0
    if probe is None or probe.share * n > PRICE * rounds * 2 * width * width:
        graph, compared, turns = _descended(base, n, width, trees, leaf, rounds, settled, seed, lambda g: kept(g) / wanted if wanted else None, recall)
        held = kept(graph) if wanted else 0
    if probe is not None and held < recall * wanted:
        graph, more = _probed(base, probe, width)
        compared, held = compared + more, kept(graph)
    return NeighbourGraph(rows, base.drop("vec"), graph, compared, n * (n - 1) // 2, turns, width, held / wanted if wanted else None)


def _descended(base: DataFrame, n: int, width: int, trees: int, leaf: int, rounds: int, settled: float, seed: int, held, recall: float | None) -> tuple[DataFrame, int, int]:
    """((u, v, score), scored pairs, rounds). `held` gives the share of the draw's neighbours that lists hold, or None: lists that gain little and hold less than
    `recall` are given up."""
    owner = _owner(base)
    vecs = base.select("nid", "vec")
    depth, dim = max(0, math.ceil(math.log2(max(1, n / leaf)))), _dim(base)
    pairs = lambda counts: int(counts.agg(F.coalesce(F.sum(F.expr("n * (n - 1) div 2")), F.lit(0)).alias("x")).first().x)
    group = [*owner, "band", "bits", "part"]
    order = [F.desc("score"), F.col("v")]
    best = _meet(width)
    cells = _signs(base, [planes(depth, dim, seed + i) for i in range(trees)], [*owner, "nid"])
    placed = cut_lineage(_parts(cells, [*owner, "band", "bits"], 2 * leaf, "nid").drop("parts"))
    compared = pairs(placed.groupBy(*group).agg(F.count("*").alias("n")))

    def begin(t: pa.Table) -> pa.Table:
        ids = t["nid"].to_numpy()
        return _table(*best(ids, t["vec"], np.ones(len(ids), bool), np.full(len(ids), -1.5)))

    once = placed.join(vecs, "nid").groupBy(*group).applyInArrow(begin, EDGE).groupBy("u", "v").agg(F.max("score").alias("score"))
    graph = cut_lineage(top_per_key(once, ["u"], order, width).select("u", "v", "score", F.lit(True).alias("fresh")))

    def local(t: pa.Table) -> pa.Table:
        return _table(*best(t["a"].to_numpy(), t["vec"], t["fresh"].to_numpy(zero_copy_only=False), t["low"].to_numpy()))

    turn, found = 0, 0.0
    while turn < rounds:
        turn += 1
        back = top_per_key(graph.select(F.col("v").alias("w"), F.col("u").alias("a"), "fresh"), ["w"], [F.desc("fresh"), F.xxhash64(F.lit(turn), "a")], width)
        members = graph.select(F.col("u").alias("w"), F.col("v").alias("a"), "fresh").unionByName(back.drop("rank")).groupBy("w", "a").agg(F.max("fresh").alias("fresh"))
        lists = members.groupBy("w").agg(F.count("*").alias("n"), F.max("fresh").alias("any")).filter("any and n > 1")
        lists = cut_lineage(lists)
        compared += pairs(lists)
        bound = graph.groupBy("u").agg(F.count("*").alias("m"), F.min("score").alias("s")).select(
            F.col("u").alias("a"), F.when(F.col("m") >= width, F.col("s")).otherwise(-1.5).alias("low"))
        met = members.join(lists.select("w"), "w").join(vecs.select(F.col("nid").alias("a"), "vec"), "a").join(bound, "a", "left").select(
            "w", "a", "vec", "fresh", F.coalesce("low", F.lit(-1.5)).alias("low"))
        new = met.groupBy("w").applyInArrow(local, EDGE).withColumn("fresh", F.lit(True))
        both = graph.withColumn("fresh", F.lit(False)).unionByName(new).groupBy("u", "v").agg(F.max("score").alias("score"), F.min("fresh").alias("fresh"))
        graph = cut_lineage(top_per_key(both, ["u"], order, width).select("u", "v", "score", "fresh"))
        if graph.filter("fresh").count() <= settled * n * width:
            break
        before, found = found, held(graph)
        if found is not None and found < recall and found - before < STALLED:
            break
    return graph.select("u", "v", "score"), compared, turn


def band_plan(n: int, threshold: float, miss: float = MISS) -> tuple[int, int]:
    """(bands, bits): as many signs as tell n unrelated vectors apart, as many bands as leave a pair at the threshold unseen with probability `miss`."""
    agree = 1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi
    bits = max(4, min(40, math.ceil(math.log2(max(2, n)))))
    return (1 if agree >= 1 else math.ceil(math.log(miss) / math.log1p(-agree ** bits))), bits


def _linked(pairs: DataFrame, vecs: DataFrame, threshold: float) -> DataFrame:
    """The pairs (u, v) at the threshold or above."""
    def run(batches):
        for b in batches:
            x, y = unit_matrix(b.column(2)), unit_matrix(b.column(3))
            ok = pa.array(np.round((x * y).sum(axis=1), 12) >= threshold) if b.num_rows else pa.array([], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(ok), b.column(1).filter(ok)], names=["u", "v"])

    two = pairs.join(vecs.select(F.col("nid").alias("u"), F.col("vec").alias("x")), "u").join(
        vecs.select(F.col("nid").alias("v"), F.col("vec").alias("y")), "v")
    return two.select("u", "v", "x", "y").mapInArrow(run, "u bigint, v bigint")


def near_dups_banded(vectors: DataFrame, model: str, threshold: float = 0.9, miss: float = MISS, block: int = BLOCK, seed: int = 29) -> DataFrame:
    """([store,] key_id, group) as `near_dups` gives it, for thresholds so high that few unrelated vectors share a band.

    A pair at the threshold is unseen with probability `miss` at most, one above it less often; no link is below it.
    """
    rows = _rows(vectors, model, _owner(vectors))
    base = cut_lineage(first_named(rows).withColumn("nid", F.monotonically_increasing_id()))
    owner, vecs = _owner(base), base.select("nid", "vec")
    bands, bits = band_plan(base.count(), threshold, miss)
    sets = [planes(bits, _dim(base), seed + i) for i in range(bands)]
    key = [*owner, "band", "bits"]
    keyed = _signs(base, sets, [*owner, "nid"])
    heads = keyed.groupBy(*key).agg(F.count("*").alias("n"), F.min(F.struct(F.xxhash64("nid").alias("h"), "nid"))["nid"].alias("head")).filter("n > 1")
    shared = cut_lineage(keyed.join(heads, key).withColumn("bucket", F.xxhash64(*key)).select("bucket", "nid", "head", "n"))
    stars = shared.filter("nid <> head").select(F.least("nid", "head").alias("u"), F.greatest("nid", "head").alias("v")).distinct()
    links = cut_lineage(_linked(stars, vecs, threshold))
    roots = cut_lineage(connected_components(links))
    rooted = shared.join(roots, F.col("nid") == F.col("node"), "left").select("bucket", "nid", "n", F.coalesce("root", "nid").alias("root"))
    parted = rooted.groupBy("bucket").agg(F.min("root").alias("a"), F.max("root").alias("b")).filter("a <> b").select("bucket")
    rest = cut_lineage(rooted.join(parted, "bucket"))
    # Small buckets name their pairs; of large ones blocks meet.
    few = rest.filter(F.col("n") <= FEW)
    named = few.join(few.select("bucket", F.col("nid").alias("other"), F.col("root").alias("other_root")), "bucket").filter(
        "nid < other and root <> other_root").select(F.col("nid").alias("u"), F.col("other").alias("v")).distinct()
    links = links.unionByName(_linked(named.join(stars, ["u", "v"], "left_anti"), vecs, threshold))
    many = rest.filter(F.col("n") > FEW).withColumn("parts", F.ceil(F.col("n") / block).cast("int")).withColumn(
        "mine", F.pmod(F.xxhash64(F.lit(5), "nid"), "parts").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    met = many.select("bucket", "nid", "root", "mine", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi")).join(vecs, "nid")

    def blocks(t: pa.Table) -> pa.Table:
        root, mine, ids = t["root"].to_numpy(), t["mine"].to_numpy(), t["nid"].to_numpy()
        lo, hi = t["lo"][0].as_py(), t["hi"][0].as_py()
        a, b = np.nonzero(mine == lo)[0], np.nonzero(mine == hi)[0]
        u = unit_matrix(t["vec"])
        x, y = np.nonzero((np.round(u[a] @ u[b].T, 12) >= threshold) & (root[a][:, None] != root[b][None, :]))
        r = local_roots(len(ids), a[x], b[y])
        leaf = np.nonzero(r != np.arange(len(r)))[0]
        return pa.table({"u": pa.array(ids[leaf]), "v": pa.array(ids[r[leaf]])})

    links = cut_lineage(links.unionByName(met.groupBy("bucket", "lo", "hi").applyInArrow(blocks, "u bigint, v bigint")))
    name = base.select("nid", "first")
    edges = links.join(name.select(F.col("nid").alias("u"), F.col("first").alias("a")), "u").join(
        name.select(F.col("nid").alias("v"), F.col("first").alias("b")), "v").select(F.col("a").alias("u"), F.col("b").alias("v"))
    return grouped(rows, base, edges)
