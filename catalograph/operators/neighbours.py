"""Batch neighbours: exact k-nearest join, near-duplicate and identity groups, approximate search.

The exact join follows the pivot method (Lu et al., "Efficient Processing of k Nearest Neighbor Joins using
MapReduce", 2012): vectors go to the cell of their nearest pivot, a first pass inside the own cell bounds the
k-th distance, and a query then visits only the cells the triangle and hyperplane inequalities cannot rule out. Nothing
is cut: a cell is skipped only when it provably holds no nearer vector. On the unit sphere Euclidean distance
is sqrt(2 - 2 cosine), so all bounds hold for cosine.

Skew. Equal vectors are folded into one row with its k + 1 least ids (no other copy can enter a top k whose
ties go to the lesser id), so a group of copies costs one row. Neighbouring cells are laid together into parts of bounded size, a hot
cell is cut into several; a task gets one part of queries against one part of candidates. A query goes once to each part that holds a cell
it must visit, with a bit a cell, so what is shuffled is rows times parts, not rows times cells: up to SIDES full parts it grows with the
table. A task multiplies cell by cell and emits at most k hits a query in one row, or, for groups, a spanning forest; never its pairs.
"""

from __future__ import annotations

import json
import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from catalograph.functions.similarity import as_double, norm
from catalograph.operators.vectors import top_per_key
from catalograph.session import cut_lineage

BLOCK = 2048  # rows a side: a task's score matrix is 32 MB; larger blocks shuffle fewer copies
MAX_PIVOTS = 4096  # the pivots go to every task: 4096 vectors of 512 floats are 16 MB
SLICE = 1024  # rows scored against all pivots at a time
PART = 1 << 22  # numbers a side of a task: 65,536 vectors of 64, 32 MB
SIDES = 16  # parts of a table, as long as none is over PART
SLAB = (4096, 1024)  # rows and columns of a task that are multiplied at a time: 16 MB
PAIRS = 1 << 16  # pairs that are scored exactly at a time
EPS = 1e-9
EDGES = 100_000  # edges of a component round a task, about 10 MB
LEAST_PARTS = 8


def _owner(*tables: DataFrame) -> list[str]:
    """The store, where every table has it: a store's indexes are its own, so nothing of another store is a neighbour."""
    return ["store"] if all("store" in t.columns for t in tables) else []


def _gid(*of: Column) -> Column:
    """128 bits of a vector's content, and of its store."""
    return F.concat_ws("-", F.hex(F.xxhash64(*of)), F.hex(F.xxhash64(F.lit(7), *of)))


def _rows(vectors: DataFrame, model: str, owner: list[str]) -> DataFrame:
    v = vectors.filter(F.col("model") == model).select(*owner, "key_id", "vec").filter(norm(as_double(F.col("vec"))) > 0)
    return v.withColumn("gid", _gid(*owner, F.col("vec")))


def _folded(rows: DataFrame, ids: int) -> DataFrame:
    """One row per distinct vector of a store with its first `ids` keys."""
    owner = _owner(rows)
    return (top_per_key(rows, ["gid"], [F.col("key_id")], ids).groupBy(*owner, "gid")
            .agg(F.first("vec").alias("vec"), F.sort_array(F.collect_list("key_id")).alias("ids")))


def unit_matrix(col: pa.ChunkedArray | pa.Array) -> np.ndarray:
    m = np.asarray((col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col).flatten(), dtype="f8")
    m = m.reshape(len(col), -1) if len(col) else m.reshape(0, 0)
    return m / np.linalg.norm(m, axis=1, keepdims=True) if len(col) else m


def sliced(batches):
    """Arrow batches cut to SLICE rows, none empty."""
    for whole in batches:
        yield from (whole.slice(i, SLICE) for i in range(0, whole.num_rows, SLICE))


def _pivots(folded: DataFrame, n: int, block: int) -> np.ndarray:
    """Up to MAX_PIVOTS distinct vectors in hash order: a bounded top-k, not a scan to the driver. They come in an order that keeps near ones together."""
    count = max(1, min(MAX_PIVOTS, n // block))
    picked = folded.orderBy(F.xxhash64("gid"), "gid").limit(count).select("vec").toArrow()
    p = unit_matrix(picked["vec"])
    cos = p @ p[: math.isqrt(len(p))].T
    return p[np.lexsort((-cos.max(axis=1), cos.argmax(axis=1)))]


def _assign(folded: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Add the nearest pivot (`cell`) and the distance to it (`r`)."""
    schema = folded.select("*").schema.add("cell", T.IntegerType()).add("r", T.DoubleType())

    def run(batches):
        for b in sliced(batches):
            u = unit_matrix(b.column(b.schema.get_field_index("vec")))
            cos = u @ pivots.T
            cell = cos.argmax(axis=1).astype("i4")
            r = np.sqrt(np.maximum(0.0, 2 - 2 * cos[np.arange(len(u)), cell]))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell), pa.array(r)],
                                             names=[*b.schema.names, "cell", "r"])

    return folded.mapInArrow(run, schema)


def _cell_stats(assigned: DataFrame, cells: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, least r, greatest r) per cell: at most MAX_PIVOTS rows reach the driver."""
    n, lo, hi = np.zeros(cells, "i8"), np.full(cells, np.inf), np.full(cells, -np.inf)
    for row in assigned.groupBy("cell").agg(F.count("*").alias("n"), F.min("r").alias("lo"), F.max("r").alias("hi")).collect():
        n[row.cell], lo[row.cell], hi[row.cell] = row.n, row.lo, row.hi
    return n, lo, hi


def _at(values, cell: str, kind: str = "array<int>") -> Column:
    """The value of a row's cell, out of one literal array."""
    return F.get(F.from_json(F.lit(json.dumps(values)), kind), F.col(cell))


class _Layout:
    """Cells laid together, in their order, into parts of at most `most` rows of a store; a larger cell is cut by hash into parts of its own.

    A row of cell c is in one of the `count[c]` parts from `base[c]` on; `members[p]` are the cells of part p.
    """

    def __init__(self, celled: DataFrame, cells: int, dim: int, block: int):
        owner = _owner(celled)
        rows = np.zeros(cells, "i8")
        per = celled.groupBy(*owner, "cell").agg(F.count("*").alias("n")).groupBy("cell").agg(F.max("n").alias("n"))
        for r in per.collect():  # one row a cell
            rows[r.cell] = r.n
        most = max(block, min(-(-int(rows.sum()) // SIDES), PART // max(1, dim)))
        self.base, self.count, self.members, room = [0] * cells, [1] * cells, [], 0
        for c in np.nonzero(rows)[0].tolist():
            n = int(rows[c])
            if n > most:
                self.base[c], self.count[c], room = len(self.members), -(-n // most), 0
                self.members += [[c]] * self.count[c]
                continue
            if room < n:
                self.members.append([])
                room = most
            self.members[-1].append(c)
            self.base[c], room = len(self.members) - 1, room - n

    def part(self, cell: str = "cell") -> Column:
        return (_at(self.base, cell) + F.pmod(F.xxhash64(F.lit(3), F.col("gid")), _at(self.count, cell))).cast("int")


def _bounded_hits(pivots: np.ndarray, stats, own: bool, upward: bool = False):
    """For a batch with `vec`, `cell` and `bound`: which cells may hold a vector within the bound of which row. With `upward` a row
    visits only cells after its own, so a pair is met once."""
    n, lo, hi = stats
    at, full = np.arange(len(n)), n > 0

    def hits(b: pa.RecordBatch) -> np.ndarray:
        column = lambda c: b.column(b.schema.get_field_index(c))
        u, cell = unit_matrix(column("vec")), np.asarray(column("cell"))
        bound = np.asarray(column("bound"), dtype="f8")
        d = np.sqrt(np.maximum(0.0, 2 - 2 * (u @ pivots.T)))
        mine = d[np.arange(len(u)), cell]
        gap = np.sqrt(np.maximum(0.0, 2 - 2 * (pivots[cell] @ pivots.T)))
        with np.errstate(divide="ignore", invalid="ignore"):
            plane = (d * d - (mine * mine)[:, None]) / (2 * gap)
        low = np.maximum(np.maximum(d - hi, lo - d), np.where(gap > 0, plane, 0.0))
        hit = (low <= bound[:, None] + EPS) & full
        hit[at[None, :] == cell[:, None]] = own
        return hit & (at[None, :] >= cell[:, None]) if upward else hit

    return hits


def _own_hits(cells: int):
    """Every row visits its own cell."""
    return lambda b: np.arange(cells)[None, :] == np.asarray(b.column(b.schema.get_field_index("cell")))[:, None]


def _bits(hit: np.ndarray) -> pa.Array:
    """Each row's hits as packed bits."""
    packed = np.packbits(hit, axis=1)
    offsets = np.arange(len(hit) + 1, dtype="i4") * packed.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(hit), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(packed.tobytes())])


def _met_parts(queries: DataFrame, cands: DataFrame, hits, mine: _Layout, theirs: _Layout, keep: list[str], run, schema) -> DataFrame:
    """Cogroup parts of queries with the parts of candidates of the same store that hold a cell they visit. `queries` has `cell` and the columns
    that `hits` and `keep` need, `cands` has `cell`."""
    members = [np.array(m) for m in theirs.members]
    q = queries.withColumn("qp", mine.part())

    def pairs(batches):
        for b in sliced(batches):
            hit, qp = hits(b), np.asarray(b.column(b.schema.get_field_index("qp")))
            to = np.stack([hit[:, m].any(axis=1) for m in members], axis=1)
            seen = [(p, c) for p in np.unique(qp) for c in np.nonzero(to[qp == p].any(axis=0))[0]]
            yield pa.RecordBatch.from_arrays([pa.array([int(p) for p, _ in seen], pa.int32()), pa.array([int(c) for _, c in seen], pa.int32())], names=["qp", "cp"])

    asked = [[] for _ in members]
    for r in q.mapInArrow(pairs, "qp int, cp int").distinct().collect():  # at most one row a pair of parts
        asked[r.cp].append(r.qp)

    def send(batches):
        for b in sliced(batches):
            hit = hits(b)
            column = lambda c: b.column(b.schema.get_field_index(c))
            for p, m in enumerate(members):
                to = np.nonzero(hit[:, m].any(axis=1))[0]
                if len(to):
                    yield pa.RecordBatch.from_arrays([*[column(c).take(pa.array(to)) for c in (*keep, "qp")], pa.array(np.full(len(to), p, "i4")), _bits(hit[to][:, m])],
                                                     names=[*keep, "qp", "cp", "bits"])

    sent = q.mapInArrow(send, q.select(*keep, "qp").schema.add("cp", T.IntegerType()).add("bits", T.BinaryType()))
    c = cands.withColumn("cp", theirs.part()).withColumn("qp", F.explode(_at(asked, "cp", "array<array<int>>")))
    key = [*_owner(queries, cands), "qp", "cp"]
    return sent.groupBy(*key).cogroup(c.groupBy(*key)).applyInArrow(lambda qt, ct: run(qt, ct, members), schema)


def _slabs(qt: pa.Table, ct: pa.Table, members: list[np.ndarray]):
    """(rows, columns) to be compared: of each cell of the part its vectors and the queries that visit it, a slab at a time."""
    cells = members[qt["cp"][0].as_py()]
    bits = np.frombuffer(b"".join(qt["bits"].to_pylist()), "u1").reshape(len(qt), -1)
    hit, cell = np.unpackbits(bits, axis=1)[:, : len(cells)].astype(bool), ct["cell"].to_numpy()
    for j, c in enumerate(cells):
        row, col = np.nonzero(hit[:, j])[0], np.nonzero(cell == c)[0]
        for y in range(0, len(col), SLAB[1]):
            for x in range(0, len(row), SLAB[0]):
                yield row[x: x + SLAB[0]], col[y: y + SLAB[1]]


def _exact(u: np.ndarray, v: np.ndarray, row: np.ndarray, col: np.ndarray) -> np.ndarray:
    """Cosines of pairs of unit vectors to 12 places."""
    parts = [np.einsum("ij,ij->i", u[row[i: i + PAIRS]], v[col[i: i + PAIRS]]) for i in range(0, len(row), PAIRS)]
    return np.round(np.concatenate(parts), 12) if parts else np.zeros(0)


def _slack(u: np.ndarray) -> float:
    """What a product of unit vectors in single precision may be off by."""
    return 1e-6 + 2.4e-7 * u.shape[1]


def _ranked(k: int, id_type: str):
    """A task of queries `(gid, vec, low)` against candidates `(first, ids, vec)`: each query's k best of cosine `low` or more, one row a query."""
    schema = f"q string, near array<struct<neg: double, first: {id_type}, ids: array<{id_type}>>>"

    def run(qt: pa.Table, ct: pa.Table, members: list[np.ndarray]) -> pa.Table:
        name = ct.schema.field("first").type
        ids = pa.list_(pa.field("element", name))  # elements declared nullable
        item = pa.struct([("neg", pa.float64()), ("first", name), ("ids", ids)])
        if not len(qt) or not len(ct):
            return pa.table({"q": pa.array([], pa.string()), "near": pa.array([], pa.list_(pa.field("element", item)))})
        ct = ct.sort_by("first")  # ties fall to the lesser id
        u, v, low = unit_matrix(qt["vec"]), unit_matrix(ct["vec"]), qt["low"].to_numpy().copy()
        u4, v4, slack = u.astype("f4"), v.astype("f4"), _slack(u)
        held, size = [], 0

        def settle() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            row, col, score = (np.concatenate(x) for x in zip(*held, strict=True)) if held else (np.zeros(0, "i8"), np.zeros(0, "i8"), np.zeros(0))
            at = np.lexsort((col, -score, row))
            row, col, score = row[at], col[at], score[at]
            rank = np.arange(len(row)) - np.searchsorted(row, row)
            last = rank == k - 1
            low[row[last]] = score[last]
            return row[rank < k], col[rank < k], score[rank < k]

        for row, col in _slabs(qt, ct, members):
            s, least = u4[row] @ v4[col].T, low[row]
            if (least < -1.5).any() and len(col) > k:  # nothing known yet
                least = np.maximum(least, -np.partition(-s, k - 1, axis=1)[:, k - 1] - slack)
            x, y = np.nonzero(s >= (least - slack).astype("f4")[:, None])
            x, y = row[x], col[y]
            score = _exact(u, v, x, y)
            ok = score >= low[x]
            held.append((x[ok], y[ok], score[ok]))
            size += int(ok.sum())
            if size > 1_000_000 + 2 * k * len(qt):
                held = [settle()]
                size = len(held[0][0])
        row, col, score = settle()
        who, start = np.unique(row, return_index=True)
        near = pa.StructArray.from_arrays([pa.array(-score), _taken(ct["first"], col), _taken(ct["ids"], col).cast(ids)], fields=list(item))
        lists = pa.ListArray.from_arrays(pa.array(np.append(start, len(row)).astype("i4")), near)
        return pa.table({"q": qt["gid"].take(pa.array(who)), "near": lists.cast(pa.list_(pa.field("element", item)))})

    return run, schema


def _taken(column: pa.ChunkedArray, at: np.ndarray) -> pa.Array:
    got = column.take(pa.array(at))
    return got.combine_chunks() if isinstance(got, pa.ChunkedArray) else got


def _best(near: DataFrame, want: int) -> DataFrame:
    """(q, near): the `want` first of each query over its rows, of which it has one a part."""
    return near.groupBy("q").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, want).alias("near"))


def knn_join(left: DataFrame, right: DataFrame, model: str, k: int = 10, exclude_self: bool = True,
             block: int = BLOCK) -> DataFrame:
    """The k nearest rows of `right` for every row of `left`: `([store,] key_id, neighbour, score, rank)`, exact. Where both tables have a
    store, neighbours are of the same store.

    All-pairs work is quadratic where the bounds cannot prune (random high-dimensional data); there `knn_approx`
    is the tool. Vectors of norm zero have no cosine and take no part.
    """
    want = k + 1 if exclude_self else k
    id_type = right.schema["key_id"].dataType.simpleString()
    owner = _owner(left, right)
    cand_rows = _rows(right, model, owner)
    query_rows = cand_rows if left is right else _rows(left, model, owner)
    folded = cut_lineage(_folded(cand_rows, want).withColumn("first", F.element_at("ids", 1)))
    n = folded.count()
    if n == 0:
        return query_rows.limit(0).select(*owner, "key_id", F.col("key_id").cast(id_type).alias("neighbour"),
                                          F.lit(0.0).alias("score"), F.lit(0).alias("rank"))
    pivots = _pivots(folded, n, block)
    cands = cut_lineage(_assign(folded, pivots))
    stats = _cell_stats(cands, len(pivots))
    asked = cands.select(*owner, "gid", "vec", "cell") if left is right else cut_lineage(
        _assign(_folded(query_rows, 1).select(*owner, "gid", "vec"), pivots).select(*owner, "gid", "vec", "cell"))
    cands = cands.select(*owner, "gid", "first", "ids", "vec", "cell")
    theirs = _Layout(cands, *pivots.shape, block)
    mine = theirs if left is right else _Layout(asked, *pivots.shape, block)
    run, schema = _ranked(want, id_type)
    keep = [*owner, "gid", "vec", "low"]

    near = cut_lineage(_best(_met_parts(asked.withColumn("low", F.lit(-2.0)), cands, _own_hits(len(pivots)), mine, theirs, keep, run, schema), want))
    bounded = asked.join(near, asked.gid == near.q, "left").withColumn(
        "low", F.coalesce(F.when(F.size("near") >= want, -F.element_at("near", -1)["neg"]), F.lit(-2.0)))
    bounded = cut_lineage(bounded.select(*owner, "gid", "vec", "cell", "low", F.when(
        F.col("low") > -2, F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("low")))).otherwise(float("inf")).alias("bound")))
    far = _met_parts(bounded, cands, _bounded_hits(pivots, stats, own=False), mine, theirs, keep, run, schema)

    return _expand(near.unionByName(far), query_rows, want, k, exclude_self)


def _expand(near: DataFrame, query_rows: DataFrame, want: int, k: int, exclude_self: bool) -> DataFrame:
    """The k best of each query row, the copies of folded vectors spread out again. `near(q, near)` as tasks of `_ranked` emit it."""
    best = _best(near, want)
    pairs = F.flatten(F.transform("near", lambda x: F.transform(
        x["ids"], lambda i: F.struct(x["neg"].alias("neg"), i.alias("neighbour")))))
    mine = pairs if not exclude_self else F.filter(pairs, lambda x: x["neighbour"] != F.col("key_id"))
    top = F.slice(F.array_sort(mine), 1, k)
    owner = _owner(query_rows)
    out = query_rows.select(*owner, "key_id", "gid").join(best, F.col("gid") == F.col("q"))
    return out.select(*owner, "key_id", F.posexplode(top).alias("pos", "x")).select(
        *owner, "key_id", F.col("x.neighbour").alias("neighbour"), (-F.col("x.neg")).alias("score"), (F.col("pos") + 1).alias("rank"))


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least index of each node's component among n nodes."""
    lab = np.arange(n)
    while True:
        new = lab.copy()
        m = np.minimum(lab[a], lab[b])
        np.minimum.at(new, a, m)
        np.minimum.at(new, b, m)
        new = new[new]
        if (new == lab).all():
            return lab
        lab = new


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of each component of `edges(u, v)`.

    Alternating large-star and small-star steps (Kiveris et al., "Connected Components in MapReduce and Beyond",
    2014), each one aggregation and one join on the node; a hub's edges combine map-side in the aggregation and AQE
    splits its side of the join. Every round is written out; rounds grow with the logarithm of the chain length and end
    when all edges form stars. Shuffles and written rounds are sized by the counted edges, of which no round makes more,
    since a round of few edges would else cost its many shuffles in empty tasks.
    """
    spark = edges.sparkSession
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)

    def sized(n: int) -> int:
        parts = min(int(before), max(LEAST_PARTS, -(-n // EDGES)))
        spark.conf.set(name, parts)
        return parts

    try:
        return _star_rounds(edges, sized)
    finally:
        spark.conf.set(name, before)


def _star_rounds(edges: DataFrame, sized) -> DataFrame:
    ordered = lambda e: e.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).dropDuplicates()
    e = cut_lineage(ordered(edges))
    n, loose = _edges_and_loose(e)
    parts = sized(n)
    e = e.coalesce(parts)
    while loose:  # the steps are proven to settle
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = ordered(both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        star = large.join(low, "u")
        small_star = star.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        e = cut_lineage(ordered(small_star).coalesce(parts))
        n, loose = _edges_and_loose(e)
        parts = sized(n)
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return cut_lineage(roots.unionByName(roots.select(F.col("root").alias("node"), "root").dropDuplicates().coalesce(parts)))


def _edges_and_loose(e: DataFrame) -> tuple[int, int]:
    """Counts of the edges (u > v) and of the nodes that keep them from being stars round their least nodes: those with two lesser ends, or with ends on both sides."""
    ends = e.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        e.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    at = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    n, loose = at.agg(F.sum("up"), F.count_if((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0)))).first()
    return n or 0, loose


def near_dups(vectors: DataFrame, model: str, threshold: float, block: int = BLOCK) -> DataFrame:
    """([store,] key_id, group): vectors of a store linked by chains of pairs at cosine >= threshold share the group's least key.

    Exact: a vector meets every cell within the threshold's distance. Blocks emit spanning forests, whose union has
    the same components as all pairs.
    """
    rows = _rows(vectors, model, _owner(vectors))
    folded = cut_lineage(first_named(rows))
    n = folded.count()
    if n == 0:
        return rows.select(*_owner(rows), "key_id", F.col("key_id").alias("group"))
    name = folded.schema["first"].dataType
    pivots = _pivots(folded, n, block)
    cells = cut_lineage(_assign(folded, pivots))
    stats = _cell_stats(cells, len(pivots))
    reach = cells.withColumn("bound", F.lit(math.sqrt(max(0.0, 2 - 2 * threshold))))
    owner = _owner(folded)
    kept = [*_owner(folded), "gid", "first", "vec"]
    parts = _Layout(cells, *pivots.shape, block)
    edges = _met_parts(reach, cells.select(*kept, "cell"), _bounded_hits(pivots, stats, own=True, upward=True), parts, parts, kept,
                       lambda qt, ct, members: forest(qt, ct, members, threshold), T.StructType([T.StructField("u", name), T.StructField("v", name)]))
    return grouped(rows, folded, edges)


def first_named(rows: DataFrame) -> DataFrame:
    """One row a distinct vector, named by its store and least key in `first`, which orders groups by their least key."""
    owner = _owner(rows)
    return _folded(rows, 1).withColumn("first", F.struct(*owner, F.element_at("ids", 1).alias("key_id"))).drop("ids")


def forest(qt: pa.Table, ct: pa.Table, members: list[np.ndarray], threshold: float) -> pa.Table:
    """Spanning links (u, v) of the pairs between two parts at the threshold or above. What is linked already is not compared again: of a
    slab whose columns are one component only the rows outside it are."""
    if not len(qt) or not len(ct):
        return pa.table({"u": qt["first"].slice(0, 0), "v": qt["first"].slice(0, 0)})
    u, v, n = unit_matrix(qt["vec"]), unit_matrix(ct["vec"]), len(qt)
    u4, v4, slack = u.astype("f4"), v.astype("f4"), _slack(u)
    root = np.arange(n + len(ct))
    for row, col in _slabs(qt, ct, members):
        own = root[n + col]
        if (own == own[0]).all():
            row = row[root[row] != own[0]]
        if not len(row):
            continue
        x, y = np.nonzero(u4[row] @ v4[col].T >= np.float32(threshold - slack))
        x, y = row[x], col[y]
        new = root[x] != root[n + y]
        x, y = x[new], y[new]
        ok = _exact(u, v, x, y) >= threshold
        if ok.any():
            root = local_roots(len(root), root[x[ok]], root[n + y[ok]])[root]
    node = pa.chunked_array([*qt["first"].chunks, *ct["first"].chunks], type=qt["first"].type)
    at = np.nonzero(root != np.arange(len(root)))[0]
    return pa.table({"u": node.take(pa.array(at)), "v": node.take(pa.array(root[at]))})


def grouped(rows: DataFrame, folded: DataFrame, edges: DataFrame) -> DataFrame:
    """([store,] key_id, group) of all rows, from links between the `first` names of `folded`."""
    owner = _owner(rows)
    roots = connected_components(edges)
    groups = folded.select("gid", "first").join(roots, F.col("first") == F.col("node"), "left").select(
        "gid", F.coalesce("root", "first")["key_id"].alias("group"))
    return rows.select(*owner, "key_id", "gid").join(groups, "gid").select(*owner, "key_id", "group")


def group_faces(vectors: DataFrame, model: str, threshold: float = 0.4, block: int = BLOCK) -> DataFrame:
    """Faces of the same person: linked by chains of pairs at cosine >= 0.4."""
    return near_dups(vectors, model, threshold, block)


class CellIndex:
    """An inverted-file index for approximate search: `rows` carry the cell of their nearest centroid.

    `rows` is best stored partitioned by cell, so that a probe reads only its cells. `radii` are the greatest distances of a cell's rows from
    its centroid.
    """

    def __init__(self, rows: DataFrame, centroids: np.ndarray, sizes: np.ndarray, radii: np.ndarray):
        self.rows, self.centroids, self.sizes, self.radii = rows, centroids, sizes, radii


def build_cells(vectors: DataFrame, model: str, n_cells: int | None = None, seed: int = 7, fit_rows: int | None = None) -> CellIndex:
    """Train k-means and assign every row to a cell.

    `n_cells` defaults to the square root of the rows, so cells grow with them. `fit_rows` bounds the rows the quantiser is trained on (all
    by default); every row is indexed either way.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import Normalizer
    from pyspark.ml.functions import array_to_vector

    rows = vectors.filter(F.col("model") == model).select(*[c for c in ("store", "model", "key_id", "vec") if c in vectors.columns])
    n = rows.count()
    n_cells = n_cells or max(1, math.isqrt(n))
    sample = rows if fit_rows is None or n <= fit_rows else rows.sample(fit_rows / n, seed=seed)
    raw = sample.filter(norm(as_double(F.col("vec"))) > 0).select(array_to_vector(as_double(F.col("vec"))).alias("raw"))
    train = Normalizer(inputCol="raw", outputCol="features").transform(raw).select("features")
    fit = KMeans(k=n_cells, seed=seed, maxIter=6, initMode="random").fit(train)
    centroids = np.array(fit.clusterCenters())
    centroids /= np.maximum(np.linalg.norm(centroids, axis=1, keepdims=True), 1e-12)
    celled = cut_lineage(_assign(rows, centroids))
    placed = celled.withColumn("r", F.nanvl("r", F.lit(None)))  # a vector of norm zero is at no distance
    n, _, radii = _cell_stats(placed.withColumn("r", F.coalesce("r", F.lit(-1.0))), len(centroids))
    return CellIndex(celled.drop("r"), centroids, n, radii)


def _cell_counts(rows: DataFrame, cells: int) -> np.ndarray:
    """Rows of each cell: one row a cell reaches the driver."""
    n = np.zeros(cells, "i8")
    for r in rows.groupBy("cell").count().collect():
        n[r.cell] = r["count"]
    return n


def knn_approx(index: CellIndex, model: str, query: list[float], k: int = 10, gate: DataFrame | None = None,
               effort: int | None = None, engine: str = "arrow") -> DataFrame:
    """kNN over cells in the order of their centroids until they hold `effort` rows that the gate admits, then an exact rerank.

    `effort` is at least k and counts admitted rows, so a narrow gate widens the search, to all cells if need be: k rows come back
    wherever the gate admits k. A given effort makes the search approximate. By default the k-th score of that first probe bounds the
    search: every cell that may hold a nearer row is read, so nothing is missed. Vectors without clusters make that all cells.
    """
    from catalograph.names import SEARCH_EF
    from catalograph.operators.vectors import knn

    rows, sizes = index.rows, index.sizes
    if gate is not None:
        rows = rows.join(gate, [c for c in gate.columns if c in rows.columns], "left_semi")
        sizes = _cell_counts(rows, len(index.centroids))
    bounded, effort = effort is None, max(k + 1, effort or max(2 * k, SEARCH_EF[0]))
    near = np.argsort(-(index.centroids @ np.asarray(query, dtype="f8")), kind="stable")
    near = near[sizes[near] > 0]
    probes = near[: int(np.searchsorted(np.cumsum(sizes[near]), effort)) + 1]
    if bounded and len(probes) < len(near):
        first = knn(rows.filter(F.col("cell").isin(*[int(c) for c in probes])), model, query, k, engine=engine)
        found = first.agg(F.count("*").alias("n"), F.min("score").alias("s")).first()
        if found.n < k:
            probes = near
        else:
            q = np.asarray(query, dtype="f8")
            away = np.sqrt(np.maximum(0.0, 2 - 2 * (index.centroids[near] @ (q / np.linalg.norm(q)))))
            probes = near[away - index.radii[near] <= math.sqrt(max(0.0, 2 - 2 * found.s)) + 1e-6]
    if len(probes) < len(near):
        rows = rows.filter(F.col("cell").isin(*[int(c) for c in probes]))
    return knn(rows, model, query, k, engine=engine)


def knn_join_approx(index: CellIndex, queries: DataFrame, model: str, k: int = 10, probes: int = 16, exclude_self: bool = True,
                    block: int = BLOCK) -> DataFrame:
    """`(key_id, neighbour, score, rank)` for `queries(model, key_id, vec)`: each visits the `probes` nearest cells of the index.

    Work is queries times probed rows. Cells are cut into blocks, so a hot one is many tasks; equal vectors are folded first. Recall is
    measured by the caller against `knn_join`.
    """
    want = k + 1 if exclude_self else k
    id_type = index.rows.schema["key_id"].dataType.simpleString()
    owner = _owner(index.rows, queries)
    folded = _folded(_rows(index.rows, model, owner), want).withColumn("first", F.element_at("ids", 1))
    cands = cut_lineage(_assign(folded, index.centroids).select(*owner, "gid", "first", "ids", "vec", "cell"))
    asked = _rows(queries, model, owner)
    visits = cut_lineage(_assign(_folded(asked, 1).select(*owner, "gid", "vec"), index.centroids).drop("r").withColumn("low", F.lit(-2.0)))
    run, schema = _ranked(want, id_type)
    layout = lambda rows: _Layout(rows, *index.centroids.shape, block)
    near = _met_parts(visits, cands, _nearest(index.centroids, min(probes, len(index.centroids))), layout(visits), layout(cands), [*owner, "gid", "vec", "low"], run, schema)
    return _expand(near, asked, want, k, exclude_self)


def _nearest(centroids: np.ndarray, probes: int):
    """Every row visits its `probes` nearest cells."""
    def hits(b: pa.RecordBatch) -> np.ndarray:
        cos = unit_matrix(b.column(b.schema.get_field_index("vec"))) @ centroids.T
        hit = np.zeros(cos.shape, bool)
        np.put_along_axis(hit, np.argsort(-cos, axis=1, kind="stable")[:, :probes], True, axis=1)
        return hit

    return hits
