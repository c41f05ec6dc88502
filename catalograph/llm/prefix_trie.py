"""A prefix trie of conversations with sums over subtrees.

A node is a distinct sequence of first turns, named by 128 bits: the sum over its turns of a hash of place, role and text, a running sum, so a
conversation of any length is hashed by many tasks. One grouping gives each node its members, their least id, and its weight, the number of its
subtree's (member, turn) pairs, which needs no walk.

Sums over subtrees go by centroid decomposition of the parent-edge forest. In a component with the total weight W the nodes of weight over W / 2
form a path down from the top, whose lowest node is the centroid. The centroid's total is added to every node of that path and the centroid leaves: its
children's subtrees become components, the rest stays one, and no part keeps more than half the weight. So rounds grow with the logarithm of the
turns, for a chain as for a star. Components of more than `local` nodes are split by joins, all at once; smaller ones are grouped and a task splits them
to the end by the same steps.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from catalograph.llm.running import around, running
from catalograph.llm.tables import written
from catalograph.operators.sizes import small

LOCAL = 20_000  # nodes of a component that a task splits by itself
COPIES = 10_000  # repeated rows made in one step
BLOCK = 4096  # ids of a node's list that travel as one row


def ordered(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, i, role, text): the turns of each conversation numbered from 0 by turn, nulls first, then role and text.

    A null role or text is empty. Repeated rows are turns of their own. Rows without a conversation id belong to none and are left out. Other
    columns are not read.
    """
    rows = conversations.select(F.col(conv).cast("bigint").alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"),
                                F.coalesce(F.col(text), F.lit("")).alias("text")).filter("conv_id is not null")
    folded = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("n"))
    placed = running(folded, ["conv_id"], ["turn", "role", "text"], {"i": F.col("n")}).select("conv_id", "i", "role", "text", "n")
    few = placed.filter(F.col("n") <= COPIES)
    many = placed.filter(F.col("n") > COPIES).withColumn("block", F.explode(F.sequence(F.lit(0), F.expr(f"(n - 1) div {COPIES}")))).withColumns(
        {"i": F.col("i") + F.col("block") * COPIES, "n": F.least(F.lit(COPIES), F.col("n") - F.col("block") * COPIES)}).drop("block").repartition("conv_id", "i")
    return few.unionByName(many).withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).select(
        "conv_id", (F.col("i") + F.col("copy")).alias("i"), "role", "text")


def marked(turns: DataFrame) -> DataFrame:
    """`turns` with the 128-bit name of what each says and the bytes of its text instead of the texts."""
    return turns.select("conv_id", "i", F.xxhash64("role", "text").alias("d1"), F.xxhash64(F.lit(7), F.col("text"), F.col("role")).alias("d2"),
                        F.octet_length("text").cast("bigint").alias("bytes"))


def branched(turns: DataFrame, family: int = 5, most: int = 8) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations) rebuilt: conversation c begins with the first h turns of c - c % family and goes on with its own after its first h;
    h is the checksum of c's decimal modulo most + 1. Returns (conv_id, i, len, d1, d2, bytes) and (conv_id, len)."""
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("own"))
    heads = turns.filter(F.col("i") < most).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("i", "d1", "d2", "bytes"))).alias("head"))  # at most `most`
    h = F.crc32(F.encode(F.col("conv_id").cast("string"), "UTF-8")) % (most + 1)
    asked = sizes.select("conv_id", "own", (F.col("conv_id") - F.col("conv_id") % family).alias("of"), h.alias("h"))
    taken = F.least(F.col("h").cast("int"), F.coalesce(F.size("head"), F.lit(0)))
    plan = asked.join(heads.select(F.col("conv_id").alias("of"), "head"), "of", "left").select(
        "conv_id", "h", taken.alias("taken"), F.slice(F.coalesce("head", F.array().cast("array<struct<i:bigint,d1:bigint,d2:bigint,bytes:bigint>>")), F.lit(1), taken).alias("head"),
        (taken + F.greatest(F.lit(0), F.col("own") - F.col("h"))).cast("bigint").alias("len"))
    plan = written(plan, "plan")
    begun = plan.select("conv_id", "len", F.explode("head").alias("t")).select("conv_id", "t.i", "len", "t.d1", "t.d2", "t.bytes")
    rest = turns.join(plan.select("conv_id", "h", "taken", "len"), "conv_id").filter("i >= h").select(
        "conv_id", (F.col("i") - F.col("h") + F.col("taken")).alias("i"), "len", "d1", "d2", "bytes")
    return begun.unionByName(rest), plan.select("conv_id", "len")


class Trie:
    """`paths`: (conv_id, depth, len, k1, k2, p1, p2, bytes), a row a turn: the node it leads to and that node's parent. `nodes`: (k1, k2, p1, p2, depth,
    conv_id, n_convs, bytes, weight), the root among them if there is a conversation."""

    def __init__(self, turns: DataFrame, conversations: DataFrame):
        lane = lambda *seed: F.xxhash64(*seed, F.col("d1"), F.col("d2"), F.col("i"))
        hashed = turns.withColumns({"x1": lane(), "x2": lane(F.lit(3))})
        sums = running(hashed, ["conv_id"], ["i"], {"p1": F.col("x1"), "p2": F.col("x2")})
        self.paths = written(sums.select("conv_id", (F.col("i") + 1).alias("depth"), "len", around(F.col("p1"), F.col("x1")).alias("k1"),
                                         around(F.col("p2"), F.col("x2")).alias("k2"), "p1", "p2", "bytes"), "paths")
        inner = self.paths.groupBy("k1", "k2").agg(
            F.first("p1").alias("p1"), F.first("p2").alias("p2"), F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"),
            F.count("*").alias("n_convs"), F.first("bytes").alias("bytes"), F.sum(F.col("len") - F.col("depth") + 1).alias("weight"))
        none = F.lit(None).cast("bigint")
        root = conversations.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.sum(F.col("len") + 1).alias("weight")).filter(
            "n_convs > 0").select(F.lit(0).cast("bigint").alias("k1"), F.lit(0).cast("bigint").alias("k2"), none.alias("p1"), none.alias("p2"),
                                  F.lit(0).cast("bigint").alias("depth"), "conv_id", "n_convs", F.lit(0).cast("bigint").alias("bytes"), "weight")
        self.nodes = written(inner.unionByName(root), "nodes")
        self.conversations = conversations

    def ends(self) -> DataFrame:
        """(k1, k2, conv_id): where each conversation ends; at the root if it has no turns."""
        zero = F.lit(0).cast("bigint")
        return self.paths.filter("depth = len").select("k1", "k2", "conv_id").unionByName(
            self.conversations.filter("len = 0").select(zero.alias("k1"), zero.alias("k2"), "conv_id"))


def _split(kids: list[list[int]], weight: list[int], values: list[list[int]], tops: list[int]) -> list[list[int]]:
    """Subtree sums of the components below `tops`."""
    sums, gone, stack = [[0] * len(weight) for _ in values], bytearray(len(weight)), list(tops)
    while stack:
        top = stack.pop()
        whole, path = weight[top], [top]
        heavy = top
        while heavy >= 0:
            heavy = next((u for u in kids[path[-1]] if not gone[u] and 2 * weight[u] > whole), -1)
            if heavy >= 0:
                path.append(heavy)
        centre, below, todo = path[-1], [], [path[-1]]
        while todo:
            v = todo.pop()
            below.append(v)
            todo += [u for u in kids[v] if not gone[u]]
        for own, out in zip(values, sums, strict=True):
            total = sum(own[v] for v in below)
            for v in path:
                out[v] += total
        for v in path[:-1]:
            weight[v] -= weight[centre]
        gone[centre] = 1
        stack += [u for u in kids[centre] if not gone[u]]
        if centre != top:
            stack.append(top)
    return sums


def _finish(names: list[str], chunk: int):
    """Whole components, sorted by component, to (k1, k2, sums)."""
    def solve(t: pa.Table) -> pa.RecordBatch:
        col = {c: t[c].to_pylist() for c in t.column_names}
        key = list(zip(col["k1"], col["k2"], strict=True))
        at, kids, tops = {k: i for i, k in enumerate(key)}, [[] for _ in key], []
        for i, (k, c, p) in enumerate(zip(key, zip(col["c1"], col["c2"], strict=True), zip(col["p1"], col["p2"], strict=True), strict=True)):
            if k == c:
                tops.append(i)
            else:
                kids[at[p]].append(i)
        sums = _split(kids, col["weight"], [col[x] for x in names], tops)
        done = [[a + b for a, b in zip(s, col[f"sum_{x}"], strict=True)] for x, s in zip(names, sums, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(col["k1"], pa.int64()), pa.array(col["k2"], pa.int64()), *[pa.array(d, pa.int64()) for d in done]],
                                          names=["k1", "k2", *[f"sum_{x}" for x in names]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for b in batches:
            t = pa.Table.from_batches([b])
            held = t if held is None else pa.concat_tables([held, t])
            if len(held) > chunk:
                c1, c2 = held["c1"].to_numpy(), held["c2"].to_numpy()
                new = np.nonzero((c1[1:] != c1[:-1]) | (c2[1:] != c2[:-1]))[0]
                if len(new):  # all but the last component, which may go on
                    yield solve(held.slice(0, int(new[-1]) + 1))
                    held = held.slice(int(new[-1]) + 1)
        if held is not None and len(held):
            yield solve(held)

    return run


def rollup(nodes: DataFrame, paths: DataFrame, values: list[str], local: int = LOCAL) -> DataFrame:
    """(k1, k2, sum_<value>...): each value of `nodes` summed over the subtree of every node. `nodes` and `paths` are those of a `Trie`."""
    sums = [f"sum_{v}" for v in values]
    zero = F.lit(0).cast("bigint")
    state = nodes.select("k1", "k2", "p1", "p2", "depth", "conv_id", "weight", *values, *[zero.alias(s) for s in sums], zero.alias("c1"), zero.alias("c2"))
    done, rest = [], []
    comp = ["c1", "c2"]
    while True:
        sizes = written(state.groupBy(*comp).agg(F.max("weight").alias("whole"), F.count("*").alias("n")).filter(F.col("n") > local), "components")
        if sizes.isEmpty():
            rest.append(state)
            break
        large = small(sizes.drop("n"))  # at most one row for `local` nodes
        rest.append(state.join(large, comp, "left_anti"))
        some = written(state.join(large, comp), "large")
        centres = some.filter(2 * F.col("weight") > F.col("whole")).groupBy(*comp).agg(F.min_by(F.struct(
            F.col("k1").alias("m1"), F.col("k2").alias("m2"), F.col("depth").alias("level"), F.col("weight").alias("cut")), "weight").alias("x")).select(*comp, "x.*")
        seen = some.join(small(written(centres, "centres")), comp)
        step = paths.select(F.col("conv_id"), F.col("depth").alias("next"), F.col("k1").alias("t1"), F.col("k2").alias("t2"), F.col("p1").alias("u1"), F.col("p2").alias("u2"))
        deep = seen.filter("depth > level").withColumn("next", F.col("level") + 1).join(step, ["conv_id", "next"])  # the ancestor just below the centroid's level
        under = F.expr("u1 = m1 and u2 = m2")
        deep = deep.withColumns({"under": under, "c1n": F.when(under, F.col("t1")).otherwise(F.col("c1")), "c2n": F.when(under, F.col("t2")).otherwise(F.col("c2"))})
        top = seen.filter("depth <= level").withColumns({"under": F.lit(False), "c1n": F.col("c1"), "c2n": F.col("c2")})
        parted = written(deep.select(*[c for c in top.columns]).unionByName(top).withColumn("centre", F.expr("k1 = m1 and k2 = m2")), "parted")
        totals = parted.filter("under or centre").groupBy(*comp).agg(*[F.sum(v).alias(f"all_{v}") for v in values])
        path = 2 * F.col("weight") > F.col("whole")
        added = parted.join(small(written(totals, "totals")), comp).withColumns(
            {**{s: F.col(s) + F.when(path, F.col(f"all_{v}")).otherwise(0) for s, v in zip(sums, values, strict=True)},
             "weight": F.col("weight") - F.when(path & ~F.col("centre"), F.col("cut")).otherwise(0)})
        added = written(added.drop(*comp).withColumnsRenamed({"c1n": "c1", "c2n": "c2"}).select(*state.columns, "centre"), "added")
        done.append(added.filter("centre").select("k1", "k2", *sums))
        state = added.filter("not centre").drop("centre")
    left = reduce(DataFrame.unionByName, rest)
    schema = "k1 bigint, k2 bigint, " + ", ".join(f"{s} bigint" for s in sums)
    finished = left.repartition(*comp).sortWithinPartitions(*comp).mapInArrow(_finish(values, local), schema)
    return written(reduce(DataFrame.unionByName, [finished, *done]), "rollup")


def id_lists(rows: DataFrame, group: list[str], ids: str) -> DataFrame:
    """(group..., sha256) of each group's distinct ids as ascending decimals, joined by commas. A digest is made in order, so a group's text goes
    through one task, in blocks; it is never held whole."""
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(i, BLOCK) for i in range(0, whole.num_rows, BLOCK)):
                keys = np.stack([b.column(i).to_numpy() for i in range(len(group))])
                cuts = [0, *(np.nonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0))[0] + 1).tolist(), b.num_rows]
                n = b.column(len(group)).to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [*[pa.array(k[cuts[:-1]]) for k in keys], pa.array([n[a] for a in cuts[:-1]], pa.int64()),
                     pa.array([",".join(map(str, n[a:z])) for a, z in zip(cuts, cuts[1:], strict=False)])], names=[*group, "least", "part"])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, hashlib.sha256()
        out = lambda k, h: pa.RecordBatch.from_pydict({**{g: [x] for g, x in zip(group, k, strict=True)}, "sha256": [h]})
        for b in batches:
            for *key, _, part in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if key != now:
                    if now is not None:
                        yield out(now, state.hexdigest())
                    now, state = key, hashlib.sha256(part.encode())
                else:
                    state.update(b"," + part.encode())
        if now is not None:
            yield out(now, state.hexdigest())

    names = ", ".join(f"{g} bigint" for g in group)
    cut = rows.select(*group, ids).repartitionByRange(*group, ids).sortWithinPartitions(*group, ids).mapInArrow(blocks, f"{names}, least bigint, part string")
    return cut.repartition(*group).sortWithinPartitions(*group, "least").mapInArrow(digests, f"{names}, sha256 string")


def report(trie: Trie, local: int = LOCAL) -> DataFrame:
    """One row a node: (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256). No conversations: no nodes."""
    children = trie.nodes.filter("depth > 0").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("n_children"))
    valued = written(trie.nodes.join(children, ["k1", "k2"], "left").withColumns(
        {"n_children": F.coalesce("n_children", F.lit(0).cast("bigint")), "leaf": F.col("n_children").isNull().cast("bigint"),
         "saved": (F.col("n_convs") - 1) * F.col("bytes")}), "valued")
    sums = rollup(valued, trie.paths, ["leaf", "saved"], local)
    parents = trie.nodes.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    ends = id_lists(trie.ends(), ["k1", "k2"], "conv_id")
    out = valued.join(sums, ["k1", "k2"]).join(ends, ["k1", "k2"], "left").join(parents, ["p1", "p2"], "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("sum_leaf").alias("n_leaves"), F.col("sum_saved").alias("saved_tokens"),
                      F.coalesce("sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))


#: Nodes by their conversations, prefixes compared as whole lists; the checksum as a table made by its rule.
ORACLE = r"""
WITH RECURSIVE bits AS (SELECT i, i AS v, 0 AS k FROM range(256) r(i)
  UNION ALL SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT i, v FROM bits WHERE k = 8),
t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS i,
  coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT DISTINCT conv_id FROM t),
sums AS (SELECT conv_id, conv_id::VARCHAR AS s, 4294967295 AS c, 1 AS j FROM ids
  UNION ALL SELECT conv_id, s, xor(c >> 8, crc.v), j + 1 FROM sums JOIN crc ON crc.i = (xor(c, ascii(s[j])) & 255) WHERE j <= length(s)),
h AS (SELECT conv_id, xor(c, 4294967295) % 9 AS h FROM sums WHERE j = length(s) + 1),
lists AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY i) AS turns FROM t GROUP BY 1),
rebuilt AS (SELECT a.conv_id, list_concat(coalesce(b.turns, [])[1:h.h], a.turns[h.h + 1:]) AS turns
  FROM lists a JOIN h USING (conv_id) LEFT JOIN lists b ON b.conv_id = a.conv_id - a.conv_id % 5),
steps AS (SELECT conv_id, len(turns) AS n, unnest(range(len(turns) + 1)) AS depth, turns FROM rebuilt),
pre AS (SELECT conv_id, n, depth, turns[1:depth] AS prefix FROM steps),
nodes AS (SELECT min(conv_id) AS conv_id, depth, prefix, count(*) AS n_convs,
  string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = depth) AS ends FROM pre GROUP BY depth, prefix),
own AS (SELECT p.conv_id AS member, p.depth, n.conv_id FROM pre p JOIN nodes n ON n.depth = p.depth AND n.prefix = p.prefix),
up AS (SELECT c.conv_id, c.depth, c.n_convs, c.prefix, c.ends, o.conv_id AS top, o.depth AS top_depth
  FROM nodes c JOIN own o ON o.member = c.conv_id AND o.depth <= c.depth),
kids AS (SELECT top AS conv_id, top_depth AS depth, count(*) AS n_children FROM up WHERE depth = top_depth + 1 GROUP BY 1, 2),
sub AS (SELECT top AS conv_id, top_depth AS depth, count(*) FILTER (k.n_children IS NULL) AS n_leaves,
  sum(CASE WHEN u.depth = 0 THEN 0 ELSE (u.n_convs - 1) * strlen(u.prefix[u.depth].text) END) AS saved_tokens
  FROM up u LEFT JOIN kids k ON k.conv_id = u.conv_id AND k.depth = u.depth GROUP BY 1, 2)
SELECT u.conv_id, u.depth::BIGINT AS depth, (SELECT a.conv_id FROM own a WHERE a.member = u.conv_id AND a.depth = u.depth - 1) AS parent_conv_id,
  u.n_convs, coalesce(k.n_children, 0)::BIGINT AS n_children, s.n_leaves, s.saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(u.ends, '')) AS ends_sha256
FROM nodes u JOIN sub s USING (conv_id, depth) LEFT JOIN kids k USING (conv_id, depth)
"""
