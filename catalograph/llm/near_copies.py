"""Near copies by exact Jaccard similarity of word shingles; candidates by SimHash balls and by MinHash bands.

A distinct text gives a SimHash of its shingles, `BANDS` bucket keys of `ROWS` MinHash values each, a sketch of one byte a value, whose agreement
estimates the similarity, and its shingles as sorted 32-bit hashes, which decide. First, texts within four bits by ball hashing are candidates, and each
row of a bucket meets the bucket's head, which is by one order of all ids, so that a crowd has about one head in all its buckets. A head's set is sent
once for every `STAR` of its members. Four bits alone find few pairs near 0.8; then, in buckets that still hold different components, blocks of rows
meet: pairs of different components go by falling estimate and each is checked exactly in the task, unless a link found before joins them already. So what
leaves a task is a spanning forest of links, and no bucket is held by one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from catalograph.llm import simhash
from catalograph.llm.simhash import _shingle_hashes
from catalograph.llm.tables import SMALL_BATCHES, least_rows, settings, steps, written
from catalograph.operators.neighbours import connected_components

SHINGLE = 5
SIMILAR = 0.8
BANDS, ROWS = 20, 5  # a pair at 0.8 shares no bucket with a probability of 0.0004
SLACK = 0.12  # three standard errors of the estimate at 0.8; pairs estimated lower are not checked
STAR = 1000  # members that meet a head in one task
BLOCK = 256  # rows of a bucket that meet as many
PASSES = ((0, 3), (3, BANDS))  # a few bands join most of a crowd, the others then have little left
_FACTORS = np.random.default_rng(11).integers(0, 1 << 63, BANDS * ROWS, "u8") * np.uint64(2) + np.uint64(1)
_SHIFTS = np.random.default_rng(12).integers(0, 1 << 63, BANDS * ROWS, "u8")
_CHUNK = 2048


@lru_cache(maxsize=64)
def shingles(text: str, k: int = SHINGLE) -> np.ndarray:
    """The distinct shingle hashes, sorted; words are cut as the SimHash operator cuts them."""
    return np.unique(np.array(_shingle_hashes(text, k), "u8"))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Texts without words are alike."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def signature(h: np.ndarray) -> tuple[np.ndarray, bytes]:
    """(bucket keys, sketch) of a shingle set."""
    low = np.full(len(_FACTORS), (1 << 64) - 1, "u8")
    for at in range(0, len(h), _CHUNK):
        low = np.minimum(low, (h[at: at + _CHUNK, None] * _FACTORS + _SHIFTS).min(axis=0))
    keys = [xxhash.xxh64_intdigest(low[i * ROWS: (i + 1) * ROWS].tobytes(), i) for i in range(BANDS)]
    return np.array(keys, "u8").view("i8"), low.astype("u1").tobytes()


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in steps(batches):
        keys, sketch, sets, codes = [], [], [], []
        for t in b.column(1).to_pylist():
            h = shingles(t)
            k, s = signature(h)
            keys.append(k)
            sketch.append(s)
            sets.append(np.unique(h.astype("u4")).tobytes())
            codes.append(simhash.majority(h))
        code = simhash._mix(np.array(codes, "u8")).view("i8")
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.list_(pa.int64())), pa.array(sketch, pa.binary()), pa.array(sets, pa.binary()), pa.array(code)],
                                         names=["id", "keys", "sketch", "own", "code"])


def _set(own: bytes) -> np.ndarray:
    return np.frombuffer(own, "u4")


def _pairs(u: list, v: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def _runs(batches: Iterator[pa.RecordBatch], key: int) -> Iterator[list[tuple]]:
    """Rows of sorted batches, a list for each value of the first `key` columns."""
    held: list[tuple] = []
    for b in steps(batches):
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if held and held[0][:key] != row[:key]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _verified(pairs: DataFrame, sets: DataFrame, similar: float) -> DataFrame:
    """The pairs (u, v) that reach `similar`; a row of `pairs` fetches the set of v, and u's comes once for up to STAR of its rows."""
    heavy = pairs.groupBy("u").agg(F.count("*").alias("n")).filter(F.col("n") > STAR)
    salted = written(pairs.join(heavy, "u", "left").select("u", "v", F.when(F.col("n").isNotNull(), F.pmod(F.xxhash64("v"), F.ceil(F.col("n") / STAR))).otherwise(0).alias("salt")), "stars")
    members = salted.join(sets.select(F.col("nid").alias("v"), "own"), "v").select("u", "salt", F.lit(1).alias("kind"), "v", "own")
    heads = salted.select("u", "salt").distinct().join(sets.select(F.col("nid").alias("u"), "own"), "u").select("u", "salt", F.lit(0).alias("kind"), F.col("u").alias("v"), "own")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, mine = None, np.zeros(0, "u4")
        for b in steps(batches):
            us, vs = [], []
            for u, _, kind, v, own in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if kind == 0:
                    head, mine = u, _set(own)
                elif u == head and jaccard(mine, _set(own)) >= similar:
                    us.append(u)
                    vs.append(v)
            yield _pairs(us, vs)

    both = members.unionByName(heads).repartition("u", "salt").sortWithinPartitions("u", "salt", "kind")
    return written(both.mapInArrow(run, "u bigint, v bigint"), "near_links")


def _blocks_meet(least: float, similar: float):
    """Rows (bucket, lo, hi, mine, root, sketch, own) sorted by the first three: links between the roots of the blocks lo and hi of a bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches, 3):
            _, lo, hi, mine, root, sketch, own = zip(*rows, strict=True)
            name, at = np.unique(np.array(root), return_inverse=True)
            if len(name) < 2:
                continue
            side, table = np.array(mine), np.frombuffer(b"".join(sketch), "u1").reshape(len(rows), -1)
            a, c = np.nonzero(side == lo[0])[0], np.nonzero(side == hi[0])[0]
            xs, ys, es = [], [], []
            for i in range(0, len(a), 32):
                part = a[i: i + 32]
                like = (table[part][:, None, :] == table[c][None, :, :]).mean(axis=2)
                x, y = np.nonzero((like >= least) & (at[part][:, None] != at[c][None, :]))
                xs.append(part[x])
                ys.append(c[y])
                es.append(like[x, y])
            x, y, e = np.concatenate(xs), np.concatenate(ys), np.concatenate(es)
            up = list(range(len(name)))

            def find(i: int) -> int:
                while up[i] != i:
                    up[i] = up[up[i]]
                    i = up[i]
                return i

            us, vs = [], []
            for i in np.argsort(-e, kind="stable").tolist():
                p, q = int(x[i]), int(y[i])
                r, s = find(int(at[p])), find(int(at[q]))
                if r != s and jaccard(_set(own[p]), _set(own[q])) >= similar:
                    up[r] = s
                    us.append(root[p])
                    vs.append(root[q])
            if us:
                yield _pairs(us, vs)

    return run


def _moved(roots: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root) after `links(node, root)` between roots; a node that has no row in `roots` is its own root."""
    to = links.select(F.col("node").alias("root"), F.col("root").alias("to"))
    return roots.join(to, "root", "left").select("node", F.coalesce("to", "root").alias("root")).unionByName(links.join(roots, "node", "left_anti"))


def components(rows: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """(node, root) of the ids of `rows(id, t)` that are linked, by chains too; an id stands for one text, `root` names the component."""
    with settings(rows.sparkSession, SMALL_BATCHES):
        return _linked(rows, similar)


def _linked(rows: DataFrame, similar: float) -> DataFrame:
    least = similar - SLACK
    signed = rows.mapInArrow(_signed, "id binary, keys array<bigint>, sketch binary, own binary, code bigint").dropDuplicates(["id"])
    signed = written(signed.withColumn("nid", F.monotonically_increasing_id()), "signatures")
    sets = signed.select("nid", "own")
    keyed = signed.select("nid", F.posexplode("keys").alias("band", "bucket"))
    order = lambda name: F.struct(F.xxhash64(F.lit(1), name).alias("h"), F.col(name).alias("nid"))
    heads = keyed.groupBy("bucket").agg(F.count("*").alias("n"), F.min(order("nid"))["nid"].alias("head")).filter("n > 1")
    shared = written(keyed.join(heads, "bucket").select("bucket", "band", "nid", "n", "head"), "shared_buckets")
    met = shared.filter("nid <> head").select(F.col("head").alias("u"), F.col("nid").alias("v"))
    first = signed.groupBy("code").agg(F.min(order("nid"))["nid"].alias("u"))
    alike = signed.select("code", F.col("nid").alias("v")).join(first, "code").filter("u <> v").select("u", "v")
    balls = simhash.links(first.select("code"))
    near = balls.join(first.select(F.col("code").alias("a"), F.col("u").alias("x")), F.col("u") == F.col("a")).select("x", "v").join(
        first.select(F.col("code").alias("a"), F.col("u").alias("y")), F.col("v") == F.col("a")).select(F.col("x").alias("u"), F.col("y").alias("v"))
    pairs = written(met.unionByName(alike).unionByName(near).distinct(), "near_pairs")
    roots = written(connected_components(_verified(pairs, sets, similar)), "near_roots")
    for lo, hi in PASSES:
        rooted = shared.filter((F.col("n") > 2) & F.col("band").between(lo, hi - 1)).join(roots, F.col("nid") == F.col("node"), "left").select(
            "bucket", "nid", "n", F.coalesce("root", "nid").alias("root"))
        parted = rooted.groupBy("bucket").agg(F.min("root").alias("a"), F.max("root").alias("b")).filter("a <> b").select("bucket")
        rest = rooted.join(parted, "bucket").withColumn("parts", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn(
            "mine", F.pmod(F.xxhash64(F.lit(5), "nid"), "parts").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        cut = written(rest.select("bucket", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "mine", "root", "nid"), "crowded")
        full = cut.join(signed.select("nid", "sketch", "own"), "nid").select("bucket", "lo", "hi", "mine", "root", "sketch", "own")
        found = full.repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi").mapInArrow(_blocks_meet(least, similar), "u bigint, v bigint")
        found = written(found, "near_links")
        if found.isEmpty():
            continue
        roots = written(_moved(roots, connected_components(found)), "near_roots")
    return signed.join(roots, F.col("nid") == F.col("node")).select(F.col("id").alias("node"), F.col("root"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", similar: float = SIMILAR) -> DataFrame:
    """One row of `docs` for each component: the least key, then the least text hash. Equal rows of that key and text are one.

    Null keys come last; a null text is an empty one, and texts without words are alike. Rows travel as one struct, so any column may have any name.
    """
    return least_rows(docs, lambda rows: components(rows, similar), key, text)
