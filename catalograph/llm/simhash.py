"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints at distance 2r or less have a point within r of both. So every distinct fingerprint emits all points of its ball of
radius r, points are shuffled, and fingerprints that meet in a point are linked: they are within 2r of each other by the triangle
inequality, which the flipped bits of both sides confirm. All that meet in one point are mutually linked, so a point gives a star, not
its pairs, and a task reduces its stars to a spanning forest.

A ball of radius 2 over 64 bits has 2,081 points, so the points are handled in `ROUNDS` rounds and packed: fingerprints are first
mixed by a linear bijection (exclusive-or shifts), under which a point is the mixed fingerprint xor a mixed mask. The upper bits of the
mixed point are its round and bucket, the others and the mask's number fill one 64-bit record. Records of one task and bucket travel as one
binary row. The files of a round's shuffle go when the round is written.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from catalograph.llm.tables import SMALL_BATCHES, least_rows, settings, steps, text_or_empty, written
from catalograph.operators.neighbours import connected_components, local_roots

SHINGLE = 4
SEED = 42
DISTANCE = 4
ROUNDS = 8  # a power of two; peak shuffle is the points of one round
ROUND_RECORDS = 64_000_000  # points that one round may hold (512 MB) before there are more rounds, up to ROUNDS
FIRST = 8  # the first pass sees one in FIRST of a round's points
MASK_BITS = 12  # up to 4096 points a ball: radius 2 at most
TASK_RECORDS = 4_000_000  # records a task gathers: 32 MB
EMIT_RECORDS = 500_000  # records a task makes at a time, with some 100 bytes of scratch a record
FLUSH = 250_000  # edges a task holds before it reduces them to a forest


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that is linear under xor."""
    x = x.astype("u8", copy=True)
    for _ in range(4):
        x ^= x << np.uint64(13)
        x ^= x >> np.uint64(7)
        x ^= x << np.uint64(17)
    return x


def ball(radius: int) -> np.ndarray:
    """All masks of at most `radius` bits."""
    return np.array([sum(1 << b for b in c) for n in range(radius + 1) for c in combinations(range(64), n)], "u8")


def _shingle_hashes(text: str, k: int) -> list[int]:
    words = text.encode().lower().split()  # of bytes: only A-Z is lowered, and only the six ASCII spaces part words
    joined, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= k:
        return [h(joined, SEED)] if words else []
    end = np.cumsum([len(w) + 1 for w in words]) - 1
    start = np.concatenate([[0], end[:-1] + 1])
    return [h(joined[a:b], SEED) for a, b in zip(start[: len(words) - k + 1].tolist(), end[k - 1:].tolist(), strict=True)]


def _column_sums(bits: np.ndarray) -> np.ndarray:
    """Sums of an (n, 64) table of 0 and 1; eight columns add in one word as long as 255 rows do not overflow a byte."""
    m = len(bits) // 255 * 255
    lanes = bits[:m].view("u8").reshape(-1, 255, 8).sum(axis=1)
    return lanes.view("u1").reshape(-1, 64).sum(axis=0, dtype="i8") + bits[m:].sum(axis=0, dtype="i8")


def majority(h: np.ndarray) -> int:
    """The bits that more than half of the hashes have; 0 of none."""
    ones = np.zeros(64, "i8")
    for at in range(0, len(h), 32_768):
        ones += _column_sums(np.unpackbits(h[at: at + 32_768].astype("<u8").view("u1").reshape(-1, 8), axis=1, bitorder="little"))
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprint_of(texts: list[str], k: int = SHINGLE) -> np.ndarray:
    """64-bit SimHash of each text; 0 without words. A bit is set if more than half of the shingle hashes have it."""
    out = np.zeros(len(texts), "u8")
    for i, t in enumerate(texts):
        out[i] = majority(np.array(_shingle_hashes(t, k), "<u8"))
    return out


def fingerprints(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), k: int = SHINGLE) -> DataFrame:
    """(keep..., fp): `fp` is the fingerprint as a signed long. A null text has no words."""
    rows = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(keep)], text_or_empty(text).alias("_t"))
    kinds = ", ".join(f"c{i} {rows.schema[f'c{i}'].dataType.simpleString()}" for i in range(len(keep)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches):
            fp = fingerprint_of(b.column(len(keep)).to_pylist(), k).view("i8")
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(fp)], names=[*b.schema.names[: len(keep)], "fp"])

    return rows.mapInArrow(run, f"{kinds}, fp bigint").select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], "fp")


def _emit(masks: np.ndarray, bits: int, rounds: int, turn: int):
    """Batches of (code, root), mixed fingerprints, to (bucket, records, roots) of one round: at most two rows a task and bucket, one of codes that
    are their own root, which then need no `roots`, and one of the others."""
    top = np.uint64(64 - (rounds.bit_length() - 1)) if rounds > 1 else None
    part = lambda x: (x >> top).astype("i8") if top is not None else np.zeros(len(x), "i8")
    of = part(masks)
    own = [np.nonzero(of == s)[0] for s in range(rounds)]
    base = (turn << bits) // rounds

    def rows(x: np.ndarray, root: np.ndarray | None) -> pa.RecordBatch:
        mine, points, number, roots = part(x), [], [], []
        for s in np.unique(mine):
            at, m = np.nonzero(mine == s)[0], own[s ^ turn]
            if len(m):
                points.append((x[at][:, None] ^ masks[m][None, :]).ravel())
                number.append(np.broadcast_to(m.astype("u8"), (len(at), len(m))).ravel())
                if root is not None:
                    roots.append(np.broadcast_to(root[at][:, None], (len(at), len(m))).ravel())
        if not points:
            return pa.RecordBatch.from_pydict({"bucket": pa.array([], pa.int64()), "records": pa.array([], pa.binary()), "roots": pa.array([], pa.binary())})
        z, no = np.concatenate(points), np.concatenate(number)
        bucket = (z >> np.uint64(64 - bits)).astype("i8") - base
        order = np.argsort(bucket.astype("u2") if (1 << bits) // rounds <= 1 << 16 else bucket, kind="stable")
        rec, bucket = ((z << np.uint64(bits)) | no)[order], bucket[order]
        r = np.concatenate(roots)[order] if root is not None else None
        cuts = np.concatenate([[0], np.nonzero(np.diff(bucket))[0] + 1, [len(bucket)]])
        spans = list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
        return pa.RecordBatch.from_arrays([
            pa.array(bucket[cuts[:-1]] + base), pa.array([rec[i:j].tobytes() for i, j in spans], pa.binary()),
            pa.array([b"" if r is None else r[i:j].tobytes() for i, j in spans], pa.binary())], names=["bucket", "records", "roots"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = max(1, EMIT_RECORDS * rounds // len(masks))
        held, n = [], 0

        def out() -> Iterator[pa.RecordBatch]:
            x, root = (np.concatenate(c) for c in zip(*held, strict=True))
            led = root != x
            if (~led).any():
                yield rows(x[~led], None)
            if led.any():
                yield rows(x[led], root[led])

        for b in batches:
            for i in range(0, b.num_rows, group):
                held.append(tuple(c.slice(i, group).to_numpy(zero_copy_only=False).view("u8") for c in b.columns))
                n += len(held[-1][0])
                if n >= group:
                    yield from out()
                    held, n = [], 0
        if n:
            yield from out()

    return run


def _meet(masks: np.ndarray, raw: np.ndarray, bits: int, distance: int):
    """Sorted (bucket, records, roots) rows to links (u, v) between the roots of mixed fingerprints that met: a spanning forest of what met
    in the task. Codes with one root are linked already and say nothing."""

    def stars(bucket: int, blobs: list[tuple[bytes, bytes]]) -> tuple[np.ndarray, np.ndarray]:
        rec, roots = [], []
        for r, own in blobs:
            x = np.frombuffer(r, "u8")
            rec.append(x)
            no = (x & np.uint64((1 << MASK_BITS) - 1)).astype("i8")
            roots.append(np.frombuffer(own, "u8") if own else (x >> np.uint64(bits) | np.uint64(bucket) << np.uint64(64 - bits)) ^ masks[no])
        rec, root = np.concatenate(rec), np.concatenate(roots)
        order = np.argsort(rec, kind="stable")
        rec, root = rec[order], root[order]
        low = rec >> np.uint64(bits)
        first = np.concatenate([[True], low[1:] != low[:-1]])
        head = np.maximum.accumulate(np.where(first, np.arange(len(rec)), 0))
        other = np.nonzero(~first & (root != root[head]))[0]
        if not len(other):
            return rec[:0], rec[:0]
        no = (rec & np.uint64((1 << MASK_BITS) - 1)).astype("i8")
        a = head[other]
        ok = np.bitwise_count(raw[no[a]] ^ raw[no[other]]) <= distance
        return _unique(root[a][ok], root[other][ok])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blobs, us, vs, n = None, [], [], [], 0

        def forest() -> pa.RecordBatch:
            u, v = _unique(np.concatenate(us), np.concatenate(vs)) if us else (np.zeros(0, "u8"),) * 2
            nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
            roots = local_roots(len(nodes), at[: len(u)], at[len(u):])
            leaf = np.nonzero(roots != np.arange(len(roots)))[0]
            return pa.RecordBatch.from_arrays([pa.array(nodes[leaf].view("i8")), pa.array(nodes[roots[leaf]].view("i8"))], names=["u", "v"])

        for b in steps(batches):
            for bucket, *blob in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if now is not None and bucket != now:
                    u, v = stars(now, blobs)
                    us.append(u)
                    vs.append(v)
                    n, blobs = n + len(u), []
                    if n > FLUSH:
                        yield forest()
                        us, vs, n = [], [], 0
                now = bucket
                blobs.append(blob)
        if blobs:
            u, v = stars(now, blobs)
            us.append(u)
            vs.append(v)
        yield forest()

    return run


def _unique(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct unordered pairs of different ends."""
    lo, hi = np.minimum(u, v), np.maximum(u, v)
    lo, hi = lo[lo != hi], hi[lo != hi]
    if not len(lo):
        return lo, hi
    order = np.lexsort((hi, lo))
    lo, hi = lo[order], hi[order]
    new = np.concatenate([[True], (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])])
    return lo[new], hi[new]


def links(codes: DataFrame, distance: int = DISTANCE, rounds: int | None = None) -> DataFrame:
    """(u, v): spanning links between distinct mixed fingerprints `code` that are within `distance` bits of each other, chains included.

    A first pass over a small part of the points links most of a crowd; its components are written and each code's root goes along
    in the rounds over all points, where only links between different roots come out. So a crowd of n costs some n links, not n a task and round.
    """
    if distance % 2 or not 0 <= distance <= 4:
        raise ValueError("the distance must be 0, 2 or 4: twice the radius of a ball")
    spark = codes.sparkSession
    raw = ball(distance // 2)
    masks = _mix(raw)
    n = codes.count()
    records = n * len(masks)
    rounds = rounds or min(ROUNDS, 1 << (records // ROUND_RECORDS).bit_length())
    # A bucket is a few hundred thousand records; its number takes the room of the mask's number in a record, at least.
    bits = max(MASK_BITS, (records // 250_000).bit_length())
    tasks = max(1, -(-n * len(masks) // (rounds * TASK_RECORDS)), min(n // 2000, spark.sparkContext.defaultParallelism * 2))
    spread = written(codes.select("code", F.col("code").alias("root")).repartition(int(tasks), "code"), "codes")
    parts = int(max(1, min((1 << bits) // rounds, tasks)))
    clean = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}  # a round's shuffle files go with the round

    def meet(of: DataFrame, turn: int, turns: int, tasks: int) -> DataFrame:
        rows = of.mapInArrow(_emit(masks, bits, turns, turn), "bucket bigint, records binary, roots binary")
        met = rows.repartition(tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(
            _meet(masks, raw, bits, distance), "u bigint, v bigint")
        return written(met, "links")

    found = []
    with settings(spark, clean | SMALL_BATCHES):
        first = rounds * FIRST
        found.append(meet(spread, 0, first, max(1, parts // FIRST)))
        roots = connected_components(found[0])
        rooted = spread.drop("root").join(roots, F.col("code") == F.col("node"), "left").select("code", F.coalesce("root", "code").alias("root"))
        spread = written(rooted.repartition(int(tasks), "code"), "rooted")
        found += [meet(spread, turn, rounds, parts) for turn in range(rounds)]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.dropDuplicates()


def components(prints: DataFrame, key: str = "doc_id", distance: int = DISTANCE, rounds: int | None = None) -> DataFrame:
    """(fp, root, component_id): `component_id` is the least key among all rows whose fingerprints are linked, by chains too, and null only
    if none has a key; `root` names the component itself."""
    folded = prints.groupBy("fp").agg(F.min(key).alias("first"))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(_mix(fp.view("u8")).view("i8"))], names=["fp", "first", "code"])

    kind = prints.schema[key].dataType.simpleString()
    codes = written(folded.mapInArrow(code, f"fp bigint, first {kind}, code bigint"), "fingerprints")
    roots = written(connected_components(links(codes, distance, rounds)), "roots")
    rooted = codes.join(roots, codes.code == roots.node, "left").withColumn("root", F.coalesce("root", "code"))
    least = written(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "least")  # a table: a large component's join may be split
    return written(rooted.join(least, "root").select("fp", "root", "component_id"), "components")


def report(docs: DataFrame, key: str = "doc_id", text: str = "text", distance: int = DISTANCE, k: int = SHINGLE) -> DataFrame:
    """(key, fingerprint, component_id) for every row."""
    prints = written(fingerprints(docs, text, (key,), k), "prints")
    return prints.join(components(prints, key, distance), "fp").select(key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", distance: int = DISTANCE, k: int = SHINGLE) -> DataFrame:
    """One row of `docs` for each component: the least key, then the least text hash. Equal rows of that key and text are one."""
    def linked(rows: DataFrame) -> DataFrame:
        prints = written(fingerprints(rows.dropDuplicates(["id"]), "t", ("id",), k), "prints")
        return prints.join(components(prints, "id", distance), "fp").select(F.col("id").alias("node"), "root")

    return least_rows(docs, linked, key, text)
