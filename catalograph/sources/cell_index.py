"""A vector index on disk: rows by store, model and cell, kept current cell by cell.

Centroids have two levels: about n^(1/4) top ones, trained on a bounded sample, and as many below each, trained on the top cell's part of it. A task
holds the top ones and the centroids of one top cell, never all. Every row is indexed. A version's cell table has, for each store and cell, the centroid,
the number of rows, the greatest distance of a row from it and the folder that holds it; an update rewrites the cells it touches and publishes the
next version, so readers of the last one are not disturbed and two writers cannot both win.

A search reads the cells nearest to the query until they hold enough rows; its k-th distance then bounds the search, and every cell that may hold a nearer
row is read: the answer is exact. A given `effort` stops after the first step.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from catalograph.functions.similarity import cosine_to
from catalograph.operators.neighbours import _assign, unit_matrix
from catalograph.operators.sizes import small
from catalograph.operators.vectors import add_judged, knn
from catalograph.session import cut_lineage
from catalograph.sources import versions as VS

FIT = 100_000  # rows the centroids are trained on at most, drawn by hash
LISTED = 512  # cells named in a filter; more are joined
PART = 20_000  # rows a task assigns to the centroids of one top cell
KEY = ["store", "model", "cell"]
NO_STORE = "-"  # of rows without one


def _kmeans(u: np.ndarray, k: int, seed: int, steps: int = 8) -> np.ndarray:
    """Unit centroids of unit rows."""
    rng = np.random.default_rng(seed)
    c = u[rng.choice(len(u), min(k, len(u)), replace=False)]
    for _ in range(steps):
        at = (u @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, at, u)
        n = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(n > 0, sums / np.maximum(n, 1e-12), c)
    return c


def _prepared(vectors: DataFrame, model: str) -> DataFrame:
    have = vectors.columns
    kept = [F.col(c) if c in have else F.lit(None).cast(t).alias(c) for c, t in (("seq", "bigint"), ("produced", "string"))]
    store = F.col("store") if "store" in have else F.lit(NO_STORE).alias("store")
    return vectors.filter(F.col("model") == model).select(store, "key_id", F.col("vec").cast("array<float>").alias("vec"), *kept)


@dataclass(frozen=True)
class StoredIndex:
    spark: SparkSession
    root: str
    model: str

    def _body(self, version: int | None = None) -> dict:
        version = version or VS.latest(self.spark, self.root)
        if version is None:
            raise FileNotFoundError(f"no index under {self.root}")
        return VS.read(self.spark, self.root, version) | {"version": version}

    def cells(self, version: int | None = None) -> DataFrame:
        """(store, model, cell, top, centroid, n, radius, at) of every cell that holds rows."""
        return self.spark.read.parquet(f"{self.root}/{self._body(version)['cells']}")

    def rows(self, cells: DataFrame | None = None, version: int | None = None) -> DataFrame:
        """(store, model, cell, key_id, vec, seq, produced) of all cells or those of `cells(store, model, cell, at)`. Up to LISTED cells are
        a filter on the partitions, more are joined and prune them at run time."""
        body = self._body(version)
        cells = self.cells(version) if cells is None else cells
        spans = cells.select(*KEY, "at").limit(LISTED + 1).collect()
        kind = T.StructType([T.StructField("store", T.StringType()), T.StructField("model", T.StringType()), T.StructField("cell", T.LongType()),
                             T.StructField("key_id", T._parse_datatype_string(body["key"])), T.StructField("vec", T.ArrayType(T.FloatType())),
                             T.StructField("seq", T.LongType()), T.StructField("produced", T.StringType())])
        folders = sorted({r["at"] for r in spans} if len(spans) <= LISTED else set(body["folders"]))
        parts = []
        for f in folders:
            read = self.spark.read.schema(kind).parquet(f"{self.root}/{f}")
            if len(spans) <= LISTED:
                mine = [r for r in spans if r["at"] == f]
                by_store: dict[str, list[int]] = {}
                for r in mine:
                    by_store.setdefault(r.store, []).append(r.cell)
                same = reduce(Column.__or__, [(F.col("store") == x) & F.col("cell").isin(*sorted(c)) for x, c in by_store.items()])
                same &= (F.col("model") == self.model) & F.col("cell").isin(*sorted({r.cell for r in mine}))
                parts.append(read.filter(same))
            else:
                parts.append(read.join(small(cells.filter(F.col("at") == f).select(*KEY), 100_000), KEY, "left_semi"))
        return reduce(DataFrame.unionByName, [p.select(*kind.names) for p in parts]) if parts else self.spark.createDataFrame([], kind)

    def search(self, query: list[float], k: int = 10, store: str = NO_STORE, effort: int | None = None, exclude=None, gate: DataFrame | None = None) -> DataFrame:
        """`(store, key_id, score)`: the k rows of a store most like the query. `gate(key_id)` admits rows. With `effort` the search is
        approximate: the nearest cells until they hold that many rows, then the best of them."""
        near = self.cells().filter((F.col("store") == store) & (F.col("cell") >= 0)).withColumn("cos", cosine_to(F.col("centroid"), query)).withColumn(
            "away", F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("cos")))).select(*KEY, "n", "radius", "at", "away")
        near = cut_lineage(near)

        def admitted(cells: DataFrame) -> DataFrame:
            rows = self.rows(cells)
            return rows if gate is None else rows.join(gate, "key_id", "left_semi")

        wanted, take = effort or max(4 * k, 256), 8
        while True:
            first = near.orderBy("away", "cell").limit(take).collect()
            if len(first) < take or sum(r.n for r in first) >= wanted:
                break
            take *= 4
        held, probe = 0, []
        for r in first:
            probe.append(r.cell)
            held += r.n
            if held >= wanted:
                break
        hits = cut_lineage(knn(admitted(near.filter(F.col("cell").isin(*probe) if probe else F.lit(False))), self.model, query, k, exclude))
        if effort is not None:
            return hits
        last = hits.agg(F.count("*").alias("n"), F.min("score").alias("s")).first()
        reach = float("inf") if last.n < k else math.sqrt(max(0.0, 2 - 2 * last.s)) + 1e-6
        return knn(admitted(near.filter(F.col("away") - F.col("radius") <= reach)), self.model, query, k, exclude)

    def update(self, add: DataFrame | None = None, remove: DataFrame | None = None) -> tuple[int, DataFrame | None]:
        """(version, report of the added rows). `add` is `vectors` with `seq`: rules as in `add_vectors`; `remove(key_id[, store])` takes keys out,
        of all stores where it names none. Only the cells that change are written."""
        body = self._body()
        cells, rows, report, placed = self.cells(body["version"]), self.rows(version=body["version"]), None, None
        if add is not None:
            new = _prepared(add, self.model).withColumn("model", F.lit(self.model))
            dims = self.spark.createDataFrame([(self.model, body["dim"])], "model string, dim int")
            taken, report = add_judged(rows.select("model", "store", "key_id"), dims, new, ["model", "store", "key_id"], ["seq", "produced"])
            report = cut_lineage(report)
            placed = cut_lineage(_placed(taken, self.centroids(), body["sides"]).withColumn("model", F.lit(self.model)))
        gone = None
        if remove is not None:
            key = [c for c in ("store", "key_id") if c in remove.columns]
            gone = cut_lineage(rows.join(remove.select(*key).distinct(), key, "left_semi").select(*KEY, "key_id"))
        touched = [d.select(*KEY) for d in (placed, gone) if d is not None]
        if not touched:
            return body["version"], report
        hot = cut_lineage(reduce(DataFrame.unionByName, touched).distinct())
        old = self.rows(cells.join(hot, KEY, "left_semi"), body["version"])
        if gone is not None:
            old = old.join(gone, [*KEY, "key_id"], "left_anti")
        if placed is not None:
            old = old.unionByName(placed.select(*old.columns))
        version = body["version"] + 1
        return self._write(old, cells.join(hot, KEY, "left_anti"), body, version), report

    def centroids(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{self._body()['centroids']}")

    def _write(self, rows: DataFrame, others: DataFrame | None, body: dict, version: int) -> int:
        """Write rows with their cells to a folder of their own, then the cell table, then the version."""
        name = VS.fresh_name(version)
        rows.select(*KEY, "key_id", "vec", "seq", "produced").hint("rebalance", *KEY).write.partitionBy(*KEY).parquet(f"{self.root}/{name}")
        mine = self.spark.read.schema(rows.select(*KEY, "key_id", "vec", "seq", "produced").schema).parquet(f"{self.root}/{name}")
        centroids = self.spark.read.parquet(f"{self.root}/{body['centroids']}")
        sized = _away(mine, centroids).groupBy(*KEY).agg(F.count("*").alias("n"), F.max("r").alias("radius"))
        table = sized.join(centroids.select("cell", "top", "centroid"), "cell", "left").select(*KEY, "top", "centroid", "n", "radius", F.lit(name).alias("at"))
        table = table if others is None else table.unionByName(others.select(*table.columns))
        table.write.parquet(f"{self.root}/{name}-cells")
        folders = sorted({*body.get("folders", []), name})
        return VS.publish(self.spark, self.root, version, {**{k: body[k] for k in ("centroids", "dim", "sides", "key")}, "cells": f"{name}-cells", "folders": folders})


def _away(rows: DataFrame, centroids: DataFrame) -> DataFrame:
    """Add `r`, the distance of each row from its cell's centroid; rows of norm zero (cell -1) have none."""
    two = rows.join(centroids.select("cell", "centroid"), "cell", "left")
    schema = T.StructType([*rows.select(*KEY).schema.fields, T.StructField("r", T.DoubleType())])

    def run(batches):
        for b in batches:
            there = b.column(4).is_valid().to_numpy(zero_copy_only=False)
            r = np.full(b.num_rows, np.nan)
            if there.any():
                at = pa.array(np.nonzero(there)[0])
                u, c = unit_matrix(b.column(3).take(at)), unit_matrix(b.column(4).take(at))
                r[there] = np.sqrt(np.maximum(0.0, 2 - 2 * (u * c).sum(axis=1)))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(r, mask=~there)], names=[*KEY, "r"])

    return two.select(*KEY, "vec", "centroid").mapInArrow(run, schema)


def _placed(rows: DataFrame, centroids: DataFrame, sides: list[list[float]]) -> DataFrame:
    """Add `cell`: the nearest centroid below the nearest of the top ones, `sides`; -1 for a vector of norm zero."""
    tops = np.array(sides)
    owned = _assign(rows, tops).withColumn("top", F.when(F.col("r").isNull() | F.isnan("r"), F.lit(-1)).otherwise(F.col("cell"))).drop("cell", "r")
    owned = cut_lineage(owned)
    sizes = owned.groupBy("top").agg(F.count("*").alias("n"))  # one row a top cell
    owned = owned.join(F.broadcast(sizes), "top").withColumn("part", F.pmod(F.xxhash64("store", "key_id"), F.ceil(F.col("n") / PART)).cast("int")).drop("n")
    below = centroids.join(F.broadcast(sizes), "top").withColumn("part", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / PART).cast("int") - 1))).drop("n")
    schema, names = T.StructType([*rows.schema.fields, T.StructField("cell", T.LongType())]), rows.columns

    def pick(r: pa.Table, c: pa.Table) -> pa.Table:
        if len(r) and len(c):
            near = (unit_matrix(r["vec"]) @ unit_matrix(c["centroid"]).T).argmax(axis=1)
            cell = c["cell"].to_numpy()[near]
        else:
            cell = np.full(len(r), -1, "i8")
        return r.select(names).append_column("cell", pa.array(cell, pa.int64()))

    return owned.select(*names, "top", "part").groupBy("top", "part").cogroup(below.select("top", "cell", "centroid", "part").groupBy("top", "part")).applyInArrow(pick, schema)


def write_index(vectors: DataFrame, model: str, root: str, fit: int = FIT, seed: int = 7) -> StoredIndex:
    """Train the centroids, index every row of `vectors([store,] model, key_id, vec[, seq, produced])` and publish version 1.

    Training draws `fit` rows at most, by hash; there are about sqrt(n) cells. All rows have one dimension.
    """
    spark = vectors.sparkSession
    rows = _prepared(vectors, model)
    n = rows.count()
    sample = rows.filter(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x) > 0).orderBy(F.xxhash64("vec", F.lit(seed)), "key_id").limit(fit).select("vec").toArrow()
    if not len(sample):
        raise ValueError("an index needs a vector that is not zero")
    u = unit_matrix(sample["vec"])
    side = max(1, round(max(1, n) ** 0.25))
    tops = _kmeans(u, side, seed)
    at = (u @ tops.T).argmax(axis=1)
    made = []
    for t in range(len(tops)):
        mine = u[at == t]
        for j, c in enumerate(_kmeans(mine, side, seed + t) if len(mine) else tops[t: t + 1]):
            made.append((t, t * side + j, [float(x) for x in c]))
    name = VS.fresh_name(1)
    spark.createDataFrame(made, "top int, cell long, centroid array<double>").write.parquet(f"{root}/{name}-centroids")  # about sqrt(n) rows, once
    body = {"centroids": f"{name}-centroids", "dim": u.shape[1], "sides": tops.tolist(), "key": rows.schema["key_id"].dataType.simpleString()}
    index = StoredIndex(spark, root, model)
    placed = _placed(rows, spark.read.parquet(f"{root}/{body['centroids']}"), body["sides"]).withColumn("model", F.lit(model))
    index._write(placed, None, body, 1)
    return index
