"""Shards by a hierarchical weighted hash tree.

A key descends region, rack and shard. At each node every child draws -ln(u) / weight from a hash of (key, child); the least draw wins,
so a child gets its weight's share, and a change of weights below one child moves keys only into or out of that child's subtree.
A new shard that must take rows only into itself therefore comes as a region of its own (`grown`): put into an existing
rack it would raise the weight of that rack, and its neighbours there would share in what flows in.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

Rack = dict[int, float]  # shard: weight
Region = dict[str, Rack]


@dataclass(frozen=True)
class Tree:
    regions: dict[str, Region]

    def grown(self, weight: float = 1.0) -> Tree:
        """One more shard, numbered next, as a region of its own."""
        shard = 1 + max(s for r in self.regions.values() for k in r.values() for s in k)
        return Tree({**self.regions, f"region-{shard}": {"rack-0": {shard: weight}}})

    def reweighted(self, region: str, rack: str, shard: int, weight: float) -> Tree:
        racks = {**self.regions[region], rack: {**self.regions[region][rack], shard: weight}}
        return Tree({**self.regions, region: racks})


def balanced(regions: int = 2, racks: int = 2, shards: int = 2) -> Tree:
    """Equal weights, shards numbered through."""
    return Tree({f"region-{g}": {f"rack-{k}": {(g * racks + k) * shards + s: 1.0 for s in range(shards)} for k in range(racks)}
                 for g in range(regions)})


def _pick(key: Column, names: list[str], weights: list[float]) -> Column:
    """Index of the child with the least draw; a child of weight 0 takes no part."""
    draws = []
    for i, (name, w) in enumerate(zip(names, weights, strict=True)):
        if w > 0:
            u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(name)), 11).cast("double") + 0.5) / float(1 << 53)
            draws.append(F.struct((-F.log(u) / w).alias("draw"), F.lit(i).alias("i")))
    return F.least(*draws)["i"] if len(draws) > 1 else F.lit(draws[0]["i"]) if draws else F.lit(None).cast("int")


def _chosen(branches: list[tuple[Column, Column]]) -> Column:
    out = F.lit(None).cast("int")
    for cond, value in reversed(branches):
        out = F.when(cond, value).otherwise(out)
    return out


def assign(rows: DataFrame, tree: Tree, key: str = "doc_id", into: str = "shard") -> DataFrame:
    """Add the shard of each row; no shuffle. A null key is a key like any other: its rows share a shard."""
    heavy = lambda rack: sum(rack.values())
    regions, k = list(tree.regions), F.col(key)
    g, r = f"_{into}_region", f"_{into}_rack"
    out = rows.withColumn(g, _pick(k, regions, [sum(map(heavy, tree.regions[x].values())) for x in regions]))
    out = out.withColumn(r, _chosen([(F.col(g) == i, _pick(k, [f"{x}/{y}" for y in tree.regions[x]], [*map(heavy, tree.regions[x].values())]))
                                     for i, x in enumerate(regions)]))
    leaves = []
    for i, x in enumerate(regions):
        for j, (y, rack) in enumerate(tree.regions[x].items()):
            shards = list(rack)
            at = _pick(k, [f"{x}/{y}/{s}" for s in shards], [rack[s] for s in shards])
            leaves.append(((F.col(g) == i) & (F.col(r) == j), F.element_at(F.array(*map(F.lit, shards)), at + 1)))
    return out.withColumn(into, _chosen(leaves).cast("int")).drop(g, r)


def number(rows: DataFrame, shard: str = "shard", order: tuple[str, ...] = ("doc_id",), bucket: int = 50_000) -> DataFrame:
    """Add `slot`, gapless from 0 within each shard.

    Equal rows are folded to one with a count first, so a key with a third of all rows is one row. A shard is cut by hash into buckets
    of about `bucket` rows, rows are numbered inside a bucket and buckets are lined up by their sizes: no task holds a shard.
    `rows` is read twice, so it should be a written table.
    """
    buckets = max(1, -(-rows.count() // bucket))
    folded = rows.groupBy(*rows.columns).agg(F.count("*").alias("_copies"))
    folded = folded.withColumn("_bucket", F.pmod(F.xxhash64(*rows.columns), F.lit(buckets)))
    inside = (f"sum(_copies) OVER (PARTITION BY {shard}, _bucket ORDER BY {', '.join([*order, *[c for c in rows.columns if c not in order]])}"
              " ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
    placed = folded.withColumn("_before", F.coalesce(F.expr(inside), F.lit(0)))
    bases = (folded.groupBy(shard, "_bucket").agg(F.sum("_copies").alias("_n"))
             .withColumn("_base", F.expr(f"coalesce(sum(_n) OVER (PARTITION BY {shard} ORDER BY _bucket"
                                         " ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)")).drop("_n"))
    same = [F.col(f"p.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (shard, "_bucket")]
    lined = placed.alias("p").join(bases.alias("b"), same[0] & same[1]).select("p.*", "_base")
    return (lined.withColumn("_i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_copies") - 1)))
            .select(*rows.columns, (F.col("_base") + F.col("_before") + F.col("_i")).alias("slot")))
