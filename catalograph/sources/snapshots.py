"""The quad table on disk: Parquet partitioned by predicate, in versions.

A version says for each predicate which folder holds it. A commit writes the predicates that its change touches and points the next version at
them; all others stay where they are, unread and unwritten. Readers take the newest version, so a job that dies leaves the old state in
force, and of two writers that began from the same version the second is refused.
"""

from __future__ import annotations

from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, functions as F

from catalograph import names as N
from catalograph.operators import reads as R
from catalograph.operators.facts import Change
from catalograph.sources import versions as VS

LONG = 256  # characters of a long text
PLACES = (8, 64)  # places that a predicate's short and long texts are spread over


def _write(quads: DataFrame, folder: str) -> list[str]:
    """Write quads by predicate and return the partitions made.

    Rows are rebalanced by predicate first: AQE cuts a big predicate into files of the advisory size and packs small ones,
    where a plain partitioned write would leave a file per task and predicate. AQE cannot cut what one task sends to one place, so a
    predicate's rows go to several by their subject, long texts to more: what a task sorts does not grow with the table. Inside a file rows are
    sorted by subject, so Parquet's min/max lets a subject lookup skip row groups.
    """
    spread = F.pmod(F.xxhash64("store", "s"), F.when(F.length("o") > LONG, PLACES[1]).otherwise(PLACES[0]))
    (quads.select(*N.QUAD_COLS).withColumn("__place", spread).hint("rebalance", "p", "__place").drop("__place").sortWithinPartitions("p", "s")
     .write.mode("errorifexists").partitionBy("p").parquet(folder))
    return [n for n in VS.names(quads.sparkSession, folder) if n.startswith("p=")]


def finished(spark: SparkSession, folder: str) -> bool:
    """Whether a write to `folder` was committed."""
    return "_SUCCESS" in VS.names(spark, folder)


def write_snapshot(quads: DataFrame, root: str) -> int:
    """Write the whole table as the next version and return its number."""
    spark = quads.sparkSession
    version = (VS.latest(spark, root) or 0) + 1
    name = VS.fresh_name(version)
    return VS.publish(spark, root, version, {"parts": {p: name for p in _write(quads, f"{root}/{name}")}})


def commit(spark: SparkSession, root: str, change: Change, base: int | None = None) -> int:
    """Publish version `base` (the newest by default) with `change` as the next one. Only the predicates the change touches are rewritten.

    `Taken` is raised if the next version exists, so nothing of another writer is lost.
    """
    base = base or VS.latest(spark, root)
    if base is None:
        raise FileNotFoundError(f"no finished snapshot under {root}")
    if base + 1 in VS.listed(spark, root):
        raise VS.Taken(f"version {base + 1} of {root} is taken")
    held, parts = change.held(), VS.read(spark, root, base)["parts"]
    q = read_snapshot(spark, root, base)
    touched = held.touches(q)
    name = VS.fresh_name(base + 1)
    made = _write(held.within(touched).apply(q.filter(F.col("p").isin(touched))), f"{root}/{name}") if touched else []
    left = {p: f for p, f in parts.items() if unquote(p[2:]) not in set(touched)}
    return VS.publish(spark, root, base + 1, {"parts": left | {p: name for p in made}})


def read_snapshot(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    have = VS.listed(spark, root)
    version = version or VS.latest(spark, root)
    if version is None or version not in have:
        raise FileNotFoundError(f"no finished snapshot {version or ''} under {root}")
    parts, folders = VS.read(spark, root, version)["parts"], {}
    for p, f in parts.items():
        folders.setdefault(f, []).append(p)

    def part(folder: str, kept: list[str]) -> DataFrame:
        whole = f"{root}/{folder}"
        every = len(kept) == sum(n.startswith("p=") for n in VS.names(spark, whole))
        paths = [whole] if every else [f"{whole}/{p}" for p in kept]
        return spark.read.schema(N.QUAD_SCHEMA).option("basePath", whole).parquet(*paths).select(*N.QUAD_COLS)

    if not folders:
        return spark.createDataFrame([], N.QUAD_SCHEMA).select(*N.QUAD_COLS)
    return reduce(DataFrame.unionByName, [part(f, p) for f, p in sorted(folders.items())])


def difference(spark: SparkSession, root: str, old: int, new: int, preds: list[str] | None = None) -> DataFrame:
    """(store, s, p, o, ..., change): the quads `added` and `removed` between two versions, of `preds` only if they are named.

    A predicate that both versions keep in the same folder is not read. The rest is one aggregation: quads count +1 or -1 by the version that
    holds them and those that cancel combine map-side as far as they meet; a quad held twice is held once.
    """
    a, b = (VS.read(spark, root, v)["parts"] for v in (old, new))
    touched = sorted(unquote(p[2:]) for p in {*a, *b} if a.get(p) != b.get(p))
    touched = [p for p in touched if preds is None or p in preds]
    side = lambda v, on: read_snapshot(spark, root, v).filter(F.col("p").isin(touched)).withColumn("new", F.lit(on))
    both = side(old, False).unionByName(side(new, True)).groupBy(*N.QUAD_COLS).agg(F.max("new").alias("there"), F.min("new").alias("fresh"))
    return both.filter(F.col("there") == F.col("fresh")).select(*N.QUAD_COLS, F.when(F.col("there"), "added").otherwise("removed").alias("change"))


def feed(spark: SparkSession, root: str, old: int, new: int) -> DataFrame:
    """What the change feed says of the images that differ between two versions, as `reads.changes` says it, and those that left it.

    (store, iri, updated, rating, is_picked, is_rejected, removed); a removed image has no values. Dates play no part, so a change that
    did not stamp its image is seen too.
    """
    preds = [N.RDF_TYPE, *[N.v(x) for x in R.FEED]]
    near = difference(spark, root, old, new, preds).select("store", "s").dropDuplicates()
    said = lambda v: R.changes(read_snapshot(spark, root, v).filter(F.col("p").isin(preds)).join(near, ["store", "s"], "left_semi"))
    return R.feed_between(said(old), said(new))
