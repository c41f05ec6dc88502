"""Vector operators: `vectors(model, key_id, vec[, store, produced])`. Scores are cosine, ties go to the lesser id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from catalograph import names as N
from catalograph.functions.similarity import cosine_to
from catalograph.functions.text import bare_id
from catalograph.operators import patterns as P
from catalograph.operators.sizes import small
from catalograph.session import cut_lineage


def _dim_checked(vec: Column, dim: Column, score: Column) -> Column:
    return F.when(F.size(vec) == dim, score).otherwise(F.raise_error(F.concat(
        F.lit("query dim "), dim.cast("string"), F.lit(" does not match index dim "), F.size(vec).cast("string"))))


def _top(df: DataFrame, k: int) -> DataFrame:
    """A limit over an order: each task keeps k rows, the driver-side merge sees k per task."""
    return df.filter(F.col("score").isNotNull()).orderBy(F.desc("score"), *_keys(df)[::-1]).limit(k)


def _named(rows: DataFrame, *cols: Column | str) -> DataFrame:
    """Score columns, with the store where there is one and the IRI where a gate brought one."""
    return rows.select(*_keys(rows), *(["iri"] if "iri" in rows.columns else []), *cols)


def _keys(*tables: DataFrame) -> list[str]:
    """What names a vector: the store too where every table has it."""
    return [*(["store"] if all("store" in t.columns for t in tables) else []), "key_id"]


def of_store(rows: DataFrame, store: str | None) -> DataFrame:
    """The rows of one store; all where none is named."""
    return rows if store is None else rows.filter(F.col("store") == store)


def knn(vectors: DataFrame, model: str, query: list[float], k: int = 10, exclude=None, engine: str = "arrow", store: str | None = None) -> DataFrame:
    """The k most similar rows of an index to a given vector: `([store,] key_id, score)`. An index is a store's own; without `store` the
    indexes of all stores are searched as one."""
    rows = of_store(vectors.filter(F.col("model") == model), store)
    if exclude is not None:
        rows = rows.filter(F.col("key_id") != exclude)
    score = _dim_checked(F.col("vec"), F.lit(len(query)), cosine_to(F.col("vec"), query, engine))
    return _top(_named(rows, score.alias("score")), k)


def gate_images(q: DataFrame, where: DataFrame) -> DataFrame:
    """(store, key_id, iri) of the images a pattern admits: its distinct `?s`, which must also be typed Image."""
    images = P.pattern(q, "?s", N.RDF_TYPE, "Image")
    admitted = P.where_exists(P.distinct(where, "store", "s"), images)
    return admitted.select("store", bare_id(F.col("s")).alias("key_id"), F.col("s").alias("iri"))


def _gated(rows: DataFrame, gate: DataFrame) -> DataFrame:
    """Rows the gate admits. The gate holds a key once, so the join that brings the IRI along multiplies nothing."""
    return rows.join(gate, P.shared_vars(gate, rows), "inner")


def hybrid(q: DataFrame, vectors: DataFrame, where: DataFrame | None, model: str, query: list[float], k: int = 10,
           exclude=None, engine: str = "arrow", store: str | None = None) -> DataFrame:
    """A graph pattern gates, cosine ranks: `([store,] key_id, iri, score)`. The gate joins before scoring, so only admitted
    rows are scored and an empty gate is an empty answer. Without a pattern there is no graph pass at all."""
    rows = vectors if where is None else _gated(vectors.filter(F.col("model") == model), gate_images(q, where))
    return knn(rows, model, query, k, exclude, engine, store)


def _like(vectors: DataFrame, rows: DataFrame, model: str, id_, k: int, store: str | None) -> DataFrame:
    """Search with a stored vector, in its own store: its one row is read first, as a client's vector would come; none, no hits. An id that
    several stores hold needs the store's name."""
    asked = stored_vector(vectors, model, id_, store).limit(2).collect()
    if len(asked) > 1:
        raise ValueError(f"several stores hold {id_}: name one")
    if not asked:
        return knn(rows.limit(0), model, [0.0], k)
    return knn(rows, model, list(asked[0].vec), k, exclude=id_, store=asked[0].store if "store" in vectors.columns else None)


def knn_like(vectors: DataFrame, model: str, id_, k: int = 10, store: str | None = None) -> DataFrame:
    """Neighbours of a stored item in its own store, itself left out."""
    return _like(vectors, vectors, model, id_, k, store)


def hybrid_like(q: DataFrame, vectors: DataFrame, where: DataFrame, model: str, id_, k: int = 10,
                outside: bool = False, store: str | None = None) -> DataFrame:
    """Hybrid search like a stored item, inside the gate or (`outside`) among the images it leaves out; in the item's own store."""
    if outside:
        everything = P.pattern(q, "?s", N.RDF_TYPE, "Image")
        where = P.where_not_exists(everything, P.distinct(where, "store", "s"))
    return _like(vectors, _gated(vectors, gate_images(q, where)), model, id_, k, store)


def with_iri(hits: DataFrame, media: DataFrame) -> DataFrame:
    """Add each hit's IRI, NULL where the table has none: the k hits are broadcast to the media, never the media
    shuffled to the hits."""
    hits = cut_lineage(hits)
    key = _keys(hits, media)
    found = media.select(*key[:-1], F.col("id").alias("key_id"), "iri").join(small(hits.select(*key)), key)
    return hits.join(small(found), key, "left")


def knn_children(vectors: DataFrame, owners: DataFrame, model: str, id_, k: int = 10, store: str | None = None) -> DataFrame:
    """Nearest child entities (faces), each with its owner in the same store. Owners are looked up after the limit; a hit without an
    owner is left out, so fewer than k may return. `owners([store,] key_id, owner)`."""
    hits = small(cut_lineage(knn_like(vectors, model, id_, k, store)))
    return hits.join(owners, _keys(hits, owners), "inner")


def stored_vector(vectors: DataFrame, model: str, id_, store: str | None = None) -> DataFrame:
    """`([store,] key_id, vec)`: one row a store that holds the id; at most one with `store`."""
    rows = of_store(vectors, store).filter((F.col("model") == model) & (F.col("key_id") == id_))
    return rows.select(*_keys(vectors), "vec")


def all_vectors(vectors: DataFrame, model: str, keep: DataFrame | None = None, store: str | None = None) -> DataFrame:
    """Every vector of an index, or those whose key is in `keep` (the since-set). `in_order` gives them as they came in."""
    rows = of_store(vectors.filter(F.col("model") == model), store)
    return rows if keep is None else rows.join(keep, P.shared_vars(keep, rows), "left_semi")


def in_order(vectors: DataFrame) -> DataFrame:
    """Vectors as they came into their index: by `seq`, those from before it was kept first, then by key."""
    return vectors.orderBy(*_keys(vectors)[:-1], *(["seq"] if "seq" in vectors.columns else []), "key_id")


def add_vectors(vectors: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(index after, report). Rows are taken in the order of `seq`: the first row of a new index fixes its dimension, a row of another
    dimension is refused, the first fitting row of a key is added, and every later one finds it present.

    The report has a row for each row of `new`: (index key, seq, dim, given, status). The index keeps `seq`, the order of insertion, and
    `produced` where `new` or the index has it. An index is a store's own where the tables have a store.
    """
    key = ["model", *_keys(vectors, new)]
    index = key[:-1]
    kept = ["seq", *(["produced"] if "produced" in [*vectors.columns, *new.columns] else [])]
    as_kept = lambda d, x: F.col(x) if x in d.columns else F.lit(None).cast(new.schema[x].dataType if x in new.columns else vectors.schema[x].dataType)
    have = vectors.select(*key, "vec", *[as_kept(vectors, x).alias(x) for x in kept])
    sizes = have.groupBy(*index).agg(F.max(F.size("vec")).alias("had"))
    first = new.groupBy(*index).agg(F.min(F.struct("seq", F.size("vec").alias("n")))["n"].alias("came"))
    dims = first.join(sizes, index, "left").select(*index, F.coalesce("had", "came").alias("dim"))
    rows = new.select(*key, "vec", *[as_kept(new, x).alias(x) for x in kept])
    taken, report = add_judged(have, dims, rows, key, kept)
    return have.unionByName(taken.select(*have.columns)), report


def add_judged(have: DataFrame, dims: DataFrame, rows: DataFrame, key: list[str], kept: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows taken, report of all rows) of `rows(key, vec, seq...)` against the keys in `have` and the dimensions of their indexes."""
    rows = rows.join(small(dims), [c for c in key if c in dims.columns])
    fits = F.size("vec") == F.col("dim")
    first = rows.filter(fits).groupBy(*key).agg(F.min(F.struct(kept[0], "vec", *kept[1:])).alias("x"))
    taken = cut_lineage(first.join(have.select(*key), key, "left_anti").select(*key, "x.*"))
    status = F.when(~fits, "refused").when(F.col("lead") == F.col("seq"), "added").otherwise("present")
    report = rows.join(taken.select(*key, F.col("seq").alias("lead")), key, "left").select(
        *key, "seq", "dim", F.size("vec").alias("given"), status.alias("status"))
    return taken, report


def remove_vectors(vectors: DataFrame, ids: DataFrame) -> DataFrame:
    """Take keys out of every index, of their own store only where both tables have a store."""
    key = _keys(vectors, ids)
    return vectors.join(ids.select(*key), key, "left_anti")


def index_records(q: DataFrame, model: str) -> DataFrame:
    """(key_id, path) the graph names for an index: image embeddings under the image, all else under the record."""
    links = q.filter(F.col("p").isin(*[N.v(x) for x in N.LINKS])).select("store", "s", "p", F.col("o").alias("ref"))
    rows = P.bgp(q, [("?ref", "item", "?node"), ("?node", "vectorPath", "?path"), ("?node", "model", P.literal(model))])
    keyed = F.when(F.col("p") == N.v("vectorData"), F.col("s")).otherwise(F.col("node"))
    return P.join(links, rows).select("store", bare_id(keyed).alias("key_id"), "path").dropDuplicates()


def rebuild_index(q: DataFrame, files: DataFrame, model: str) -> tuple[DataFrame, DataFrame]:
    """(vectors, report) of an index rebuilt from the graph and `files(path, vec)`.

    One vector per key, the first path that exists; the report has vectors, dim, missing files and 20 of their
    paths. A graph that names nothing, or nothing on disk, makes the report's `refused` true.
    """
    rows = index_records(q, model).join(files.select("path", "vec"), "path", "left")
    kept = rows.filter(F.col("vec").isNotNull()).groupBy("store", "key_id").agg(F.min(F.struct("path", "vec")).alias("x"))
    kept = kept.select(F.lit(model).alias("model"), "store", "key_id", F.col("x.vec").alias("vec"))
    found = kept.agg(F.count("*").alias("vectors"), F.max(F.size("vec")).alias("dim"),
                     F.min(F.size("vec")).alias("least_dim")).withColumn("index", F.lit(model))
    gone = rows.filter(F.col("vec").isNull()).select("key_id", "path")
    sample = gone.orderBy("key_id", "path").limit(20).agg(F.sort_array(F.collect_list(F.struct("key_id", "path"))).alias("x"))
    lost = gone.agg(F.count("*").alias("missing")).withColumn("index", F.lit(model)).join(
        F.broadcast(sample.select(F.lit(model).alias("index"), F.col("x.path").alias("missing_sample"))), "index")
    report = found.join(F.broadcast(lost), "index").select(
        "index", "dim", "vectors", "missing", "missing_sample",
        ((F.col("vectors") == 0) | (F.col("dim") != F.col("least_dim"))).alias("refused"))
    return kept, report


def index_stats(vectors: DataFrame) -> DataFrame:
    return vectors.groupBy("model", *_keys(vectors)[:-1]).agg(F.max(F.size("vec")).alias("dim"), F.count("*").alias("count"))


def model_gap(scores: DataFrame, a: str, b: str) -> DataFrame:
    """Images two models score differently, widest gap first. `scores(id, model, score)`: one aggregation brings
    both scores of an image together."""
    pick = lambda m: F.max(F.when(F.col("model") == m, F.col("score")))
    both = scores.filter(F.col("model").isin(a, b)).groupBy("id").agg(pick(a).alias("a"), pick(b).alias("b"))
    return both.dropna().withColumn("gap", F.abs(F.col("a") - F.col("b"))).orderBy(F.desc("gap"), "id")


def top_per_key(rows: DataFrame, key: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows per key. Spark limits each key inside the map tasks before the shuffle (window group limit),
    so a hot key sends k rows a task, not its whole group."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)
