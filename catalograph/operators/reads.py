"""Reads over the catalogue: facts, state, work lists, change feeds, counts."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from catalograph import names as N
from catalograph.functions.text import instant
from catalograph.operators import patterns as P


def facts(q: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Predicate → all values of each node, values sorted. Restrict by `nodes(store, s)`."""
    rows = q if nodes is None else P.describe(q, nodes)
    return rows.groupBy("store", "s", "p").agg(F.sort_array(F.collect_list("o")).alias("values"))


def media_table(q: DataFrame, fields: list[str], classes: tuple[str, ...] = ("Image", "Video", "Media")) -> DataFrame:
    """One row per media with the first value of each functional field. The fields are a fixed list, so the pivot
    is one aggregation with map-side combine and reads only those predicate partitions."""
    preds = [N.v(f) for f in fields]
    typed = [N.v(c) for c in classes]
    rows = q.filter(F.col("p").isin(*preds) | ((F.col("p") == N.RDF_TYPE) & F.col("o").isin(*typed)))
    first = lambda p: F.min(F.when(F.col("p") == p, F.col("o")))
    out = rows.groupBy("store", "s").agg(first(N.RDF_TYPE).alias("class"), *[first(N.v(f)).alias(f) for f in fields])
    return out.filter(F.col("class").isNotNull()).withColumn("class", F.substring_index("class", "/", -1))


def stage_models(q: DataFrame, links: list[str] = N.LINKS) -> DataFrame:
    """(store, s, link, model) of every stage reference."""
    preds = [N.v(x) for x in links]
    refs = q.filter(F.col("p").isin(*preds)).select(
        "store", "s", F.substring_index("p", "/", -1).alias("link"), F.col("o").alias("ref"))
    return P.join(refs, P.pattern(q, "?ref", "model", "?model")).select("store", "s", "link", "model").dropDuplicates()


def media_state(q: DataFrame) -> DataFrame:
    """Per media: dates, type, thumbnail flag and, per stage link, the sorted models that ran."""
    base = media_table(q, ["mediaType", "createdDate", "enrichmentCompleteDate", "thumbnail"])
    models = stage_models(q).groupBy("store", "s").agg(*[
        F.sort_array(F.collect_set(F.when(F.col("link") == x, F.col("model")))).alias(x) for x in N.LINKS])
    out = base.join(models, ["store", "s"], "left")
    none = F.array().cast("array<string>")
    return out.select("store", "s", "mediaType", "createdDate", "enrichmentCompleteDate",
                      F.col("thumbnail").isNotNull().alias("thumbnail"), *[F.coalesce(x, none).alias(x) for x in N.LINKS])


def stage_status(state: DataFrame, stages: dict[str, tuple[str, bool]], attempts: DataFrame) -> DataFrame:
    """done / off / holding / pending of each reported stage.

    `stages`: stage -> (model, enabled); a stage not in it is not configured. "holding" shows any recorded
    failure, whatever its age.
    """
    rows = []
    for st in N.STATE_STAGES:
        model, enabled = stages.get(st, (None, False))
        rows.append(F.struct(F.lit(st).alias("stage"), F.lit(model).cast("string").alias("model"),
                             F.lit(enabled).alias("enabled"), F.lit(st in stages).alias("configured"),
                             F.col(N.STAGE_LINKS[st]).alias("models")))
    long = state.select("store", "s", F.explode(F.array(*rows)).alias("x")).select("store", "s", "x.*")
    long = long.join(attempts.select("store", "s", "stage", "error", "terminal"), ["store", "s", "stage"], "left")
    done = F.coalesce(F.array_contains("models", F.col("model")), F.lit(False))
    status = (F.when(~F.col("configured"), F.when(F.size("models") > 0, "done").otherwise("off"))
              .when(done, "done").when(~F.col("enabled"), "off")
              .when(F.col("error").isNotNull(), "holding").otherwise("pending"))
    held = F.col("status") == "holding"
    return long.withColumn("status", status).select(
        "store", "s", "stage", "models", "status", F.when(held, F.col("error")).alias("error"),
        F.when(held, F.col("terminal")).alias("terminal"))


def pending(media: DataFrame, refs: DataFrame, link: str, model: str, limit: int | None = None,
            since: str | None = None) -> DataFrame:
    """Images without a reference by `model` under `link`, past the stage's gate, newest first.

    The floor compares the date TEXT, as the work list does. One row per image: absence and gates are anti and
    semi conditions, never a join that multiplies. `media` carries has_scene_objects and has_long_caption.
    """
    m = media.filter(F.col("class") == "Image")
    if since is not None:
        m = m.filter(F.col("created") >= since)
    gate = {"regionData": "has_scene_objects", "vectorData": "has_long_caption"}.get(link)
    if gate:
        m = m.filter(F.col(gate))
    done = refs.filter((F.col("link") == link) & (F.col("model") == model)).select("store", "iri")
    out = m.join(done, ["store", "iri"], "left_anti").select("store", "id", "iri", "media_path", "media_type", "created")
    return out if limit is None else out.orderBy(F.desc("created"), "iri", "store").limit(limit)


def complete_candidates(media: DataFrame, refs: DataFrame, required: list[tuple[str, str]],
                        limit: int | None = None) -> DataFrame:
    """Images holding a reference for every required (link, model) and no completion mark, newest first.

    Relational division as one pre-aggregated flag set per image. Nothing required: no image qualifies.
    """
    if not required:
        return media.filter(F.lit(False)).select("store", "id", "iri", "created")
    flags = [F.max((F.col("link") == a) & (F.col("model") == b)) for a, b in required]
    every = flags[0]
    for f in flags[1:]:
        every = every & f
    wanted = F.lit(False)
    for a, b in required:
        wanted = wanted | ((F.col("link") == a) & (F.col("model") == b))
    have = refs.filter(wanted).groupBy("store", "iri").agg(every.alias("every")).filter("every").drop("every")
    m = media.filter((F.col("class") == "Image") & F.col("complete").isNull())
    out = m.join(have, ["store", "iri"], "left_semi").select("store", "id", "iri", "created")
    return out if limit is None else out.orderBy(F.desc("created"), "iri", "store").limit(limit)


def attempts(outcomes: DataFrame) -> DataFrame:
    """Last failure per (store, s, stage) unless a later success cleared it.

    `outcomes(store, s, stage, at, seq, ok, error, terminal)`; the latest row per key decides (map-side max).
    """
    last = outcomes.groupBy("store", "s", "stage").agg(
        F.max(F.struct("at", "seq", "ok", "error", "terminal")).alias("x")).select("store", "s", "stage", "x.*")
    return last.filter(~F.col("ok")).drop("ok", "seq")


def holding(attempts_: DataFrame, now: Column | datetime, seconds: int = N.HOLD_SECONDS) -> DataFrame:
    """Failures younger than the hold, whatever their kind."""
    now = now if isinstance(now, Column) else F.lit(now)
    return attempts_.filter(F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("at").cast("timestamp"))
                            < F.lit(seconds * 1_000_000))


def next_batch(pending_: DataFrame, held: DataFrame, batch: int = N.BATCH) -> DataFrame:
    """The next items of a stage: of the newest 4 × batch pending, those not on hold, up to the batch."""
    order = [F.desc("created"), F.col("iri"), F.col("store")]
    asked = pending_.orderBy(*order).limit(4 * batch)
    return asked.join(held, P.shared_vars(held, asked), "left_anti").orderBy(*order).limit(batch)


FEED = ("updatedDate", "rating", "isPicked", "isRejected")


def changes(q: DataFrame, since: str | None = None) -> DataFrame:
    """Images changed at or after `since`, each with its marks; cleared marks are still rows (0 / false)."""
    rows = P.join(P.pattern(q, "?s", N.RDF_TYPE, "Image"), P.pattern(q, "?s", "updatedDate", "?u"))
    if since is not None:
        rows = P.where_since(rows, "u", since)
    for var, field in (("r", "rating"), ("p", "isPicked"), ("j", "isRejected")):
        rows = P.optional(rows, P.pattern(q, "?s", field, f"?{var}"))
    return rows.select("store", F.col("s").alias("iri"), F.col("u").alias("updated"),
                       F.coalesce(F.col("r").try_cast("bigint"), F.lit(0)).alias("rating"),
                       F.coalesce(F.col("p") == "true", F.lit(False)).alias("is_picked"),
                       F.coalesce(F.col("j") == "true", F.lit(False)).alias("is_rejected"))


def feed_between(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows of the feed `after` that `before` does not have, and one row with `removed` for each image that is in `before` only."""
    gone = before.select("store", "iri").dropDuplicates().join(after.select("store", "iri"), ["store", "iri"], "left_anti")
    rest = [F.lit(None).cast(after.schema[c].dataType).alias(c) for c in after.columns if c not in ("store", "iri")]
    return after.subtract(before).withColumn("removed", F.lit(False)).unionByName(gone.select("store", "iri", *rest, F.lit(True).alias("removed")))


def in_feed_order(changed: DataFrame) -> DataFrame:
    return changed.orderBy(instant(F.col("updated")), "iri", "store")


def cursor(inflight: DataFrame, now: Column) -> DataFrame:
    """The next `since`: now, or the oldest write still in flight. Take it BEFORE reading the feed."""
    return inflight.agg(F.least(now.cast("timestamp"), F.min(F.col("at").cast("timestamp"))).alias("snapshot"))


def embedded_since(q: DataFrame, model: str, since: str) -> DataFrame:
    """Images whose vector reference for `model` was produced at or after an instant."""
    rows = P.bgp(q, [("?s", "vectorData", "?e"), ("?e", "model", P.literal(model)), ("?s", N.RDF_TYPE, "Image"),
                     ("?e", "producedDate", "?d")])
    return P.distinct(P.where_since(rows, "d", since), "store", "s")


COUNTED = {"thumbnails": "thumbnail", "captions": "captionData", "embeddings": "vectorData", "poses": "poseData",
           "regions": "regionData", "depths": "depthData", "faces": "faceData"}


def counts(q: DataFrame) -> DataFrame:
    """Per store: images, and images with a thumbnail or at least one RECORD of each stage, in one pass.

    References that hold an item are reduced to one row each first, so an image is joined once per reference and
    an empty run does not count.
    """
    images = P.pattern(q, "?s", N.RDF_TYPE, "Image")
    items = P.pattern(q, "?ref", "item", "?i").select("store", "ref").dropDuplicates()
    links = q.filter(F.col("p").isin(*[N.v(x) for x in N.LINKS])).select(
        "store", "s", F.substring_index("p", "/", -1).alias("link"), F.col("o").alias("ref"))
    have = links.join(items, ["store", "ref"], "left_semi").select("store", "s", "link")
    thumbs = P.pattern(q, "?s", "thumbnail", "?t").select("store", "s", F.lit("thumbnail").alias("link"))
    per_image = have.unionByName(thumbs).groupBy("store", "s").agg(*[
        F.max(F.col("link") == x).alias(n) for n, x in COUNTED.items()])
    return (images.dropDuplicates().join(per_image, ["store", "s"], "left").groupBy("store")
            .agg(F.count("*").alias("images"), *[F.count_if(F.coalesce(F.col(n), F.lit(False))).alias(n) for n in COUNTED]))


def count_changes(q: DataFrame, n: int = 1) -> DataFrame:
    """(store, iri, what, n): what `counts` counts in these quads, as changes by `n`: images, thumbnails, and references that hold a record.
    Of a commit, give the quads that came with 1 and those that went with -1, a reference together with its items."""
    images = P.pattern(q, "?s", N.RDF_TYPE, "Image").select("store", "s", F.lit("images").alias("what")).dropDuplicates()
    items = P.pattern(q, "?ref", "item", "?i").select("store", "ref").dropDuplicates()
    named = F.create_map(*[F.lit(x) for n_, link in COUNTED.items() for x in (link, n_)])
    links = q.filter(F.col("p").isin(*[N.v(x) for x in N.LINKS])).select(
        "store", "s", F.try_element_at(named, F.substring_index("p", "/", -1)).alias("what"), F.col("o").alias("ref"))
    have = links.filter("what IS NOT NULL").join(items, ["store", "ref"], "left_semi").select("store", "s", "what")
    thumbs = P.pattern(q, "?s", "thumbnail", "?t").select("store", "s", F.lit("thumbnails").alias("what"))
    return images.unionByName(have).unionByName(thumbs).select("store", F.col("s").alias("iri"), "what", F.lit(n).cast("bigint").alias("n"))


def locate(ids: DataFrame, id_: str | None = None) -> DataFrame:
    """(id, stores, store): where an id lives over all stores. Several stores is ambiguous: `store` stays NULL."""
    rows = ids if id_ is None else ids.filter(F.col("id") == id_)
    out = rows.groupBy("id").agg(F.count_distinct("store").alias("stores"), F.min("store").alias("store"))
    return out.withColumn("store", F.when(F.col("stores") == 1, F.col("store")))


def locate_one(ids: DataFrame, id_: str) -> str:
    """The one store of an id; unknown and ambiguous ids are errors."""
    hits = locate(ids, id_).take(1)
    if not hits:
        raise LookupError(f"id not found: {id_}")
    if hits[0].stores > 1:
        raise LookupError(f"id {id_} is in {hits[0].stores} stores; name one")
    return hits[0].store
