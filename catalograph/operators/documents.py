"""The nested document of one image: flat fields, object bag, thumbnail, stage references, related things."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from catalograph import names as N
from catalograph.functions.text import bare_id, bracket_iri
from catalograph.operators import patterns as P
from catalograph.operators.facts import classes

DOCUMENT_FIELDS = list(dict.fromkeys(
    [f for f in N.STRUCTURAL_FIELDS if f != "createdDate"] + [f for f in N.PERCEPTION_FIELDS if f != "sceneObjects"]
    + list(N.settable()) + [n for n, _ in N.DATATYPE_PROPERTIES["Video"]]))


def image_documents(q: DataFrame, media: DataFrame | None = None) -> DataFrame:
    """`(store, s, created, document)` per media: a JSON text.

    Facts of the media and of the nodes it owns are brought to the media in one aggregation per node kind; arrays are
    sorted (references by path, related things by name), so equal graphs give equal documents.
    """
    nodes = classes(q, "Image", "Video", "Media").select("store", "s")
    if media is not None:
        nodes = P.where_exists(nodes, media)
    flat = [N.v(f) for f in DOCUMENT_FIELDS if f != "sceneObjects"]
    own = q.filter(F.col("p").isin(*flat, N.v("createdDate"), N.v("sceneObjects"), N.v("relatedToId")))
    pick = lambda f: F.min(F.when(F.col("p") == N.v(f), F.col("o")))
    related = F.when((F.col("p") == N.v("relatedToId")) & F.col("o").startswith(N.MEDIA_NS), bracket_iri(F.col("o")))
    wide = own.groupBy("store", "s").agg(
        pick("createdDate").alias("created"), *[pick(f).alias(f) for f in DOCUMENT_FIELDS if f != "sceneObjects"],
        F.sort_array(F.collect_set(F.when(F.col("p") == N.v("sceneObjects"), F.col("o")))).alias("sceneObjects"),
        F.sort_array(F.collect_set(related)).alias("relatedToId"))

    ref_fields = ["path", "model", "count", "producedDate", "modelReplyPath", "width", "height"]
    node = q.filter(F.col("p").isin(*[N.v(f) for f in ref_fields])).groupBy("store", F.col("s").alias("node")).agg(*[pick(f).alias(f) for f in ref_fields])
    links = q.filter(F.col("p").isin(*[N.v(x) for x in N.OWNED_LINKS])).select(
        "store", "s", F.substring_index("p", "/", -1).alias("link"), F.col("o").alias("node")).join(node, ["store", "node"]).filter("path IS NOT NULL")
    ref = F.struct("path", bare_id(F.col("node")).alias("id"), "model", F.col("count").try_cast("bigint").alias("count"), "producedDate", "modelReplyPath")
    thumb = F.struct("path", bare_id(F.col("node")).alias("id"), F.col("width").try_cast("bigint").alias("width"),
                     F.col("height").try_cast("bigint").alias("height"), "producedDate")
    by_link = links.groupBy("store", "s").agg(
        F.min(F.when((F.col("link") == "thumbnail") & F.col("width").isNotNull() & F.col("height").isNotNull(), thumb)).alias("thumbnail"),
        *[F.sort_array(F.collect_list(F.when(F.col("link") == x, ref))).alias(x) for x in N.LINKS])
    out = nodes.join(wide, ["store", "s"]).join(by_link, ["store", "s"], "left")
    lists = [*N.LINKS, "sceneObjects", "relatedToId"]
    body = [F.col("s").alias("iri"), F.col("created").alias("createdDate"), *[F.col(f) for f in DOCUMENT_FIELDS if f != "sceneObjects"], F.col("thumbnail"),
            *[F.when(F.size(x) > 0, F.col(x)).alias(x) for x in lists]]
    return out.select("store", "s", "created", F.to_json(F.struct(*body)).alias("document"))
