"""Curated sets. Membership is a `relatedToId` edge from the media; a set holds no list."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from catalograph import names as N
from catalograph.functions.text import bare_id, stripped, valid_id
from catalograph.operators import patterns as P
from catalograph.operators.facts import Change, classes, judge_links, quad


def set_iri(class_: str, id_: str) -> str:
    return f"{N.MEDIA_NS}{class_}/{id_}"


def set_nodes(q: DataFrame) -> DataFrame:
    """(store, class, id, iri, created, updated, description) of every set that has a creation date."""
    typed = classes(q, *N.SET_MEMBER)
    fields = q.filter(F.col("p").isin(N.v("createdDate"), N.v("updatedDate"), N.v("description")) & F.col("s").rlike(
        f"^{N.MEDIA_NS}({'|'.join(N.SET_MEMBER)})/"))
    pick = lambda f: F.max(F.when(F.col("p") == N.v(f), F.col("o")))
    wide = fields.groupBy("store", "s").agg(pick("createdDate").alias("created"), pick("updatedDate").alias("updated"),
                                            pick("description").alias("description"))
    return typed.join(wide, ["store", "s"]).filter("created IS NOT NULL").select(
        "store", "class", bare_id(F.col("s")).alias("id"), F.col("s").alias("iri"), "created", "updated", "description")


def list_sets(q: DataFrame, class_: str) -> DataFrame:
    """Sets of a kind, oldest first by the text of their date, then by id."""
    return set_nodes(q).filter(F.col("class") == class_).orderBy("created", "id", "store")


def members(q: DataFrame, store: str, iri: str) -> DataFrame:
    """Members of one set in IRI order. An unknown set is an error, found by a one-row look before the read."""
    if classes(q, *N.SET_MEMBER).filter((F.col("store") == store) & (F.col("s") == iri)).isEmpty():
        raise LookupError(f"set not found: {iri}")
    rows = q.filter((F.col("p") == N.v("relatedToId")) & (F.col("o") == iri) & (F.col("store") == store))
    return rows.select("store", F.col("s").alias("member")).orderBy("member")


def member_counts(q: DataFrame) -> DataFrame:
    """(store, iri, members) of every set."""
    edges = q.filter(F.col("p") == N.v("relatedToId")).select("store", F.col("o").alias("s")).groupBy("store", "s").agg(F.count("*").alias("members"))
    return classes(q, *N.SET_MEMBER).join(edges, ["store", "s"], "left").select(
        "store", F.col("s").alias("iri"), F.coalesce("members", F.lit(0)).alias("members"))


def set_quads(sets: DataFrame) -> DataFrame:
    """The quads of `sets(store, class, id, created, updated, description)`; blank texts make no fact."""
    iri = F.concat(F.lit(N.MEDIA_NS), "class", F.lit("/"), "id")
    one = lambda p, o, k: F.struct(F.lit(p).alias("p"), o.alias("o"), F.lit(k).alias("o_kind"))
    facts = F.array(one(N.RDF_TYPE, F.concat(F.lit(N.VOCAB), "class"), "iri"), one(N.v("id"), iri, "iri"),
                    one(N.v("createdDate"), F.col("created"), "literal"), one(N.v("updatedDate"), F.col("updated"), "literal"),
                    one(N.v("description"), F.nullif(stripped("description"), F.lit("")), "literal"))
    rows = sets.select("store", iri.alias("s"), F.explode(F.filter(facts, lambda x: x["o"].isNotNull())).alias("x"))
    return rows.select("store", "s", "x.p", "x.o", "x.o_kind", F.lit(None).cast("string").alias("dt"), F.lit(N.GRAPH).alias("g"))


def create_sets(q: DataFrame, new: DataFrame, now: str) -> Change:
    """New sets `(store, class, id, description[, seq])`. An id is refused when malformed or already the id of a media or of a set of any
    kind; of several requests for one id the first by `seq` is made and the report counts the others as `refused`."""
    taken = classes(q, "Image", "Video", "Media", *N.SET_MEMBER).select("store", bare_id(F.col("s")).alias("id"), F.lit(True).alias("taken")).dropDuplicates()
    seq = F.col("seq") if "seq" in new.columns else F.lit(0)
    first = F.min(F.struct(seq.alias("seq"), "class", "description")).alias("x")
    asked = new.groupBy("store", "id").agg((F.count("*") - 1).alias("refused"), first).select("store", "id", "refused", "x.class", "x.description")
    judged = asked.join(taken, ["store", "id"], "left").withColumn("status", (
        F.when(~valid_id(F.col("id")), "invalid id").when(F.col("taken"), "taken").otherwise("made")))
    made = judged.filter("status = 'made'").select("store", "class", "id", F.lit(now).alias("created"), F.lit(now).alias("updated"), "description")
    return Change(set_quads(made), None, judged.select("store", "class", "id", "status", "refused"))


def add_members(q: DataFrame, pairs: DataFrame) -> Change:
    """`pairs(store, s, target)`: media and set must exist and fit; a present member is no change."""
    rows = pairs.join(classes(q, "Image", "Video", "Media"), ["store", "s"], "left")
    is_set = F.col("target_class").isin(*N.SET_MEMBER)
    judged = judge_links(q, rows).withColumn("status", (
        F.when(F.col("class").isNull(), "id not found").when(F.col("link_reason").isNotNull(), F.col("link_reason"))
        .when(~is_set, "not a set").otherwise("ok")))
    edges = judged.filter("status = 'ok'").select(*quad(F.col("store"), F.col("s"), N.v("relatedToId"), F.col("node"), "iri"))
    return Change(P.fresh_quads(q, edges), None, judged.select("store", "s", "target", "status"))


def remove_members(q: DataFrame, pairs: DataFrame) -> Change:
    """`pairs(store, s, iri)` come apart; one that is no member is no change."""
    gone = q.filter(F.col("p") == N.v("relatedToId")).join(
        pairs.select("store", "s", F.col("iri").alias("o")).dropDuplicates(), ["store", "s", "o"], "left_semi").select(*N.QUAD_COLS)
    return Change(None, gone, gone.groupBy("store", "o").agg(F.count("*").alias("removed")))


def delete_set(q: DataFrame, sets: DataFrame) -> Change:
    """`sets(store, iri)` go: their members are unlinked, then the node. The report lists the members."""
    keys = sets.select("store", F.col("iri").alias("k")).dropDuplicates()
    edges = q.filter(F.col("p") == N.v("relatedToId")).join(keys.withColumnRenamed("k", "o"), ["store", "o"], "left_semi").select(*N.QUAD_COLS)
    nodes = q.join(keys.withColumnRenamed("k", "s"), ["store", "s"], "left_semi").select(*N.QUAD_COLS)
    return Change(None, edges.unionByName(nodes), edges.select("store", F.col("o").alias("iri"), F.col("s").alias("member")))


def reload_sets(q: DataFrame, files: DataFrame) -> Change:
    """Set nodes as their files say: every old statement of a set that has a file goes first."""
    keys = files.select("store", F.concat(F.lit(N.MEDIA_NS), "class", F.lit("/"), "id").alias("s")).dropDuplicates()
    old = q.join(keys, ["store", "s"], "left_semi").select(*N.QUAD_COLS)
    return Change(set_quads(files), old, keys)
