"""Registered vector queries."""

from pyspark.sql import functions as F

from catalograph import names as N
from catalograph.operators import neighbour_graph as NG, neighbours as NB, patterns as P, reads as R, vectors as X
from catalograph.plans.binding import M, TYPE, V
from catalograph.plans.registry import query
from catalograph.session import fresh_dir
from catalograph.sources import cell_index as CI

MODEL = "emb-64"
COS = "list_cosine_similarity(CAST(a.vec AS DOUBLE[]), CAST(b.vec AS DOUBLE[]))"
Q0 = "(SELECT vec FROM m_vectors WHERE key_id = 0)"


def query_vector(b, id_=0):
    """The vector asked for, as a client would send it."""
    return X.stored_vector(b.vectors, MODEL, id_).first().vec


def keyed(b):
    """The index keyed by text ids, as the graph names its images."""
    return b.vectors.withColumn("key_id", F.col("key_id").cast("string"))


def micro(vec):
    """A whole vector as text, in millionths."""
    return F.array_join(F.transform(vec, lambda x: F.round(x.cast("double") * 1000000).cast("bigint").cast("string")), ",").alias(vec)


def scored(df, by="key_id"):
    return df.select(by, F.round("score", 6).alias("score"))


@query("v1_knn", f"""
SELECT b.key_id, round({COS}, 6) AS score FROM m_vectors b JOIN m_vectors a ON a.key_id = 0 ORDER BY {COS} DESC, b.key_id LIMIT 10""")
def _(b):
    return scored(X.knn(b.vectors, MODEL, query_vector(b)))


@query("v1_knn_native", f"""
SELECT b.key_id, round({COS}, 6) AS score FROM m_vectors b JOIN m_vectors a ON a.key_id = 0 ORDER BY {COS} DESC, b.key_id LIMIT 25""")
def _(b):
    return scored(X.knn(b.vectors, MODEL, query_vector(b), 25, engine="native"))


@query("v2_hybrid_search", f"""
SELECT CAST(b.key_id AS STRING) AS key_id, m.iri, round({COS}, 6) AS score FROM m_vectors b JOIN m_vectors a ON a.key_id = 0
JOIN m_media m ON m.n = b.key_id WHERE m.class = 'Image' AND m.lang = 'en' AND m.n % 4 <> 0 AND b.key_id <> 0 ORDER BY {COS} DESC, b.key_id LIMIT 10""")
def _(b):
    where = P.pattern(b.quads, "?s", "sceneObjects", P.literal("en"))
    hits = X.hybrid(b.quads, keyed(b), where, MODEL, query_vector(b), 10, exclude="0")
    return hits.select("key_id", "iri", F.round("score", 6).alias("score"))


@query("v2_hybrid_outside_set", f"""
SELECT CAST(b.key_id AS STRING) AS key_id, round({COS}, 6) AS score FROM m_vectors b JOIN m_vectors a ON a.key_id = 1
JOIN m_media m ON m.n = b.key_id WHERE m.class = 'Image' AND m.source <> 'src3' AND b.key_id <> 1 ORDER BY {COS} DESC, b.key_id LIMIT 10""")
def _(b):
    inside = P.pattern(b.quads, "?s", "relatedToId", M + "ImageSet/src3")
    return scored(X.hybrid_like(b.quads, keyed(b), inside, MODEL, "1", 10, outside=True))


@query("v3_knn_like", f"""
SELECT b.key_id, round({COS}, 6) AS score FROM m_vectors b JOIN m_vectors a ON a.key_id = 7 WHERE b.key_id <> 7 ORDER BY {COS} DESC, b.key_id LIMIT 10""")
def _(b):
    return scored(X.knn_like(b.vectors, MODEL, 7))


@query("v3_knn_like_with_iri", f"""
SELECT h.key_id, m.iri, round(h.score, 6) AS score FROM (SELECT CAST(b.key_id AS STRING) AS key_id, {COS} AS score FROM m_vectors b JOIN m_vectors a ON a.key_id = 7
  WHERE b.key_id <> 7 ORDER BY 2 DESC, 1 LIMIT 10) h LEFT JOIN m_media m ON m.id = h.key_id""")
def _(b):
    hits = X.with_iri(X.knn_like(keyed(b), MODEL, "7"), b.media)
    return hits.select("key_id", "iri", F.round("score", 6).alias("score"))


@query("v5_knn_children", f"""
SELECT h.key_id, m.iri AS owner, round(h.score, 6) AS score FROM (SELECT b.key_id, {COS} AS score FROM m_vectors b JOIN m_vectors a ON a.key_id = 3
  WHERE b.key_id <> 3 ORDER BY 2 DESC, 1 LIMIT 15) h JOIN m_media m ON m.n = h.key_id % 100 AND m.class = 'Image'""")
def _(b):
    owners = b.vectors.select("key_id", (F.col("key_id") % 100).alias("n")).join(
        b.media.filter("class = 'Image'").select("n", F.col("iri").alias("owner")), "n").select("key_id", "owner")
    hits = X.knn_children(b.vectors, owners, MODEL, 3, 15)
    return hits.select("key_id", "owner", F.round("score", 6).alias("score"))


@query("v6_knn_join", f"""
SELECT key_id, neighbour, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (
SELECT a.key_id, b.key_id AS neighbour, {COS} AS score, row_number() OVER (PARTITION BY a.key_id ORDER BY round({COS}, 12) DESC, b.key_id) AS rank
FROM m_vectors a JOIN m_vectors b ON a.key_id <> b.key_id) x WHERE rank <= 5""")
def _(b):
    return NB.knn_join(b.vectors, b.vectors, MODEL, 5, block=256).withColumn("score", F.round("score", 6))


GROUPS = """
WITH RECURSIVE pairs AS MATERIALIZED (SELECT a.key_id AS u, b.key_id AS v FROM m_vectors a JOIN m_vectors b ON a.key_id <> b.key_id WHERE {cos} >= {t}),
reach AS (SELECT key_id AS u, key_id AS v FROM m_vectors UNION SELECT r.u, p.v FROM reach r JOIN pairs p ON p.u = r.v)
SELECT u AS key_id, min(v) AS "group" FROM reach GROUP BY u"""


@query("v7_near_dups", GROUPS.format(cos=COS, t=0.43))
def _(b):
    return NB.near_dups(b.vectors, MODEL, 0.43, block=256)


@query("v9_group_faces", GROUPS.format(cos=COS, t=0.4))
def _(b):
    return NB.group_faces(b.vectors, MODEL, block=256)


V1 = "SELECT b.key_id, round({cos}, 6) AS score FROM {of} b JOIN m_vectors a ON a.key_id = 0 {where} ORDER BY {cos} DESC, b.key_id LIMIT {k}"


@query("v8_knn_approx", V1.format(cos=COS, of="m_vectors", where="", k=10))
def _(b):
    return scored(NB.knn_approx(NB.build_cells(b.vectors, MODEL), MODEL, query_vector(b), 10))


@query("v8_gated", V1.format(cos=COS, of="m_vectors", where="WHERE b.key_id % 97 = 5", k=10))
def _(b):
    gate = b.vectors.filter("key_id % 97 = 5").select("key_id")
    return scored(NB.knn_approx(NB.build_cells(b.vectors, MODEL), MODEL, query_vector(b), 10, gate=gate))


@query("v8_large_k", V1.format(cos=COS, of="m_vectors", where="", k=5000))
def _(b):
    return scored(NB.knn_approx(NB.build_cells(b.vectors, MODEL), MODEL, query_vector(b), 5000))


def recall(b, k=10):
    """Approximate against exact neighbours of every vector whose id is divisible by 20."""
    asked = b.vectors.filter("key_id % 20 = 0")
    index = NB.build_cells(b.vectors, MODEL)
    near = NB.knn_join_approx(index, asked, MODEL, k, probes=max(1, round(0.85 * len(index.centroids))))
    exact = NB.knn_join(asked, b.vectors, MODEL, k)
    both = near.join(exact.select("key_id", "neighbour"), ["key_id", "neighbour"])
    return (asked.agg((F.count("*") * k).alias("wanted")).crossJoin(near.agg(F.count("*").alias("given"))).crossJoin(  # three one-row tables
        both.agg(F.count("*").alias("found"))))


@query("v8_recall", "SELECT count(*) * 10 AS wanted, count(*) * 10 AS given, true AS recall_95 FROM m_vectors WHERE key_id % 20 = 0")
def _(b):
    return recall(b).select("wanted", "given", (F.col("found") >= 0.95 * F.col("wanted")).alias("recall_95"))


@query("v10_stored_vector", "SELECT key_id, round(list_sum(CAST(vec AS DOUBLE[])), 6) AS total, len(vec) AS dim FROM m_vectors WHERE key_id = 11")
def _(b):
    return X.stored_vector(b.vectors, MODEL, 11).select("key_id", F.expr(
        "round(aggregate(cast(vec AS array<double>), 0D, (a, x) -> a + x), 6)").alias("total"), F.size("vec").cast("bigint").alias("dim"))


@query("v11_all_vectors_since", f"""
SELECT v.key_id, array_to_string(list_transform(v.vec, lambda x: CAST(round(CAST(x AS DOUBLE) * 1000000) AS BIGINT)), ',') AS vec FROM m_vectors v JOIN m_refs r ON r.n = v.key_id AND r.link = 'vectorData'
AND CAST(r.created AS TIMESTAMPTZ) >= CAST('2024-01-12T05:00:00Z' AS TIMESTAMPTZ)""")
def _(b):
    keep = R.embedded_since(b.quads, MODEL, "2024-01-12T05:00:00Z").select(F.substring_index("s", "/", -1).alias("key_id"))
    return X.all_vectors(keyed(b), MODEL, keep).select(
        F.col("key_id").cast("bigint").alias("key_id"), micro("vec")).orderBy("key_id")


@query("v12_add_vectors", """
SELECT model, key_id, dim, given, CASE WHEN given <> dim THEN 'refused' WHEN model = 'emb-64' THEN 'present' ELSE 'added' END AS status FROM (
SELECT CASE WHEN label < 5 THEN 'emb-64' ELSE 'other' END AS model, key_id, CAST(64 AS INTEGER) AS dim,
  CAST(CASE WHEN label = 9 THEN 63 ELSE 64 END AS INTEGER) AS given FROM m_vectors) x""")
def _(b):
    new = b.vectors.select(F.expr("CASE WHEN label < 5 THEN 'emb-64' ELSE 'other' END").alias("model"), "key_id",
                           F.expr("CASE WHEN label = 9 THEN slice(vec, 1, 63) ELSE vec END").alias("vec"),
                           F.expr("CASE WHEN label = 9 THEN 1000000 ELSE 0 END + key_id").alias("seq"))
    return X.add_vectors(b.vectors, new)[1].drop("seq")


@query("v13_remove_vectors", "SELECT label, count(*) AS n FROM m_vectors WHERE key_id NOT IN (SELECT doc_id FROM labels) GROUP BY label")
def _(b):
    ids = b.table("labels").select(F.col("doc_id").alias("key_id"))
    return X.remove_vectors(b.vectors, ids).groupBy("label").agg(F.count("*").alias("n"))


def stored_files(b):
    """Vector files: those of every label but 3 are on disk."""
    return b.vectors.filter("label <> 3").select(F.format_string("vectorData/%d.npy", "key_id").alias("path"), "vec")


REBUILD = """
rows AS (SELECT r.id AS key_id, concat('vectorData/', r.id, '.npy') AS path, e.vec FROM m_refs r LEFT JOIN m_vectors e
  ON e.key_id = r.n AND e.label <> 3 WHERE r.link = 'vectorData')"""


@query("v14_rebuild_index", f"""
WITH {REBUILD}
SELECT key_id, len(vec) AS dim, array_to_string(list_transform(vec, lambda x: CAST(round(CAST(x AS DOUBLE) * 1000000) AS BIGINT)), ',') AS vec FROM rows WHERE vec IS NOT NULL""")
def _(b):
    return X.rebuild_index(b.quads, stored_files(b), MODEL)[0].select("key_id", F.size("vec").cast("bigint").alias("dim"), micro("vec"))


@query("v14_rebuild_report", f"""
WITH {REBUILD}
SELECT 'emb-64' AS "index", CAST(64 AS INTEGER) AS dim, count(vec) AS vectors, count(*) - count(vec) AS missing,
(SELECT string_agg(path, '|' ORDER BY key_id, path) FROM (SELECT key_id, path FROM rows WHERE vec IS NULL ORDER BY key_id, path LIMIT 20)) AS missing_sample, false AS refused FROM rows""")
def _(b):
    rep = X.rebuild_index(b.quads, stored_files(b), MODEL)[1]
    return rep.withColumn("missing_sample", F.array_join("missing_sample", "|"))


@query("v15_index_stats", "SELECT model, CAST(max(len(vec)) AS INTEGER) AS dim, count(*) AS count FROM m_vectors GROUP BY model")
def _(b):
    return X.index_stats(b.vectors)


@query("v18_model_gap", """
SELECT id, round(a, 6) AS a, round(b, 6) AS b, round(abs(a - b), 6) AS gap FROM (
SELECT id, CAST(width % 101 AS DOUBLE) AS a, CAST(length(text) % 97 AS DOUBLE) AS b FROM m_media WHERE class = 'Image') x""")
def _(b):
    im = b.media.filter("class = 'Image'")
    scores = im.select("id", F.explode(F.array(
        F.struct(F.lit("m1").alias("model"), (F.col("width") % 101).cast("double").alias("score")),
        F.struct(F.lit("m2").alias("model"), (F.length("text") % 97).cast("double").alias("score")))).alias("x")).select("id", "x.*")
    return X.model_gap(scores, "m1", "m2").select("id", F.round("a", 6).alias("a"), F.round("b", 6).alias("b"), F.round("gap", 6).alias("gap"))


@query("v13_remove_in_one_store", """
WITH x AS (SELECT s.store, v.key_id FROM m_vectors v, (VALUES ('a'), ('b')) s(store))
SELECT store, count(*) AS n FROM x WHERE NOT (store = 'a' AND key_id % 3 = 0) GROUP BY store""")
def _(b):
    two = b.vectors.withColumn("store", F.explode(F.array(F.lit("a"), F.lit("b"))))
    ids = b.vectors.filter("key_id % 3 = 0").select(F.lit("a").alias("store"), "key_id")
    return X.remove_vectors(two, ids).groupBy("store").agg(F.count("*").alias("n"))


@query("v12_add_in_two_stores", """
SELECT store, status, count(*) AS n FROM (SELECT s.store, CASE WHEN s.store = 'a' THEN 'present' ELSE 'added' END AS status
FROM m_vectors v, (VALUES ('a'), ('b')) s(store)) GROUP BY store, status""")
def _(b):
    have = b.vectors.withColumn("store", F.lit("a"))
    new = b.vectors.withColumn("store", F.explode(F.array(F.lit("a"), F.lit("b")))).withColumn("seq", F.col("key_id"))
    return X.add_vectors(have, new)[1].groupBy("store", "status").agg(F.count("*").alias("n"))


# ── two stores with equal ids ───────────────────────────────────────────────────────────────────────────────

TWO = "x AS (SELECT 'a' AS store, key_id, vec FROM m_vectors UNION ALL SELECT 'b', key_id, list_reverse(vec) FROM m_vectors)"
MICRO = "array_to_string(list_transform({v}, lambda x: CAST(round(CAST(x AS DOUBLE) * 1000000) AS BIGINT)), ',')"


def two_stores(b):
    """Store b has the ids of store a and other vectors."""
    mine = b.vectors.select("model", "key_id", "vec")
    return mine.withColumn("store", F.lit("a")).unionByName(mine.withColumns({"vec": F.reverse("vec"), "store": F.lit("b")}))


@query("v3_like_in_a_store", f"""
WITH {TWO} SELECT b.store, b.key_id, round({COS}, 6) AS score FROM x b JOIN x a ON a.store = 'b' AND a.key_id = 7
WHERE b.store = 'b' AND b.key_id <> 7 ORDER BY {COS} DESC, b.key_id LIMIT 10""")
def _(b):
    return X.knn_like(two_stores(b), MODEL, 7, store="b").select("store", "key_id", F.round("score", 6).alias("score"))


@query("v5_children_in_a_store", f"""
WITH {TWO} SELECT h.store, h.key_id, concat(h.store, '/', h.key_id % 100) AS owner, round(h.score, 6) AS score FROM (SELECT b.store, b.key_id, {COS} AS score
FROM x b JOIN x a ON a.store = 'b' AND a.key_id = 3 WHERE b.store = 'b' AND b.key_id <> 3 ORDER BY 3 DESC, 2 LIMIT 15) h WHERE h.key_id % 2 = 0""")
def _(b):
    owners = two_stores(b).filter("key_id % 2 = 0").select("store", "key_id", F.concat("store", F.lit("/"), F.col("key_id") % 100).alias("owner"))
    return X.knn_children(two_stores(b), owners, MODEL, 3, 15, store="b").select("store", "key_id", "owner", F.round("score", 6).alias("score"))


@query("v6_knn_join_two_stores", f"""
WITH {TWO} SELECT store, key_id, neighbour, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (
SELECT a.store, a.key_id, b.key_id AS neighbour, {COS} AS score, row_number() OVER (PARTITION BY a.store, a.key_id ORDER BY round({COS}, 12) DESC, b.key_id) AS rank
FROM x a JOIN x b ON a.key_id <> b.key_id AND a.store = b.store) y WHERE rank <= 3""")
def _(b):
    two = two_stores(b)
    return NB.knn_join(two, two, MODEL, 3, block=256).withColumn("score", F.round("score", 6))


@query("v7_near_dups_two_stores", """
WITH RECURSIVE {two}, pairs AS MATERIALIZED (SELECT a.store, a.key_id AS u, b.key_id AS v FROM x a JOIN x b ON a.key_id <> b.key_id AND a.store = b.store WHERE {cos} >= 0.43),
reach AS (SELECT store, key_id AS u, key_id AS v FROM x UNION SELECT r.store, r.u, p.v FROM reach r JOIN pairs p ON p.u = r.v AND p.store = r.store)
SELECT store, u AS key_id, min(v) AS "group" FROM reach GROUP BY store, u""".format(two=TWO, cos=COS))
def _(b):
    return NB.near_dups(two_stores(b), MODEL, 0.43, block=256)


@query("v10_stored_in_a_store", f"WITH {TWO} SELECT store, key_id, {MICRO.format(v='vec')} AS vec FROM x WHERE store = 'b' AND key_id = 11")
def _(b):
    return X.stored_vector(two_stores(b), MODEL, 11, "b").select("store", "key_id", micro("vec"))


@query("v12_first_fitting_row", f"""
SELECT key_id + 1000000 AS key_id, key_id * 2 + 1 AS seq, {MICRO.format(v='vec')} AS vec, 'refused,added,present' AS outcomes FROM m_vectors""")
def _(b):
    """Each new key comes three times: too short, as it is, reversed. The first is refused, the second stays."""
    came = F.array(F.struct(F.slice("vec", 1, 63).alias("vec"), F.lit(0).alias("more")), F.struct(F.col("vec"), F.lit(1).alias("more")),
                   F.struct(F.reverse("vec").alias("vec"), F.lit(2).alias("more")))
    new = b.vectors.select("model", (F.col("key_id") + 1000000).alias("key_id"), F.explode(came).alias("x")).select(
        "model", "key_id", "x.vec", (F.col("key_id") * 2 - 2000000 + F.when(F.col("x.more") == 2, 10_000_000).otherwise(F.col("x.more"))).alias("seq"))
    after, report = X.add_vectors(b.vectors, new)
    said = report.groupBy("key_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "status"))), lambda r: r["status"]), ",").alias("outcomes"))
    return X.in_order(after.filter("seq is not null")).select("key_id", "seq", micro("vec")).join(said, "key_id")


# ── neighbours without scanning cells, an index on disk ─────────────────────────────────────────────────────

@query("v6_knn_graph", "SELECT count(*) * 10 AS wanted, count(*) * 10 AS given, true AS recall_90, true AS exact_scores FROM m_vectors WHERE key_id % 20 = 0")
def _(b):
    """The graph's lists for every vector whose id is divisible by 20 against exact neighbours."""
    asked = b.vectors.filter("key_id % 20 = 0")
    near = NG.knn_graph(b.vectors, MODEL, 10).neighbours(10, queries=asked.select("key_id")).withColumnRenamed("score", "given_score")
    exact = NB.knn_join(asked, b.vectors, MODEL, 10)
    both = near.join(exact.select("key_id", "neighbour", "score"), ["key_id", "neighbour"], "left")
    found = both.agg(F.count("*").alias("given"), F.count("score").alias("found"),
                     F.coalesce(F.max(F.abs(F.col("score") - F.col("given_score"))) < 1e-9, F.lit(True)).alias("exact_scores"))
    return found.join(F.broadcast(asked.agg((F.count("*") * 10).alias("wanted"))), F.lit(True)).select(
        "wanted", "given", (F.col("found") >= 0.9 * F.col("wanted")).alias("recall_90"), "exact_scores")


PLANTED = """planted AS (SELECT key_id, vec FROM m_vectors UNION ALL
SELECT key_id + 1000000 * i, list_concat([vec[1] * (1 + 0.05 * i)], vec[2:64]) FROM m_vectors, range(1, 4) r(i) WHERE key_id % 5 = 0)"""


@query("v7_near_dups_banded", "WITH RECURSIVE " + PLANTED + """,
pairs AS MATERIALIZED (SELECT a.key_id AS u, b.key_id AS v FROM planted a JOIN planted b ON a.key_id <> b.key_id WHERE {cos} >= 0.9),
reach AS (SELECT key_id AS u, key_id AS v FROM planted UNION SELECT r.u, p.v FROM reach r JOIN pairs p ON p.u = r.v)
SELECT u AS key_id, min(v) AS "group" FROM reach GROUP BY u""".format(cos=COS))
def _(b):
    mine = b.vectors.select("model", "key_id", "vec")
    copies = mine.filter("key_id % 5 = 0").withColumn("i", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))).select(
        "model", (F.col("key_id") + 1000000 * F.col("i")).alias("key_id"),
        F.transform("vec", lambda x, at: F.when(at == 0, x * (1 + 0.05 * F.col("i"))).otherwise(x.cast("double")).cast("float")).alias("vec"))
    return NG.near_dups_banded(mine.unionByName(copies), MODEL, 0.9)


def kept_index(b):
    """(index, report): built on two stores, then rows added to one and keys removed from both; once a binding."""
    if hasattr(b, "kept_index"):
        return b.kept_index
    index = CI.write_index(two_stores(b), MODEL, fresh_dir(b.spark, "index"))
    new = b.vectors.filter("key_id % 7 = 0").select("model", F.lit("a").alias("store"), (F.col("key_id") + 1000000).alias("key_id"), F.col("key_id").alias("seq"),
                                                    F.when(F.col("key_id") % 2 == 0, F.reverse("vec")).otherwise(F.slice("vec", 1, 63)).alias("vec"))
    b.kept_index = index, index.update(new, b.vectors.filter("key_id % 5 = 0").select("key_id"))[1]
    return b.kept_index


@query("v8_stored_index", f"""
WITH {TWO}, after AS (SELECT store, key_id, vec FROM x WHERE key_id % 5 <> 0 UNION ALL
  SELECT 'a', key_id + 1000000, list_reverse(vec) FROM m_vectors WHERE key_id % 14 = 0)
SELECT 'a' AS store, * FROM ({V1.format(cos=COS, of="after", where="WHERE b.store = 'a'", k=10)}) UNION ALL
SELECT 'b' AS store, * FROM ({V1.format(cos=COS, of="after", where="WHERE b.store = 'b'", k=10)})""")
def _(b):
    index, q = kept_index(b)[0], query_vector(b)
    return index.search(q, 10, "a").unionByName(index.search(q, 10, "b")).select("store", "key_id", F.round("score", 6).alias("score"))


@query("v8_stored_index_report", """
SELECT 'a' AS store, key_id + 1000000 AS key_id, CASE WHEN key_id % 2 = 0 THEN 'added' ELSE 'refused' END AS status FROM m_vectors WHERE key_id % 7 = 0""")
def _(b):
    return kept_index(b)[1].select("store", "key_id", "status")


@query("v8_stored_index_cells", f"""
WITH {TWO} SELECT store, count(*) AS vectors, true AS within FROM (SELECT store, key_id FROM x WHERE key_id % 5 <> 0 UNION ALL
  SELECT 'a', key_id + 1000000 FROM m_vectors WHERE key_id % 14 = 0) y GROUP BY store""")
def _(b):
    """The cell table after an update: its counts are the rows', and no row lies outside its cell's radius."""
    index = kept_index(b)[0]
    away = CI._away(index.rows(), index.centroids()).groupBy(*CI.KEY).agg(F.count("*").alias("rows"), F.max("r").alias("r"))
    both = index.cells().join(away, CI.KEY)
    return both.groupBy("store").agg(F.sum("n").alias("vectors"), F.every((F.col("rows") == F.col("n")) & (F.coalesce("r", F.lit(0.0)) <= F.coalesce("radius", F.lit(0.0)) + 1e-9)).alias("within"))
