"""Registered graph-pattern queries."""

from pyspark.sql import functions as F

from catalograph import names as N
from catalograph.operators import patterns as P
from catalograph.plans.binding import G, M, TYPE, V
from catalograph.plans.registry import query

IMAGE = f"p = '{TYPE}' AND o = '{V}Image'"


@query("g1_pattern", f"SELECT store, s, o AS size FROM quads WHERE p = '{V}width'")
def _(b):
    return P.pattern(b.quads, "?s", "width", "?size")


@query("g1_repeated_variable", f"SELECT store, s FROM quads WHERE p = '{V}id' AND s = o AND o_kind = 'iri'")
def _(b):
    return P.pattern(b.quads, "?s", "id", "?s")


@query("g2_bgp", f"""
SELECT t.store, t.s AS img, m.o AS model, x.o AS rec FROM quads t
JOIN quads l ON l.store = t.store AND l.s = t.s AND l.p = '{V}poseData'
JOIN quads m ON m.store = t.store AND m.s = l.o AND m.p = '{V}model'
JOIN quads x ON x.store = t.store AND x.s = l.o AND x.p = '{V}item'
WHERE t.p = '{TYPE}' AND t.o = '{V}Image'""")
def _(b):
    return P.bgp(b.quads, [("?img", N.RDF_TYPE, "Image"), ("?img", "poseData", "?ref"), ("?ref", "model", "?model"),
                           ("?ref", "item", "?rec")]).select("store", "img", "model", "rec")


@query("g2_work_rows", f"""
SELECT t.store, t.s, a.o AS path, b.o AS type, c.o AS d FROM quads t
JOIN quads a ON a.store = t.store AND a.s = t.s AND a.p = '{V}mediaPath'
JOIN quads b ON b.store = t.store AND b.s = t.s AND b.p = '{V}mediaType'
JOIN quads c ON c.store = t.store AND c.s = t.s AND c.p = '{V}createdDate'
WHERE t.p = '{TYPE}' AND t.o = '{V}Image'""")
def _(b):
    return P.bgp(b.quads, [("?s", N.RDF_TYPE, "Image"), ("?s", "mediaPath", "?path"), ("?s", "mediaType", "?type"),
                           ("?s", "createdDate", "?d")])


@query("g3_optional", f"""
SELECT t.store, t.s, r.o AS rating FROM quads t
LEFT JOIN quads r ON r.store = t.store AND r.s = t.s AND r.p = '{V}rating' WHERE {IMAGE.replace('p =', 't.p =').replace('o =', 't.o =')}""")
def _(b):
    return P.optional(P.pattern(b.quads, "?s", N.RDF_TYPE, "Image"), P.pattern(b.quads, "?s", "rating", "?rating"))


@query("g4_union", f"""
SELECT store, s, o AS caption, CAST(NULL AS STRING) AS mark FROM quads WHERE p = '{V}shortCaption'
UNION ALL SELECT store, s, NULL, o FROM quads WHERE p = '{V}isPicked'""")
def _(b):
    return P.union(P.pattern(b.quads, "?s", "shortCaption", "?caption"), P.pattern(b.quads, "?s", "isPicked", "?mark"))


@query("g5_where_typed", f"""
SELECT store, s, o AS w FROM quads WHERE p = '{V}width' AND TRY_CAST(o AS BIGINT) >= 4000""")
def _(b):
    return P.where_typed(P.pattern(b.quads, "?s", "width", "?w"), "w", ">=", 4000, "bigint")


@query("g6_where_since", f"""
SELECT store, s, o AS u FROM quads WHERE p = '{V}updatedDate'
AND CAST(o AS TIMESTAMPTZ) >= CAST('2024-02-15T08:30:00+01:00' AS TIMESTAMPTZ)""")
def _(b):
    return P.where_since(P.pattern(b.quads, "?s", "updatedDate", "?u"), "u", "2024-02-15T08:30:00+01:00")


@query("g7_where_in", f"""
SELECT l.store, l.s, l.p, m.o AS m FROM quads l JOIN quads m ON m.store = l.store AND m.s = l.o AND m.p = '{V}model'
WHERE l.p IN ('{V}captionData', '{V}poseData')""")
def _(b):
    links = P.where_in(P.pattern(b.quads, "?s", "?p", "?e"), "p", [N.v("captionData"), N.v("poseData")])
    return P.join(links, P.pattern(b.quads, "?e", "model", "?m")).drop("e")


@query("g8_where_str", f"""
SELECT store, s, p, o FROM quads WHERE starts_with(s, '{M}Enrichment/') AND contains(p, 'ontology/cat/pro')""")
def _(b):
    return P.where_str(P.where_str(P.pattern(b.quads, "?s", "?p", "?o"), "s", starts=M + "Enrichment/"),
                       "p", contains="ontology/cat/pro")


@query("g9_not_exists", f"""
SELECT store, s FROM quads t WHERE {IMAGE} AND NOT EXISTS
(SELECT 1 FROM quads x WHERE x.store = t.store AND x.s = t.s AND x.p = '{V}poseData')""")
def _(b):
    return P.where_not_exists(P.pattern(b.quads, "?s", N.RDF_TYPE, "Image"), P.pattern(b.quads, "?s", "poseData", "?r"))


@query("g9_exists", f"""
SELECT store, s FROM quads t WHERE {IMAGE} AND EXISTS
(SELECT 1 FROM quads x WHERE x.store = t.store AND x.s = t.s AND x.p = '{V}relatedToId' AND x.o = '{M}ImageSet/src3')""")
def _(b):
    return P.where_exists(P.pattern(b.quads, "?s", N.RDF_TYPE, "Image"),
                          P.pattern(b.quads, "?s", "relatedToId", M + "ImageSet/src3"))


@query("g10_minus", f"""
SELECT store, s, o AS v FROM quads t WHERE p = '{V}rating' AND NOT EXISTS
(SELECT 1 FROM quads x WHERE x.store = t.store AND x.s = t.s AND x.p = '{V}isRejected')""")
def _(b):
    kept = P.minus(P.pattern(b.quads, "?s", "rating", "?v"), P.pattern(b.quads, "?s", "isRejected", "?j"))
    return P.minus(kept, P.pattern(b.quads, "?other", "isPicked", "?flag"))


@query("g11_distinct", "SELECT DISTINCT store, p FROM quads")
def _(b):
    return P.distinct(P.pattern(b.quads, "?s", "?p", "?o"), "store", "p")


@query("g12_count_distinct", f"""
SELECT t.store, count(DISTINCT t.s) AS n FROM quads t JOIN quads l ON l.store = t.store AND l.s = t.s AND l.p = '{V}poseData'
JOIN quads i ON i.store = l.store AND i.s = l.o AND i.p = '{V}item' WHERE t.p = '{TYPE}' AND t.o = '{V}Image' GROUP BY t.store""")
def _(b):
    return P.count_distinct(P.bgp(b.quads, [("?s", N.RDF_TYPE, "Image"), ("?s", "poseData", "?d"), ("?d", "item", "?i")]), "s")


@query("g13_aggregate", f"""
SELECT store, st, n, total, mean, lo, hi, one FROM (
SELECT x.store, x.o AS st, count(w.o) AS n, CAST(sum(TRY_CAST(w.o AS BIGINT)) AS BIGINT) AS total, round(avg(TRY_CAST(w.o AS BIGINT)), 6) AS mean,
  min(TRY_CAST(w.o AS BIGINT)) AS lo, max(TRY_CAST(w.o AS BIGINT)) AS hi, min(w.o) AS one
FROM quads x JOIN quads w ON w.store = x.store AND w.s = x.s AND w.p = '{V}width'
WHERE x.p = '{V}relatedToId' GROUP BY x.store, x.o) y WHERE n >= 5""")
def _(b):
    rows = P.bgp(b.quads, [("?s", "relatedToId", "?st"), ("?s", "width", "?w")])
    out = P.aggregate(rows, ["store", "st"], {
        "n": ("count", "w"), "total": ("sum", "w", "bigint"), "mean": ("avg", "w", "bigint"),
        "lo": ("min", "w", "bigint"), "hi": ("max", "w", "bigint"), "one": ("sample", "w")}, F.col("n") >= 5)
    return out.withColumn("mean", F.round("mean", 6))


@query("g13_group_concat", f"""
SELECT l.store, l.s, string_agg(DISTINCT m.o, ', ' ORDER BY m.o) AS models FROM quads l
JOIN quads m ON m.store = l.store AND m.s = l.o AND m.p = '{V}model'
WHERE l.p IN ('{V}captionData', '{V}poseData', '{V}vectorData') GROUP BY l.store, l.s""")
def _(b):
    links = P.where_in(P.pattern(b.quads, "?s", "?p", "?e"), "p", [N.v(x) for x in ("captionData", "poseData", "vectorData")])
    rows = P.join(links, P.pattern(b.quads, "?e", "model", "?m"))
    return P.aggregate(rows, ["store", "s"], {"models": ("group_concat", "m", ", ")})


@query("g14_order", f"""
SELECT store, s, u FROM (SELECT store, s, o AS u FROM quads WHERE p = '{V}updatedDate')
ORDER BY CAST(u AS TIMESTAMPTZ), s, store""")
def _(b):
    return P.order(P.pattern(b.quads, "?s", "updatedDate", "?u"), [("u", "asc"), ("s", "asc"), ("store", "asc")], instants=("u",))


@query("g15_slice", f"""
SELECT store, s, d FROM (SELECT store, s, o AS d FROM quads WHERE p = '{V}createdDate') ORDER BY d DESC, s, store LIMIT 20 OFFSET 10""")
def _(b):
    return P.slice_rows(P.pattern(b.quads, "?s", "createdDate", "?d"), [("d", "desc"), ("s", "asc"), ("store", "asc")], 20, 10)


@query("g16_ask", f"SELECT count(*) > 0 AS answer FROM quads WHERE p = '{V}rating' AND o = '5'")
def _(b):
    return P.ask(P.pattern(b.quads, "?s", "rating", P.literal("5")))


@query("g17_graph", f"SELECT store, s, g FROM quads WHERE p = '{V}isPicked' AND o = 'true' AND g = '{G}'")
def _(b):
    return P.join(P.pattern(b.quads, "?s", "isPicked", P.literal("true"), N.GRAPH),
                  P.pattern(b.quads, "?s", "isPicked", P.literal("true"), "?g"))


@query("g18_construct", f"""
WITH rows AS (SELECT l.store, l.s, l.o AS r, m.o AS m FROM quads l JOIN quads m ON m.store = l.store AND m.s = l.o AND m.p = '{V}model'
  WHERE l.p = '{V}captionData')
SELECT DISTINCT * FROM (
SELECT store, r AS s, '{V}of' AS p, s AS o, 'iri' AS o_kind FROM rows
UNION ALL SELECT store, s, '{V}describedBy', m, 'literal' FROM rows)""")
def _(b):
    rows = P.bgp(b.quads, [("?s", "captionData", "?r"), ("?r", "model", "?m")])
    return P.construct(rows, [("?r", "of", "?s"), ("?s", "describedBy", "?m")])


@query("g19_describe", f"""
WITH all_quads AS MATERIALIZED (SELECT * FROM quads), picked AS MATERIALIZED (SELECT DISTINCT store, s FROM all_quads WHERE p = '{V}isRejected')
SELECT q.* FROM all_quads q SEMI JOIN picked x ON x.store = q.store AND x.s = q.s""")
def _(b):
    return P.describe(b.quads, P.pattern(b.quads, "?s", "isRejected", "?o").select("store", "s"))


@query("g20_bind_values", f"""
SELECT r.store, r.s, r.o AS v, CAST(r.o AS BIGINT) * 20 AS pct FROM quads r WHERE r.p = '{V}rating' AND r.o IN ('3', '4', '5')""")
def _(b):
    rows = P.values(P.pattern(b.quads, "?s", "rating", "?v"), "v", ["3", "4", "5"])
    return P.bind(rows, "pct", F.col("v").try_cast("bigint") * 20)


@query("g21_path", f"""
WITH pairs AS (SELECT store, s, o FROM quads WHERE p = '{V}captionData' UNION ALL SELECT store, s, o FROM quads WHERE p = '{V}poseData')
SELECT i.store, i.o AS s, a.s AS o FROM pairs a JOIN quads i ON i.store = a.store AND i.s = a.o AND i.p = '{V}item'""")
def _(b):
    return P.path(b.quads, ("^", ("/", ("|", "captionData", "poseData"), "item")))


@query("g22_closure", f"""
WITH RECURSIVE edges AS (SELECT DISTINCT store, s, o FROM quads WHERE p = '{V}relatedToId' AND starts_with(o, '{M}Image/')),
walk AS (SELECT store, s, o, CAST(1 AS INTEGER) AS depth FROM edges
  UNION SELECT w.store, w.s, e.o, w.depth + 1 FROM walk w JOIN edges e ON e.store = w.store AND e.s = w.o)
SELECT store, s, o, min(depth) AS depth FROM walk GROUP BY store, s, o""")
def _(b):
    edges = P.where_str(P.pattern(b.quads, "?s", "relatedToId", "?o"), "o", starts=M + "Image/")
    return P.closure(edges)


@query("g23_resolve", f"""
SELECT event_id, CASE event_type WHEN 'click' THEN '{V}click' WHEN 'view' THEN '{N.DC}view'
  WHEN 'error' THEN 'urn:x:error' ELSE concat('{V}', event_type) END AS iri FROM events""")
def _(b):
    named = b.table("events").select("event_id", F.expr(
        "CASE event_type WHEN 'click' THEN 'cat:click' WHEN 'view' THEN 'dc:view' WHEN 'error' THEN 'urn:x:error' "
        "ELSE event_type END").alias("name"))
    return P.resolve_names(named, "name").drop("name")


@query("g24_delete_where", f"""
SELECT p, count(*) AS n FROM quads q WHERE NOT (p = '{V}vectorData') AND NOT EXISTS
(SELECT 1 FROM quads x WHERE x.store = q.store AND x.o = q.s AND x.p = '{V}vectorData') GROUP BY p""")
def _(b):
    links = b.quads.filter(F.col("p") == N.v("vectorData"))
    left = P.delete_where(P.delete_where(b.quads, links), links.select("store", F.col("o").alias("s")))
    return left.groupBy("p").agg(F.count("*").alias("n"))


@query("g25_insert", f"""
SELECT p, count(*) AS n FROM (SELECT DISTINCT store, s, p, o, o_kind, dt, g FROM (
  SELECT * FROM quads UNION ALL SELECT store, s, '{V}sceneObjects', o, 'literal', NULL, g FROM quads WHERE p = '{N.DC}subject'))
GROUP BY p""")
def _(b):
    new = b.quads.filter(F.col("p") == N.DC + "subject").withColumn("p", F.lit(N.v("sceneObjects")))
    return P.insert(b.quads, new).groupBy("p").agg(F.count("*").alias("n"))
