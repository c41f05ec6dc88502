"""Registered reads."""

from pyspark.sql import functions as F

from catalograph import names as N
from catalograph.operators import patterns as P, reads as R
from catalograph.plans.binding import M, TYPE, V
from catalograph.plans.registry import query

WORK = f"""
work AS (SELECT *, n % 4 <> 0 AS has_long, CASE WHEN n % 11 = 0 THEN updated END AS complete FROM m_media WHERE class = 'Image')"""


def work(b):
    """Media rows as the work list reads them."""
    return b.media.select("store", "id", "n", "iri", "class", "media_path", "media_type", "created",
                          F.expr("short_caption IS NOT NULL").alias("has_long_caption"),
                          F.expr("n % 4 <> 0").alias("has_scene_objects"),
                          F.expr("CASE WHEN n % 11 = 0 THEN updated END").alias("complete"))


@query("r1_facts", f"""
SELECT q.store, q.s, q.p, string_agg(q.o, '|' ORDER BY q.o) AS values, count(*) AS n FROM quads q
WHERE EXISTS (SELECT 1 FROM quads x WHERE x.store = q.store AND x.s = q.s AND x.p = '{V}isPicked') GROUP BY q.store, q.s, q.p""")
def _(b):
    nodes = P.pattern(b.quads, "?s", "isPicked", "?o").select("store", "s")
    return R.facts(b.quads, nodes).withColumn("n", F.size("values").cast("bigint")).withColumn(
        "values", F.array_join("values", "|"))


WIDE = ["mediaPath", "mediaType", "createdDate", "updatedDate", "width", "longCaption", "rating", "isPicked", "isRejected"]


@query("r2_media_table", f"""
SELECT store, s, replace(max(CASE WHEN p = '{TYPE}' THEN o END), '{V}', '') AS class,
{', '.join(f"min(CASE WHEN p = '{V}{f}' THEN o END) AS {f}" for f in WIDE)}
FROM quads GROUP BY store, s HAVING max(CASE WHEN p = '{TYPE}' THEN o END) IN ('{V}Image', '{V}Video', '{V}Media')""")
def _(b):
    return R.media_table(b.quads, WIDE)


@query("r3_media_state", f"""
WITH runs AS (SELECT l.store, l.s, l.p, m.o AS model FROM quads l JOIN quads m ON m.store = l.store AND m.s = l.o AND m.p = '{V}model'),
one AS (SELECT store, s, p, min(o) AS o FROM quads GROUP BY store, s, p)
SELECT t.store, t.s, a.o AS mediaType, b.o AS createdDate, c.o AS enrichmentCompleteDate, d.o IS NOT NULL AS thumbnail,
{', '.join(f"coalesce((SELECT string_agg(DISTINCT model, ',' ORDER BY model) FROM runs r WHERE r.store = t.store AND r.s = t.s AND r.p = '{V}{x}'), '') AS {x}" for x in N.LINKS)}
FROM quads t LEFT JOIN one a ON a.store = t.store AND a.s = t.s AND a.p = '{V}mediaType'
LEFT JOIN one b ON b.store = t.store AND b.s = t.s AND b.p = '{V}createdDate'
LEFT JOIN one c ON c.store = t.store AND c.s = t.s AND c.p = '{V}enrichmentCompleteDate'
LEFT JOIN one d ON d.store = t.store AND d.s = t.s AND d.p = '{V}thumbnail'
WHERE t.p = '{TYPE}' AND t.o IN ('{V}Image', '{V}Video')""")
def _(b):
    st = R.media_state(b.quads)
    return st.select(*[F.array_join(c, ",").alias(c) if c in N.LINKS else c for c in st.columns])


STAGES = {"embed": ("emb-64", True), "caption": ("cap-b", True), "pose": ("pose-a", False)}


@query("r4_stage_status", f"""
WITH runs AS (SELECT l.store, l.s, replace(l.p, '{V}', '') AS link, m.o AS model FROM quads l JOIN quads m ON m.store = l.store AND m.s = l.o AND m.p = '{V}model'
  WHERE l.p IN ('{V}captionData', '{V}poseData', '{V}vectorData', '{V}regionData')),
last AS (SELECT id, stage, arg_max_null(status, event_id) AS status, arg_max_null(error, event_id) AS error FROM m_calls GROUP BY id, stage),
st AS (SELECT m.store, m.iri AS s, m.id, x.stage, x.link, x.model, x.enabled, x.configured FROM m_media m CROSS JOIN
  (VALUES ('embed', 'vectorData', 'emb-64', true, true), ('caption', 'captionData', 'cap-b', true, true),
          ('pose', 'poseData', 'pose-a', false, true), ('segment', 'regionData', NULL, false, false)) x(stage, link, model, enabled, configured)),
j AS (SELECT st.*, EXISTS (SELECT 1 FROM runs r WHERE r.store = st.store AND r.s = st.s AND r.link = st.link AND r.model = st.model) AS done,
  (SELECT count(*) FROM runs r WHERE r.store = st.store AND r.s = st.s AND r.link = st.link) AS n,
  l.error AS e, l.status AS code FROM st LEFT JOIN last l ON l.id = st.id AND l.stage = st.stage AND l.status IS DISTINCT FROM 200)
SELECT store, s, stage, status, n, CASE WHEN status = 'holding' THEN e END AS error,
  CASE WHEN status = 'holding' THEN coalesce(code IN (422, 404), false) END AS terminal FROM (
SELECT *, CASE WHEN NOT configured THEN CASE WHEN n > 0 THEN 'done' ELSE 'off' END WHEN done THEN 'done'
  WHEN NOT enabled THEN 'off' WHEN e IS NOT NULL THEN 'holding' ELSE 'pending' END AS status FROM j) z""")
def _(b):
    outcomes = b.calls.join(b.media.select("id", F.col("store").alias("st"), "iri"), "id").select(
        F.col("st").alias("store"), F.col("iri").alias("s"), "stage", F.col("ts").alias("at"), F.col("event_id").alias("seq"),
        F.expr("coalesce(status = 200, false)").alias("ok"), "error", F.expr("coalesce(status IN (422, 404), false)").alias("terminal"))
    return R.stage_status(R.media_state(b.quads), STAGES, R.attempts(outcomes)).withColumn(
        "n", F.size("models").cast("bigint")).drop("models")


@query("r5_pending", f"""
WITH {WORK}
SELECT store, id, iri, media_path, media_type, created FROM work w WHERE created >= '2024-01-10' AND has_long AND NOT EXISTS
(SELECT 1 FROM m_refs r WHERE r.store = w.store AND r.iri = w.iri AND r.link = 'vectorData' AND r.model = 'emb-64')
ORDER BY created DESC, iri, store LIMIT 96""")
def _(b):
    return R.pending(work(b), b.refs, "vectorData", "emb-64", 96, "2024-01-10")


@query("r5_pending_all", f"""
WITH {WORK}
SELECT store, id, iri, media_path, media_type, created FROM work w WHERE NOT EXISTS
(SELECT 1 FROM m_refs r WHERE r.store = w.store AND r.iri = w.iri AND r.link = 'poseData' AND r.model = 'pose-a')""")
def _(b):
    return R.pending(work(b), b.refs, "poseData", "pose-a")


REQUIRED = [("captionData", "cap-a"), ("poseData", "pose-a"), ("vectorData", "emb-64")]


@query("r6_complete_candidates", f"""
WITH {WORK}
SELECT store, id, iri, created FROM work w WHERE complete IS NULL AND 3 = (SELECT count(DISTINCT r.link) FROM m_refs r
  WHERE r.store = w.store AND r.iri = w.iri AND (r.link, r.model) IN (('captionData', 'cap-a'), ('poseData', 'pose-a'), ('vectorData', 'emb-64')))""")
def _(b):
    return R.complete_candidates(work(b), b.refs, REQUIRED)


OUTCOMES = """
outcomes AS (SELECT m.store, m.iri, c.stage, c.ts, c.event_id, coalesce(c.status = 200, false) AS ok, c.error FROM m_calls c JOIN m_media m ON m.id = c.id)"""


def outcomes(b):
    return b.calls.join(b.media.select("id", F.col("store").alias("st"), "iri"), "id").select(
        F.col("st").alias("store"), F.col("iri").alias("s"), "stage", F.col("ts").alias("at"), F.col("event_id").alias("seq"),
        F.expr("coalesce(status = 200, false)").alias("ok"), "error", F.expr("coalesce(status IN (422, 404), false)").alias("terminal"))


@query("r7_next_batch", f"""
WITH {WORK}, {OUTCOMES},
last AS (SELECT store, iri, arg_max(ok, event_id) AS ok, max(ts) AS at FROM outcomes WHERE stage = 'pose' GROUP BY store, iri),
asked AS (SELECT store, id, iri, media_path, media_type, created FROM work w WHERE NOT EXISTS
  (SELECT 1 FROM m_refs r WHERE r.store = w.store AND r.iri = w.iri AND r.link = 'poseData' AND r.model = 'pose-a')
  ORDER BY created DESC, iri, store LIMIT 96)
SELECT * FROM asked a WHERE NOT EXISTS (SELECT 1 FROM last l WHERE l.store = a.store AND l.iri = a.iri AND NOT l.ok
  AND l.at > TIMESTAMP '2024-01-29 00:00:00') ORDER BY created DESC, iri, store LIMIT 24""")
def _(b):
    held = R.holding(R.attempts(outcomes(b).filter("stage = 'pose'")), F.lit("2024-01-30 00:00:00").cast("timestamp"), 86_400)
    held = held.select("store", F.col("s").alias("iri"))
    return R.next_batch(R.pending(work(b), b.refs, "poseData", "pose-a"), held)


@query("r8_attempts", f"""
WITH {OUTCOMES}
SELECT store, iri AS s, stage, error, strftime(last_at, '%Y-%m-%d %H:%M:%S') AS "at", last_at > TIMESTAMP '2024-01-30 23:00:00' - INTERVAL 600 SECOND AS held FROM
(SELECT store, iri, stage, arg_max(ok, event_id) AS ok, arg_max_null(error, event_id) AS error, max(ts) AS last_at FROM outcomes GROUP BY store, iri, stage)
WHERE NOT ok""")
def _(b):
    last = R.attempts(outcomes(b))
    held = R.holding(last, F.lit("2024-01-30 23:00:00").cast("timestamp")).select("store", "s", "stage", F.lit(True).alias("held"))
    return last.join(held, ["store", "s", "stage"], "left").select(
        "store", "s", "stage", "error", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("at"), F.coalesce("held", F.lit(False)).alias("held"))


CHANGES = f"""
SELECT m.store, m.iri, m.updated, coalesce(CAST(m.rating AS BIGINT), 0) AS rating, coalesce(m.quality = 1, false) AS is_picked,
  coalesce(m.toxic = 1, false) AS is_rejected FROM m_media m WHERE m.class = 'Image' AND m.n % 7 <> 0"""


@query("r9_changes", f"""{CHANGES} AND CAST(m.updated AS TIMESTAMPTZ) >= CAST('2024-02-10T00:00:00+02:00' AS TIMESTAMPTZ)""")
def _(b):
    return R.in_feed_order(R.changes(b.quads, "2024-02-10T00:00:00+02:00"))


@query("r9_changes_all", CHANGES)
def _(b):
    return R.changes(b.quads)


@query("r9_cursor", """
SELECT strftime(least(max(ts), max(CASE WHEN event_type = 'error' THEN ts END)), '%Y-%m-%d %H:%M:%S') AS snapshot FROM events""")
def _(b):
    late = b.table("events").agg(F.max(F.expr("CASE WHEN event_type = 'error' THEN ts END")).alias("at"), F.max("ts").alias("now"))
    return R.cursor(late, F.max("now")).select(F.date_format("snapshot", "yyyy-MM-dd HH:mm:ss").alias("snapshot"))


@query("r10_embedded_since", f"""
SELECT DISTINCT store, iri AS s FROM m_refs WHERE link = 'vectorData' AND model = 'emb-64'
AND CAST(created AS TIMESTAMPTZ) >= CAST('2024-01-12T05:00:00Z' AS TIMESTAMPTZ)""")
def _(b):
    return R.embedded_since(b.quads, "emb-64", "2024-01-12T05:00:00Z")


@query("r12_counts", f"""
SELECT m.store, count(*) AS images, count(*) FILTER (WHERE width > 500) AS thumbnails,
{', '.join(f"count(*) FILTER (WHERE EXISTS (SELECT 1 FROM m_records r WHERE r.store = m.store AND r.iri = m.iri AND r.link = '{x}')) AS {n}" for n, x in R.COUNTED.items() if n != 'thumbnails')}
FROM m_media m WHERE class = 'Image' GROUP BY m.store""")
def _(b):
    return R.counts(b.quads)


@query("r13_locate", """
SELECT id, count(DISTINCT store) AS stores, CASE WHEN count(DISTINCT store) = 1 THEN min(store) END AS store FROM
(SELECT store, id FROM m_media UNION ALL SELECT 'web001', CAST(page_id AS STRING) FROM pages) GROUP BY id""")
def _(b):
    ids = b.media.select("store", "id").unionByName(
        b.table("pages").select(F.lit("web001").alias("store"), F.col("page_id").cast("string").alias("id")))
    return R.locate(ids)
