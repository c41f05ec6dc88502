"""Registered fact maintenance and set queries."""

from pyspark.sql import functions as F

from catalograph import names as N
from catalograph.operators import facts as D, patterns as P, sets as C
from catalograph.plans.binding import G, M, TYPE, V
from catalograph.plans.registry import query
from catalograph.session import fresh_dir
from catalograph.sources import snapshots as SN

NOW = "2024-06-01T12:00:00+02:00"
DT = "coalesce(dt, '') AS dt"


STATE_ROWS = 500_000  # rows of a task that counts subjects, at some 250 bytes each


def by_predicate(q, rows):
    """The whole next state, by predicate: rows and a content checksum that SQL can repeat. Subjects hardly fold before they meet, so the `rows` of
    the table are dealt to tasks of bounded size first."""
    parts = max(int(q.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // STATE_ROWS))
    return q.repartition(parts, "p", "store", "s").groupBy("p").agg(F.count("*").alias("n"), F.sum(F.length("o").cast("bigint")).alias("chars"),
                              F.count_distinct("store", "s").alias("subjects"))


STATE = "SELECT p, count(*) AS n, CAST(sum(length(o)) AS BIGINT) AS chars, count(DISTINCT (store, s)) AS subjects FROM {t} GROUP BY p"

JUDGED = f"""
judged AS (SELECT *, CASE
  WHEN key = 'rating' THEN CASE WHEN CAST(value AS INTEGER) BETWEEN 0 AND 5 THEN value END
  WHEN key = 'isPicked' THEN replace(value, '"', '')
  WHEN key = 'imageAestheticScore' THEN CASE WHEN CAST(replace(value, '"', '') AS INTEGER) BETWEEN 0 AND 100 THEN replace(value, '"', '') END
  WHEN key = 'mediaCreatedDate' THEN CASE WHEN value <> '"yesterday"' THEN replace(value, '"', '') END
  ELSE replace(value, '"', '') END AS o,
  CASE key WHEN 'rating' THEN '{N.XSD}integer' WHEN 'imageAestheticScore' THEN '{N.XSD}integer' WHEN 'isPicked' THEN '{N.XSD}boolean'
    WHEN 'mediaCreatedDate' THEN '{N.XSD}dateTime' END AS dt FROM m_edits),
report AS (SELECT request, count(*) AS rows, CASE WHEN count(*) = count(o) THEN 'done' ELSE 'refused' END AS status FROM judged GROUP BY request),
last AS (SELECT store, s, key, arg_max(o, seq) AS o, arg_max_null(dt, seq) AS dt FROM judged j WHERE EXISTS
  (SELECT 1 FROM report r WHERE r.request = j.request AND status = 'done') GROUP BY store, s, key)"""


@query("d10_set_fields", f"WITH {JUDGED} SELECT store, s, concat('{V}', key) AS p, o, {DT} FROM last")
def _(b):
    return D.set_fields(b.quads, b.edits).added.select("store", "s", "p", "o", F.coalesce("dt", F.lit("")).alias("dt"))


@query("d10_set_report", f"WITH {JUDGED} SELECT * FROM report")
def _(b):
    return D.set_fields(b.quads, b.edits).report.select("request", "rows", "status")


@query("d10_set_state", f"""WITH {JUDGED},
after AS (SELECT store, s, p, o FROM quads q WHERE NOT EXISTS (SELECT 1 FROM last l WHERE l.store = q.store AND l.s = q.s AND concat('{V}', l.key) = q.p)
  UNION ALL SELECT store, s, concat('{V}', key), o FROM last) {STATE.format(t='after')}""")
def _(b):
    return by_predicate(D.set_fields(b.quads, b.edits).apply(b.quads), b.quads.count())


LINK_EDITS = f"""
links AS (SELECT e.event_id AS seq, CAST(e.event_id AS STRING) AS request, m.store, m.iri AS s, m.class, m.source, CASE e.event_type
  WHEN 'click' THEN concat('<cat/ImageSet/', m.source, '>') WHEN 'view' THEN '<cat/ImageSet/src1>' WHEN 'signup' THEN '<cat/VideoSet/src1>'
  WHEN 'purchase' THEN concat('<cat/Image/', m.id, '>') ELSE '<other/Moment/x1>' END AS target FROM events e JOIN m_media m ON m.n = e.user_id),
known AS (SELECT store, iri, class FROM m_media UNION ALL SELECT store, iri, class FROM m_sets),
judged AS (SELECT l.*, concat('{N.BASE}', replace(replace(l.target, '<', ''), '>', '')) AS node, k.class AS tc FROM links l
  LEFT JOIN known k ON k.store = l.store AND k.iri = concat('{N.BASE}', replace(replace(l.target, '<', ''), '>', ''))),
reasons AS (SELECT *, CASE WHEN NOT starts_with(node, '{M}') THEN 'outside this catalogue' WHEN node = s THEN 'the media itself'
  WHEN tc IS NULL THEN 'no such thing in this store' WHEN (tc = 'ImageSet' AND class <> 'Image') OR (tc = 'VideoSet' AND class <> 'Video') THEN 'wrong kind of set' END AS reason FROM judged)"""


def link_edits(b):
    return b.table("events").join(b.media, F.col("n") == F.col("user_id")).select(
        F.col("event_id").alias("seq"), F.col("event_id").cast("string").alias("request"), "store", F.col("iri").alias("s"), F.expr(
            """CASE event_type WHEN 'click' THEN concat('<cat/ImageSet/', source, '>') WHEN 'view' THEN '<cat/ImageSet/src1>'
            WHEN 'signup' THEN '<cat/VideoSet/src1>' WHEN 'purchase' THEN concat('<cat/Image/', id, '>') ELSE '<other/Moment/x1>' END""").alias("target"))


@query("d11_add_links", f"""WITH {LINK_EDITS}
SELECT DISTINCT store, s, node AS o FROM reasons r WHERE reason IS NULL AND NOT EXISTS (SELECT 1 FROM quads q WHERE q.store = r.store AND q.s = r.s AND q.p = '{V}relatedToId' AND q.o = r.node)""")
def _(b):
    edits = link_edits(b).withColumn("value", F.concat(F.lit('"'), "target", F.lit('"')))
    return D.add_links(b.quads, edits).added.select("store", "s", "o")


@query("d11_link_report", f"WITH {LINK_EDITS} SELECT request, reason FROM reasons")
def _(b):
    edits = link_edits(b).withColumn("value", F.concat(F.lit('["'), "target", F.lit('"]')))
    return D.add_links(b.quads, edits).report.select("request", "reason")


UNSET = f"""
edits AS (SELECT e.event_id, CAST(e.event_id AS STRING) AS request, m.store, m.iri AS s, m.source, CASE e.event_type WHEN 'click' THEN 'rating' WHEN 'view' THEN 'sceneObjects'
  WHEN 'signup' THEN 'relatedToId' WHEN 'purchase' THEN concat('relatedToId=<cat/ImageSet/', m.source, '>') ELSE 'duration' END AS field
  FROM events e JOIN m_media m ON m.n = e.user_id)"""


def unset_edits(b):
    return b.table("events").join(b.media, F.col("n") == F.col("user_id")).select(
        F.col("event_id").cast("string").alias("request"), "store", F.col("iri").alias("s"), F.expr(
            """CASE event_type WHEN 'click' THEN 'rating' WHEN 'view' THEN 'sceneObjects' WHEN 'signup' THEN 'relatedToId'
            WHEN 'purchase' THEN concat('relatedToId=<cat/ImageSet/', source, '>') ELSE 'duration' END""").alias("field"))


@query("d12_unset_fields", f"""WITH {UNSET},
after AS (SELECT * FROM quads q WHERE NOT EXISTS (SELECT 1 FROM edits e WHERE e.store = q.store AND e.s = q.s AND e.field IN ('rating', 'sceneObjects') AND concat('{V}', e.field) = q.p)
 AND NOT EXISTS (SELECT 1 FROM edits e WHERE e.store = q.store AND e.s = q.s AND starts_with(e.field, 'relatedToId=') AND q.p = '{V}relatedToId' AND q.o = concat('{M}ImageSet/', e.source)))
{STATE.format(t='after')}""")
def _(b):
    return by_predicate(D.unset_fields(b.quads, unset_edits(b)).apply(b.quads), b.quads.count())


@query("d12_unset_report", f"""WITH {UNSET}
SELECT request, CASE field WHEN 'relatedToId' THEN 'say which link' WHEN 'duration' THEN 'not settable' END AS reason FROM edits""")
def _(b):
    return D.unset_fields(b.quads, unset_edits(b)).report.select("request", "reason")


def parsed(b):
    """Parsed answers for every image: captions, objects and two scene fields."""
    return b.media.filter("class = 'Image'").select(
        "store", F.col("iri").alias("s"), F.col("lang").alias("short_caption"), F.lit(None).cast("string").alias("long_caption"),
        F.when(F.col("n") % 2 == 0, "prompts/p1.md").alias("prompt_path"), F.array("lang", "source").alias("objects"),
        F.array(F.struct(F.lit("sceneMood").alias("k"), F.col("source").alias("v"))).alias("scene"))


@query("d13_set_perception", f"""
WITH im AS (SELECT * FROM m_media WHERE class = 'Image'),
after AS (SELECT store, s, p, o FROM quads q WHERE NOT (p IN ({', '.join(f"'{V}{f}'" for f in N.PERCEPTION_FIELDS)}) AND EXISTS (SELECT 1 FROM im WHERE im.store = q.store AND im.iri = q.s))
 UNION ALL SELECT store, iri, '{V}shortCaption', lang FROM im UNION ALL SELECT store, iri, '{V}longCaption', '' FROM im
 UNION ALL SELECT store, iri, '{V}modelPromptPath', 'prompts/p1.md' FROM im WHERE n % 2 = 0
 UNION ALL SELECT store, iri, '{V}sceneObjects', lang FROM im UNION ALL SELECT store, iri, '{V}sceneObjects', source FROM im
 UNION ALL SELECT store, iri, '{V}sceneMood', source FROM im) {STATE.format(t='after')}""")
def _(b):
    return by_predicate(D.set_perception(b.quads, parsed(b)).apply(b.quads), b.quads.count())


STATEMENTS = f"""
stated AS (SELECT DISTINCT m.store, m.iri AS media, c.role AS block, m.iri AS s, '{N.DC}subject' AS p, CASE WHEN c.role = 'user' THEN m.source ELSE c.role END AS o
  FROM conversations c JOIN m_media m ON m.n = c.conv_id)"""


@query("d8_add_statements", f"""WITH {STATEMENTS}
SELECT store, media, count(DISTINCT o) AS statements, count(DISTINCT CASE WHEN NOT EXISTS (SELECT 1 FROM quads q WHERE q.store = t.store AND q.s = t.s AND q.p = t.p AND q.o = t.o) THEN o END) AS inserted,
count(DISTINCT block) AS descriptions FROM stated t GROUP BY store, media""")
def _(b):
    rows = b.table("conversations").join(b.media, F.col("n") == F.col("conv_id")).select(
        F.col("iri").alias("media"), F.col("role").alias("block"), *D.quad(
            F.col("store"), F.col("iri"), N.DC + "subject", F.expr("CASE WHEN role = 'user' THEN source ELSE role END")))
    return D.add_statements(b.quads, rows).report


@query("d9_describe", f"""
SELECT DISTINCT m.store, m.iri AS s, '{V}description' AS p, l.o FROM labels b JOIN m_media m ON m.n = b.doc_id
CROSS JOIN LATERAL (SELECT concat('quality ', CAST(b.quality AS STRING)) AS o UNION ALL SELECT concat('toxic ', CAST(b.toxic AS STRING))) l""")
def _(b):
    facts = b.table("labels").join(b.media.select("store", "iri", F.col("n").alias("doc_id")), "doc_id").select(
        "store", F.col("iri").alias("s"), F.lit("description").alias("name"),
        F.array(F.concat(F.lit("quality "), F.col("quality").cast("string")), F.concat(F.lit("toxic "), F.col("toxic").cast("string"))).alias("values"))
    return D.describe_facts(b.quads, facts).added.select("store", "s", "p", "o")


def labelled(b):
    return b.table("labels").join(b.media.select("store", F.col("iri").alias("s"), F.col("n").alias("doc_id")), "doc_id")


LABELLED = "lab AS (SELECT m.store, m.iri AS s, m.n, b.quality, b.toxic FROM labels b JOIN m_media m ON m.n = b.doc_id)"


@query("d23_touch", f"""WITH {LABELLED},
after AS (SELECT store, s, o FROM quads q WHERE p = '{V}updatedDate' AND NOT EXISTS (SELECT 1 FROM lab WHERE lab.store = q.store AND lab.s = q.s)
  UNION ALL SELECT store, s, '{NOW}' FROM lab) SELECT store, s, o FROM after""")
def _(b):
    after = D.touch(b.quads, labelled(b), NOW).apply(b.quads)
    return after.filter(F.col("p") == N.v("updatedDate")).select("store", "s", "o")


@query("d24_mark_complete", f"""WITH {LABELLED}
SELECT store, s FROM lab WHERE n % 11 <> 0""")
def _(b):
    return D.mark_complete(b.quads, labelled(b), NOW).report


OWNED = f"""
owned AS (SELECT r.store, r.iri AS media, r.link, r.ref AS s, 'ref' AS role FROM m_refs r
  UNION ALL SELECT x.store, x.iri, x.link, x.rec, 'item' FROM m_records x
  UNION ALL SELECT store, iri, 'thumbnail', concat('{M}Thumbnail/t', id), 'ref' FROM m_media WHERE class = 'Image' AND width > 500),
files AS (SELECT DISTINCT o.store, o.media, o.link, q.o AS path FROM owned o JOIN quads q ON q.store = o.store AND q.s = o.s
  AND q.p IN ('{V}path', '{V}modelReplyPath', '{V}vectorPath', '{V}depthMapPath', '{V}overlayPath', '{V}maskPath'))"""


@query("d25_forget", f"""WITH {LABELLED}, {OWNED}
SELECT l.store, l.s AS media,
 (SELECT count(*) FROM owned o JOIN quads q ON q.store = o.store AND q.s = o.s WHERE o.store = l.store AND o.media = l.s AND o.link = 'captionData')
 + CASE WHEN EXISTS (SELECT 1 FROM owned o WHERE o.store = l.store AND o.media = l.s AND o.link = 'captionData') THEN
   (SELECT count(*) FROM quads q WHERE q.store = l.store AND q.s = l.s AND q.p IN ('{V}captionData', '{V}enrichmentCompleteDate')) ELSE 0 END AS facts_removed,
 (SELECT count(*) FROM files f WHERE f.store = l.store AND f.media = l.s AND f.link = 'captionData') AS files_removed FROM lab l""")
def _(b):
    return D.forget(b.quads, labelled(b), "captionData")[0].report


@query("d25_forget_vectors", f"""WITH {LABELLED} SELECT DISTINCT l.store, r.id AS key_id FROM lab l JOIN m_refs r ON r.store = l.store AND r.iri = l.s AND r.link = 'vectorData'""")
def _(b):
    return D.forget(b.quads, labelled(b), "vectorData")[1]


@query("d26_delete_media", f"""WITH {LABELLED}, {OWNED},
targets AS (SELECT store, s FROM lab WHERE toxic = 1 UNION SELECT o.store, o.s FROM owned o JOIN lab l ON l.store = o.store AND l.s = o.media AND l.toxic = 1),
after AS (SELECT * FROM quads q WHERE NOT EXISTS (SELECT 1 FROM targets t WHERE t.store = q.store AND t.s = q.s)) {STATE.format(t='after')}""")
def _(b):
    change, _ = D.delete_media(b.quads, labelled(b).filter("toxic = 1"))
    return by_predicate(change.apply(b.quads), b.quads.count())


@query("d26_delete_report", f"""WITH {LABELLED}, {OWNED}
SELECT l.store, l.s AS media, (SELECT count(*) FROM quads q WHERE q.store = l.store AND q.s = l.s)
 + (SELECT count(*) FROM owned o JOIN quads q ON q.store = o.store AND q.s = o.s WHERE o.store = l.store AND o.media = l.s) AS facts,
 1 + (SELECT count(*) FROM files f WHERE f.store = l.store AND f.media = l.s) AS files FROM lab l WHERE toxic = 1""")
def _(b):
    return D.delete_media(b.quads, labelled(b).filter("toxic = 1"))[0].report


@query("d27_wipe", f"""WITH {OWNED},
after AS (SELECT * FROM quads q WHERE p <> '{V}vectorData' AND NOT EXISTS (SELECT 1 FROM owned o WHERE o.link = 'vectorData' AND o.store = q.store AND o.s = q.s)) {STATE.format(t='after')}""")
def _(b):
    return by_predicate(D.wipe(b.quads).apply(b.quads), b.quads.count())


@query("d28_unset_everywhere", f"SELECT store, count(DISTINCT s) AS subjects, count(*) AS facts FROM quads WHERE p = '{V}enrichmentCompleteDate' GROUP BY store")
def _(b):
    return D.unset_everywhere(b.quads, "enrichmentCompleteDate").report


@query("d28_state", f"""WITH after AS (SELECT * FROM quads WHERE p <> '{V}enrichmentCompleteDate') {STATE.format(t='after')}""")
def _(b):
    return by_predicate(D.unset_everywhere(b.quads, "enrichmentCompleteDate").apply(b.quads), b.quads.count())


NEW_DC = "http://purl.org/dc/terms/"


@query("d29_rename_ns", f"""
SELECT store, s, CASE WHEN starts_with(p, '{N.DC}') THEN concat('{NEW_DC}', substr(p, {len(N.DC) + 1})) ELSE p END AS p,
CASE WHEN o_kind = 'iri' AND starts_with(o, '{N.DC}') THEN concat('{NEW_DC}', substr(o, {len(N.DC) + 1})) ELSE o END AS o FROM quads
WHERE starts_with(p, '{N.DC}') OR (o_kind = 'iri' AND starts_with(o, '{N.DC}'))""")
def _(b):
    return D.rename_ns(b.quads, N.DC, NEW_DC).added.select("store", "s", "p", "o")


@query("d29_state", f"""
WITH after AS (SELECT DISTINCT store, s, CASE WHEN starts_with(p, '{N.DC}') THEN concat('{NEW_DC}', substr(p, {len(N.DC) + 1})) ELSE p END AS p,
CASE WHEN o_kind = 'iri' AND starts_with(o, '{N.DC}') THEN concat('{NEW_DC}', substr(o, {len(N.DC) + 1})) ELSE o END AS o, o_kind, dt, g FROM quads) {STATE.format(t='after')}""")
def _(b):
    return by_predicate(D.rename_ns(b.quads, N.DC, NEW_DC).apply(b.quads), b.quads.count())


def committed(b, change):
    """The table as readers see it after the change was committed by predicate to a snapshot of all facts."""
    root = fresh_dir(b.spark, "committed")
    SN.write_snapshot(b.quads, root)
    SN.commit(b.spark, root, change)
    after = SN.read_snapshot(b.spark, root)
    return by_predicate(after, after.count())


@query("d28_commit", f"""WITH after AS (SELECT * FROM quads WHERE p <> '{V}enrichmentCompleteDate') {STATE.format(t='after')}""")
def _(b):
    return committed(b, D.unset_everywhere(b.quads, "enrichmentCompleteDate"))


@query("d29_commit", f"""
WITH after AS (SELECT DISTINCT store, s, CASE WHEN starts_with(p, '{N.DC}') THEN concat('{NEW_DC}', substr(p, {len(N.DC) + 1})) ELSE p END AS p,
CASE WHEN o_kind = 'iri' AND starts_with(o, '{N.DC}') THEN concat('{NEW_DC}', substr(o, {len(N.DC) + 1})) ELSE o END AS o, o_kind, dt, g FROM quads) {STATE.format(t='after')}""")
def _(b):
    return committed(b, D.rename_ns(b.quads, N.DC, NEW_DC))


@query("d29_rename_report", f"""
SELECT q.store, count(DISTINCT CASE WHEN m.class = 'Image' THEN q.s END) AS images, count(*) AS facts FROM quads q LEFT JOIN m_media m ON m.store = q.store AND m.iri = q.s
WHERE starts_with(p, '{N.DC}') OR (o_kind = 'iri' AND starts_with(o, '{N.DC}')) GROUP BY q.store""")
def _(b):
    return D.rename_ns(b.quads, N.DC, NEW_DC).report


# ── sets ────────────────────────────────────────────────────────────────────────────────────────────────────

@query("c1_list_sets", "SELECT store, class, id, iri, created, created AS updated, description FROM m_sets WHERE class = 'ImageSet'")
def _(b):
    return C.list_sets(b.quads, "ImageSet")


@query("c2_members", "SELECT store, iri AS member FROM m_media WHERE class = 'Image' AND source = 'src3' AND store = 'en0001'")
def _(b):
    return C.members(b.quads, "en0001", M + "ImageSet/src3")


@query("c2_member_counts", "SELECT s.store, s.iri, count(m.id) AS members FROM m_sets s LEFT JOIN m_media m ON m.store = s.store AND m.source = s.id AND concat(m.class, 'Set') = s.class GROUP BY s.store, s.iri")
def _(b):
    return C.member_counts(b.quads)


@query("c3_create_sets", f"""
WITH asked AS (SELECT 'en0001' AS store, CASE WHEN p_size % 5 = 0 THEN p_name WHEN p_size % 5 = 1 THEN 'src3' WHEN p_size % 5 = 2 THEN CAST(p_partkey AS STRING) ELSE concat('part-', CAST(p_size AS STRING), '-', CAST(CAST(floor(p_partkey / 2) AS BIGINT) AS STRING)) END AS id FROM part),
n AS (SELECT store, id, count(*) AS times FROM asked GROUP BY store, id),
taken AS (SELECT store, id FROM m_media UNION SELECT store, id FROM m_sets)
SELECT store, 'ImageSet' AS class, id, CASE WHEN NOT regexp_full_match(id, '[A-Za-z0-9_-]{{1,200}}') THEN 'invalid id'
 WHEN EXISTS (SELECT 1 FROM taken t WHERE t.store = n.store AND t.id = n.id) THEN 'taken' ELSE 'made' END AS status, times - 1 AS refused FROM n""")
def _(b):
    new = b.table("part").select(F.lit("en0001").alias("store"), F.lit("ImageSet").alias("class"), F.expr(
        """CASE WHEN p_size % 5 = 0 THEN p_name WHEN p_size % 5 = 1 THEN 'src3' WHEN p_size % 5 = 2 THEN CAST(p_partkey AS STRING)
        ELSE concat('part-', CAST(p_size AS STRING), '-', CAST(CAST(p_partkey AS DOUBLE) / 2 AS BIGINT)) END""").alias("id"), F.lit(" ").alias("description"))
    return C.create_sets(b.quads, new, NOW).report


@query("c4_add_members", f"""WITH {LINK_EDITS}
SELECT DISTINCT store, s, target, CASE WHEN reason IS NULL AND tc NOT IN ('ImageSet', 'VideoSet') THEN 'not a set' ELSE coalesce(reason, 'ok') END AS status FROM reasons""")
def _(b):
    return C.add_members(b.quads, link_edits(b).select("store", "s", "target").dropDuplicates()).report


@query("c5_remove_members", f"SELECT store, concat('{M}ImageSet/', source) AS o, count(*) AS removed FROM m_media WHERE class = 'Image' AND lang = 'en' GROUP BY store, source")
def _(b):
    pairs = b.media.filter("lang = 'en'").select("store", F.col("iri").alias("s"), F.concat(F.lit(M + "ImageSet/"), "source").alias("iri"))
    return C.remove_members(b.quads, pairs).report


@query("c6_delete_set", f"SELECT m.store, concat('{M}ImageSet/', source) AS iri, m.iri AS member FROM m_media m WHERE class = 'Image' AND source IN ('src1', 'src12')")
def _(b):
    doomed = b.sets.filter("class = 'ImageSet' AND id IN ('src1', 'src12')").select("store", "iri")
    return C.delete_set(b.quads, doomed).report


@query("c8_reload_sets", f"""
WITH f AS (SELECT * FROM m_sets WHERE class = 'ImageSet'),
after AS (SELECT store, s, p, o FROM quads q WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.store = q.store AND f.iri = q.s)
 UNION ALL SELECT store, iri, '{TYPE}', concat('{V}', class) FROM f UNION ALL SELECT store, iri, '{V}id', iri FROM f
 UNION ALL SELECT store, iri, '{V}createdDate', created FROM f UNION ALL SELECT store, iri, '{V}description', 'as filed' FROM f) {STATE.format(t='after')}""")
def _(b):
    files = b.sets.filter("class = 'ImageSet'").select("store", "class", "id", "created", F.lit(None).cast("string").alias("updated"), F.lit("as filed").alias("description"))
    return by_predicate(C.reload_sets(b.quads, files).apply(b.quads), b.quads.count())


@query("r9_version_feed", f"""WITH {JUDGED},
had AS (SELECT store, iri, n, updated, coalesce(CAST(rating AS BIGINT), 0) AS r, coalesce(quality = 1, false) AS p, coalesce(toxic = 1, false) AS j FROM m_media WHERE class = 'Image' AND n % 7 <> 0),
has AS (SELECT had.*, coalesce(CAST(a.o AS BIGINT), r) AS r1, coalesce(b.o = 'true', p) AS p1 FROM had LEFT JOIN last a ON a.store = had.store AND a.s = had.iri AND a.key = 'rating'
  LEFT JOIN last b ON b.store = had.store AND b.s = had.iri AND b.key = 'isPicked')
SELECT store, iri, updated, r1 AS rating, p1 AS is_picked, j AS is_rejected, false AS removed FROM has WHERE n % 13 <> 0 AND (r1 <> r OR p1 <> p)
UNION ALL SELECT store, iri, NULL, NULL, NULL, NULL, true FROM has WHERE n % 13 = 0""")
def _(b):
    """Two commits, edits and removed media; the feed is read off the versions before and after."""
    root = fresh_dir(b.spark, "feed")
    first = SN.write_snapshot(b.quads, root)
    SN.commit(b.spark, root, D.set_fields(b.quads, b.edits))
    gone = b.media.filter("n % 13 = 0").select("store", F.col("iri").alias("s"))
    last = SN.commit(b.spark, root, D.Change(None, gone, gone))
    return SN.feed(b.spark, root, first, last)
