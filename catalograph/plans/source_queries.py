"""Registered sources, sinks, scalar functions and streams."""

from datetime import date

from functools import reduce

from pyspark.sql import functions as F

from catalograph import names as N
from catalograph.functions import geometry as GEO, text as T
from catalograph.operators import analytics as A, reads as R, vectors as X
from catalograph.plans.binding import G, M, TYPE, V
from catalograph.plans.read_queries import REQUIRED
from catalograph.plans.registry import query
from catalograph.plans.run_queries import arrivals
from catalograph.plans.vector_queries import micro
from catalograph.session import fresh_dir
from catalograph.sources import exports as E, files as FI, nquads as NQ, tables as TB
from catalograph.streaming import streams as ST

# ── sources and sinks ───────────────────────────────────────────────────────────────────────────────────────


@query("s1_s2_nquads_round_trip", "SELECT store, s, p, o, o_kind, coalesce(dt, '') AS dt, g FROM quads")
def _(b):
    """The whole graph written as N-Quads, a folder per store, and read back."""
    out = fresh_dir(b.spark, "nquads")
    NQ.write_nquads(b.quads.withColumnRenamed("store", "st"), out, ("st",))
    lines = b.spark.read.text(out)
    return NQ.parse_lines(lines, store=F.col("st")).drop("st").withColumn("dt", F.coalesce("dt", F.lit("")))


@query("s1_read_files", "SELECT store, count(*) AS n, CAST(sum(length(o)) AS BIGINT) AS chars, count(DISTINCT p) AS preds FROM quads GROUP BY store")
def _(b):
    """Record files of each store read through the reader, store by store."""
    stores = [r.store for r in b.quads.select("store").distinct().collect()]  # a handful
    out = fresh_dir(b.spark, "records")
    NQ.write_nquads(b.quads.withColumnRenamed("store", "st"), out, ("st",))
    every = reduce(lambda x, y: x.unionByName(y), [NQ.read_nquads(b.spark, f"{out}/st={s}", s) for s in stores])
    return every.groupBy("store").agg(F.count("*").alias("n"), F.sum(F.length("o").cast("bigint")).alias("chars"), F.count_distinct("p").alias("preds"))


@query("s12_arriving_files", "SELECT 'web001' AS store, CAST(sum(strlen(text) + 1) AS BIGINT) AS bytes, true AS dated FROM documents")
def _(b):
    """Every document's text written out as files and read as arrivals."""
    out = fresh_dir(b.spark, "arriving")
    b.table("documents").select("text").write.text(out)
    rows = FI.arrivals(b.spark, out, "web001", stream=False)
    return rows.groupBy("store").agg(F.sum(F.length("content").cast("bigint")).alias("bytes"), F.min(F.col("created").isNotNull() & (F.col("batch") == "files")).alias("dated"))


@query("s2_ntriples", f"SELECT concat('<', s, '> <', p, '> \"', o, '\"', CASE WHEN dt IS NULL THEN '' ELSE concat('^^<', dt, '>') END, ' .') AS value FROM quads WHERE p IN ('{V}rating', '{V}width')")
def _(b):
    out = fresh_dir(b.spark, "ntriples")
    NQ.write_ntriples(b.quads.filter(F.col("p").isin(N.v("rating"), N.v("width"))), out)
    return b.spark.read.text(out)


@query("s3_media_paths", """
SELECT media_path AS path, 'source' AS role, CASE WHEN class = 'Video' THEN 'video' ELSE 'image' END AS kind, concat('2024-01-', lpad(CAST(1 + n % 28 AS STRING), 2, '0')) AS day, id, CASE WHEN class = 'Video' THEN 'mp4' ELSE 'png' END AS ext, CAST(NULL AS STRING) AS model FROM m_media
UNION ALL SELECT concat('image/enrichment/embed/2024/01/02/20240102-030405-', id, '.embed.emb-64.npy'), 'enrichment', 'image', '2024-01-02', id, 'npy', 'emb-64' FROM m_media""")
def _(b):
    paths = b.media.select(F.explode(F.array("media_path", F.concat(F.lit("image/enrichment/embed/2024/01/02/20240102-030405-"), "id", F.lit(".embed.emb-64.npy")))).alias("path"))
    return FI.parse_media_path(paths).select("path", "role", "kind", "day", "id", "ext", "model")


@query("s4_decode_npy", "SELECT key_id, array_to_string(list_transform(vec, lambda x: CAST(round(CAST(x AS DOUBLE) * 1000000) AS BIGINT)), ',') AS vec, len(vec) AS dim FROM m_vectors")
def _(b):
    """Stored vectors as `.npy` bytes, decoded."""
    header = "{'descr': '<f4', 'fortran_order': False, 'shape': (64,), }".ljust(117) + "\n"
    le = E.packed(F.lit(""), F.col("vec"))
    npy = F.concat(F.unhex(F.lit("934E554D5059" + "0100" + len(header).to_bytes(2, "little").hex())), F.lit(header).cast("binary"), F.substring(le, 2, 1 << 30))
    back = b.vectors.select("key_id", FI.decode_npy(npy).alias("vec"))
    return back.select("key_id", micro("vec"), F.size("vec").cast("bigint").alias("dim"))


@query("s5_export_ndjson", f"SELECT concat('<cat/Image/', id, '>') AS id, len(vec) AS dim, round(list_sum(CAST(vec AS DOUBLE[])), 5) AS total FROM m_vectors v JOIN m_media m ON m.n = v.key_id WHERE m.class = 'Image'")
def _(b):
    out = fresh_dir(b.spark, "export")
    rows = b.vectors.join(b.media.filter("class = 'Image'").select(F.col("n").alias("key_id"), "iri"), "key_id")
    E.export_vectors(rows, out)
    x = F.from_json("value", "id string, vector array<float>")
    return b.spark.read.text(out).select(x.alias("x")).select("x.id", F.size("x.vector").cast("bigint").alias("dim"), F.expr(
        "round(aggregate(cast(x.vector AS array<double>), 0D, (a, y) -> a + y), 5)").alias("total"))


@query("s6_export_packed", "SELECT key_id, 1 + length(CAST(key_id AS STRING)) + 4 * len(vec) AS f32_bytes, 1 + length(CAST(key_id AS STRING)) + 2 * len(vec) AS f16_bytes FROM m_vectors")
def _(b):
    k = F.col("key_id").cast("string")
    both = b.vectors.select("key_id", E.packed(k, F.col("vec")).alias("a"), E.packed(k, F.col("vec"), "f16").alias("c"))
    return both.select("key_id", F.length("a").cast("bigint").alias("f32_bytes"), F.length("c").cast("bigint").alias("f16_bytes"))


def logged(b):
    return b.calls.select(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("time"), "store", "id", "stage", F.lit("m").alias("model"), F.lit("u").alias("url"),
                          "request_bytes", "status", "latency_ms", "error")


@query("s7_s8_call_log", "SELECT strftime(ts, '%Y-%m-%d') AS day, stage, count(*) AS n, CAST(sum(latency_ms) AS BIGINT) AS latency_ms FROM m_calls WHERE date_diff('day', CAST(ts AS DATE), DATE '2024-01-30') <= 10 GROUP BY 1, 2")
def _(b):
    out = fresh_dir(b.spark, "calls")
    TB.write_calls(logged(b), out)
    kept = TB.retain(TB.read_calls(b.spark, out), date(2024, 1, 30), 10)
    return kept.groupBy("day", "stage").agg(F.count("*").alias("n"), F.sum("latency_ms").alias("latency_ms"))


@query("s9_set_files", "SELECT store, class, id, created, created AS updated, description FROM m_sets")
def _(b):
    from catalograph.operators.sets import set_quads

    """Every set of every store and class, written as files and loaded again."""
    keys = b.sets.select("store", "class").distinct().collect()  # a handful of stores and classes
    out = fresh_dir(b.spark, "sets")
    q = set_quads(b.sets.withColumn("updated", F.col("created")))
    lines = q.select("store", F.regexp_extract("s", "/([^/]+)/[^/]+$", 1).alias("class"), F.substring_index("s", "/", -1).alias("id"), NQ.nquads_line().alias("value"))
    lines.write.partitionBy("store", "class", "id").text(out)
    texts = b.spark.read.text(out).select("store", "class", F.concat("id", F.lit(".nq")).alias("file"), "value")
    loaded = [FI.sets_from_lines(texts.filter((F.col("store") == k.store) & (F.col("class") == k["class"])).select("file", "value"), k["class"], k.store) for k in keys]
    return reduce(lambda x, y: x.unionByName(y), loaded)


@query("s10_ontology", """
SELECT concat('prop', CAST(p_partkey AS STRING)) AS local, CASE WHEN p_size % 3 = 0 THEN 'Image' WHEN p_size % 3 = 1 THEN 'Media' ELSE 'Pose' END AS domain,
CASE WHEN p_size % 2 = 0 THEN 'integer' ELSE concat('Range', CAST(p_partkey AS STRING)) END AS range, CASE WHEN p_size % 2 = 1 THEN CAST(0 AS BIGINT) END AS lo,
CASE WHEN p_size % 2 = 1 THEN CAST(p_size AS BIGINT) END AS hi, p_size % 3 < 2 AS settable FROM part""")
def _(b):
    """A vocabulary with a property, and for half of them a bounded range, per part."""
    out = fresh_dir(b.spark, "ontology")
    b.table("part").select(F.expr(r"""concat('# part\ncat:prop', p_partkey, ' a owl:DatatypeProperty ;\n    rdfs:domain cat:', CASE p_size % 3 WHEN 0 THEN 'Image' WHEN 1 THEN 'Media' ELSE 'Pose' END,
      ' ;\n    rdfs:range ', CASE WHEN p_size % 2 = 0 THEN 'xsd:integer' ELSE concat('cat:Range', p_partkey) END, ' .\n',
      CASE WHEN p_size % 2 = 1 THEN concat('\ncat:Range', p_partkey, ' a rdfs:Datatype ;\n    owl:withRestrictions ( [ xsd:minInclusive 0 ] [ xsd:maxInclusive ', p_size, ' ] ) .\n') ELSE '' END)""")).write.text(out)
    return TB.load_ontology(b.spark, out)


@query("s11_ledger", "SELECT status, count(*) AS n, count(DISTINCT source_path) AS paths FROM (SELECT concat('src, \"', CAST(user_id AS STRING), '\".png') AS source_path, event_type AS status FROM events) x GROUP BY status")
def _(b):
    out = fresh_dir(b.spark, "ledger")
    rows = b.table("events").select(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("when"), F.col("event_type").alias("status"),
                                    F.concat(F.lit('src, "'), "user_id", F.lit('".png')).alias("source_path"))
    TB.append_ledger(rows, out)
    return TB.read_ledger(b.spark, out).groupBy("status").agg(F.count("*").alias("n"), F.count_distinct("source_path").alias("paths"))


# ── scalar functions ────────────────────────────────────────────────────────────────────────────────────────

@query("f1_f3_identities", f"SELECT store, iri, id AS bare, concat('<cat/', class, '/', id, '>') AS bracket, iri AS back FROM m_media")
def _(b):
    br = T.bracket_iri(F.col("iri"))
    return b.media.select("store", "iri", T.bare_id(F.concat(F.lit(" "), br, F.lit(" "))).alias("bare"), br.alias("bracket"), T.iri_from_bracket(br).alias("back"))


@query("f4_f6_names", """
SELECT url, split_part(url, '/', 3) AS host, CASE WHEN page_id % 3 = 0 THEN 'Image' WHEN page_id % 3 = 1 THEN 'Video' ELSE 'Media' END AS class,
CASE WHEN page_id % 3 = 0 THEN 'image' WHEN page_id % 3 = 1 THEN 'video' ELSE 'other' END AS kind, regexp_full_match(split_part(url, '/', 3), '[A-Za-z0-9_-]{1,200}') AS id_ok,
regexp_full_match(split_part(url, '/', 3), '[A-Za-z0-9._-]{1,128}') AS index_ok, lower(substr(split_part(url, '/', 3), 1, 6)) AS store FROM pages""")
def _(b):
    host = F.split_part("url", F.lit("/"), F.lit(3))
    mime = F.expr("CASE page_id % 3 WHEN 0 THEN 'image/webp' WHEN 1 THEN 'video/mp4' ELSE 'text/html' END")
    return b.table("pages").select("url", host.alias("host"), T.media_class(mime).alias("class"), T.media_kind(mime).alias("kind"), T.valid_id(host).alias("id_ok"),
                                   T.valid_index_name(host).alias("index_ok"), T.store_id(F.concat(F.lit("  "), F.upper(host))).alias("store"))


@query("f7_model_label", """
SELECT p_partkey, label, regexp_full_match(label, '[a-z0-9]+(-[a-z0-9]+)*') AS ok FROM (SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS label FROM part) x""")
def _(b):
    label = T.model_label(F.concat(F.lit("vendor/"), "p_name"))
    return b.table("part").select("p_partkey", label.alias("label"), T.valid_model_label(label).alias("ok"))


@query("f9_paths", r"""
SELECT store, id, concat('image/img/source/', replace(substr(created, 1, 10), '-', '/'), '/', replace(substr(created, 1, 10), '-', ''), '-', replace(substr(created, 12, 8), ':', ''), '-', id, '.png') AS source,
concat(CASE WHEN class = 'Video' THEN 'video' ELSE 'image' END, '/enrichment/pose/', replace(substr(created, 1, 10), '-', '/'), '/', regexp_replace(regexp_extract(media_path, '[^/]*$'), '\.[^.]*$', ''), '.pose.a-b.nq') AS enrichment FROM m_media""")
def _(b):
    return b.media.select("store", "id", T.media_path(F.lit("image"), F.col("created"), F.col("id"), F.lit("png")).alias("source"),
                          T.enrichment_path(F.col("media_path"), F.col("created"), F.lit("pose"), F.lit("a/b"), F.lit("nq")).alias("enrichment"))


@query("f10_path_segment", "SELECT page_id, url_encode(url) AS segment FROM pages")
def _(b):
    return b.table("pages").select("page_id", T.path_segment(F.col("url")).alias("segment"))


@query("f11_instants", "SELECT store, id, strftime(CAST(created AS TIMESTAMPTZ) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS at, true AS zoned, false AS bare FROM m_media".replace(" AS at,", ' AS "at",'))
def _(b):
    c = F.col("created")
    return b.media.select("store", "id", F.date_format(T.instant(c), "yyyy-MM-dd HH:mm:ss").alias("at"), T.is_zoned_date(c).alias("zoned"),
                          T.is_zoned_date(F.substring(c, 1, 19)).alias("bare"))


@query("f12_geometry", """
SELECT event_id, concat(regexp_replace(regexp_replace(printf('%.2f', value), '0+$', ''), '\\.$', ''), ',', CAST(user_id AS STRING), ',1;0.5,2,0.125') AS text, CAST(2 AS BIGINT) AS points, round(value, 2) AS x FROM events""")
def _(b):
    pts = F.array(F.array(F.col("value"), F.col("user_id").cast("double"), F.lit(1.0)), F.array(F.lit(0.5), F.lit(2.0), F.lit(0.125)))
    text = GEO.points_text(pts)
    back = GEO.parse_points(text)
    return b.table("events").select("event_id", text.alias("text"), F.size(back).cast("bigint").alias("points"), F.round(back[0][0], 2).alias("x"))


@query("f13_f14_file_names", """
SELECT event_id, strftime(date_trunc('second', ts) - INTERVAL 7 HOUR, '%Y-%m-%dT%H:%M:%S-07:00') AS made, CAST(NULL AS STRING) AS bad, concat(event_type, '-', CAST(user_id AS STRING), '-bare') AS set_id, event_type AS by_pattern FROM events""")
def _(b):
    ev = b.table("events")
    stem = F.concat(F.date_format("ts", "yyyyMMdd-HHmmss"), F.lit("-"), F.lpad(F.lower(F.hex("event_id")), 8, "0"))
    name = F.concat(F.initcap("event_type"), F.lit("__"), "user_id", F.lit("_bare__s"), "event_id")
    return ev.select("event_id", T.date_from_name(stem, "America/Phoenix").alias("made"), T.date_from_name(name, "UTC").alias("bad"),
                     T.set_from_name(name).alias("set_id"), T.set_from_name(name, ("[0-9]+_(.*)", "([A-Za-z]+)__")).alias("by_pattern"))


@query("f17_mime_types", """
SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'image/jpeg' WHEN 1 THEN 'image/png' WHEN 2 THEN 'video/mp4' WHEN 3 THEN 'video/quicktime' WHEN 4 THEN 'image/webp' ELSE 'application/octet-stream' END AS mime FROM pages""")
def _(b):
    ext = F.expr("CASE page_id % 6 WHEN 0 THEN '.JPeg' WHEN 1 THEN '.png' WHEN 2 THEN '.m4v' WHEN 3 THEN '.MOV' WHEN 4 THEN '.webp' ELSE '' END")
    return b.table("pages").select("page_id", T.mime_of(F.concat(F.lit("a.b/file"), "page_id", ext)).alias("mime"))


# ── streams ─────────────────────────────────────────────────────────────────────────────────────────────────

def streamed(b, df, parts=3):
    """A table replayed as a stream of `parts` files, one file a micro-batch."""
    src = fresh_dir(b.spark, "feed")
    df.repartition(parts).write.parquet(src)
    return ST.stream_session(b.spark).readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)


def landed(b, stream, mode="append"):
    out = fresh_dir(b.spark, "sink")
    ST.run_to_end(stream, out, mode)
    return b.spark.read.parquet(out)


@query("t1_ingest_stream", f"""
SELECT CASE WHEN (page_id % 7 = 0 AND page_id % 5 NOT IN (0, 1)) OR (page_id % 7 = 1 AND page_id % 5 NOT IN (2, 3)) THEN 'rejected' ELSE 'stored' END AS status, count(*) AS media FROM pages GROUP BY 1""")
def _(b):
    """Pages of one address are files of their own: the page number tells them apart."""
    out, feed = fresh_dir(b.spark, "ingest"), streamed(b, arrivals(b).withColumnRenamed("page_id", "item"))
    none = feed.sparkSession.createDataFrame([], N.QUAD_SCHEMA)
    ST.ingest_stream(feed, lambda: none, out, fresh_dir(b.spark, "ckpt")).awaitTermination()
    stored = b.spark.read.parquet(f"{out}/quads").filter(F.col("p") == N.v("mediaPath")).agg(F.lit("stored").alias("status"), F.count_distinct("s").alias("media"))
    rejected = b.spark.read.parquet(f"{out}/rejects").agg(F.lit("rejected").alias("status"), F.count("*").alias("media"))
    return stored.unionByName(rejected)


@query("t2_live_work", """
SELECT store, iri, created FROM m_media m WHERE class = 'Image' AND n % 4 <> 0 AND NOT EXISTS (SELECT 1 FROM m_refs r WHERE r.store = m.store AND r.iri = m.iri AND r.link = 'vectorData' AND r.model = 'emb-64')""")
def _(b):
    media = b.media.filter("class = 'Image'").select("store", "iri", F.explode(F.expr(
        "filter(array(struct('image' AS kind, created AS text), CASE WHEN n % 4 <> 0 THEN struct('gate' AS kind, '' AS text) END), x -> x IS NOT NULL)")).alias("x")).select("store", "iri", "x.*")
    done = b.refs.filter("link = 'vectorData' AND model = 'emb-64'").select("store", "iri", F.lit("done").alias("kind"), F.lit("").alias("text"))
    rows = landed(b, ST.live_work(streamed(b, media.unionByName(done))))
    last = rows.groupBy("store", "iri").agg(F.max(F.struct("batch", "created", "pending")).alias("x"))
    return last.filter("x.pending").select("store", "iri", "x.created")


WORK_EVENTS = """
w AS (SELECT store, iri, CAST(-1 AS BIGINT) AS seq, 'image' AS kind, created AS text FROM m_media WHERE class = 'Image' UNION ALL
 SELECT store, iri, event_id, CASE event_type WHEN 'click' THEN 'gate' WHEN 'view' THEN 'done' WHEN 'signup' THEN 'forgotten' WHEN 'purchase' THEN 'ungate' ELSE
   CASE WHEN event_id % 2 = 0 THEN 'removed' ELSE 'image' END END, created FROM events e JOIN m_media m ON m.n = e.user_id WHERE m.class = 'Image')"""


@query("t2_from_state", f"""WITH {WORK_EVENTS}
SELECT store, iri, max(text) AS created FROM w GROUP BY store, iri
HAVING arg_max(kind, seq) FILTER (WHERE kind IN ('image', 'removed')) = 'image' AND coalesce(arg_max(kind, seq) FILTER (WHERE kind IN ('gate', 'ungate')) = 'gate', false)
 AND NOT coalesce(arg_max(kind, seq) FILTER (WHERE kind IN ('done', 'forgotten')) = 'done', false)""")
def _(b):
    """The last tenth of the events as a stream over the state that the others left."""
    b.table("events").createOrReplaceTempView("work_events")
    b.media.createOrReplaceTempView("work_media")
    events = b.spark.sql("WITH " + WORK_EVENTS.replace("m_media", "work_media").replace("events e", "work_events e") + " SELECT * FROM w")
    cut = b.table("events").agg((F.max("event_id") * 0.9).cast("bigint").alias("at"))
    parted = events.crossJoin(F.broadcast(cut))  # one row
    kept = fresh_dir(b.spark, "state")
    ST.work_state(parted.filter("seq <= at").drop("at")).write.parquet(kept)
    feed = streamed(b, parted.filter("seq > at").drop("at"))
    rows = landed(b, ST.live_work(feed, feed.sparkSession.read.parquet(kept)))
    return ST.work_after(b.spark.read.parquet(kept), rows)


@query("t3_holds", """
WITH o AS (SELECT m.store, m.iri AS s, c.stage, arg_max(coalesce(c.status = 200, false), c.event_id) AS ok, max(c.ts) AS last_at FROM m_calls c JOIN m_media m ON m.id = c.id GROUP BY m.store, m.iri, c.stage)
SELECT store, s, stage, strftime(last_at + INTERVAL 600 SECOND, '%Y-%m-%d %H:%M:%S') AS until FROM o WHERE NOT ok""")
def _(b):
    outcomes = b.calls.join(b.media.select("id", F.col("store").alias("st"), "iri"), "id").select(
        F.col("st").alias("store"), F.col("iri").alias("s"), "stage", F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("at"), F.expr("coalesce(status = 200, false)").alias("ok"))
    rows = landed(b, ST.holds(streamed(b, outcomes), delay="60 days"))
    last = rows.groupBy("store", "s", "stage").agg(F.max(F.struct("batch", "until", "action")).alias("x"))
    return last.filter("x.action = 'hold'").select("store", "s", "stage", F.date_format("x.until", "yyyy-MM-dd HH:mm:ss").alias("until"))


@query("t3_holds_clock", """
SELECT m.store, m.iri AS s, c.stage FROM m_calls c JOIN m_media m ON m.id = c.id GROUP BY m.store, m.iri, c.stage
HAVING NOT arg_max(coalesce(c.status = 200, false), c.event_id) AND arg_max(c.event_id % 3 = 0, c.event_id)""")
def _(b):
    """Holds on the wall clock: every third outcome is of the hour to come, the others are of yesterday and hold nothing."""
    at = F.expr("current_timestamp() + CASE WHEN event_id % 3 = 0 THEN INTERVAL 1 HOUR ELSE INTERVAL -24 HOURS END")
    outcomes = b.calls.join(b.media.select("id", F.col("store").alias("st"), "iri"), "id").select(
        F.col("st").alias("store"), F.col("iri").alias("s"), "stage", F.col("event_id").alias("seq"), at.alias("at"), F.expr("coalesce(status = 200, false)").alias("ok"))
    out = fresh_dir(b.spark, "sink")
    ST.run_until_idle(ST.holds_by_clock(streamed(b, outcomes)), out)
    rows = b.spark.read.parquet(out)
    last = rows.groupBy("store", "s", "stage").agg(F.max(F.struct("batch", "action")).alias("x"))
    return last.filter("x.action = 'hold'").select("store", "s", "stage")


@query("t5_ready_marks", """
SELECT store, iri FROM m_media m WHERE class = 'Image' AND n % 11 <> 0 AND 3 = (SELECT count(DISTINCT r.link) FROM m_refs r
  WHERE r.store = m.store AND r.iri = m.iri AND (r.link, r.model) IN (('captionData', 'cap-a'), ('poseData', 'pose-a'), ('vectorData', 'emb-64')))""")
def _(b):
    """Marks already there are told before the references that follow."""
    done = b.media.filter("n % 11 = 0").select("store", "iri", F.lit("complete").alias("link"), F.lit("").alias("model"))
    known = done.select("store", "iri", F.lit(True).alias("known"))
    refs = b.refs.join(known, ["store", "iri"], "left").filter("known IS NULL").select("store", "iri", "link", "model")
    return landed(b, ST.ready_marks(streamed(b, done.unionByName(refs)), REQUIRED)).select("store", "iri")


@query("t6_latest_marks", """
SELECT m.store, m.iri, arg_max(CAST(floor(value) AS BIGINT) % 6, event_id) AS rating, arg_max(event_type = 'view', event_id) AS is_picked FROM events e JOIN m_media m ON m.n = e.user_id GROUP BY m.store, m.iri""")
def _(b):
    marks = b.table("events").join(b.media, F.col("n") == F.col("user_id")).select(
        "store", "iri", F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("seq"), F.expr("CAST(floor(value) AS BIGINT) % 6").alias("rating"),
        F.expr("event_type = 'view'").alias("is_picked"), F.expr("event_type = 'error'").alias("is_rejected"))
    twice = marks.unionByName(marks.filter("is_rejected"))  # a feed may repeat a change
    rows = landed(b, ST.latest_marks(streamed(b, twice), "60 days"), "update")
    return ST.newest(rows, ["store", "iri"]).select("store", "iri", "rating", "is_picked")


@query("t7_call_metrics", """
SELECT strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M') AS start, stage, CASE WHEN status = 200 THEN 'recorded' WHEN status IN (422, 404) THEN 'terminal' WHEN status = 402 THEN 'quota'
 WHEN status IS NULL AND error IN ('error sending request', 'operation timed out') THEN 'unreachable' ELSE 'transient' END AS outcome, count(*) AS calls, CAST(sum(latency_ms) AS BIGINT) AS latency_ms FROM m_calls GROUP BY 1, 2, 3""")
def _(b):
    stream = ST.call_metrics(streamed(b, b.calls.select("ts", "stage", "status", "error", "latency_ms")), "1 minute", "60 days")
    rows = ST.newest(landed(b, stream, "update"), ["start", "stage", "outcome"], by="calls")
    return rows.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "stage", "outcome", "calls", "latency_ms")


@query("t8_counts_stream", f"""
SELECT m.store, count(*) AS images, count(*) FILTER (WHERE width > 500) AS thumbnails FROM m_media m WHERE class = 'Image' GROUP BY m.store""")
def _(b):
    out = fresh_dir(b.spark, "counts")
    feed = streamed(b, b.edits.select("seq", "s"), 2)
    ST.counts_stream(feed, lambda: b.quads, out, fresh_dir(b.spark, "ckpt"), {"availableNow": True}).awaitTermination()
    rows = b.spark.read.parquet(out)
    last = rows.groupBy("store").agg(F.max(F.struct("batch", "images", "thumbnails")).alias("x"))
    return last.select("store", "x.images", "x.thumbnails")


@query("t8_counts_delta", f"""
SELECT m.store, count(*) AS images, count(*) FILTER (WHERE width > 500 AND n % 3 <> 0) AS thumbnails,
{', '.join(f"count(*) FILTER (WHERE EXISTS (SELECT 1 FROM m_records r WHERE r.store = m.store AND r.iri = m.iri AND r.link = '{x}')) AS {n}" for n, x in R.COUNTED.items() if n != 'thumbnails')}
FROM m_media m WHERE class = 'Image' AND n % 5 <> 0 GROUP BY m.store""")
def _(b):
    """Media numbers below 200 of every 400 are the state begun from, the others arrive; then images and thumbnails go."""
    made = R.count_changes(b.quads).join(b.media.select("store", "iri", "n").withColumnRenamed("n", "no"), ["store", "iri"])
    gone = made.filter("(what = 'images' AND no % 5 = 0) OR (what = 'thumbnails' AND no % 3 = 0)").withColumn("n", -F.col("n"))
    kept, out = fresh_dir(b.spark, "held"), fresh_dir(b.spark, "counts")
    ST.held_state(made.filter("no % 400 < 200")).write.parquet(kept)
    feed = streamed(b, made.filter("no % 400 >= 200").unionByName(gone).drop("no"))
    ST.counts_by_delta(feed, out, fresh_dir(b.spark, "ckpt"), feed.sparkSession.read.parquet(kept), {"availableNow": True}).awaitTermination()
    return ST.latest_counts(b.spark, out)
