"""Registered model-run, arrival, document and analytics queries."""

import struct
import zlib

import pyarrow as pa
from pyspark.sql import functions as F

from catalograph import names as N
from catalograph.functions import geometry as GEO, text as T
from catalograph.operators import analytics as A, arrivals as AR, documents as DOC, facts as D, patterns as P, runs as RUN
from catalograph.plans.binding import G, M, TYPE, V
from catalograph.plans.registry import query

AT = "2024-06-01T12:00:00+02:00"
IMAGES = "im AS (SELECT * FROM m_media WHERE class = 'Image')"
ALPHA = N.ID_ALPHABET


def base32_sql(seed: str, length: int = 16) -> str:
    """The id rule in SQL: letters drawn from 5-bit groups of an md5."""
    half = lambda j: f"CAST(concat('0x', substr(md5({seed}), {1 + 10 * j}, 10)) AS BIGINT)"
    return "concat(" + ", ".join(f"substr('{ALPHA}', CAST(1 + (({half(i // 8)} >> {5 * (i % 8)}) & 31) AS BIGINT), 1)" for i in range(length)) + ")"


def answers(b, model, answer):
    """One answer text per image, built from its row."""
    return b.media.filter("class = 'Image'").select("store", F.col("iri").alias("media"), "media_path", "created", F.lit(model).alias("model"),
                                                    F.lit(AT).alias("produced"), F.expr(answer).alias("answer"), "n")


def ref_sql(stage, model):
    return base32_sql(f"concat(store, '|', iri, '|{stage}|{model}|{AT}')")


def file_sql(stage, model, ext):
    day = "replace(substr(created, 1, 10), '-', '/')"
    stem = "regexp_replace(regexp_extract(media_path, '[^/]*$'), '\\.[^.]*$', '')"
    return f"concat('image/enrichment/{stage}/', {day}, '/', {stem}, '.{stage}.{model}.{ext}')"


@query("d14_enrichment_quads", f"""
WITH {IMAGES}, r AS (SELECT *, {ref_sql('pose', 'pose-b')} AS rid FROM im),
rec AS (SELECT r.*, {base32_sql("concat(rid, '/', CAST(k.r_regionkey + 1 AS STRING))")} AS kid, k.r_regionkey AS k FROM r JOIN region k ON k.r_regionkey < n % 3)
SELECT * FROM (
SELECT store, iri AS s, '{V}poseData' AS p, concat('{M}Enrichment/', rid) AS o, 'iri' AS o_kind FROM r
UNION ALL SELECT store, concat('{M}Enrichment/', rid), '{TYPE}', '{V}Enrichment', 'iri' FROM r
UNION ALL SELECT store, concat('{M}Enrichment/', rid), '{V}id', concat('{M}Enrichment/', rid), 'iri' FROM r
UNION ALL SELECT store, concat('{M}Enrichment/', rid), '{V}model', 'pose-b', 'literal' FROM r
UNION ALL SELECT store, concat('{M}Enrichment/', rid), '{V}path', {file_sql('pose', 'pose-b', 'nq')}, 'literal' FROM r
UNION ALL SELECT store, concat('{M}Enrichment/', rid), '{V}producedDate', '{AT}', 'literal' FROM r
UNION ALL SELECT store, concat('{M}Enrichment/', rid), '{V}item', concat('{M}Pose/', kid), 'iri' FROM rec
UNION ALL SELECT store, concat('{M}Pose/', kid), '{TYPE}', '{V}Pose', 'iri' FROM rec
UNION ALL SELECT store, concat('{M}Pose/', kid), '{V}id', concat('{M}Pose/', kid), 'iri' FROM rec
UNION ALL SELECT store, concat('{M}Pose/', kid), '{V}model', 'pose-b', 'literal' FROM rec
UNION ALL SELECT store, concat('{M}Pose/', kid), '{V}producedDate', '{AT}', 'literal' FROM rec
UNION ALL SELECT store, concat('{M}Pose/', kid), '{V}keypoints', concat(CAST(k AS STRING), ',1.5,0.25;', CAST(n AS STRING), ',2,1'), 'literal' FROM rec) x""")
def _(b):
    person = lambda k: f"concat('[[{k}.0,1.5,0.25],[', n, ',2.0001,1.0]]')"
    runs, _ = RUN.pose_runs(answers(b, "pose-b", f"""concat('{{"keypoints":[', CASE n % 3 WHEN 0 THEN '' WHEN 1 THEN {person(0)}
      ELSE concat({person(0)}, ',', {person(1)}) END, ']}}')"""))
    return RUN.enrichment_quads(runs).select("store", "s", "p", "o", "o_kind")


@query("d15_embedding_runs", f"""
WITH {IMAGES} SELECT store, iri AS media, CASE n % 5 WHEN 0 THEN 'no vector in the answer' WHEN 1 THEN 'stated dimension 4, given length 3' END AS reason,
CASE WHEN n % 5 > 1 THEN {file_sql('embed', 'emb-3', 'npy')} END AS vector_path FROM im""")
def _(b):
    runs, _, failures = RUN.embedding_runs(answers(b, "emb-3", """CASE n % 5 WHEN 0 THEN '{"vector":[],"dim":0}'
      WHEN 1 THEN '{"vector":[1,2,3],"dim":4}' WHEN 2 THEN concat('{"vector":[1,0.5,', n, '],"dim":3,"precision":" "}')
      ELSE concat('{"vector":[1,0.5,', n, '],"precision":"fp16","provider":"p"}') END"""))
    fields = F.map_from_entries(F.filter(F.get("records", 0)["fields"], lambda f: f["v"].isNotNull()))
    return runs.select("store", "media", F.lit(None).cast("string").alias("reason"), fields["vectorPath"].alias("vector_path")).unionByName(
        failures.select("store", "media", "reason", F.lit(None).cast("string").alias("vector_path")))


@query("d16_region_runs", f"""
WITH {IMAGES} SELECT store, iri AS media, n % 4 AS "count", CASE WHEN n % 4 = 0 THEN '' ELSE concat('thing0;0.7500;', CASE WHEN n % 2 = 0 THEN concat('1,2,3,', id) ELSE '' END, ';0,0;1,1') END AS first FROM im""")
def _(b):
    one = lambda k: f"""concat('{{"prompt":"thing{k}","score":0.75,"bbox":', CASE WHEN n % 2 = 0 THEN concat('[1,2,3,', n, ']') ELSE '[1,2]' END, ',"polygon":"0,0;1,1"}}')"""
    runs, _ = RUN.region_runs(answers(b, "seg-a", f"""concat('{{"regions":[', CASE n % 4 WHEN 0 THEN '' WHEN 1 THEN {one(0)}
      WHEN 2 THEN concat({one(0)}, ',', {one(1)}) ELSE concat({one(0)}, ',', {one(1)}, ',', {one(2)}) END, ']}}')"""))
    values = F.array_join(F.transform(F.get("records", 0)["fields"], lambda f: F.coalesce(f["v"], F.lit(""))), ";")
    return runs.select("store", "media", "count", F.coalesce(values, F.lit("")).alias("first"))


@query("d17_pose_runs", f"""
WITH {IMAGES} SELECT store, iri AS media, CASE WHEN n % 2 = 0 THEN '' ELSE concat('1.5,', id, '.25,1;0,2,0.333') END AS keypoints, CASE WHEN n % 2 = 1 AND n % 3 = 0 THEN {file_sql('pose', 'pose-c', 'png')} END AS overlay FROM im""")
def _(b):
    runs, _ = RUN.pose_runs(answers(b, "pose-c", """CASE WHEN n % 2 = 0 THEN '{}' ELSE concat('{"keypoints":[[[1.50,', n, '.25,1.0],[0,2,0.33333]]]',
      CASE WHEN n % 3 = 0 THEN ',"skeleton_png_b64":"AAAA"' ELSE '' END, '}') END"""))
    f = F.get("records", 0)["fields"]
    return runs.select("store", "media", F.coalesce(f[0]["v"], F.lit("")).alias("keypoints"), f[1]["v"].alias("overlay"))


@query("d18_depth_runs", f"""
WITH {IMAGES} SELECT store, iri AS media, CASE n % 4 WHEN 0 THEN 'the reply holds no depth map' WHEN 1 THEN 'the depth range is missing' WHEN 2 THEN 'the depth map has another format than PNG' END AS reason,
CASE WHEN n % 4 = 3 THEN concat('-1.2637;', id, '.5') END AS range FROM im""")
def _(b):
    runs, failures = RUN.depth_runs(answers(b, "depth-a", """CASE n % 4 WHEN 0 THEN '{}' WHEN 1 THEN '{"depth_png_b64":"iVBORw0KGgoAAAA="}'
      WHEN 2 THEN '{"depth_png_b64":"AAAAAAAAAAAA","min":0,"max":1}' ELSE concat('{"depth_png_b64":"iVBORw0KGgoAAAA=","min":-1.2637,"max":', n, '.5,"width":64}') END"""))
    f = F.get("records", 0)["fields"]
    return runs.select("store", "media", F.lit(None).cast("string").alias("reason"), F.concat(f[1]["v"], F.lit(";"), f[2]["v"]).alias("range")).unionByName(
        failures.select("store", "media", "reason", F.lit(None).cast("string").alias("range")))


@query("d19_face_runs", f"""
WITH {IMAGES} SELECT store, iri AS media, CASE n % 4 WHEN 0 THEN 'the reply lists no faces' WHEN 1 THEN 'one of the faces is incomplete' END AS reason,
CAST(CASE n % 4 WHEN 2 THEN 0 WHEN 3 THEN 1 END AS BIGINT) AS faces, CASE WHEN n % 4 = 3 THEN concat('1,2,3.5,', id) END AS bbox FROM im""")
def _(b):
    face = """'{"bbox":[1,2,3.5,', n, '],"score":0.9,"kps":[[1,1],[2,2],[3,3],[4,4],[5,5]],"pose":[0.5,1,-2],"embedding":[0.1,0.2]}'"""
    runs, _, failures = RUN.face_runs(answers(b, "face-a", f"""CASE n % 4 WHEN 0 THEN '{{}}' WHEN 2 THEN '{{"faces":[]}}'
      WHEN 1 THEN concat('{{"faces":[', {face}, ',{{"bbox":[1,2],"score":0.5}}]}}') ELSE concat('{{"faces":[', {face}, ']}}') END"""))
    return runs.select("store", "media", F.lit(None).cast("string").alias("reason"), F.size("records").cast("bigint").alias("faces"),
                       F.get("records", 0)["fields"][0]["v"].alias("bbox")).unionByName(failures.select(
        "store", "media", "reason", F.lit(None).cast("bigint").alias("faces"), F.lit(None).cast("string").alias("bbox")))


@query("d20_parse_captions", f"""
WITH {IMAGES} SELECT store, iri AS media, CASE n % 7 WHEN 0 THEN 'no object in the reply' WHEN 1 THEN 'the reply''s object does not parse' WHEN 2 THEN 'sceneObjects is no list of texts' END AS reason,
CASE WHEN n % 7 IN (3, 4) THEN concat('about ', source) ELSE '' END AS short_caption,
CASE n % 7 WHEN 3 THEN concat('dog,', lang) WHEN 4 THEN 'cat,red hat' WHEN 5 THEN 'true' WHEN 6 THEN 'a,b' ELSE '' END AS objects,
CASE WHEN n % 7 IN (3, 4) THEN 'sceneMood=calm,imageTechnicalScore=88' ELSE '' END AS scene, CASE WHEN n % 7 IN (3, 4, 5) THEN 'wild' ELSE '' END AS dropped FROM im""")
def _(b):
    rest = """'"shortCaption":" about ', source, ' ","sceneMood":"calm","sceneGaze":"n/a","imageTechnicalScore":88,"wild":1}'"""
    a = b.media.filter("class = 'Image'").select("store", F.col("iri").alias("media"), F.expr(f"""CASE n % 7 WHEN 0 THEN 'no object here' WHEN 1 THEN 'x {{"a": }} y'
      WHEN 2 THEN '{{"sceneObjects": 5}}' WHEN 5 THEN '{{"sceneObjects":"true","shortCaption":7,"wild":1}}'
      WHEN 6 THEN '{{"sceneObjects":["a",1,"b"],"longCaption":true}}' WHEN 3 THEN concat('```json {{"sceneObjects":["Dog.;", "{"y" * 41}", "', lang, '", "dog"],', {rest}, ' ```')
      ELSE concat('{{"sceneObjects":"Cat, red hat.,,CAT",', {rest}) END""").alias("answer"))
    out = RUN.parse_captions(a)
    bad = F.col("reason").isNotNull()
    text = lambda c: F.when(bad, "").otherwise(c)
    return out.select("store", "media", "reason", text(F.col("short_caption")).alias("short_caption"), text(F.array_join("objects", ",")).alias("objects"),
                      text(F.array_join(F.transform("scene", lambda f: F.concat(f["k"], F.lit("="), f["v"])), ",")).alias("scene"),
                      text(F.array_join("dropped", ",")).alias("dropped"))


@query("d21_segment_requests", "SELECT store, iri, CASE WHEN n % 4 = 0 THEN 'person,src3' ELSE concat(lang, ',', source, ',person', CASE WHEN source = 'src3' THEN '' ELSE ',src3' END) END AS nouns FROM m_media WHERE class = 'Image'")
def _(b):
    media = b.media.filter("class = 'Image'").select("store", "iri", F.expr("CASE WHEN n % 4 <> 0 THEN array(lang, source) END").alias("scene_objects"))
    return RUN.segment_requests(media, ["person", "src3"]).select("store", "iri", "nouns")


@query("d22_embedding_text", """
SELECT store, iri, md5(concat(CASE WHEN trim(short_caption) <> '' THEN concat('shortCaption: ', trim(short_caption), chr(10)) ELSE '' END,
CASE WHEN trim(long_caption) <> '' THEN concat('longCaption: ', trim(long_caption), chr(10)) ELSE '' END,
CASE WHEN short_caption IS NOT NULL THEN concat('renderRequestInformation: ', source, chr(10)) ELSE '' END)) AS digest FROM m_media""")
def _(b):
    media = b.media.withColumn("render_request", F.when(F.col("short_caption").isNotNull(), F.concat(F.lit(" "), "source")))
    return media.select("store", "iri", F.md5(RUN.embedding_text(media)).alias("digest"))


# ── arrivals ────────────────────────────────────────────────────────────────────────────────────────────────

def arrivals(b):
    """Pages as arriving files: a signature by page number in front of the whole page text."""
    magic = "CASE page_id % 5 WHEN 0 THEN X'89504E470D0A1A0A' WHEN 1 THEN X'FFD8FFE0' WHEN 2 THEN X'00000018667479707174202000000000' WHEN 3 THEN X'000000186674797069736F6D' ELSE X'25504446' END"
    return b.table("pages").select(
        F.lit("web001").alias("store"), F.lit("b1").alias("batch"), F.col("url").alias("path"), F.expr(f"concat({magic}, cast(html AS binary))").alias("content"),
        F.expr("CASE WHEN page_id % 7 = 0 THEN 'image/png' WHEN page_id % 7 = 1 THEN 'video/mp4' WHEN page_id % 7 = 2 THEN 'text/html' END").alias("claimed"),
        F.lit("2024-06-01T12:30:45+02:00").alias("created"), "page_id")


ARR = f"""
pg AS (SELECT *, CASE page_id % 5 WHEN 0 THEN 'image/png' WHEN 1 THEN 'image/jpeg' WHEN 2 THEN 'video/quicktime' WHEN 3 THEN 'video/mp4' END AS seen,
 CASE WHEN page_id % 7 = 0 THEN 'image/png' WHEN page_id % 7 = 1 THEN 'video/mp4' WHEN page_id % 7 = 2 THEN 'text/html' END AS claim FROM pages),
arr AS (SELECT url AS path, coalesce(seen, claim, 'application/octet-stream') AS arrived, CASE WHEN claim = 'image/png' AND coalesce(seen, '') NOT LIKE 'image/%' THEN 'not a readable image'
 WHEN claim = 'video/mp4' AND coalesce(seen, '') NOT LIKE 'video/%' THEN 'not a readable video' END AS reason FROM pg),
named AS (SELECT *, {base32_sql("concat('web001|b1|', path, '|2024-06-01T12:30:45+02:00')")} AS id, CASE WHEN arrived = 'image/jpeg' THEN 'image/png' ELSE arrived END AS media_type FROM arr),
placed AS (SELECT *, CASE WHEN media_type LIKE 'image/%' THEN 'image' WHEN media_type LIKE 'video/%' THEN 'video' ELSE 'other' END AS kind,
 CASE media_type WHEN 'image/png' THEN 'png' WHEN 'video/quicktime' THEN 'mov' WHEN 'video/mp4' THEN 'mp4' ELSE 'bin' END AS ext FROM named)"""


@query("d1_ingest", f"""
WITH {ARR}, good AS (SELECT *, concat('{M}', CASE kind WHEN 'image' THEN 'Image' WHEN 'video' THEN 'Video' ELSE 'Media' END, '/', id) AS iri,
 concat(kind, '/img/source/2024/06/01/20240601-123045-', id, '.', ext) AS mp FROM placed WHERE reason IS NULL)
SELECT iri AS s, '{TYPE}' AS p, concat('{V}', CASE kind WHEN 'image' THEN 'Image' WHEN 'video' THEN 'Video' ELSE 'Media' END) AS o FROM good
UNION ALL SELECT iri, '{V}id', iri FROM good UNION ALL SELECT iri, '{V}mediaPath', mp FROM good
UNION ALL SELECT iri, '{V}createdDate', '2024-06-01T12:30:45+02:00' FROM good UNION ALL SELECT iri, '{V}updatedDate', '2024-06-01T12:30:45+02:00' FROM good
UNION ALL SELECT iri, '{V}mediaType', media_type FROM good
UNION ALL SELECT iri, '{V}sourceFile', CASE WHEN arrived = 'image/jpeg' THEN concat('image/img/original/2024/06/01/20240601-123045-', id, '.jpg') ELSE mp END FROM good""")
def _(b):
    rows = AR.arrival_rows(arrivals(b)).withColumn("width", F.lit(None).cast("bigint")).withColumn("height", F.lit(None).cast("bigint"))
    return AR.arrival_quads(rows).select("s", "p", "o")


def request_png(doc_id: int, text: str | None) -> bytes:
    """A PNG with the whole text as its render request in one of the three kinds of text chunk, plain or deflated, by document number."""
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    said, key = f"\n\t {text or ''}\r\n ", b"remark" if doc_id % 7 == 0 else N.RENDER_REQUEST_CHUNK.encode()
    narrow, wide, cut = said.encode("latin-1", "replace"), said.encode(), doc_id % 5
    body = [(b"tEXt", narrow), (b"zTXt", b"\0" + zlib.compress(narrow)), (b"iTXt", b"\0\0en\0\0" + wide), (b"iTXt", b"\1\0\0\0" + zlib.compress(wide)),
            (b"zTXt", b"\0" + zlib.compress(narrow)[:-1])][cut]
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">II5B", 640 + doc_id % 3, 480, 8, 2, 0, 0, 0)) + chunk(body[0], key + b"\0" + body[1]) + chunk(
        b"IDAT", b"px") + chunk(b"IEND", b"")


@query("d1_render_request", """
SELECT concat('doc/', doc_id) AS path, CASE WHEN doc_id % 7 = 0 OR doc_id % 5 = 4 THEN NULL ELSE nullif(trim(CASE WHEN doc_id % 5 < 2 THEN regexp_replace(coalesce(text, ''), '[^\\x{0}-\\x{FF}]', '?', 'g')
 ELSE coalesce(text, '') END, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13), chr(133), chr(160))), '') END AS request, CASE WHEN doc_id % 7 <> 0 AND doc_id % 5 = 4 THEN 'refused' ELSE 'stored' END AS outcome FROM documents""")
def _(b):
    """PNG files made of whole texts go through `ingest`; the request stored with each, or the refusal of one that cannot be read."""
    @F.arrow_udf("binary")
    def made(doc_id: pa.Array, text: pa.Array) -> pa.Array:
        return pa.array([request_png(i.as_py(), t.as_py()) for i, t in zip(doc_id, text, strict=True)], pa.binary())

    files = b.table("documents").select(
        F.lit("doc001").alias("store"), F.lit("b1").alias("batch"), F.concat(F.lit("doc/"), "doc_id").alias("path"), made("doc_id", "text").alias("content"),
        F.lit("image/png").alias("claimed"), F.lit("2024-06-01T12:30:45+02:00").alias("created"))
    rows, quads, rejects = AR.ingest(files, b.quads.filter("store = 'doc001'"))
    said = P.pattern(quads, "?iri", "renderRequestInformation", "?request").select("iri", "request")
    good = rows.filter("reason IS NULL").select("path", "iri").join(said, "iri", "left").select("path", "request", F.lit("stored").alias("outcome"))
    return good.unionByName(rejects.select("path", F.lit(None).cast("string").alias("request"), F.lit("refused").alias("outcome")))


@query("d2_sniff", f"WITH {ARR} SELECT path, arrived AS media_type, reason FROM arr")
def _(b):
    return AR.verify(arrivals(b)).select("path", "media_type", "reason")


XML = "replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


def packets(b):
    """An RDF/XML packet per document, whole text included: a producer block, a named moment and, on some, a block of
    this catalogue from another store, fields of its namespace, or a broken end."""
    text = XML.format(c="regexp_replace(text, '[\\\\x00-\\\\x08\\\\x0b\\\\x0c\\\\x0e-\\\\x1f\\\\r]', ' ')")
    return b.media.select("store", F.col("iri").alias("media"), "n", "class", "source", F.expr(f"""concat('<x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF xmlns:rdf="{N.RDF}">',
      '<rdf:Description rdf:about="" xmlns:dc="{N.DC}" xmlns:cat="{V}"><dc:title>', {text}, '</dc:title><dc:subject>', source, '</dc:subject>',
      CASE WHEN n % 3 = 0 THEN '<cat:relatedToId>&lt;cat/ImageSet/new-set&gt;</cat:relatedToId>' ELSE '' END,
      CASE WHEN n % 4 = 0 THEN '<cat:mediaCreatedDate>2024-05-01T00:00:00Z</cat:mediaCreatedDate>' WHEN n % 4 = 1 THEN '<cat:mediaCreatedDate>yesterday</cat:mediaCreatedDate>' ELSE '' END,
      CASE WHEN n % 5 = 0 THEN '<cat:rating>5</cat:rating>' ELSE '' END, '</rdf:Description>',
      '<rdf:Description rdf:about="urn:moment:', n, '" xmlns:dc="{N.DC}" dc:creator="', lang, '"/>',
      CASE WHEN n % 2 = 0 THEN '<rdf:Description rdf:about="" xmlns:cat="{V}"><cat:id>&lt;cat/Image/old&gt;</cat:id><cat:width>9</cat:width></rdf:Description>' ELSE '' END,
      CASE WHEN n % 13 = 12 THEN '<open>' ELSE '' END, '</rdf:RDF></x:xmpmeta>')""").alias("packet"))


SAID = f"""
pk AS (SELECT * FROM m_media WHERE n % 13 <> 12),
said AS (SELECT store, iri AS media, iri AS s, '{N.DC}subject' AS p, source AS o FROM pk
 UNION ALL SELECT store, iri, concat('urn:moment:', id), '{N.DC}creator', lang FROM pk
 UNION ALL SELECT store, iri, iri, '{V}relatedToId', '<cat/ImageSet/new-set>' FROM pk WHERE n % 3 = 0
 UNION ALL SELECT store, iri, iri, '{V}mediaCreatedDate', CASE WHEN n % 4 = 0 THEN '2024-05-01T00:00:00Z' ELSE 'yesterday' END FROM pk WHERE n % 4 < 2
 UNION ALL SELECT store, iri, iri, '{V}rating', '5' FROM pk WHERE n % 5 = 0)"""


def said(b):
    return AR.harvest(packets(b))


@query("d3_harvest", f"WITH {SAID} SELECT * FROM said UNION ALL SELECT store, iri, iri, '{N.DC}title', CAST(length(text) AS STRING) FROM pk")
def _(b):
    rows = said(b).filter("o_kind <> 'fault'")
    return rows.select("store", "media", "s", "p", F.when(F.col("p") == N.DC + "title", F.length("o").cast("string")).otherwise(F.col("o")).alias("o"))


@query("d3_packet_faults", "SELECT store, iri AS media FROM m_media WHERE n % 13 = 12")
def _(b):
    return AR.packet_faults(said(b)).select("store", "media")


@query("d4_producer_policy", f"WITH {SAID} SELECT store, media, '{V}rating' AS names FROM said WHERE p = '{V}rating'")
def _(b):
    return AR.producer_policy(said(b), "later")[1].withColumn("names", F.array_join("names", ","))


@query("d4_arrival_policy", f"WITH {SAID} SELECT p, count(*) AS n FROM said WHERE p <> '{V}rating' GROUP BY p UNION ALL SELECT '{N.DC}title', count(*) FROM pk")
def _(b):
    return AR.producer_policy(said(b))[0].groupBy("p").agg(F.count("*").alias("n"))


@query("d5_edges", f"WITH {SAID} SELECT store, s, '{M}ImageSet/new-set' AS o, 'iri' AS o_kind FROM said WHERE p = '{V}relatedToId'")
def _(b):
    return AR.edges(said(b)).filter(F.col("p") == N.v("relatedToId")).select("store", "s", "o", "o_kind")


@query("d6_check_dates", f"WITH {SAID} SELECT store, media, 'mediaCreatedDate: not an RFC3339 date with a zone' AS reason FROM said WHERE o = 'yesterday'")
def _(b):
    return AR.check_dates(said(b))


@query("d7_named_sets", f"""WITH {SAID}, w AS (SELECT DISTINCT t.store FROM said t JOIN m_media m ON m.store = t.store AND m.iri = t.media WHERE p = '{V}relatedToId' AND m.class = 'Image')
SELECT store, '{M}ImageSet/new-set' AS s, '{TYPE}' AS p, '{V}ImageSet' AS o FROM w UNION ALL SELECT store, '{M}ImageSet/new-set', '{V}id', '{M}ImageSet/new-set' FROM w
UNION ALL SELECT store, '{M}ImageSet/new-set', '{V}createdDate', '{AT}' FROM w UNION ALL SELECT store, '{M}ImageSet/new-set', '{V}updatedDate', '{AT}' FROM w""")
def _(b):
    media = b.media.select("store", F.col("iri").alias("media"), "class")
    return AR.make_named_sets(AR.edges(said(b)), b.quads, media, AT)[0].select("store", "s", "p", "o")


@query("d7_wrong_sets", f"WITH {SAID} SELECT t.store, t.media, 'wrong kind of set: {M}ImageSet/new-set' AS reason FROM said t JOIN m_media m ON m.store = t.store AND m.iri = t.media WHERE p = '{V}relatedToId' AND m.class = 'Video'")
def _(b):
    media = b.media.select("store", F.col("iri").alias("media"), "class")
    return AR.make_named_sets(AR.edges(said(b)), b.quads, media, AT)[1]


LEG = "http://media.example/legacy/"


def legacy_packets(b):
    return b.table("conversations").select(
        F.lit("en0001").alias("store"), F.concat(F.lit(M + "Image/c"), "conv_id", F.lit("-"), "turn").alias("media"),
        F.expr("""CASE WHEN turn % 3 = 2 THEN concat('loose-', conv_id) ELSE concat('20240', 1 + turn % 9, '0', 1 + conv_id % 9, '-2300', lpad(CAST(conv_id % 60 AS STRING), 2, '0'), '-', lpad(lower(hex(conv_id)), 8, '0')) END""").alias("stem"),
        F.expr(f"""concat('<rdf:RDF xmlns:rdf="{N.RDF}"><rdf:Description rdf:about="" xmlns:l="{LEG}" xmlns:r="{LEG}retired/"><l:momentId>m', conv_id, '</l:momentId>',
          '<r:cid>c</r:cid>', CASE WHEN role = 'user' THEN concat('<l:inSetId>', CASE WHEN conv_id % 4 = 0 THEN 'bad id' ELSE concat('set-', conv_id % 10) END, '</l:inSetId>') ELSE '' END,
          '</rdf:Description><rdf:Description rdf:about="Region:0" xmlns:l="{LEG}" l:score="1"/></rdf:RDF>')""").alias("packet"))


@query("d30_migrate_outcomes", f"""
WITH c AS (SELECT *, CASE WHEN role = 'user' THEN CASE WHEN conv_id % 4 = 0 THEN 'bad id' ELSE concat('set-', CAST(conv_id % 10 AS STRING)) END END AS set_id,
 CASE WHEN turn % 3 <> 2 THEN concat('2024-0', CAST(1 + turn % 9 AS STRING), '-0', CAST(1 + conv_id % 9 AS STRING), 'T23:00:', lpad(CAST(conv_id % 60 AS STRING), 2, '0'), '+00:00') END AS utc FROM conversations)
SELECT concat('{M}Image/c', CAST(conv_id AS STRING), '-', CAST(turn AS STRING)) AS media, concat('m', CAST(conv_id AS STRING)) AS moment, set_id,
 CASE WHEN utc IS NOT NULL THEN strftime(CAST(utc AS TIMESTAMPTZ) AT TIME ZONE 'Asia/Kolkata', '%Y-%m-%dT%H:%M:%S+05:30') END AS media_created_date,
 CASE WHEN utc IS NULL THEN 'file name holds no date' WHEN set_id = 'bad id' THEN 'set id is not usable' END AS reason FROM c""")
def _(b):
    return AR.migrate_packets(legacy_packets(b), LEG, LEG + "retired/", "Asia/Kolkata")[1].select("media", "moment", "set_id", "media_created_date", "reason")


@query("d30_migrate_statements", f"""
WITH c AS (SELECT *, CASE WHEN role = 'user' THEN concat('set-', CAST(conv_id % 10 AS STRING)) END AS set_id FROM conversations WHERE turn % 3 <> 2 AND NOT (role = 'user' AND conv_id % 4 = 0))
SELECT '{LEG}momentId' AS p, count(*) AS n FROM c HAVING count(*) > 0 UNION ALL SELECT '{LEG}inSetId', count(set_id) FROM c HAVING count(set_id) > 0
UNION ALL SELECT '{V}mediaCreatedDate', count(*) FROM c HAVING count(*) > 0 UNION ALL SELECT '{V}relatedToId', count(*) + count(set_id) FROM c HAVING count(*) > 0""")
def _(b):
    return AR.migrate_packets(legacy_packets(b), LEG, LEG + "retired/", "Asia/Kolkata")[0].groupBy("p").agg(F.count("*").alias("n"))


@query("d31_image_documents", f"""
SELECT m.store, m.iri AS s, m.created, m.media_path AS path, CASE WHEN m.n % 4 <> 0 THEN concat(m.lang, '|', m.source) ELSE '' END AS objects,
 (SELECT count(*) FROM m_refs r WHERE r.store = m.store AND r.iri = m.iri AND r.link = 'captionData') AS captions,
 (SELECT min(r.path) FROM m_refs r WHERE r.store = m.store AND r.iri = m.iri AND r.link = 'captionData') AS first_caption,
 CASE WHEN m.class = 'Image' AND m.width > 500 THEN CAST(512 AS BIGINT) END AS thumb,
 (SELECT string_agg(replace(concat('<', q.o, '>'), '{N.BASE}', ''), '|' ORDER BY q.o) FROM quads q WHERE q.store = m.store AND q.s = m.iri AND q.p = '{V}relatedToId') AS related FROM m_media m""")
def _(b):
    d = DOC.image_documents(b.quads)
    get = lambda p: F.get_json_object("document", p)
    lst = lambda p: F.coalesce(F.array_join(F.from_json(get(p), "array<string>"), "|"), F.lit(""))
    caps = F.from_json(get("$.captionData"), "array<struct<path:string>>")
    return d.select("store", "s", "created", get("$.mediaPath").alias("path"), lst("$.sceneObjects").alias("objects"),
                    F.coalesce(F.size(caps), F.lit(0)).cast("bigint").alias("captions"),
                    F.get(caps, 0)["path"].alias("first_caption"), get("$.thumbnail.width").cast("bigint").alias("thumb"), lst("$.relatedToId").alias("related"))


# ── analytics ───────────────────────────────────────────────────────────────────────────────────────────────

OUTCOME = """CASE WHEN status = 200 THEN 'recorded' WHEN status IN (422, 404) THEN 'terminal' WHEN status = 402 THEN 'quota'
 WHEN status IS NULL AND error IN ('error sending request', 'operation timed out') THEN 'unreachable' ELSE 'transient' END"""


@query("r14_classify", f"SELECT event_id, stage, {OUTCOME} AS outcome FROM m_calls")
def _(b):
    return A.classify(b.calls).select("event_id", "stage", "outcome")


@query("r15_call_stats", f"""
SELECT strftime(ts, '%Y-%m-%d') AS day, stage, {OUTCOME} AS outcome, count(*) AS calls, round(avg(latency_ms), 6) AS mean_ms, CAST(quantile_disc(latency_ms, 0.5) AS BIGINT) AS median_ms,
max(latency_ms) AS max_ms, CAST(sum(request_bytes) AS BIGINT) AS request_bytes FROM m_calls GROUP BY 1, 2, 3""")
def _(b):
    return A.call_stats(A.classify(b.calls), F.date_format("ts", "yyyy-MM-dd")).withColumn("mean_ms", F.round("mean_ms", 6))


@query("r16_exact_dups", """
WITH h AS (SELECT concat('doc/', CAST(doc_id AS STRING)) AS path, sha256(text) AS hash FROM documents), g AS (SELECT hash, min(path) AS kept FROM h GROUP BY hash HAVING count(*) > 1)
SELECT h.path, h.hash, g.kept, h.path <> g.kept AS duplicate FROM h JOIN g ON g.hash = h.hash""")
def _(b):
    files = b.table("documents").select(F.concat(F.lit("doc/"), "doc_id").alias("path"), F.col("text").cast("binary").alias("content"))
    return A.exact_dups(files)


@query("r16_png_dups", """
WITH h AS (SELECT concat('doc/', CAST(doc_id AS STRING)) AS path, text, n_chars FROM documents), g AS (SELECT text, min(path) AS kept FROM h GROUP BY text HAVING count(*) > 1)
SELECT h.path, g.kept, h.path <> g.kept AS duplicate FROM h JOIN g ON g.text = h.text""")
def _(b):
    """Documents wrapped as PNG files whose metadata chunk differs from copy to copy."""
    chunk = lambda kind, data: f"concat(unhex(lpad(hex(length({data})), 8, '0')), cast('{kind}' AS binary), {data}, X'00000000')"
    xmp = "concat(cast('XML:com.adobe.xmp' AS binary), X'0000000000', cast(cast(doc_id AS string) AS binary))"
    png = f"concat(X'89504E470D0A1A0A', {chunk('iTXt', xmp)}, {chunk('IDAT', 'cast(text AS binary)')}, {chunk('IEND', 'X' + chr(39) * 2)})"
    files = b.table("documents").select(F.concat(F.lit("doc/"), "doc_id").alias("path"), F.expr(png).alias("content"))
    return A.exact_dups(files, "png").select("path", "kept", "duplicate")


def survey(b):
    """Packets for the profile, by month of the media date; some media carry none."""
    return b.media.select(F.expr("concat('2024/0', 1 + width % 3)").alias("month"), F.col("iri").alias("path"), F.expr(
        f"""CASE WHEN n % 6 <> 5 THEN concat('<rdf:RDF><rdf:Description rdf:about=""', ' xmlns:legacy="x"><legacy:longCaption>', source, '</legacy:longCaption><legacy:mood>',
        lang, '</legacy:mood></rdf:Description>', repeat('<rdf:Description rdf:about="Region:0"><legacy:score>1</legacy:score></rdf:Description>', CAST(n % 4 AS INT)),
        CASE WHEN n % 5 = 0 THEN '<rdf:Description rdf:about="Pose:0" xmlns:legacy="x"/>' ELSE '' END, '</rdf:RDF>') END""").alias("packet"))


@query("r18_profile", """
WITH s AS (SELECT concat('2024/0', CAST(1 + width % 3 AS STRING)) AS month, n % 6 <> 5 AS has, n % 4 AS regions, n % 5 = 0 AS pose, n FROM m_media),
t AS (SELECT *, has AND (regions > 0 OR pose) AS sib, has AND regions > 0 AND NOT pose AS bad FROM s)
SELECT metric, key, CAST(sum(x) AS BIGINT) AS total, CAST(max(x) AS BIGINT) AS greatest FROM (
SELECT 'read' AS metric, '' AS key, 1 AS x FROM t UNION ALL SELECT 'missing', '', 1 FROM t WHERE NOT has UNION ALL SELECT 'found', '', 1 FROM t WHERE has
UNION ALL SELECT 'read_in_month', month, 1 FROM t UNION ALL SELECT 'several_blocks', '', 1 FROM t WHERE sib UNION ALL SELECT 'unbound_packets', '', 1 FROM t WHERE bad
UNION ALL SELECT 'unbound_in_month', month, 1 FROM t WHERE bad UNION ALL SELECT 'unbound_prefix', 'legacy', 1 FROM t WHERE bad
UNION ALL SELECT 'region_packets', '', 1 FROM t WHERE has AND regions > 0 UNION ALL SELECT 'region_blocks', '', regions FROM t WHERE has AND regions > 0
UNION ALL SELECT 'pose_packets', '', 1 FROM t WHERE has AND pose UNION ALL SELECT 'caption_field', 'longCaption', 1 FROM t WHERE has
UNION ALL SELECT 'field_in_month', concat(month, ' legacy:longCaption'), 1 FROM t WHERE has UNION ALL SELECT 'field_in_month', concat(month, ' legacy:mood'), 1 FROM t WHERE has
UNION ALL SELECT 'field_in_month', concat(month, ' legacy:score'), 1 FROM t JOIN region k ON k.r_regionkey < t.regions WHERE has) x GROUP BY metric, key""")
def _(b):
    return A.profile(survey(b))


@query("r18_stride", "SELECT month, path FROM (SELECT concat('2024/0', CAST(1 + width % 3 AS STRING)) AS month, iri AS path, row_number() OVER (ORDER BY concat('2024/0', CAST(1 + width % 3 AS STRING)), iri) - 1 AS r FROM m_media) x WHERE r % 7 = 0")
def _(b):
    return A.stride(survey(b).select("month", "path"), ["month", "path"], 7)


def ledger(b):
    return b.table("events").select(F.col("event_id").alias("seq"), F.concat(F.lit("src/"), F.col("user_id") * 7 % 101, F.lit("-"), (F.col("event_id") / 40).cast("bigint"), F.lit(".png")).alias("source_path"), F.expr(
        "CASE event_type WHEN 'click' THEN 'delivering' WHEN 'view' THEN 'stored' WHEN 'purchase' THEN 'refused' WHEN 'signup' THEN 'skipped' ELSE 'stored-not-moved' END").alias("status"))


LEDGER = """l AS (SELECT event_id AS seq, concat('src/', CAST(user_id * 7 % 101 AS STRING), '-', CAST(CAST(floor(event_id / 40) AS BIGINT) AS STRING), '.png') AS source_path,
 CASE event_type WHEN 'click' THEN 'delivering' WHEN 'view' THEN 'stored' WHEN 'purchase' THEN 'refused' WHEN 'signup' THEN 'skipped' ELSE 'stored-not-moved' END AS status FROM events)"""


@query("r19_reconcile", f"WITH {LEDGER} SELECT source_path, bool_or(status IN ('stored', 'stored-not-moved')) AS done, arg_max(status, seq) AS last_status, count(*) AS rows, arg_max(status, seq) = 'delivering' AS uncertain FROM l GROUP BY source_path")
def _(b):
    return A.reconcile(ledger(b))


@query("r19_ledger_counts", f"WITH {LEDGER} SELECT status, count(*) AS n FROM l GROUP BY status")
def _(b):
    return A.ledger_counts(ledger(b))


@query("r20_already_stored", f"""
WITH d AS (SELECT store, iri, created, source, n, CASE WHEN n % 3 = 1 THEN source WHEN n % 3 = 2 THEN 'sha256:x' END AS moment FROM m_media),
hits AS (SELECT d.store, d.iri AS path, x.iri AS s FROM d JOIN m_media x ON x.store = d.store AND x.created = d.created WHERE d.moment IS NULL OR (d.n % 3 = 1 AND x.source = d.moment))
SELECT store, path, min(s) AS s FROM hits GROUP BY store, path HAVING count(DISTINCT s) = 1""")
def _(b):
    dated = b.quads.filter((F.col("p") == N.v("createdDate")) & F.col("s").rlike("/(Image|Video)/")).withColumn("p", F.lit(N.v("mediaCreatedDate")))
    facts = b.media.select("store", F.col("iri").alias("path"), F.col("created").alias("media_created_date"), F.expr(
        "CASE WHEN n % 3 = 1 THEN source WHEN n % 3 = 2 THEN 'sha256:x' END").alias("moment"))
    return A.already_stored(b.quads.unionByName(dated), facts, N.DC + "subject", N.BASE + "moments/Moment/")


@query("r21_audit_vocab", f"SELECT p, count(*) AS n, 'foreign' AS verdict FROM quads WHERE starts_with(p, '{N.DC}') GROUP BY p")
def _(b):
    return A.audit_vocab(b.quads, A.declared_predicates())


@query("r22_audit_cardinality", f"""
SELECT 'exactly 1' AS rule, store, concat('{M}Thumbnail/t', id) AS s, 'Thumbnail' AS class, 'x' AS property, CAST(0 AS BIGINT) AS n FROM m_media WHERE false
UNION ALL SELECT 'exactly 1', store, s, 'Image', 'createdDate', CAST(2 AS BIGINT) FROM (SELECT store, iri AS s FROM m_media WHERE class = 'Image' AND n % 7 <> 0 AND updated <> created)
UNION ALL SELECT 'exactly 1', store, iri, 'Image', 'mediaType', CAST(0 AS BIGINT) FROM m_media WHERE class = 'Image'
UNION ALL SELECT 'exactly 1', store, iri, 'Video', 'mediaType', CAST(0 AS BIGINT) FROM m_media WHERE class = 'Video'
UNION ALL SELECT 'exactly 1', store, iri, 'Video', 'createdDate', CAST(2 AS BIGINT) FROM m_media WHERE class = 'Video' AND n % 7 <> 0
UNION ALL SELECT 'at most 1', store, iri, class, 'width', CAST(2 AS BIGINT) FROM m_media WHERE length(media_type) <> width""")
def _(b):
    """The graph with every update date said as a creation date and every media type as a width."""
    q, p = b.quads, F.col("p")
    extra = q.filter(p == N.v("updatedDate")).join(D.classes(q, "Image", "Video"), ["store", "s"], "left_semi").withColumn("p", F.lit(N.v("createdDate")))
    moved = q.filter(p == N.v("mediaType")).withColumn("p", F.lit(N.v("width"))).withColumn("o", F.length("o").cast("string"))
    widths = q.filter(p == N.v("width")).unionByName(moved).dropDuplicates(N.QUAD_COLS)
    bent = q.filter(~p.isin(N.v("mediaType"), N.v("width"))).unionByName(extra.select(*N.QUAD_COLS)).unionByName(widths)
    return A.audit_cardinality(bent)
