"""The shared test tables read as a media catalogue.

Each view is one SQL text that both Spark and DuckDB run, so a query and its SQL twin start from the same rows.
The tables hold no pipeline state (which model ran on what), so state is set by rules on the row id; these rules
say what IS stored and keep every row. Facts become quads in one pass over the media view.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from catalograph import names as N
from catalograph.sources.snapshots import read_snapshot, write_snapshot
from catalograph.session import fresh_dir

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]

M, V, G, TYPE = N.MEDIA_NS, N.VOCAB, N.GRAPH, N.RDF_TYPE
STR = "STRING"

VIEWS: dict[str, str] = {}

VIEWS["m_media"] = f"""
SELECT concat(d.lang, '0001') AS store, CAST(d.doc_id AS STRING) AS id, d.doc_id AS n,
  CASE WHEN d.doc_id % 10 = 9 THEN 'Video' ELSE 'Image' END AS class,
  concat('{M}', CASE WHEN d.doc_id % 10 = 9 THEN 'Video' ELSE 'Image' END, '/', CAST(d.doc_id AS STRING)) AS iri,
  CASE WHEN d.doc_id % 10 = 9 THEN 'video/mp4' ELSE 'image/png' END AS media_type,
  concat(CASE WHEN d.doc_id % 10 = 9 THEN 'video' ELSE 'image' END, '/img/source/2024/01/',
         lpad(CAST(1 + d.doc_id % 28 AS STRING), 2, '0'), '/202401', lpad(CAST(1 + d.doc_id % 28 AS STRING), 2, '0'),
         '-', lpad(CAST(d.doc_id % 24 AS STRING), 2, '0'), '0000-', CAST(d.doc_id AS STRING),
         CASE WHEN d.doc_id % 10 = 9 THEN '.mp4' ELSE '.png' END) AS media_path,
  concat('2024-01-', lpad(CAST(1 + d.doc_id % 28 AS STRING), 2, '0'), 'T',
         lpad(CAST(d.doc_id % 24 AS STRING), 2, '0'), ':00:00',
         CASE WHEN d.doc_id % 2 = 0 THEN '-07:00' ELSE '-08:00' END) AS created,
  concat('2024-02-', lpad(CAST(1 + d.n_chars % 28 AS STRING), 2, '0'), 'T08:',
         lpad(CAST(d.n_chars % 60 AS STRING), 2, '0'), ':00',
         CASE WHEN d.doc_id % 2 = 0 THEN '+01:00' ELSE 'Z' END) AS updated,
  CASE WHEN d.doc_id % 4 <> 0 THEN concat('A ', d.lang, ' text from ', d.source) END AS short_caption,
  CASE WHEN d.doc_id % 4 <> 0 THEN d.text END AS long_caption,
  d.lang, d.source, d.n_chars AS width, d.text,
  l.quality, l.toxic, CASE WHEN l.doc_id IS NOT NULL THEN CAST(d.doc_id % 6 AS INT) END AS rating,
  e.vec_id IS NOT NULL AS has_vec
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id LEFT JOIN embeddings e ON e.vec_id = d.doc_id"""

VIEWS["m_refs"] = f"""
SELECT store, id, n, iri, created, media_path, link, model, records,
  concat('{M}Enrichment/', link, '-', model, '-', id) AS ref,
  concat(link, '/', id, '.', model, '.nq') AS path
FROM (
  SELECT store, id, n, iri, created, media_path, 'captionData' AS link, 'cap-a' AS model, CAST(1 AS BIGINT) AS records
    FROM m_media WHERE class = 'Image' AND n % 4 <> 0
  UNION ALL SELECT store, id, n, iri, created, media_path, 'captionData', 'cap-b', CAST(1 AS BIGINT)
    FROM m_media WHERE class = 'Image' AND n % 6 = 0
  UNION ALL SELECT store, id, n, iri, created, media_path, 'poseData', 'pose-a', n % 5
    FROM m_media WHERE class = 'Image' AND n % 3 = 0
  UNION ALL SELECT store, id, n, iri, created, media_path, 'vectorData', 'emb-64', CAST(1 AS BIGINT)
    FROM m_media WHERE class = 'Image' AND n % 4 <> 0 AND n % 5 <> 0 AND has_vec
) r"""

VIEWS["m_records"] = f"""
SELECT r.store, r.id, r.n, r.iri, r.created, r.link, r.model, r.ref, k.r_regionkey AS k,
  CASE r.link WHEN 'captionData' THEN 'Caption' WHEN 'poseData' THEN 'Pose' ELSE 'Embedding' END AS class,
  concat('{M}', CASE r.link WHEN 'captionData' THEN 'Caption' WHEN 'poseData' THEN 'Pose' ELSE 'Embedding' END,
         '/', r.model, '-', r.id, '-', CAST(k.r_regionkey AS STRING)) AS rec
FROM m_refs r JOIN region k ON k.r_regionkey < r.records"""

VIEWS["m_vectors"] = """
SELECT 'emb-64' AS model, vec_id AS key_id, embedding AS vec, label FROM embeddings"""

VIEWS["m_calls"] = """
SELECT event_id, ts, CAST(user_id AS STRING) AS id, 'en0001' AS store,
  CASE event_id % 6 WHEN 0 THEN 'caption' WHEN 1 THEN 'embed' WHEN 2 THEN 'pose' WHEN 3 THEN 'segment'
                    WHEN 4 THEN 'depth' ELSE 'face' END AS stage,
  CASE WHEN event_type <> 'error' THEN 200 WHEN event_id % 8 = 0 THEN 422 WHEN event_id % 8 = 1 THEN 503
       WHEN event_id % 8 = 2 THEN 402 WHEN event_id % 8 = 3 THEN 404 WHEN event_id % 8 = 4 THEN 429 END AS status,
  CASE WHEN event_type <> 'error' THEN NULL WHEN event_id % 8 = 5 THEN 'error sending request'
       WHEN event_id % 8 = 6 THEN 'operation timed out' WHEN event_id % 8 = 7 THEN 'embed returned no vector'
       WHEN event_id % 8 = 2 THEN '402 quota exceeded (add credits)' ELSE 'refused' END AS error,
  CAST(floor(value * 10) AS BIGINT) AS latency_ms, CAST(floor(value * 100) AS BIGINT) AS request_bytes
FROM events"""

VIEWS["m_edits"] = """
SELECT event_id AS seq, concat(CAST(user_id AS STRING), '-', CAST(CAST(floor(event_id / 500) AS BIGINT) AS STRING)) AS request,
  m.store, m.iri AS s, ts,
  CASE event_type WHEN 'click' THEN 'rating' WHEN 'view' THEN 'isPicked' WHEN 'purchase' THEN 'imageAestheticScore'
                  WHEN 'signup' THEN 'mediaCreatedDate' ELSE 'shortCaption' END AS key,
  CASE event_type WHEN 'click' THEN CAST(CAST(floor(value) AS BIGINT) % 7 AS STRING)
                  WHEN 'view' THEN CASE WHEN value < 200 THEN 'true' ELSE '"false"' END
                  WHEN 'purchase' THEN concat('"', CAST(CAST(floor(value) AS BIGINT) AS STRING), '"')
                  WHEN 'signup' THEN CASE WHEN value > 200 THEN '"yesterday"' ELSE '"2024-03-01T10:00:00-08:00"' END
                  ELSE '"a new caption"' END AS value
FROM events JOIN m_media m ON m.n = user_id WHERE m.class = 'Image'"""

# Facts of a media row: (predicate, condition, object, kind, datatype).
MEDIA_FACTS = [
    (TYPE, "true", f"concat('{V}', class)", "iri", None),
    (V + "id", "true", "iri", "iri", None),
    (V + "mediaPath", "true", "media_path", "literal", None),
    (V + "sourceFile", "true", "media_path", "literal", None),
    (V + "mediaType", "true", "media_type", "literal", None),
    (V + "createdDate", "true", "created", "literal", None),
    (V + "updatedDate", "n % 7 <> 0", "updated", "literal", None),
    (V + "width", "true", "CAST(width AS STRING)", "literal", None),
    (V + "shortCaption", "short_caption IS NOT NULL", "short_caption", "literal", None),
    (V + "longCaption", "long_caption IS NOT NULL", "long_caption", "literal", None),
    (V + "sceneObjects", "n % 4 <> 0", "lang", "literal", None),
    (V + "sceneObjects", "n % 4 <> 0", "source", "literal", None),
    (V + "rating", "rating IS NOT NULL", "CAST(rating AS STRING)", "literal", N.XSD + "integer"),
    (V + "isPicked", "quality = 1", "'true'", "literal", N.XSD + "boolean"),
    (V + "isRejected", "toxic = 1", "'true'", "literal", N.XSD + "boolean"),
    (V + "enrichmentCompleteDate", "n % 11 = 0", "updated", "literal", None),
    (V + "relatedToId", "class = 'Image'", f"concat('{M}ImageSet/', source)", "iri", None),
    (V + "relatedToId", "class = 'Video'", f"concat('{M}VideoSet/', source)", "iri", None),
    (V + "relatedToId", "class = 'Image' AND n > 0 AND floor(n / 7) % 10 <> 9",
     f"concat('{M}Image/', CAST(CAST(floor(n / 7) AS BIGINT) AS STRING))", "iri", None),
    (V + "thumbnail", "class = 'Image' AND width > 500", f"concat('{M}Thumbnail/t', id)", "iri", None),
    (N.DC + "subject", "true", "source", "literal", None),
    (N.DC + "creator", "n % 3 = 1", f"concat('{N.DC}agent/', lang)", "iri", None),
]
THUMB_FACTS = [
    (TYPE, f"'{V}Thumbnail'", "iri"), (V + "id", f"concat('{M}Thumbnail/t', id)", "iri"),
    (V + "path", "concat('image/img/jpg/', id, '_512.jpg')", "literal"), (V + "width", "'512'", "literal"),
    (V + "height", "'384'", "literal"), (V + "producedDate", "created", "literal"),
]
REF_FACTS = [
    ("iri", "", "ref", "iri", "true"),  # predicate is the link itself, see below
    ("ref", TYPE, f"'{V}Enrichment'", "iri", "true"), ("ref", V + "id", "ref", "iri", "true"),
    ("ref", V + "model", "model", "literal", "true"), ("ref", V + "path", "path", "literal", "true"),
    ("ref", V + "producedDate", "created", "literal", "true"),
]
RECORD_FACTS = [
    ("ref", V + "item", "rec", "iri", "true"), ("rec", TYPE, f"concat('{V}', class)", "iri", "true"),
    ("rec", V + "id", "rec", "iri", "true"), ("rec", V + "model", "model", "literal", "true"),
    ("rec", V + "producedDate", "created", "literal", "true"),
    ("rec", V + "text", "concat('caption ', id)", "literal", "class = 'Caption'"),
    ("rec", V + "keypoints", "concat(id, ',', CAST(k AS STRING), ',1')", "literal", "class = 'Pose'"),
    ("rec", V + "dim", "'64'", "literal", "class = 'Embedding'"),
    ("rec", V + "vectorPath", "concat('vectorData/', id, '.npy')", "literal", "class = 'Embedding'"),
]
SET_FACTS = [
    (TYPE, f"concat('{V}', class)", "iri"), (V + "id", "iri", "iri"), (V + "createdDate", "created", "literal"),
    (V + "updatedDate", "created", "literal"), (V + "description", "description", "literal"),
]
VIEWS["m_sets"] = f"""
SELECT store, class, source AS id, concat('{M}', class, '/', source) AS iri, created,
  CASE WHEN members > 3 THEN concat(CAST(members AS STRING), ' members') END AS description
FROM (SELECT store, concat(class, 'Set') AS class, source, min(created) AS created, count(*) AS members
      FROM m_media GROUP BY store, concat(class, 'Set'), source) x"""


def _fact_rows() -> list[tuple[str, str, str, str, str, str, str]]:
    """(view, condition, subject, predicate expression, object, kind, datatype or NULL) of every fact."""
    q = lambda t: f"'{t}'"
    rows = [("m_media", c, "iri", q(p), o, k, q(dt) if dt else "CAST(NULL AS STRING)") for p, c, o, k, dt in MEDIA_FACTS]
    null = "CAST(NULL AS STRING)"
    rows += [("m_media", "class = 'Image' AND width > 500", f"concat('{M}Thumbnail/t', id)", q(p), o, k, null)
             for p, o, k in THUMB_FACTS]
    rows += [("m_refs", c, s, q(p) if p else f"concat('{V}', link)", o, k, null) for s, p, o, k, c in REF_FACTS]
    rows += [("m_records", c, s, q(p), o, k, null) for s, p, o, k, c in RECORD_FACTS]
    rows += [("m_sets", "description IS NOT NULL" if p.endswith("description") else "true", "iri", q(p), o, k, null)
             for p, o, k in SET_FACTS]
    return rows


VIEWS["quads"] = "\nUNION ALL ".join(
    f"SELECT store, {s} AS s, {p} AS p, {o} AS o, '{k}' AS o_kind, {dt} AS dt, '{G}' AS g FROM {view} WHERE {cond}"
    for view, cond, s, p, o, k, dt in _fact_rows())


def oracle(sql: str) -> str:
    """A DuckDB query over the bound views."""
    views = ",\n".join(f"{n} AS ({t.strip()})" for n, t in VIEWS.items())
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {views},\n{body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {views},\n{body[5:]}"
    return f"WITH {views}\n{body}"


class Binding:
    """The views of one data folder as DataFrames; all lazy but `quads`, which is written once and read back."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def _views(self) -> dict[str, DataFrame]:
        """Each view over this folder's tables. Temp views only carry names into the SQL texts: the frames are
        resolved here, so a later binding of another folder does not change them."""
        for t in ("documents", "labels", "embeddings", "events", "region"):
            self.table(t).createOrReplaceTempView(t)
        out = {}
        for name, sql in VIEWS.items():
            if name != "quads":
                out[name] = self.spark.sql(sql)
                out[name].createOrReplaceTempView(name)
        return out

    def view(self, name: str) -> DataFrame:
        return self._views[name]

    media = cached_property(lambda self: self.view("m_media"))
    refs = cached_property(lambda self: self.view("m_refs"))
    records = cached_property(lambda self: self.view("m_records"))
    sets = cached_property(lambda self: self.view("m_sets"))
    vectors = cached_property(lambda self: self.view("m_vectors"))
    calls = cached_property(lambda self: self.view("m_calls"))
    edits = cached_property(lambda self: self.view("m_edits"))

    def lazy_quads(self) -> DataFrame:
        """All facts: one pass per view, each row exploded to its quads."""
        parts = []
        for view in ("m_media", "m_refs", "m_records", "m_sets"):
            facts = [r for r in _fact_rows() if r[0] == view]
            items = ", ".join(
                f"CASE WHEN {c} THEN named_struct('s', {s}, 'p', {p}, 'o', {o}, 'o_kind', '{k}', 'dt', {dt}) END"
                for _, c, s, p, o, k, dt in facts)
            parts.append(self.view(view).selectExpr("store", f"explode(filter(array({items}), x -> x IS NOT NULL)) AS f")
                         .select("store", "f.*", F.lit(G).alias("g")))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    @cached_property
    def quads(self) -> DataFrame:
        root = fresh_dir(self.spark, "quads")
        write_snapshot(self.lazy_quads(), root)
        return read_snapshot(self.spark, root)


_OPEN: dict[tuple[str, str], Binding] = {}


def open_binding(spark: SparkSession, sf_dir: str) -> Binding:
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"))
    if key not in _OPEN:
        _OPEN[key] = Binding(spark, sf_dir)
    return _OPEN[key]
