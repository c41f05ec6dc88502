"""Model answers to facts. `answers(store, media, media_path, created, model, produced, answer)` holds one model reply
(JSON text) a row; each parser returns (runs, failures), and `enrichment_quads` turns runs into quads.

A run: the columns of the answer plus `link, stage, ref_id, path, reply_path, count, request, records`, where records
is an array of (class, id, fields array of (k, v)). A run that found nothing is a run without records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from catalograph import names as N
from catalograph.functions.geometry import numbers_text, plain, points_text, trimmed
from catalograph.functions.text import base32_id, bare_id, enrichment_path, stripped, valid_id

FIELDS = "array<struct<k:string,v:string>>"
RECORDS = f"array<struct<class:string,id:string,fields:{FIELDS}>>"
REQUEST = "struct<nouns:string,min_confidence:double,polygon_verts:int>"
PNG_MAGIC = "89504E470D0A1A0A"
RUN_COLS = ["store", "media", "link", "stage", "model", "produced", "ref_id", "path", "reply_path", "count", "request", "records"]


def _field(k: str, value: Column) -> Column:
    return F.struct(F.lit(k).alias("k"), value.cast("string").alias("v"))


def _file(stage: str, ext: Column | str) -> Column:
    ext = F.lit(ext) if isinstance(ext, str) else ext
    return enrichment_path(F.col("media_path"), F.col("created"), F.lit(stage), F.col("model"), ext)


def _start(answers: DataFrame, stage: str, schema: str | None) -> DataFrame:
    df = answers.withColumn("ref_id", base32_id(F.concat_ws("|", "store", "media", F.lit(stage), "model", "produced")))
    df = df.withColumn("link", F.lit(N.STAGE_LINKS[stage])).withColumn("stage", F.lit(stage))
    return df if schema is None else df.withColumn("x", F.from_json("answer", schema))


def _done(df: DataFrame, stage: str, reason: Column, records: Column, count: Column | None = None, reply: bool = True,
          request: Column | None = None) -> tuple[DataFrame, DataFrame]:
    judged = df.withColumn("reason", reason)
    runs = judged.filter("reason IS NULL").select(
        "store", "media", "link", "stage", "model", "produced", "ref_id", _file(stage, "nq").alias("path"),
        (_file(stage, "json") if reply else F.lit(None).cast("string")).alias("reply_path"),
        (count if count is not None else F.lit(None)).cast("bigint").alias("count"),
        (request if request is not None else F.lit(None)).cast(REQUEST).alias("request"), records.cast(RECORDS).alias("records"))
    return runs, judged.filter("reason IS NOT NULL").select("store", "media", "model", "reason")


def _record(class_: str, id_: Column, *fields: Column) -> Column:
    return F.struct(F.lit(class_).alias("class"), id_.alias("id"), F.array(*fields).alias("fields"))


def _numbered(items: Column, build) -> Column:
    """Records of a list, each with an id of its own."""
    ids = F.transform(F.sequence(F.lit(1), F.greatest(F.size(items), F.lit(1))), lambda i: base32_id(F.concat_ws("/", "ref_id", i.cast("string"))))
    return F.when(F.size(items) > 0, F.zip_with(items, ids, build)).otherwise(F.array().cast(RECORDS))


def enrichment_quads(runs: DataFrame) -> DataFrame:
    """Reference and record quads of runs. An empty value never becomes a fact, and only the segment reference
    carries a count."""
    iri = lambda cls, id_: F.concat(F.lit(N.MEDIA_NS), cls, F.lit("/"), id_)
    ref = iri(F.lit("Enrichment"), F.col("ref_id"))
    t = lambda s, p, o, kind="literal": F.struct(s.alias("s"), (p if isinstance(p, Column) else F.lit(N.v(p) if ":" not in p else p)).alias("p"),
                                                 o.cast("string").alias("o"), F.lit(kind).alias("o_kind"))
    region = F.col("link") == "regionData"
    facts = F.array(
        t(F.col("media"), F.concat(F.lit(N.VOCAB), "link"), ref, "iri"),
        t(ref, N.RDF_TYPE, F.when(region, N.v("RegionData")).otherwise(N.v("Enrichment")), "iri"), t(ref, "id", ref, "iri"),
        t(ref, "model", F.col("model")), t(ref, "path", F.col("path")), t(ref, "count", F.when(region, F.col("count"))),
        t(ref, "modelReplyPath", F.col("reply_path")), t(ref, "requestNouns", F.col("request.nouns")),
        t(ref, "requestMinConfidence", plain(F.col("request.min_confidence"))),
        t(ref, "requestPolygonVerts", F.col("request.polygon_verts")), t(ref, "producedDate", F.col("produced")))

    def of_record(r: Column) -> Column:
        node = iri(r["class"], r["id"])
        own = F.array(t(ref, "item", node, "iri"), t(node, N.RDF_TYPE, F.concat(F.lit(N.VOCAB), r["class"]), "iri"),
                      t(node, "id", node, "iri"), t(node, "model", F.col("model")), t(node, "producedDate", F.col("produced")))
        return F.concat(own, F.transform(r["fields"], lambda f: t(node, F.concat(F.lit(N.VOCAB), f["k"]), f["v"])))

    every = F.concat(facts, F.flatten(F.transform("records", of_record)))
    rows = runs.select("store", F.explode(F.filter(every, lambda x: x["o"].isNotNull() & (x["o"] != ""))).alias("x"))
    return rows.select("store", "x.*", F.lit(None).cast("string").alias("dt"), F.lit(N.GRAPH).alias("g")).select(*N.QUAD_COLS)


def _blankless(c: Column) -> Column:
    return F.when(stripped(c) != "", c)


def embedding_runs(answers: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(runs, vectors, failures). A vector whose length is not the stated dimension is a failed run."""
    df = _start(answers, "embed", "vector array<float>, dim int, precision string, provider string")
    v = F.col("x.vector")
    reason = (F.when(v.isNull() | (F.size(v) == 0), "no vector in the answer")
              .when(F.coalesce(F.col("x.dim"), F.lit(0)).isin(0) | (F.col("x.dim") == F.size(v)), None)
              .otherwise(F.concat(F.lit("stated dimension "), F.col("x.dim").cast("string"), F.lit(", given length "), F.size(v).cast("string"))))
    rec = _record("Embedding", base32_id(F.concat_ws("/", "ref_id", F.lit("1"))), _field("dim", F.size(v)), _field("vectorPath", _file("embed", "npy")),
                  _field("precision", _blankless(F.col("x.precision"))), _field("provider", _blankless(F.col("x.provider"))))
    runs, failures = _done(df, "embed", reason, F.array(rec))
    vectors = df.filter(reason.isNull()).select("store", "model", bare_id(F.col("media")).alias("key_id"), v.alias("vec"), "produced")
    return runs, vectors, failures


def region_runs(answers: DataFrame, request: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """One region per finding; the box only when it has four numbers."""
    df = _start(answers, "segment", "regions array<struct<prompt:string,score:double,bbox:array<bigint>,polygon:string>>")
    regions = F.coalesce(F.col("x.regions"), F.array().cast("array<struct<prompt:string,score:double,bbox:array<bigint>,polygon:string>>"))
    records = _numbered(regions, lambda r, i: _record(
        "Region", i, _field("descriptor", r["prompt"]), _field("score", F.format_string("%.4f", F.coalesce(r["score"], F.lit(0.0)))),
        _field("bbox", F.when(F.size(r["bbox"]) == 4, F.array_join(r["bbox"].cast("array<string>"), ","))), _field("polygon", r["polygon"])))
    bad = F.when(F.try_parse_json("answer").isNull(), "unreadable segment reply")
    return _done(df, "segment", bad, records, count=F.size(regions), request=request)


def pose_runs(answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One record per person. No keypoints is a run that found nobody."""
    df = _start(answers, "pose", "keypoints array<array<array<double>>>, skeleton_png_b64 string")
    people = F.coalesce(F.col("x.keypoints"), F.array().cast("array<array<array<double>>>"))
    overlay = F.when(F.coalesce(F.col("x.skeleton_png_b64"), F.lit("")) != "", _file("pose", "png"))
    records = _numbered(people, lambda p, i: _record("Pose", i, _field("keypoints", points_text(p, trimmed)), _field("overlayPath", overlay)))
    bad = F.when(F.try_parse_json("answer").isNull(), "unreadable pose reply")
    return _done(df, "pose", bad, records, reply=False)


def depth_runs(answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One map per image; without a map, its range or PNG bytes the image stays pending."""
    df = _start(answers, "depth", "depth_png_b64 string, min double, max double, width int, height int, precision string, provider string")
    text = stripped(F.coalesce(F.col("x.depth_png_b64"), F.lit("")))
    magic = F.substring(F.hex(F.try_to_binary(text, F.lit("base64"))), 1, 16)
    reason = (F.when(text == "", "the reply holds no depth map")
              .when(F.col("x.min").isNull() | F.col("x.max").isNull(), "the depth range is missing")
              .when(magic.isNull(), "the depth map is no base64").when(magic != PNG_MAGIC, "the depth map has another format than PNG"))
    rec = _record("Depth", base32_id(F.concat_ws("/", "ref_id", F.lit("1"))), _field("depthMapPath", _file("depth", "png")),
                  _field("depthMin", plain(F.col("x.min"))), _field("depthMax", plain(F.col("x.max"))), _field("width", F.col("x.width")),
                  _field("height", F.col("x.height")), _field("precision", _blankless(F.col("x.precision"))),
                  _field("provider", _blankless(F.col("x.provider"))))
    return _done(df, "depth", reason, F.array(rec))


FACE = ("struct<bbox:array<double>,score:double,kps:array<array<double>>,pose:array<double>,embedding:array<float>>")


def face_runs(answers: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(runs, vectors keyed by face, failures). One malformed face refuses the whole run; an empty list is a finding,
    a missing one a failure."""
    df = _start(answers, "face", f"faces array<{FACE}>, precision string, provider string")
    faces = F.col("x.faces")
    good = F.forall(faces, lambda f: (F.coalesce(F.size(f["bbox"]), F.lit(-1)) == 4) & f["score"].isNotNull()
                    & (F.coalesce(F.size(f["kps"]), F.lit(-1)) == 5) & F.coalesce(F.forall(f["kps"], lambda p: F.size(p) == 2), F.lit(False))
                    & (f["pose"].isNull() | (F.size(f["pose"]) == 3)) & (F.coalesce(F.size(f["embedding"]), F.lit(0)) > 0))
    reason = F.when(faces.isNull(), "the reply lists no faces").when(~good, "one of the faces is incomplete")
    records = _numbered(faces, lambda f, i: _record(
        "Face", i, _field("bbox", numbers_text(f["bbox"])), _field("score", F.format_string("%.4f", f["score"])),
        _field("landmarks", points_text(f["kps"], plain)), _field("vectorPath", _file("face", F.concat(i, F.lit(".npy")))),
        _field("dim", F.size(f["embedding"])), _field("headPose", numbers_text(f["pose"])),
        _field("precision", _blankless(F.col("x.precision"))), _field("provider", _blankless(F.col("x.provider")))))
    runs, failures = _done(df, "face", reason, records)
    pairs = df.filter(reason.isNull()).select("store", "model", "produced", "ref_id", F.posexplode(faces).alias("at", "f"))
    vectors = pairs.select("store", "model", base32_id(F.concat_ws("/", "ref_id", (F.col("at") + 1).cast("string"))).alias("key_id"),
                           F.col("f.embedding").alias("vec"), "produced")
    return runs, vectors, failures


def parse_captions(answers: DataFrame, text: str = "answer") -> DataFrame:
    """Parsed caption answers: `short_caption, long_caption, objects, scene, dropped, reason`.

    The object is what stands between the first `{` and the last `}`. Undeclared keys are named and left out,
    the rest is kept; `N/A` and empty values are no facts.
    """
    raw = F.regexp_extract(F.col(text), "(?s)(\\{.*\\})", 1)
    df = answers.withColumn("j", F.try_parse_json(raw))
    df = df.withColumn("m", F.when(F.schema_of_variant("j").startswith("OBJECT"), F.from_json(raw, "map<string,string>")))
    get = lambda k: F.try_element_at(F.col("m"), F.lit(k))
    typed = lambda k: F.coalesce(F.schema_of_variant(F.try_variant_get("j", f"$.{k}", "variant")), F.lit("VOID"))
    said = lambda k: F.when(typed(k) == "STRING", F.coalesce(stripped(get(k)), F.lit(""))).otherwise("")  # only a text is a caption
    texts = F.transform(F.filter(F.try_variant_get("j", "$.sceneObjects", "array<variant>"), lambda x: F.schema_of_variant(x) == "STRING"),
                        lambda x: x.cast("string"))
    items = F.when(typed("sceneObjects").startswith("ARRAY"), texts).otherwise(F.split(get("sceneObjects"), ","))
    clean = F.transform(items, lambda x: F.lower(stripped(F.regexp_replace(stripped(x), "^[.;]+|[.;]+$", ""))))
    kept = F.array_distinct(F.filter(clean, lambda x: (x != "") & (F.octet_length(x) <= 40)))
    scene = F.filter(F.array(*[F.struct(F.lit(k).alias("k"), stripped(get(k)).alias("v")) for k in N.SCENE_FIELDS + N.JUDGEMENT_FIELDS]),
                     lambda f: f["v"].isNotNull() & (f["v"] != "") & (F.upper(f["v"]) != "N/A"))
    declared = F.array(*[F.lit(k) for k in ["shortCaption", "longCaption", "sceneObjects", *N.SCENE_FIELDS, *N.JUDGEMENT_FIELDS]])
    reason = (F.when(raw == "", "no object in the reply").when(F.col("m").isNull(), "the reply's object does not parse")
              .when(F.map_contains_key("m", F.lit("sceneObjects")) & ~typed("sceneObjects").startswith("ARRAY") & (typed("sceneObjects") != "STRING"),
                    "sceneObjects is no list of texts"))
    none = F.array().cast("array<string>")
    return df.select(*[c for c in answers.columns], said("shortCaption").alias("short_caption"),
                     said("longCaption").alias("long_caption"), F.coalesce(kept, none).alias("objects"),
                     scene.alias("scene"), F.coalesce(F.sort_array(F.array_except(F.map_keys("m"), declared)), none).alias("dropped"),
                     reason.alias("reason"))


def caption_runs(answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Caption runs: the whole answer is kept on the record. `answers` may carry `prompt_path`."""
    prompt = F.col("prompt_path") if "prompt_path" in answers.columns else F.lit(None).cast("string")
    df = parse_captions(_start(answers, "caption", None))
    rec = _record("Caption", base32_id(F.concat_ws("/", "ref_id", F.lit("1"))), _field("text", F.col("answer")), _field("modelPromptPath", _blankless(prompt)))
    return _done(df, "caption", F.col("reason"), F.array(rec), reply=False)


def segment_requests(media: DataFrame, always: list[str]) -> DataFrame:
    """What to ask the segmenter: an image's scene objects, then the nouns always asked for, none twice."""
    nouns = F.array_union(F.coalesce("scene_objects", F.array().cast("array<string>")), F.array(*[F.lit(x) for x in always]).cast("array<string>"))
    return media.select("store", "iri", F.array_join(nouns, ",").alias("nouns"), F.size(nouns).alias("n"))


def embedding_text(media: DataFrame) -> Column:
    """`label: value` lines of the captions and the render request, blank ones left out."""
    cols = {"shortCaption": "short_caption", "longCaption": "long_caption", "renderRequestInformation": "render_request"}
    lines = [F.when(stripped(F.col(c)) != "", F.concat(F.lit(f"{label}: "), stripped(F.col(c)), F.lit("\n")))
             for label, c in cols.items() if c in media.columns]
    return F.concat_ws("", *lines)
