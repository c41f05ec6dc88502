import json
import struct
import zlib
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from catalograph import names as N
from catalograph.operators import analytics as A, arrivals as AR, facts as D
from catalograph.sources import exports as E, files as FI, nquads as NQ, snapshots as SN, tables as TB, versions as VS
from tests.conftest import img


def chunk(kind, data):
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def png(w=64, h=48, xmp=None, pixels=b"pixels"):
    out = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">II5B", w, h, 8, 2, 0, 0, 0))
    if xmp is not None:
        out += chunk(b"iTXt", b"XML:com.adobe.xmp\0\0\0\0\0" + xmp)
    return out + chunk(b"IDAT", pixels) + chunk(b"IEND", b"")


def test_nquads_round_trip_and_malformed_lines(spark, tmp_path, quads):
    q = quads((img("a"), "shortCaption", 'say "hi"\\ \n\r tab\t end é 😀'), ("_:b1", "rating", "5", "literal", N.XSD + "integer"),
              (img("a"), "relatedToId", "_:b1", "bnode"), (img("a"), "relatedToId", img("b")))
    NQ.write_nquads(q, f"{tmp_path}/out")
    back = NQ.read_nquads(spark, f"{tmp_path}/out", "st0001")
    key = lambda df: sorted(map(repr, (tuple(r) for r in df.select(*N.QUAD_COLS).collect())))
    assert key(back) == key(q)
    (tmp_path / "extra.nq").write_text('# note\n\n<http://a> <http://p> "caf\\u00e9 \\U0001F600 it\\\'s"@fr .\n', encoding="utf-8")
    r = NQ.read_nquads(spark, f"{tmp_path}/extra.nq").first()
    assert r.o == "café 😀 it's" and r.dt.endswith("@fr") and r.g is None and r.file.endswith("extra.nq")
    (tmp_path / "bad.nq").write_text("<http://a> <http://p> .\n")
    with pytest.raises(Exception, match="malformed N-Quads line"):
        NQ.read_nquads(spark, f"{tmp_path}/bad.nq").collect()


def test_long_literals_parse_in_constant_stack(spark):
    text = "word \\n \\\"" * 40_000
    df = spark.createDataFrame([(f'<http://a> <http://p> "{text}" <{N.GRAPH}> .',)], "value string")
    assert len(NQ.parse_lines(df).first().o) == 8 * 40_000


def test_snapshots_are_versions_and_prune_by_predicate(spark, tmp_path, quads):
    root = f"{tmp_path}/q"
    a = quads((img("a"), "width", "1"), (img("a"), "height", "2"))
    assert SN.write_snapshot(a, root) == 1
    changed = D.unset_everywhere(SN.read_snapshot(spark, root), "width").apply(SN.read_snapshot(spark, root))
    assert SN.write_snapshot(changed, root) == 2
    (tmp_path / "q" / "v=3").mkdir()  # a write that died
    assert SN.read_snapshot(spark, root).count() == 1 and SN.read_snapshot(spark, root, 1).count() == 2


def test_a_commit_writes_what_it_touches_and_one_writer_wins(spark, tmp_path, quads):
    root = f"{tmp_path}/q"
    a = quads(*[(img(f"a{i}"), p, str(i)) for i in range(20) for p in ("width", "height", "source")])
    assert SN.write_snapshot(a, root) == 1
    files = lambda: {f: f.stat().st_mtime_ns for f in tmp_path.rglob("*.parquet")}
    before, q = files(), SN.read_snapshot(spark, root)
    mine, other = D.unset_everywhere(q, "width"), D.unset_everywhere(q, "height")
    assert SN.commit(spark, root, mine) == 2
    with pytest.raises(VS.Taken):
        SN.commit(spark, root, other, base=1)
    after = files()
    assert all(after[f] == t for f, t in before.items()) and set(after) == set(before)  # a predicate that went needs no file
    more = D.Change(quads((img("z"), "source", "9"), (img("a1"), "source", "1")), quads((img("a3"), "source", "3")).select("store", "s", "p"), q)
    assert SN.commit(spark, root, more) == 3
    new = set(files()) - set(before)
    assert new and all("source" in f.parent.name for f in new)
    got = sorted((r.p.rsplit("/", 1)[-1].rsplit("#")[-1], r.s) for r in SN.read_snapshot(spark, root).collect())
    want = [("height", img(f"a{i}")) for i in range(20)] + [("source", img(f"a{i}")) for i in range(20) if i != 3] + [("source", img("z"))]
    assert got == sorted(want)
    assert SN.read_snapshot(spark, root, 1).count() == 60 and SN.read_snapshot(spark, root, 2).count() == 40
    whole = D.Change(None, quads(*[(img(f"a{i}"), "x", "") for i in range(20)]).select("store", "s"), q)
    assert SN.commit(spark, root, whole) == 4 and [r.s for r in SN.read_snapshot(spark, root).collect()] == [img("z")]


def test_a_version_that_is_half_written_is_not_there(spark, tmp_path, quads):
    root = f"{tmp_path}/q"
    SN.write_snapshot(quads((img("a"), "width", "1")), root)
    (tmp_path / "q" / "_versions" / "2.json").write_text('{"par')
    assert SN.read_snapshot(spark, root).count() == 1 and VS.latest(spark, root) == 1


def test_stored_vectors(spark, tmp_path):
    d = tmp_path / "image" / "enrichment" / "embed" / "2024" / "01" / "02"
    d.mkdir(parents=True)
    for i in range(3):
        np.save(d / f"20240102-030405-id{i}.embed.m1.npy", np.array([i, 0.5], dtype="<f4"))
    rel = "image/enrichment/embed/2024/01/02/20240102-030405-id{}.embed.m1.npy"
    recs = spark.createDataFrame([(str(i), rel.format(i)) for i in range(4)], "key_id string, path string")
    got = {r.key_id: r.vec for r in FI.load_vectors(spark, str(tmp_path), recs).collect()}
    assert got == {"0": [0.0, 0.5], "1": [1.0, 0.5], "2": [2.0, 0.5], "3": None}
    seen = FI.scan_media(spark, str(tmp_path)).filter("ext = 'npy'").orderBy("id").collect()
    assert [(r.role, r.stage, r.model, r.day, r.id) for r in seen] == [("enrichment", "embed", "m1", "2024-01-02", f"id{i}") for i in range(3)]
    np.save(d / "20240102-030405-id9.embed.m1.npy", np.array([1, 2]))
    with pytest.raises(Exception, match="f32"):
        FI.load_vectors(spark, str(tmp_path), spark.createDataFrame([("9", rel.format(9))], "key_id string, path string")).collect()


def test_path_grammar(spark):
    paths = ["image/img/jpg/2024/01/02/20240102-030405-abc_512.jpg", "image/enrichment/face/2024/01/02/20240102-030405-abc.face.m1.f9.npy", "notes/readme.txt"]
    rows = [FI.parse_media_path(spark.createDataFrame([(p,)], "path string")).first() for p in paths]
    assert (rows[0].role, rows[0].id, rows[0].long_edge, rows[0].ext) == ("jpg", "abc", 512, "jpg")
    assert (rows[1].stage, rows[1].model, rows[1].item, rows[1].id) == ("face", "m1", "f9", "abc")
    assert rows[2].role == "other" and rows[2].id is None


def test_exports(spark, tmp_path):
    v = spark.createDataFrame([("b", [0.5, -2.0]), ("a", [1.0, 3.0])], "key_id string, vec array<float>")
    E.export_vectors(v, f"{tmp_path}/nd")
    assert [json.loads(r.value) for r in spark.read.text(f"{tmp_path}/nd").orderBy("value").collect()] == [{"id": "a", "vector": [1.0, 3.0]}, {"id": "b", "vector": [0.5, -2.0]}]
    for form, dtype in (("f32", "<f4"), ("f16", "<f2")):
        E.export_vectors(v, f"{tmp_path}/{form}", form)
        recs = sorted(bytes(r.record) for r in spark.read.parquet(f"{tmp_path}/{form}").collect())
        assert recs == [b"\x01a" + np.array([1, 3], dtype).tobytes(), b"\x01b" + np.array([0.5, -2], dtype).tobytes()]
    with pytest.raises(ValueError, match="format must be"):
        E.export_vectors(v, f"{tmp_path}/x", "csv")


def test_call_log_and_retention(spark, tmp_path):
    calls = spark.createDataFrame([("2024-01-01T23:59:59-08:00", "s", "i", "pose", 200), ("2024-01-05T00:00:00Z", "s", "i", "pose", 503)], "time string, store string, id string, stage string, status int")
    TB.write_calls(calls, f"{tmp_path}/log")
    log = TB.read_calls(spark, f"{tmp_path}/log").unionByName(spark.createDataFrame([("notes",)], "day string"), allowMissingColumns=True)
    assert sorted(r.day for r in TB.retain(log, date(2024, 1, 8), 3).collect()) == ["2024-01-05", "notes"]
    with pytest.raises(ValueError):
        TB.retain(log, date(2024, 1, 8), 0)


SET_OK = [f"<{N.MEDIA_NS}ImageSet/s1> <{N.RDF_TYPE}> <{N.v('ImageSet')}> <{N.GRAPH}> .", f"<{N.MEDIA_NS}ImageSet/s1> <{N.v('id')}> <{N.MEDIA_NS}ImageSet/s1> <{N.GRAPH}> .",
          f"<{N.MEDIA_NS}ImageSet/s1> <{N.v('createdDate')}> \"2024\" <{N.GRAPH}> ."]


@pytest.mark.parametrize("name, change, fault", [
    ("s1", lambda x: x, None), ("s2", lambda x: x, "other than its id"), ("s1", lambda x: x[1:], "is not typed"), ("s1", lambda x: x[:2], "lacks its creation date"),
    ("s1", lambda x: [x[0], x[2]], "never states its id"), ("s1", lambda x: x + [x[2].replace("s1>", "s9>", 1)], "more than one node"),
    ("s1", lambda x: x + [x[2].replace("createdDate", "rating")], "unknown statement"), ("s1", lambda x: x[:2] + [x[2].replace(f" <{N.GRAPH}>", "")], "another graph")])
def test_set_files_are_strict(spark, tmp_path, name, change, fault):
    (tmp_path / f"{name}.nq").write_text("\n".join(change(SET_OK)) + "\n")
    load = lambda: FI.load_sets(spark, str(tmp_path), "ImageSet", "st0001").collect()
    if fault is None:
        assert [(r.id, r.created) for r in load()] == [("s1", "2024")]
    else:
        with pytest.raises(Exception, match=fault):
            load()


def test_ontology_text(spark, tmp_path):
    (tmp_path / "o.ttl").write_text("""@prefix cat: <x> .
cat:Media a owl:Class .

cat:stars a owl:DatatypeProperty ;
    rdfs:comment "how many" ;
    rdfs:domain cat:Media ;
    rdfs:range cat:StarValue .

cat:StarValue a rdfs:Datatype ;
    owl:withRestrictions ( [ xsd:minInclusive -2 ] [ xsd:maxInclusive 5 ] ) .

cat:free a owl:DatatypeProperty ;
    rdfs:domain cat:Pose .
""")
    o = TB.load_ontology(spark, str(tmp_path / "o.ttl"))
    assert sorted(map(tuple, o.collect())) == [("free", "Pose", "string", None, None, False), ("stars", "Media", "StarValue", -2, 5, True)]
    assert TB.settable_of(o) == {"stars": "StarValue"}


def test_ledger_appends(spark, tmp_path):
    row = lambda s: spark.createDataFrame([("2024", s, "a,b \"q\".png", "line one\nline two")], "when string, status string, source_path string, reason string")
    for s in ("delivering", "stored"):
        TB.append_ledger(row(s), f"{tmp_path}/l")
    got = TB.read_ledger(spark, f"{tmp_path}/l")
    assert {r.status for r in got.collect()} == {"delivering", "stored"} and {r.source_path for r in got.collect()} == {'a,b "q".png'}
    assert A.reconcile(got).first().done


def test_picture_hash_ignores_only_the_metadata_chunk(spark):
    files = [("a", png(xmp=b"one")), ("b", png(xmp=b"two, longer")), ("c", png(pixels=b"other")), ("d", png()[:-6]), ("e", b"plain")]
    df = spark.createDataFrame([(p, bytearray(b)) for p, b in files], "path string, content binary")
    h = {r.path: r.h for r in df.select("path", A.png_hash(F.col("content")).alias("h")).collect()}
    assert h["a"] == h["b"] != h["c"] and h["d"] is None and h["e"] is None
    assert [(r.path, r.kept, r.duplicate) for r in A.exact_dups(df, "png").orderBy("path").collect()] == [("a", "a", False), ("b", "a", True)]


def test_arriving_files_become_facts(spark, tmp_path, quads):
    packet = f"""<rdf:RDF xmlns:rdf="{N.RDF}"><rdf:Description rdf:about="" xmlns:dc="{N.DC}" xmlns:cat="{N.VOCAB}"><dc:subject><rdf:Bag><rdf:li>x</rdf:li><rdf:li>y</rdf:li></rdf:Bag></dc:subject>
      <cat:relatedToId>&lt;cat/ImageSet/new&gt;</cat:relatedToId><cat:mediaCreatedDate>{{}}</cat:mediaCreatedDate></rdf:Description></rdf:RDF>"""
    for name, body in (("good.png", png(2000, 1000)), ("late.png", png()), ("fake.png", b"GIF8"[::-1]), ("clip.mov", b"\0\0\0\x18ftypqt  \0\0")):
        (tmp_path / name).write_bytes(body)
    files = FI.arrivals(spark, str(tmp_path), "st0001", stream=False).withColumn("path", F.substring_index("path", "/", -1))
    packets = spark.createDataFrame([("st0001", "good.png", packet.format("2024-05-01T00:00:00Z")), ("st0001", "late.png", packet.format("2024-05-01"))], "store string, path string, packet string")
    rows, facts, rejects = AR.ingest(files, quads((img("zz"), N.RDF_TYPE, N.v("Image"))), packets, "now")
    assert {r.path: r.reason for r in rejects.collect()} == {"fake.png": "not a readable image", "late.png": "mediaCreatedDate: not an RFC3339 date with a zone"}
    assert {r.path: r["class"] for r in rows.collect()} == {"good.png": "Image", "clip.mov": "Video"}
    f = [((["blank"] + r.s.split("/"))[-2], r.p.rsplit("/", 1)[-1].rsplit("#")[-1], r.o) for r in facts.collect()]
    assert ("Image", "width", "2000") in f and ("Thumbnail", "width", "512") in f and ("Thumbnail", "height", "256") in f
    assert ("Image", "relatedToId", N.MEDIA_NS + "ImageSet/new") in f and ("ImageSet", "createdDate", "now") in f
    assert sorted(o for _, p, o in f if p in ("_1", "_2")) == ["x", "y"]


def test_a_set_that_cannot_be_made_refuses_its_file(spark, quads):
    """An id too long, an id another node has; a set that exists, or can be made, does not."""
    q = quads((img("zz"), N.RDF_TYPE, N.v("Image")), (N.MEDIA_NS + "ImageSet/old", N.RDF_TYPE, N.v("ImageSet")))
    named = {"long": "ImageSet/" + "x" * 201, "taken": "ImageSet/zz", "old": "ImageSet/old", "new": "ImageSet/fresh", "wrong": "VideoSet/v"}
    said = quads(*[(img(k), "relatedToId", N.MEDIA_NS + s, "iri", None) for k, s in named.items()]).withColumn("media", F.col("s"))
    media = spark.createDataFrame([("st0001", img(k), "Image") for k in named], "store string, media string, class string")
    made, rejects = AR.make_named_sets(said, q, media, "now")
    why = {r.media.rsplit("/", 1)[-1]: r.reason for r in rejects.collect()}
    assert set(why) == {"long", "taken", "wrong"} and "could not be made" in why["long"] and why["long"].endswith("invalid id") and why["taken"].endswith("the id is taken")
    assert {r.s for r in made.collect()} == {N.MEDIA_NS + "ImageSet/fresh"}


def test_two_copies_get_two_ids_and_a_retry_the_same(spark):
    df = spark.createDataFrame([("s", "b", p, bytearray(png()), "image/png", "2024-01-02T03:04:05Z") for p in ("a", "b")], "store string, batch string, path string, content binary, claimed string, created string")
    one = {r.path: r.id for r in AR.arrival_rows(df).collect()}
    assert one["a"] != one["b"] and one == {r.path: r.id for r in AR.arrival_rows(df).collect()}
    taken = spark.createDataFrame([("s", one["a"])], "store string, id string")
    again = {r.path: r.id for r in AR.arrival_rows(df, taken).collect()}
    assert again["a"] != one["a"] and again["b"] == one["b"]


def test_later_dates_count_distinct_values_with_those_present(spark, quads):
    st = spark.createDataFrame([("st0001", img(i), 0, img(i), N.v("mediaCreatedDate"), d, "literal", None) for i, d in
                                (("a", "2024-01-01T00:00:00Z"), ("b", "2024-01-02T00:00:00Z"), ("c", "2024-01-01"))], AR.STATEMENT_SCHEMA)
    have = quads(*[(img(i), "mediaCreatedDate", "2024-01-01T00:00:00Z") for i in "ab"])
    assert {r.media: r.reason for r in AR.check_dates(st, have).collect()} == {
        img("b"): "mediaCreatedDate: more than one value", img("c"): "mediaCreatedDate: not an RFC3339 date with a zone"}


def test_added_statements_refuse_own_names(spark):
    st = spark.createDataFrame([("s", img("a"), 0, img("a"), p, "1", "literal", None) for p in (N.v("rating"), N.v("relatedToId"), N.DC + "x")], AR.STATEMENT_SCHEMA)
    kept, refused = AR.producer_policy(st, "later")
    assert kept.count() == 0 and refused.first().names == [N.v("rating")]
    assert AR.producer_policy(st)[0].count() == 2


def test_control_characters_survive_a_round_trip(spark, tmp_path):
    from catalograph.sources import nquads as NQ

    texts = ["back\\slash and \x01 control \x1f", "\x08\x0c\x7f", 'quote " and \\u0041 kept', "tab\tline\nend\r"]
    q = spark.createDataFrame([("st", "http://a/s", "http://a/p", t, "literal", None, N.GRAPH) for t in texts], N.QUAD_SCHEMA)
    NQ.write_nquads(q, f"file://{tmp_path}/out")
    assert sorted(r.o for r in NQ.read_nquads(spark, f"file://{tmp_path}/out", "st").collect()) == sorted(texts)


def test_pictures_that_are_not_decoded_are_refused(spark):
    kinds = {"avif": b"\0\0\0\x1cftypavif\0\0", "heic": b"\0\0\0\x18ftypheic\0\0", "bmp": b"BM6\0\0\0\0\0", "mp4": b"\0\0\0\x18ftypisom\0\0", "png": png()}
    df = spark.createDataFrame([("s", "b", k, bytearray(v), "", "2024-01-02T03:04:05Z") for k, v in kinds.items()],
                               "store string, batch string, path string, content binary, claimed string, created string")
    got = {r.path: r.reason for r in AR.verify(df).collect()}
    assert got == {"avif": "not a readable image", "heic": "not a readable image", "bmp": "not a readable image", "mp4": None, "png": None}


def test_one_path_delivered_three_times_gets_three_ids(spark):
    cols = "store string, batch string, path string, content binary, claimed string, created string"
    taken, seen = None, set()
    for _ in range(3):  # the same time each time: the draw itself must move on
        df = spark.createDataFrame([("s", "files", "a.png", bytearray(png()), "image/png", "2024-01-02T03:04:05Z")], cols)
        new = AR.mint_ids(df, taken).select("store", "id")
        seen |= {r.id for r in new.collect()}
        taken = new if taken is None else taken.union(new)
    assert len(seen) == 3


def test_render_request_of_every_kind_of_text_chunk():
    import zlib

    from catalograph.operators.analytics import _png_read

    def made(*chunks):
        return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">II5B", 2, 2, 8, 2, 0, 0, 0)) + b"".join(chunk(k, d) for k, d in chunks) + chunk(b"IEND", b"")

    said = lambda *chunks: _png_read(made(*chunks))[1:]
    key = b"parameters\0"
    assert said((b"tEXt", key + b"caf\xe9")) == ("caf\u00e9", None)
    assert said((b"zTXt", key + b"\0" + zlib.compress(b"a cat"))) == ("a cat", None)
    assert said((b"iTXt", key + b"\0\0en\0word\0" + "\u732b".encode())) == ("\u732b", None)
    assert said((b"iTXt", key + b"\1\0\0\0" + zlib.compress("\u732b".encode()))) == ("\u732b", None)
    assert said((b"tEXt", b"other\0x"), (b"tEXt", b"parameters"), (b"tEXt", key + b"1"), (b"tEXt", key + b"2")) == ("1", None)
    assert said((b"IDAT", key + b"x")) == (None, None)
    assert said((b"tEXt", key)) == ("", None)
    for broken in ((b"zTXt", key), (b"zTXt", key + b"\0nonsense"), (b"iTXt", key + b"\0"), (b"iTXt", key + b"\1\0\0\0zz")):
        assert said(broken)[0] is None and said(broken)[1].startswith("its render request cannot be read")
    long = "x" * 3_000_000
    assert said((b"zTXt", key + b"\0" + zlib.compress(long.encode()))) == (long, None)
    assert _png_read(made((b"tEXt", key + b"1"))[:-6]) == (None, None, None)


def test_a_file_whose_request_cannot_be_read_lands_nothing(spark):
    good, bad = png(), png().replace(chunk(b"IEND", b""), chunk(b"zTXt", b"parameters\0\0zz") + chunk(b"IEND", b""))
    blank = png().replace(chunk(b"IEND", b""), chunk(b"tEXt", b"parameters\0 \n\t") + chunk(b"IEND", b""))
    df = spark.createDataFrame([("st", "b", p, c, "image/png", "2024-01-01T00:00:00Z") for p, c in (("good", good), ("bad", bad), ("blank", blank), ("null", None))],
                               "store string, batch string, path string, content binary, claimed string, created string")
    _, quads, rejects = AR.ingest(df, spark.createDataFrame([], N.QUAD_SCHEMA))
    assert {(r.path, r.reason.split(":")[0]) for r in rejects.collect()} == {("bad", "its render request cannot be read"), ("null", "not a readable image")}
    assert quads.filter(F.col("p") == N.v("renderRequestInformation")).count() == 0
    assert quads.filter(F.col("p") == N.v("mediaPath")).count() == 2


def test_the_feed_of_two_versions_tells_changes_and_removals(spark, tmp_path, quads):
    root, typed = f"{tmp_path}/feed", lambda *ids: [(img(i), N.RDF_TYPE, N.v("Image"), "iri") for i in ids]
    dated = lambda *ids: [(img(i), "updatedDate", "2024-01-01T00:00:00Z") for i in ids]
    first = SN.write_snapshot(quads(*typed("a", "b", "c", "d", "e"), *dated("a", "b", "c", "d", "e"), (img("a"), "rating", "3"), (img("b"), "isPicked", "true"), (img("e"), "width", "5")), root)
    q = SN.read_snapshot(spark, root)
    keys = lambda *r: spark.createDataFrame(r, "store string, s string, p string")
    none = keys()
    SN.commit(spark, root, D.Change(quads((img("a"), "rating", "5"), (img("e"), "width", "6"), *typed("n"), *dated("n")), keys(("st0001", img("a"), N.v("rating")), ("st0001", img("b"), N.v("isPicked"))), none))
    last = SN.commit(spark, root, D.Change(None, keys(("st0001", img("c"), N.RDF_TYPE), ("st0001", img("d"), N.v("updatedDate"))), none))
    got = {(r.iri, r.updated is None, r.rating, r.is_picked, r.removed) for r in SN.feed(spark, root, first, last).collect()}
    assert got == {(img("a"), False, 5, False, False), (img("b"), False, 0, False, False), (img("n"), False, 0, False, False), (img("c"), True, None, None, True), (img("d"), True, None, None, True)}
    assert {(r.s, r.p.rsplit("/", 1)[-1], r.o, r.change) for r in SN.difference(spark, root, first, last, [N.v("rating"), N.v("width")]).collect()} == {
        (img("a"), "rating", "3", "removed"), (img("a"), "rating", "5", "added"), (img("e"), "width", "6", "added")}
    assert SN.feed(spark, root, last, last).count() == 0 and q.count() == 13
    plan = SN.difference(spark, root, first, last)._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and N.v("createdDate") not in plan


def test_statements_are_passed_on_before_a_batch_ends():
    """1,000 packets of 20,000 characters in one batch: what is held at a time is bounded by characters, not by packets."""
    import pyarrow as pa

    text = "x" * 20_000
    packet = f'<rdf:RDF xmlns:rdf="{N.RDF}"><rdf:Description rdf:about="" xmlns:dc="{N.DC}"><dc:title>{text}</dc:title></rdf:Description></rdf:RDF>'
    batch = pa.RecordBatch.from_arrays([pa.array(["st"] * 1000), pa.array([f"m{i}" for i in range(1000)]), pa.array([packet] * 999 + ["<broken"])], names=["store", "media", "packet"])
    out = list(AR.statement_batches(iter([batch])))
    assert sum(b.num_rows for b in out) == 1000 and max(b.nbytes for b in out) < 2 * AR.HELD
    assert [b.column(6)[-1].as_py() for b in out[-1:]] == ["fault"]


def test_what_one_task_sends_is_written_by_several(spark, tmp_path):
    """One input task holds all rows of a predicate and a store; AQE alone cannot cut its block."""
    name = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    text = F.concat(*[F.sha2(F.concat(F.lit(str(i)), F.col("id").cast("string")), 512) for i in range(8)])
    q = spark.range(20000, numPartitions=1).select(F.lit("st").alias("store"), F.concat(F.lit("s"), "id").alias("s"), F.lit(N.v("longCaption")).alias("p"), text.alias("o"),
                                                  F.lit("literal").alias("o_kind"), F.lit(None).cast("string").alias("dt"), F.lit(N.GRAPH).alias("g"))
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "1m")
        SN.write_snapshot(q, str(tmp_path / "q"))
        NQ.write_nquads(q.withColumnRenamed("store", "st"), str(tmp_path / "n"), ("st",))
    finally:
        spark.conf.set(name, before)
    assert len(list((tmp_path / "q").rglob("*.parquet"))) >= 4 and len(list((tmp_path / "n").rglob("*.txt"))) >= 4
    assert SN.read_snapshot(spark, str(tmp_path / "q")).count() == spark.read.text(str(tmp_path / "n")).count() == 20000


def test_subjects_are_counted_in_tasks_of_bounded_size(spark, quads):
    from catalograph.plans import fact_queries as FQ

    q = quads(("a", "rating", "1"), ("a", "rating", "22"), ("b", "rating", "3"), ("b", "width", "4"))
    got = FQ.by_predicate(q, 40 * FQ.STATE_ROWS)
    assert {(r.p, r.n, r.chars, r.subjects) for r in got.collect()} == {(N.v("rating"), 3, 4, 2), (N.v("width"), 1, 1, 1)}
    assert ", 40)" in got._jdf.queryExecution().toString() and "REPARTITION_BY_NUM" in got._jdf.queryExecution().toString()
