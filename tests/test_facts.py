import pytest
from pyspark.sql import functions as F

from catalograph import names as N
from catalograph.operators import facts as D, sets as C, vectors as X
from tests.conftest import img

A, B = img("a"), img("b")
S1, VS1 = N.MEDIA_NS + "ImageSet/s1", N.MEDIA_NS + "VideoSet/v1"


@pytest.fixture
def q(quads):
    base = [(A, N.RDF_TYPE, N.v("Image")), (B, N.RDF_TYPE, N.v("Image")), (S1, N.RDF_TYPE, N.v("ImageSet")), (VS1, N.RDF_TYPE, N.v("VideoSet")),
            (A, "rating", "2", "literal", N.XSD + "integer"), (A, "sceneObjects", "dog"), (A, "sceneObjects", "cat"), (A, "relatedToId", S1),
            (S1, "createdDate", "2024-01-01T00:00:00Z")]
    return quads(*base)


def edits(spark, *rows):
    return spark.createDataFrame([(r, i, "st0001", s, k, v) for i, (r, s, k, v) in enumerate(rows)],
                                 "request string, seq long, store string, s string, key string, value string")


@pytest.mark.parametrize("key, value, want", [
    ("rating", "6", None), ("rating", "5", "5"), ("rating", '" 3 "', "3"), ("rating", "4.0", None), ("isPicked", '"yes"', None), ("isPicked", "true", "true"),
    ("shortCaption", "5", None), ("shortCaption", '" kept as is "', " kept as is "), ("mediaCreatedDate", '"2026-11-12T09:14:02"', None),
    ("mediaCreatedDate", '"yesterday"', None), ("mediaCreatedDate", '"2026-02-30T09:14:02Z"', None), ("mediaCreatedDate", '" 2026-11-12T09:14:02-08:00 "', "2026-11-12T09:14:02-08:00"),
    ("imageTechnicalScore", "100", "100"), ("imageTechnicalScore", "101", None), ("duration", "1", None), ("nothing", "1", None), ("description", '"x"', "x")])
def test_set_checks_values(spark, q, key, value, want):
    c = D.set_fields(q, edits(spark, ("r", A, key, value)))
    assert [r.o for r in c.added.collect()] == ([want] if want is not None else [])


def test_one_bad_key_refuses_the_request_and_set_replaces(spark, q):
    c = D.set_fields(q, edits(spark, ("r1", A, "rating", "9"), ("r1", A, "isPicked", "true"), ("r2", A, "sceneObjects", '"bird"'), ("r3", img("zz"), "rating", "1")))
    after = c.apply(q)
    assert {r.request: r.status for r in c.report.collect()} == {"r1": "refused", "r2": "done", "r3": "refused"}
    assert [r.o for r in after.filter(F.col("p") == N.v("sceneObjects")).collect()] == ["bird"]
    assert after.filter(F.col("p") == N.v("isPicked")).count() == 0
    assert after.count() == q.count() - 1


def test_links_are_added_one_at_a_time(spark, q):
    vals = [("r1", A, "relatedToId", '"<cat/ImageSet/s1>"'), ("r2", A, "relatedToId", '["<cat/Image/b>"]'), ("r3", A, "relatedToId", '"<cat/VideoSet/v1>"'),
            ("r4", A, "relatedToId", '"<cat/Image/a>"'), ("r5", A, "relatedToId", '"<other/Moment/x>"'), ("r6", A, "relatedToId", '"text"'), ("r7", A, "relatedToId", '"<cat/Image/zz>"')]
    c = D.set_fields(q, edits(spark, *vals))
    why = {r.request: r.reason for r in c.report.collect()}
    assert why == {"r1": None, "r2": None, "r3": "wrong kind of set", "r4": "the media itself", "r5": "outside this catalogue", "r6": "not a reference", "r7": "no such thing in this store"}
    after = c.apply(q)
    assert {r.o for r in after.filter(F.col("p") == N.v("relatedToId")).collect()} == {S1, B}


def test_unset(spark, q):
    e = spark.createDataFrame([("r1", "st0001", A, "sceneObjects"), ("r2", "st0001", A, "relatedToId"), ("r3", "st0001", A, "relatedToId=<cat/ImageSet/s1>"),
                               ("r4", "st0001", A, "height"), ("r5", "st0001", A, "isPicked")], "request string, store string, s string, field string")
    c = D.unset_fields(q, e)
    assert {r.request: r.status for r in c.report.collect()} == {"r1": "done", "r2": "refused", "r3": "done", "r4": "refused", "r5": "done"}
    left = c.apply(q).filter(F.col("s") == A)
    assert {r.p for r in left.collect()} == {N.RDF_TYPE, N.v("rating")}


def test_touch_and_mark_once(spark, quads, q):
    keys = spark.createDataFrame([("st0001", A)], "store string, s string")
    once = D.mark_complete(q, keys, "t1").apply(q)
    again = D.mark_complete(once, keys, "t2")
    assert again.report.count() == 0 and again.apply(once).count() == once.count()
    moved = D.touch(D.touch(q, keys, "t1").apply(q), keys, "t2").apply(q.unionByName(quads((A, "updatedDate", "t0"), (A, "updatedDate", "t1"))))
    assert [r.o for r in moved.filter(F.col("p") == N.v("updatedDate")).collect()] == ["t2"]


def test_forget_and_delete(spark, quads, q):
    ref, face = N.MEDIA_NS + "Enrichment/r", N.MEDIA_NS + "Face/f"
    q = q.unionByName(quads((A, "faceData", ref), (ref, "model", "m"), (ref, "path", "a.nq"), (ref, "item", face), (face, "vectorPath", "f.npy"),
                            (face, "path", "not a file of a record"), (A, "enrichmentCompleteDate", "t"), (B, "enrichmentCompleteDate", "t")))
    both = spark.createDataFrame([("st0001", A), ("st0001", B)], "store string, s string")
    c, keys = D.forget(q, both, "faceData")
    assert {r.media: (r.facts_removed, r.files_removed) for r in c.report.collect()} == {A: (7, 2), B: (0, 0)}
    assert [r.key_id for r in keys.collect()] == ["f"]
    after = c.apply(q)
    assert after.filter(F.col("s").isin(ref, face)).count() == 0 and after.filter(F.col("p") == N.v("enrichmentCompleteDate")).count() == 1
    with pytest.raises(ValueError, match="no stage writes"):
        D.forget(q, both, "thumbnail")
    d, keys = D.delete_media(q, spark.createDataFrame([("st0001", A)], "store string, s string"))
    assert {r.s for r in d.apply(q).collect()} == {B, S1, VS1} and {r.key_id for r in keys.collect()} == {"a", "f"}


def test_rename_merges_and_refuses_equal_names(quads):
    q = quads((A, N.DC + "x", "1"), (A, "http://new/x", "1"), (A, "http://new/y", N.DC + "z", "iri"), (A, "http://new/y", N.DC + "z", "literal"))
    c = D.rename_ns(q, N.DC, "http://new/")
    after = c.apply(q)
    assert after.count() == 3 and c.report.first().facts == 2
    assert after.filter("o_kind = 'literal'").filter(F.col("o").startswith(N.DC)).count() == 1
    for pair in (("", "x"), ("x", "x")):
        with pytest.raises(ValueError):
            D.rename_ns(q, *pair)


def test_sets(spark, q):
    new = spark.createDataFrame([("st0001", "ImageSet", i, " ") for i in ("fresh", "a", "v1", "bad id", "twice", "twice")], "store string, class string, id string, description string")
    c = C.create_sets(q, new, "now")
    assert {r.id: r.status for r in c.report.collect()} == {"fresh": "made", "a": "taken", "v1": "taken", "bad id": "invalid id", "twice": "made"}
    assert sorted(r.p.rsplit("/", 1)[-1].rsplit("#")[-1] for r in c.added.collect()) == sorted(["createdDate", "id", "type", "updatedDate"] * 2)
    assert [r.member for r in C.members(q, "st0001", S1).collect()] == [A]
    with pytest.raises(LookupError, match="set not found"):
        C.members(q, "st0001", N.MEDIA_NS + "ImageSet/none")
    gone = C.delete_set(q, spark.createDataFrame([("st0001", S1)], "store string, iri string"))
    assert [r.member for r in gone.report.collect()] == [A]
    assert gone.apply(q).filter((F.col("s") == S1) | (F.col("o") == S1)).count() == 0


def test_vectors_fix_their_dimension(spark):
    have = spark.createDataFrame([("m", 1, [1.0, 0.0])], "model string, key_id long, vec array<float>")
    new = spark.createDataFrame([("m", 1, [5.0, 5.0], 0), ("m", 2, [1.0], 1), ("n", 1, [1.0, 2.0, 3.0], 2), ("n", 2, [1.0], 3)], "model string, key_id long, vec array<float>, seq long")
    after, report = X.add_vectors(have, new)
    assert {(r.model, r.key_id): r.status for r in report.collect()} == {("m", 1): "present", ("m", 2): "refused", ("n", 1): "added", ("n", 2): "refused"}
    assert after.count() == 2
    with pytest.raises(Exception, match="query dim 3 does not match index dim 2"):
        X.knn(have, "m", [1.0, 0.0, 0.0]).collect()


def test_search_order_exclusion_and_empty_gate(spark, quads, q):
    v = spark.createDataFrame([("m", "a", [1.0, 0.0, 0.0]), ("m", "b", [0.9, 0.1, 0.0]), ("m", "c", [0.0, 1.0, 0.0])], "model string, key_id string, vec array<float>")
    assert [r.key_id for r in X.knn(v, "m", [1.0, 0.0, 0.0]).collect()] == ["a", "b", "c"]
    assert [r.key_id for r in X.knn_like(v, "m", "a").collect()] == ["b", "c"]
    none = quads((A, "height", "1")).filter("false").select("store", "s")
    assert X.hybrid(q, v, none, "m", [1.0]).count() == 0
    only = quads((B, "x", "1")).select("store", "s")
    assert [r.key_id for r in X.hybrid(q, v, only, "m", [1.0, 0.0, 0.0]).collect()] == ["b"]
    assert X.hybrid(q, v, None, "m", [1.0, 0.0, 0.0], 2).count() == 2


def test_packet_grammar():
    """Property attributes, named blank nodes, languages, literal and list content."""
    from catalograph.operators.arrivals import read_statements

    packet = """<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:x="http://x/" xmlns:st="http://st/" xml:lang="en"><rdf:Description rdf:about="">
<x:h st:action="saved" st:when="now"/><x:who rdf:nodeID="p"/><x:t xml:lang="fr">bon</x:t><x:u>plain</x:u><x:v xml:lang="">none</x:v><x:n rdf:datatype="http://d/int">3</x:n>
<x:raw rdf:parseType="Literal">a<b>c</b></x:raw><x:list rdf:parseType="Collection"><rdf:Description rdf:about="http://i/1"/></x:list>
</rdf:Description><rdf:Description rdf:nodeID="p" x:name="Ann"/></rdf:RDF>"""
    rows = [r[1:] for r in read_statements(packet, "http://m/a")]
    said = {(s, p): (o, k, dt) for s, p, o, k, dt in rows}
    en = N.RDF + "langString@en"
    h, _, _ = said[("http://m/a", "http://x/h")]
    assert said[(h, "http://st/action")] == ("saved", "literal", en) and said[(h, "http://st/when")] == ("now", "literal", en)
    who, kind, _ = said[("http://m/a", "http://x/who")]
    assert kind == "bnode" and said[(who, "http://x/name")] == ("Ann", "literal", en)
    assert said[("http://m/a", "http://x/t")] == ("bon", "literal", N.RDF + "langString@fr") and said[("http://m/a", "http://x/u")] == ("plain", "literal", en)
    assert said[("http://m/a", "http://x/v")] == ("none", "literal", None) and said[("http://m/a", "http://x/n")] == ("3", "literal", "http://d/int")
    assert said[("http://m/a", "http://x/raw")] == ("a<b>c</b>", "literal", N.RDF + "XMLLiteral")
    own = packet.replace('rdf:nodeID="p" x:name="Ann"', f'rdf:about="x" xmlns:o="{N.VOCAB}" o:id="&lt;cat/Image/a>"')
    assert read_statements(own, "http://m/a") and read_statements(packet, "http://m/a", later=True)
    for bad in (own, '<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#"></rdf:RDF>'):
        with pytest.raises(ValueError, match="later packet"):
            read_statements(bad, "http://m/a", later=True)
    cell, _, _ = said[("http://m/a", "http://x/list")]
    assert said[(cell, N.RDF + "first")] == ("http://i/1", "iri", None) and said[(cell, N.RDF + "rest")] == (N.RDF + "nil", "iri", None)


def test_the_first_fitting_row_of_a_key_is_taken(spark):
    have = spark.createDataFrame([("a", "m", "x", [1.0, 0.0])], "store string, model string, key_id string, vec array<float>")
    new = spark.createDataFrame([("a", "m", "b", [1.0, 2.0, 3.0], 1, "t1"), ("a", "m", "b", [4.0, 5.0], 2, "t2"), ("a", "m", "b", [6.0, 7.0], 3, "t3"),
                                 ("b", "m", "x", [1.0, 1.0, 1.0], 4, "t4"), ("a", "m", "a", [9.0, 9.0], 5, "t5"), ("a", "m", "x", [9.0, 9.0], 6, "t6")],
                                "store string, model string, key_id string, vec array<float>, seq long, produced string")
    after, report = X.add_vectors(have, new)
    assert [r.status for r in report.orderBy("seq").collect()] == ["refused", "added", "present", "added", "added", "present"]
    assert [(r.store, r.key_id, r.vec[0], r.seq, r.produced) for r in X.in_order(after).collect()] == [
        ("a", "x", 1.0, None, None), ("a", "b", 4.0, 2, "t2"), ("a", "a", 9.0, 5, "t5"), ("b", "x", 1.0, 4, "t4")]


def test_like_needs_a_store_where_ids_repeat(spark):
    v = spark.createDataFrame([("a", "m", 1, [1.0, 0.0]), ("b", "m", 1, [0.0, 1.0]), ("a", "m", 2, [1.0, 0.1]), ("b", "m", 3, [0.1, 1.0])],
                              "store string, model string, key_id long, vec array<float>")
    with pytest.raises(ValueError, match="name one"):
        X.knn_like(v, "m", 1)
    assert [(r.store, r.key_id) for r in X.knn_like(v, "m", 1, store="b").collect()] == [("b", 3)]
    assert [(r.store, r.key_id) for r in X.knn_like(v, "m", 3).collect()] == [("b", 1)]


def test_white_space_of_any_kind_is_stripped(spark):
    from catalograph.functions.text import bare_id, iri_from_bracket, stripped

    df = spark.createDataFrame([("\n about \t",), ("\u00a0x y\u2003\r\n",), (" \t\n",), ("\t<cat/Image/a>\n",)], "t string")
    got = df.select(stripped("t").alias("s"), bare_id(F.col("t")).alias("b"), iri_from_bracket(F.col("t")).alias("i")).collect()
    assert [r.s for r in got] == ["about", "x y", "", "<cat/Image/a>"] and got[3].b == "a" and got[3].i.endswith("cat/Image/a")
