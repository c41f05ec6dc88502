import pytest
from pyspark.sql import functions as F

from catalograph import names as N
from catalograph.operators import patterns as P
from tests.conftest import img

A, B, C, D = (img(x) for x in "abcd")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_names_resolve_and_unknown_prefixes_fail(spark):
    assert P.resolve("width") == N.v("width")
    assert P.resolve("dc:title") == N.DC + "title"
    assert P.resolve("urn:x") == "urn:x"
    with pytest.raises(ValueError, match="unknown prefix"):
        P.resolve("nope:x")
    df = spark.createDataFrame([("nope:x",)], "name string")
    with pytest.raises(Exception, match="unknown prefix"):
        P.resolve_names(df, "name").collect()


def test_repeated_variable_is_an_equality(quads):
    q = quads((A, "id", A), (B, "id", C))
    assert rows(P.pattern(q, "?x", "id", "?x")) == [("st0001", A)]


def test_an_iri_and_an_equal_text_do_not_join(quads):
    q = quads((A, "relatedToId", B), (C, "relatedToId", B, "literal"), (B, "width", "7"))
    assert rows(P.bgp(q, [("?s", "relatedToId", "?t"), ("?t", "width", "?w")]).select("s", "w")) == [(A, "7")]
    same = P.bgp(quads((A, "shortCaption", B, "literal"), (C, "relatedToId", B)), [("?x", "shortCaption", "?v"), ("?y", "relatedToId", "?v")])
    assert rows(same) == []


def test_patterns_never_match_across_stores(spark, quads):
    q = quads((A, "relatedToId", B), store="one001").unionByName(quads((B, "width", "7"), store="two001"))
    assert P.bgp(q, [("?s", "relatedToId", "?t"), ("?t", "width", "?w")]).count() == 0


def test_a_cross_product_is_refused(quads):
    with pytest.raises(ValueError, match="cross product"):
        P.bgp(quads((A, "width", "1")), [("?a", "width", "?w"), ("?b", "height", "?h")])


def test_optional_with_an_unbound_shared_variable(quads):
    q = quads((A, "width", "1"), (B, "width", "2"), (A, "height", "9"), (A, "rating", "9"), (B, "rating", "3"))
    left = P.optional(P.pattern(q, "?s", "width", "?w"), P.pattern(q, "?s", "height", "?v"))
    out = P.optional(left, P.pattern(q, "?s", "rating", "?v"), maybe_unbound=("v",))
    assert rows(out.select("s", "w", "v")) == [(A, "1", "9"), (B, "2", "3")]


def test_minus_without_shared_variables_removes_nothing(quads):
    q = quads((A, "width", "1"), (B, "height", "2"))
    assert P.minus(P.pattern(q, "?s", "width", "?w"), P.pattern(q, "?t", "height", "?h")).count() == 1
    assert P.minus(P.pattern(q, "?s", "width", "?w"), P.pattern(q, "?s", "width", "?x")).count() == 0


def test_typed_filters_drop_what_is_no_such_value(quads):
    q = quads((A, "rating", "4"), (B, "rating", "four"), (C, "rating", "3"))
    r = P.pattern(q, "?s", "rating", "?v")
    assert rows(P.where_typed(r, "v", ">=", 3, "bigint").select("s")) == [(A,), (C,)]
    d = quads((A, "updatedDate", "2024-01-01T00:30:00+02:00"), (B, "updatedDate", "yesterday"), (C, "updatedDate", "2024-01-01T00:00:00"))
    assert rows(P.where_since(P.pattern(d, "?s", "updatedDate", "?u"), "u", "2023-12-31T22:30:00Z").select("s")) == [(A,)]
    with pytest.raises(ValueError, match="zone"):
        P.where_since(d, "o", "2024-01-01")


def test_construct_leaves_unbound_triples_out(quads):
    q = quads((A, "width", "1"), (B, "width", "2"), (A, "height", "3"))
    r = P.optional(P.pattern(q, "?s", "width", "?w"), P.pattern(q, "?s", "height", "?h"))
    out = P.construct(r, [("?s", "dc:w", "?w"), ("?s", "dc:h", "?h")])
    assert rows(out.select("s", "p", "o")) == [(A, N.DC + "h", "3"), (A, N.DC + "w", "1"), (B, N.DC + "w", "2")]


def test_closure_ends_on_cycles(quads):
    q = quads((A, "relatedToId", B), (B, "relatedToId", C), (C, "relatedToId", A), (C, "relatedToId", D))
    e = P.pattern(q, "?s", "relatedToId", "?o")
    got = {(s[-1], o[-1]): d for _, s, o, d in rows(P.closure(e))}
    assert got[("a", "d")] == 3 and got[("a", "a")] == 3 and len(got) == 12
    only = P.closure(e, P.pattern(q, "?s", "relatedToId", D).select("store", "s"))
    assert {r.s for r in only.collect()} == {C}


def test_closure_of_a_long_chain(spark):
    e = spark.createDataFrame([("st", f"n{i:03d}", f"n{i + 1:03d}") for i in range(200)] + [("st", "n050", "n150")], "store string, s string, o string")
    got = {(r.s, r.o): r.depth for r in P.closure(e).collect()}
    want = lambda i, j: j - i if i > 50 or j < 150 else min(j - i, 50 - i + 1 + j - 150)
    assert got == {(f"n{i:03d}", f"n{j:03d}"): want(i, j) for i in range(201) for j in range(i + 1, 201)}


def test_values_take_a_long_list(spark):
    df = spark.range(100).selectExpr("CAST(id AS STRING) AS v")
    assert P.values(df, "v", [str(i) for i in range(50, 20_050)]).count() == 50


def test_optional_with_an_unbound_key(spark):
    left = spark.createDataFrame([("st", "a", "x"), ("st", "b", None), ("st", "c", "z")], "store string, s string, r string")
    right = spark.createDataFrame([("st", "x", "1"), ("st", "y", "2")], "store string, r string, v string")
    assert rows(P.optional(left, right, ("r",)).select("s", "r", "v")) == [("a", "x", "1"), ("b", "x", "1"), ("b", "y", "2"), ("c", "z", None)]


def test_insert_and_delete_keep_set_semantics(quads):
    q = quads((A, "width", "1"), (B, "width", "2", "literal", N.XSD + "integer"))
    assert P.insert(q, q).count() == 2
    assert P.fresh_quads(q, quads((A, "width", "1"), (A, "width", "1", "literal", N.XSD + "integer"))).count() == 1
    assert rows(P.delete_where(q, q.filter(F.col("s") == A)).select("s")) == [(B,)]


def test_paths(quads):
    q = quads((A, "poseData", B), (B, "item", C), (A, "captionData", D), (D, "item", C))
    assert rows(P.path(q, ("/", ("|", "poseData", "captionData"), "item")).select("s", "o")) == [(A, C), (A, C)]
    assert rows(P.path(q, ("^", "poseData")).select("s", "o")) == [(B, A)]


def test_ask_and_slices(quads):
    q = quads((A, "width", "1"), (B, "width", "2"))
    assert P.ask(P.pattern(q, "?s", "width", P.literal("2"))).first().answer is True
    assert P.ask(P.pattern(q, "?s", "width", P.literal("9"))).first().answer is False
    assert rows(P.slice_rows(P.pattern(q, "?s", "width", "?w"), [("w", "desc")], 1, 1).select("w")) == [("1",)]
