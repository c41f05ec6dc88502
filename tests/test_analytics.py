"""Call statistics and uncertain files on groups larger than the shared tables have, and files that share a path."""

from pyspark.sql import functions as F

from catalograph import names as N
from catalograph.operators import analytics as A, arrivals as AR


def test_the_median_of_a_large_group_is_exact(spark):
    """More distinct latencies than a summary of 10,000 entries tells apart; one group has none at all."""
    n = 400_003
    calls = spark.range(n).select((F.col("id") * 7 % n * 5).alias("latency_ms"), F.lit("a").alias("stage")).unionByName(
        spark.range(3).select(F.lit(None).cast("long").alias("latency_ms"), F.lit("b").alias("stage")))
    calls = calls.withColumns({"outcome": F.lit("recorded"), "request_bytes": F.lit(2)})
    got = {r.stage: r for r in A.call_stats(calls, F.lit("d")).collect()}
    assert (got["a"].median_ms, got["a"].max_ms, got["a"].calls, got["a"].mean_ms) == (5 * (n // 2), 5 * (n - 1), n, 5.0 * (n // 2))
    assert (got["b"].calls, got["b"].median_ms, got["b"].mean_ms, got["b"].request_bytes) == (3, None, None, 6)


def stored(spark, media, facts):
    """`media`: (id, date, moment said); `facts`: (path, date, moment)."""
    rows = [("st", i, N.v("mediaCreatedDate"), d, "literal", None, N.GRAPH) for i, d, _ in media]
    rows += [("st", i, N.DC + "subject", m, "literal", None, N.GRAPH) for i, _, m in media if m]
    q = spark.createDataFrame(rows, N.QUAD_SCHEMA)
    f = spark.createDataFrame([("st", *x) for x in facts], "store string, path string, media_created_date string, moment string")
    return A.already_stored(q, f, N.DC + "subject", "m:")


def test_uncertain_files_need_one_hit(spark):
    media = [("a", "d1", "x"), ("b", "d1", "y"), ("c", "d2", None), ("c", "d2", "z"), ("e", "d3", None)]
    facts = [("one", "d1", "x"), ("none", "d1", "w"), ("two", "d1", None), ("same", "d2", None), ("both", "d2", None), ("both", "d3", None), ("part", "d1", None), ("part", "d3", None)]
    assert {(r.path, r.s) for r in stored(spark, media, facts).collect()} == {("one", "a"), ("same", "c")}


def test_files_of_one_date_do_not_meet_all_media_of_it(spark):
    """A date that 3,000 media and 3,000 files share is 9 million pairs; no join may give more rows than its inputs."""
    made = stored(spark, [(f"m{i}", "d", f"x{i}") for i in range(3000)], [(f"p{i}", "d", f"x{i}" if i % 2 else None) for i in range(3000)])
    assert len(made.collect()) == 1500
    todo, most = [made._jdf.queryExecution().executedPlan()], 0
    while todo:
        p = todo.pop()
        name = p.nodeName()
        if name == "AdaptiveSparkPlan":
            todo.append(p.executedPlan())
            continue
        if "QueryStage" in name:
            todo.append(p.plan())
            continue
        if "Join" in name and p.metrics().contains("numOutputRows"):
            most = max(most, p.metrics().apply("numOutputRows").value())
        todo += [p.children().apply(i) for i in range(p.children().size())]
    assert 0 < most <= 6000


def test_files_of_one_path_get_ids_of_their_own(spark):
    df = spark.createDataFrame([("st", "b", "same", bytearray(b"x"), None, "2024-01-01T00:00:00Z", i) for i in range(3)],
                               "store string, batch string, path string, content binary, claimed string, created string, item long")
    ids = [r.id for r in AR.arrival_rows(df).collect()]
    assert len(set(ids)) == 3 and sorted(ids) == sorted(r.id for r in AR.arrival_rows(df).collect())
