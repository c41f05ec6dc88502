import struct

from pyspark.sql import functions as F

from catalograph import names as N
from catalograph.sources import files as FI
from catalograph.streaming import streams as ST


def feed(spark, tmp_path, schema, *batches):
    """Each batch a file, read one a micro-batch in order."""
    import os
    src = tmp_path / "feed"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/b{i}")
        part = next(p for p in (tmp_path / f"b{i}").iterdir() if p.name.startswith("part"))
        src.mkdir(exist_ok=True)
        target = src / f"{i}.parquet"
        part.rename(target)
        os.utime(target, (1_700_000_000 + i * 60,) * 2)
    s = ST.stream_session(spark, 2)
    return s.readStream.schema(spark.createDataFrame([], schema).schema).option("maxFilesPerTrigger", 1).parquet(str(src))


def landed(spark, stream, tmp_path, mode="append"):
    out = f"{tmp_path}/out"
    ST.to_batches(stream, out, mode, f"{tmp_path}/ckpt").awaitTermination()
    return spark.read.parquet(out)


CALLS = "ts timestamp_ntz, stage string, status int, error string, latency_ms long"


def ts(text):
    import datetime
    return datetime.datetime.fromisoformat(text)


def test_late_calls_are_dropped(spark, tmp_path):
    row = lambda t: (ts(t), "pose", 200, None, 10)
    stream = feed(spark, tmp_path, CALLS, [row("2024-01-01 00:00:10"), row("2024-01-01 01:00:00")], [row("2024-01-01 02:00:00")],
                  [row("2024-01-01 00:00:20"), row("2024-01-01 01:59:59")])
    got = landed(spark, ST.call_metrics(stream, "1 minute", "10 minutes"), tmp_path, "update")
    n = {r.start.strftime("%H:%M"): r.calls for r in ST.newest(got, ["start", "stage", "outcome"], "calls").collect()}
    assert n == {"00:00": 1, "01:00": 1, "02:00": 1, "01:59": 1}


OUTCOMES = "store string, s string, stage string, seq long, at timestamp, ok boolean"


def test_holds_open_clear_and_expire(spark, tmp_path):
    row = lambda i, s, t, ok: ("st", s, "pose", i, ts(t), ok)
    stream = feed(spark, tmp_path, OUTCOMES, [row(1, "a", "2024-01-01 00:00:00", False), row(2, "b", "2024-01-01 00:00:30", False)],
                  [row(3, "b", "2024-01-01 00:01:00", True), row(4, "x", "2024-01-01 01:00:00", True)], [row(5, "y", "2024-01-01 01:01:00", True)])
    got = landed(spark, ST.holds(stream), tmp_path)
    assert sorted((r.s, r.action) for r in got.collect()) == [("a", "expire"), ("a", "hold"), ("b", "clear"), ("b", "hold")]


def test_work_list_follows_writes(spark, tmp_path):
    e = lambda s, kind, text="": ("st", s, kind, text)
    stream = feed(spark, tmp_path, "store string, iri string, kind string, text string",
                  [e("a", "image", "2024"), e("b", "image", "2024"), e("b", "gate")], [e("a", "gate"), e("b", "done")], [e("b", "forgotten"), e("a", "removed")])
    got = landed(spark, ST.live_work(stream), tmp_path)
    said = sorted((r.batch, r.iri, r.pending) for r in got.collect())
    assert said == [(0, "b", True), (1, "a", True), (1, "b", False), (2, "a", False), (2, "b", True)]


def test_ready_is_said_once(spark, tmp_path):
    r = lambda s, link, model="m": ("st", s, link, model)
    stream = feed(spark, tmp_path, "store string, iri string, link string, model string",
                  [r("a", "poseData"), r("b", "complete"), r("c", "poseData", "other")], [r("a", "captionData"), r("b", "poseData"), r("c", "captionData")],
                  [r("a", "captionData"), r("b", "captionData"), r("a", "poseData")])
    got = landed(spark, ST.ready_marks(stream, [("poseData", "m"), ("captionData", "m")]), tmp_path)
    assert [(x.batch, x.iri) for x in got.collect()] == [(1, "a")]


def test_files_are_taken_in_once(spark, tmp_path):
    from tests.test_sources import png

    root = tmp_path / "in"
    root.mkdir()
    s = ST.stream_session(spark, 2)
    none = s.createDataFrame([], N.QUAD_SCHEMA)
    run = lambda: ST.ingest_stream(FI.arrivals(s, str(root), "st0001", max_files=1), lambda: none, f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    (root / "a.png").write_bytes(png())
    (root / "b.png").write_bytes(b"not a picture")
    run()
    first = {r.s for r in spark.read.parquet(f"{tmp_path}/out/quads").filter(F.col("p") == N.v("mediaPath")).collect()}
    (root / "c.png").write_bytes(png())
    run()
    run()
    all_ = {r.s for r in spark.read.parquet(f"{tmp_path}/out/quads").filter(F.col("p") == N.v("mediaPath")).collect()}
    assert len(first) == 1 and len(all_) == 2 and first < all_
    assert spark.read.parquet(f"{tmp_path}/out/rejects").count() == 1


def test_a_batch_run_again_over_its_own_facts_keeps_its_ids(spark, tmp_path):
    from tests.test_sources import png

    root = tmp_path / "in"
    root.mkdir()
    s = ST.stream_session(spark, 2)
    none, out = s.createDataFrame([], N.QUAD_SCHEMA), f"{tmp_path}/out"
    stored = lambda: none.unionByName(s.read.schema(N.QUAD_SCHEMA).parquet(f"{out}/quads").select(*none.columns)) if (tmp_path / "out/quads").exists() else none
    run = lambda: ST.ingest_stream(FI.arrivals(s, str(root), "st0001", max_files=1), stored, out, f"{tmp_path}/ck").awaitTermination()
    facts = lambda: sorted(map(str, spark.read.parquet(f"{out}/quads").collect()))
    (root / "a.png").write_bytes(png())
    (root / "b.png").write_bytes(png())
    run()
    before = facts()
    last = max((tmp_path / "ck/commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last.unlink()  # the facts landed, the batch's mark did not
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    run()
    assert facts() == before and before


def test_a_failure_already_over_holds_nothing(spark, tmp_path):
    row = lambda i, s, t, ok: ("st", s, "pose", i, ts(t), ok)
    stream = feed(spark, tmp_path, OUTCOMES, [row(1, "x", "2024-01-01 00:00:00", True)], [row(2, "x", "2024-01-01 03:00:00", True)],
                  [row(3, "a", "2024-01-01 02:59:30", False), row(4, "b", "2024-01-01 00:30:00", False)],
                  [row(5, "x", "2024-01-01 06:00:00", True)], [row(6, "x", "2024-01-01 07:00:00", True)])
    got = sorted((r.s, r.action) for r in landed(spark, ST.holds(stream), tmp_path).collect())
    assert got == [("a", "expire"), ("a", "hold")]


def test_the_last_word_of_a_batch_holds_in_any_order(spark, tmp_path):
    e = lambda s, kind, seq: ("st", s, kind, "", seq)
    stream = feed(spark, tmp_path, "store string, iri string, kind string, text string, seq long",
                  [e("a", "forgotten", 4), e("a", "done", 3), e("a", "gate", 2), e("a", "image", 1), e("b", "done", 9), e("b", "forgotten", 8), e("b", "image", 1), e("b", "gate", 2)],
                  [e("a", "done", 2)])
    assert [(r.iri, r.pending) for r in landed(spark, ST.live_work(stream), tmp_path).collect()] == [("a", True)]


def test_a_hold_by_the_wall_clock_ends_without_another_event(spark, tmp_path):
    import datetime
    import time

    now = datetime.datetime.now(datetime.timezone.utc).replace(tzinfo=None)
    old = now - datetime.timedelta(hours=1)
    stream = feed(spark, tmp_path, OUTCOMES, [("st", "a", "pose", 1, now, False), ("st", "b", "pose", 2, old, False), ("st", "c", "pose", 3, now, True)])
    q = ST.to_batches(ST.holds_by_clock(stream, 15), f"{tmp_path}/out", checkpoint=f"{tmp_path}/ckpt", trigger={"processingTime": "500 milliseconds"})
    said = lambda: sorted((r.s, r.action) for r in spark.read.parquet(f"{tmp_path}/out").collect()) if any((tmp_path / "out").glob("*/_SUCCESS")) else []
    try:
        end = time.time() + 60
        while time.time() < end and len(said()) < 2 and q.isActive:
            time.sleep(1)
    finally:
        q.stop()
    assert said() == [("a", "expire"), ("a", "hold")]


def test_work_list_from_a_standing_state(spark, tmp_path):
    e = lambda s, kind, seq, text="": ("st", s, kind, text, seq)
    schema = "store string, iri string, kind string, text string, seq long"
    before = [e("a", "image", 1, "2024"), e("a", "gate", 2), e("b", "image", 3, "2023"), e("b", "done", 4), e("c", "image", 5, "2022"), e("c", "gate", 6), e("c", "ungate", 7),
              e("d", "gate", 8), e("e", "image", 9, None), e("e", "gate", 10)]
    after = [[e("b", "gate", 11), e("a", "gate", 12), e("c", "done", 2), e("f", "image", 13, "2021"), e("f", "gate", 14)], [e("b", "forgotten", 15), e("e", "removed", 16), e("d", "image", 17, "2020")]]
    known = ST.work_state(spark.createDataFrame(before, schema))
    assert {r.iri: (r.image, r.done, r.gate, r.created) for r in known.collect()} == {
        "a": (True, False, True, "2024"), "b": (True, True, False, "2023"), "c": (True, False, False, "2022"), "d": (False, False, True, None), "e": (True, False, True, None)}
    stream = feed(spark, tmp_path, schema, *after)
    known.write.parquet(f"{tmp_path}/known")
    mine = stream.sparkSession.read.parquet(f"{tmp_path}/known")
    got = landed(spark, ST.live_work(stream, mine), tmp_path)
    assert sorted((r.batch, r.iri, r.pending) for r in got.collect()) == [(0, "f", True), (1, "b", True), (1, "d", True), (1, "e", False)]
    whole = ST.work_state(spark.createDataFrame([*before, *after[0], *after[1]], schema)).filter("image AND gate AND NOT done")
    assert sorted((r.iri, r.created) for r in ST.work_after(known, got).collect()) == sorted((r.iri, r.created) for r in whole.select("iri", "created").collect())


def test_counts_by_what_changed(spark, tmp_path):
    c = lambda iri, what, n=1: ("st", iri, what, n)
    schema = "store string, iri string, what string, n long"
    before = [c("a", "images"), c("a", "captions"), c("a", "captions"), c("b", "captions"), c("v", "poses")]
    batches = [[c("b", "images"), c("a", "captions", -1), c("x", "images", -1), c("z", "unheard")], [c("a", "captions", -1), c("b", "thumbnails"), c("x", "images"), c("x", "images")],
               [c("a", "images", -1)]]
    known = ST.held_state(spark.createDataFrame(before, schema))
    known.write.parquet(f"{tmp_path}/known")
    stream = feed(spark, tmp_path, schema, *batches)
    mine = stream.sparkSession.read.parquet(f"{tmp_path}/known")
    run = lambda: ST.counts_by_delta(stream, f"{tmp_path}/out", f"{tmp_path}/ck", mine, {"availableNow": True}).awaitTermination()
    run()
    at = lambda i: [(r.images, r.captions, r.thumbnails, r.poses) for r in spark.read.parquet(f"{tmp_path}/out/batch={i}").collect()]
    assert [at(0), at(1), at(2)] == [[(2, 2, 0, 0)], [(3, 1, 1, 0)], [(2, 1, 1, 0)]]
    whole = ST.counts_of(ST.held_state(spark.createDataFrame(before + [r for b in batches for r in b], schema))).collect()
    assert ST.latest_counts(spark, f"{tmp_path}/out").select(*whole[0].__fields__).collect() == whole
    last = max((tmp_path / "ck/commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last.unlink()  # the totals landed, the batch's mark did not
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    run()
    assert at(2) == [(2, 1, 1, 0)]


def test_count_changes_say_what_counts_counts(spark, quads):
    from catalograph.operators import reads as R
    from tests.conftest import img

    q = quads((img("a"), N.RDF_TYPE, N.v("Image"), "iri"), (img("b"), N.RDF_TYPE, N.v("Image"), "iri"), (img("v"), N.RDF_TYPE, N.v("Video"), "iri"),
              (img("a"), "captionData", img("r1"), "iri"), (img("a"), "captionData", img("r2"), "iri"), (img("r1"), "item", img("i1"), "iri"), (img("r1"), "item", img("i2"), "iri"),
              (img("b"), "poseData", img("r3"), "iri"), (img("v"), "captionData", img("r1"), "iri"), (img("b"), "thumbnail", img("t"), "iri"))
    assert sorted((r.iri, r.what, r.n) for r in R.count_changes(q, -1).collect()) == sorted(
        [(img("a"), "images", -1), (img("b"), "images", -1), (img("a"), "captions", -1), (img("v"), "captions", -1), (img("b"), "thumbnails", -1)])
    same = R.counts(q)
    assert ST.counts_of(ST.held_state(R.count_changes(q))).select(*same.columns).collect() == same.collect()


def test_holds_of_one_bucket_end_each_at_its_own_time(spark, tmp_path):
    row = lambda i, s, t, ok: ("st", s, "pose", i, ts(t), ok)
    stream = feed(spark, tmp_path, OUTCOMES, [row(1, "late", "2024-01-01 00:20:00", False), row(2, "early", "2024-01-01 00:00:00", False), row(3, "freed", "2024-01-01 00:01:00", False)],
                  [row(4, "freed", "2024-01-01 00:20:30", True)], [row(5, "new", "2024-01-01 01:00:00", False)], [row(6, "x", "2024-01-01 01:01:00", True)])
    got = landed(spark, ST.holds(stream, buckets=1), tmp_path)
    assert sorted((r.s, r.action, r.until.strftime("%H:%M")) for r in got.collect()) == [
        ("early", "expire", "00:10"), ("early", "hold", "00:10"), ("freed", "clear", "00:30"), ("freed", "hold", "00:11"), ("late", "expire", "00:30"), ("late", "hold", "00:30"),
        ("new", "hold", "01:10")]


def test_state_is_kept_by_bucket(spark, tmp_path):
    e = lambda i, kind, seq: ("st", f"m{i}", kind, "2024", seq)
    schema = "store string, iri string, kind string, text string, seq long"
    stream = feed(spark, tmp_path, schema, [e(i, k, n) for i in range(500) for n, k in enumerate(("image", "gate"))], [e(i, "done", 9) for i in range(0, 500, 2)])
    known = ST.work_state(spark.createDataFrame([e(i, "done", -1) for i in range(400, 700)], schema))
    known.write.parquet(f"{tmp_path}/known")
    out = f"{tmp_path}/out"
    q = ST.to_batches(ST.live_work(stream, stream.sparkSession.read.parquet(f"{tmp_path}/known"), 7), out, checkpoint=f"{tmp_path}/ckpt")
    q.awaitTermination()
    assert q.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] == 7  # not one a media
    said = sorted((r.batch, int(r.iri[1:]), r.pending) for r in spark.read.parquet(out).collect())
    assert said == [(0, i, True) for i in range(400)] + [(1, i, False) for i in range(0, 400, 2)]
