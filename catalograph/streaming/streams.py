"""Streams: ingest, live work list, holds, ready marks, change feed, call metrics, counts.

Every sink writes one folder per micro-batch and overwrites it on a retry, so a batch that runs twice lands once.
State lives in RocksDB with its checkpoint in the shared folder, for keyed operators by buckets of keys.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from catalograph import names as N
from catalograph.operators import reads as R
from catalograph.operators.analytics import classify
from catalograph.operators.arrivals import ingest
from catalograph.session import cut_lineage, fresh_dir
from catalograph.sources import versions as VS
from catalograph.sources.snapshots import finished

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_session(spark: SparkSession, partitions: int | None = None) -> SparkSession:
    """A session of its own for streams: state is partitioned once and for all, so its partition count is fixed here."""
    s = spark.newSession()
    s.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    s.conf.set("spark.sql.shuffle.partitions", str(partitions or spark.sparkContext.defaultParallelism))
    s.conf.set("spark.sql.session.timeZone", "UTC")
    return s


def to_batches(df: DataFrame, path: str, mode: str = "append", checkpoint: str | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Write each micro-batch to its own folder below `path`."""
    def land(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (df.writeStream.outputMode(mode).foreachBatch(land)
            .option("checkpointLocation", checkpoint or fresh_dir(df.sparkSession, "stream"))
            .trigger(**(trigger or {"availableNow": True})).start())


def run_to_end(df: DataFrame, path: str, mode: str = "append") -> None:
    """Drain what is there now."""
    to_batches(df, path, mode).awaitTermination()


def run_until_idle(df: DataFrame, path: str, mode: str = "append", checkpoint: str | None = None, every: str = "3 seconds") -> None:
    """Drain a stream on the wall clock, whose timers make batches for ever: it is stopped after a batch that brought nothing, in the pause
    before the next one. Batches that take longer than `every` leave no pause; then the third such batch is broken off, which its retry mends."""
    q = to_batches(df, path, mode, checkpoint, {"processingTime": every})
    first = None  # the first batch without input
    try:
        while not q.awaitTermination(0.1):  # raises what the stream failed with
            last = q.lastProgress
            if last is None or last["numInputRows"]:
                continue
            first = last["batchId"] if first is None else first
            if not q.status["isTriggerActive"] or last["batchId"] > first + 1:
                return
    finally:
        q.stop()


# ── ingest ──────────────────────────────────────────────────────────────────────────────────────────────────

def ingest_stream(arrivals: DataFrame, quads: Callable[[], DataFrame], out: str, checkpoint: str,
                  packets: Callable[[DataFrame], DataFrame] | None = None, now: str = "", trigger: dict | None = None) -> StreamingQuery:
    """Arrivals to `out/quads` and `out/rejects`. Ids come from the arrival; `quads()` gives the facts already stored and may include
    what this sink landed. Facts are the last thing a batch writes, so a batch run again after they landed changes nothing, and its files keep
    their ids."""
    def land(batch: DataFrame, batch_id: int) -> None:
        target = f"{out}/quads/batch={batch_id}"
        if finished(batch.sparkSession, target):
            return
        _, facts, rejects = ingest(batch, quads(), None if packets is None else packets(batch), now)
        facts = cut_lineage(facts)  # before the folder is touched that `quads()` may read
        rejects.write.mode("overwrite").parquet(f"{out}/rejects/batch={batch_id}")
        facts.write.mode("overwrite").parquet(target)

    return (arrivals.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


# ── keyed state ─────────────────────────────────────────────────────────────────────────────────────────────

BUCKETS = 512  # groups that the keys of a stream are dealt to; what one holds is read and written whole, so more than some 10 million keys need more


class Bucket(StatefulProcessor):
    """The state of all keys of one bucket: a call into Python and an exchange with the state store cost far more than a row, so they are paid by the
    bucket. A key's state is a list of plain values; the bucket's is the JSON text of [timer, [[key, state], ...]]."""

    KEY: tuple[str, ...] = ("store", "iri")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("bucket", "held string")

    def _held(self) -> tuple[int | None, dict[tuple, list]]:
        row = self.state.get()
        timer, keys = json.loads(row[0]) if row is not None else (None, [])
        return timer, {tuple(k): v for k, v in keys}

    def _keep(self, held: dict[tuple, list], timer: int | None = None) -> None:
        self.state.update((json.dumps([timer, list(held.items())], separators=(",", ":")),))

    def _rows(self, frames: Iterator[pd.DataFrame], *names: str) -> Iterator[tuple]:
        """(key, values...) of every row, in the order they came."""
        for b in frames:
            keys = zip(*[[x if isinstance(x, str) else None for x in b[c]] for c in self.KEY], strict=True)
            yield from zip(keys, *[b[c] for c in names], strict=True)

    def _frame(self, rows: list[tuple], *names: str) -> Iterator[pd.DataFrame]:
        if rows:
            yield pd.DataFrame([(*k, *rest) for k, *rest in rows], columns=[*self.KEY, *names])

    def close(self) -> None:
        pass


def _by_bucket(rows: DataFrame, processor: Bucket, output: str, time_mode: str, buckets: int, known: DataFrame | None = None) -> DataFrame:
    deal = lambda df: df.withColumn("bucket", F.pmod(F.xxhash64(*processor.KEY), F.lit(buckets)).cast("int")).groupBy("bucket")
    return deal(rows).transformWithStateInPandas(processor, output, "Append", time_mode, initialState=None if known is None else deal(known))


class WorkItem(Bucket):
    """Per media: [image, done, gate, created, and the seq of the last word on each], and whether that makes it pending."""

    ASPECTS = (("image", "removed"), ("done", "forgotten"), ("gate", "ungate"))
    ABOUT = {kind: (i, kind == on) for i, (on, off) in enumerate(ASPECTS) for kind in (on, off)}

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        _, held = self._held()
        for k, image, done, gate, created, seq in self._rows(iter([initialState]), "image", "done", "gate", "created", "seq"):
            held[k] = [bool(image), bool(done), bool(gate), created if isinstance(created, str) else None, *[int(seq)] * 3]
        self._keep(held)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        _, held = self._held()
        newest: dict[tuple, list] = {}
        for k, kind, text, seq in self._rows(rows, "kind", "text", "seq"):
            words = newest.setdefault(k, [None, None, None])
            if kind in self.ABOUT:
                i, on = self.ABOUT[kind]
                if words[i] is None or seq >= words[i][0]:
                    words[i] = (int(seq), on, text if isinstance(text, str) else None)
        said = []
        for k, words in newest.items():
            x = held.setdefault(k, [False, False, False, None, -1, -1, -1])
            was = x[0] and x[2] and not x[1]
            for i, word in enumerate(words):
                if word is not None and word[0] >= x[4 + i]:  # an older word that comes late says nothing new
                    x[4 + i], x[i] = word[0], word[1]
                    if i == 0 and word[1]:
                        x[3] = word[2]
            now = x[0] and x[2] and not x[1]
            if now != was:
                said.append((k, x[3], now))
        self._keep(held)
        yield from self._frame(said, "created", "pending")


def live_work(events: DataFrame, known: DataFrame | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Changes of the work list of one stage. `events(store, iri, kind, text[, seq])`: kind is image (text: its date), done,
    forgotten, gate, ungate or removed; the last word by `seq` holds, in whatever order a batch brings them. A row leaves when a media
    becomes pending or stops being so.

    `known` is the state to begin from, as `work_state` reads it off a catalogue: what is pending there is not said again.
    """
    if "seq" not in events.columns:
        events = events.withColumn("seq", F.lit(0).cast("bigint"))
    return _by_bucket(events, WorkItem(), "store string, iri string, created string, pending boolean", "None", buckets,
                      None if known is None else known.select(*WORK_STATE))


WORK_STATE = ["store", "iri", "image", "done", "gate", "created", "seq"]


def work_state(events: DataFrame) -> DataFrame:
    """What a batch of `events` leaves of each media, one row each: the last word of every aspect by `seq`, folded map-side."""
    last = lambda on, off: F.coalesce(F.max_by(F.col("kind") == on, F.when(F.col("kind").isin(on, off), F.col("seq"))), F.lit(False))
    made = F.max_by("text", F.when(F.col("kind") == "image", F.col("seq")))
    return events.groupBy("store", "iri").agg(*[last(on, off).alias(on) for on, off in WorkItem.ASPECTS], made.alias("created"), F.max("seq").alias("seq"))


def work_after(known: DataFrame, landed: DataFrame) -> DataFrame:
    """(store, iri, created) that are pending: the state begun from, overtaken by the changes landed since, batch by batch."""
    began = known.filter("image AND gate AND NOT done").select("store", "iri", F.lit(-1).cast("bigint").alias("batch"), "created", F.lit(True).alias("pending"))
    said = landed.select("store", "iri", F.col("batch").cast("bigint").alias("batch"), "created", "pending")
    last = began.unionByName(said).groupBy("store", "iri").agg(F.max_by(F.struct("created", "pending"), "batch").alias("x"))
    return last.filter("x.pending").select("store", "iri", "x.created")


class Hold(Bucket):
    """Per (store, media, stage): [seq, until in microseconds, held] of the failure that holds it, until it expires or a success clears it.
    A bucket has one timer, no later than the first hold that ends; one that finds nothing over only sets the next."""

    KEY = ("store", "s", "stage")

    def __init__(self, seconds: int, wall_clock: bool = False):
        self.seconds, self.wall_clock = seconds, wall_clock

    def _now(self, timerValues) -> int:
        return timerValues.getCurrentProcessingTimeInMs() if self.wall_clock else timerValues.getCurrentWatermarkInMs()

    @staticmethod
    def _first(held: dict[tuple, list]) -> int | None:
        return min((until // 1000 for _, until, on in held.values() if on), default=None)

    def _said(self, rows: list[tuple]) -> Iterator[pd.DataFrame]:
        yield from self._frame([(k, action, pd.Timestamp(until, unit="us")) for k, action, until in rows], "action", "until")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        timer, held = self._held()
        newest: dict[tuple, tuple] = {}
        for k, n, at, ok in self._rows(rows, "seq", "at", "ok"):
            if n > (newest[k][0] if k in newest else held[k][0] if k in held else -1):  # an older outcome that comes late says nothing new
                newest[k] = (int(n), at, ok)
        said, now = [], self._now(timerValues)
        for k, (n, at, ok) in newest.items():
            was = held[k][2] if k in held else False
            until = pd.Timestamp(at).value // 1000 + self.seconds * 1_000_000
            lasting = not ok and until // 1000 > now
            held[k] = [n, until, lasting]
            if lasting:
                said.append((k, "hold", until))
            elif was:  # the failure's own time is over: what held before ends with it
                said.append((k, "clear" if ok else "expire", until))
        if not newest:
            return
        first = self._first(held)
        if first is not None and (timer is None or first < timer):
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(first)
            timer = first
        self._keep(held, timer)
        yield from self._said(said)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        _, held = self._held()
        said, now = [], self._now(timerValues)
        for k, x in held.items():
            if x[2] and x[1] // 1000 <= now:
                x[2] = False
                said.append((k, "expire", x[1]))
        timer = self._first(held)
        if timer is not None:
            self.handle.registerTimer(timer)
        self._keep(held, timer)
        yield from self._said(said)


HOLD_ROW = "store string, s string, stage string, action string, until timestamp"


def holds(outcomes: DataFrame, delay: str = "1 minute", seconds: int = N.HOLD_SECONDS, buckets: int = BUCKETS) -> DataFrame:
    """Hold changes from `outcomes(store, s, stage, seq, at, ok)`; holds end with the event-time clock."""
    rows = outcomes.withColumn("at", F.col("at").cast("timestamp")).withWatermark("at", delay)
    return _by_bucket(rows, Hold(seconds), HOLD_ROW, "EventTime", buckets)


def holds_by_clock(outcomes: DataFrame, seconds: int = N.HOLD_SECONDS, buckets: int = BUCKETS) -> DataFrame:
    """As `holds`, but on the wall clock: a hold ends `seconds` after its failure although nothing more arrives. The clock is the
    micro-batch's own, which the offset log keeps, so a batch that runs again says the same. Run it with a `processingTime` trigger: `availableNow` would not end."""
    rows = outcomes.withColumn("at", F.col("at").cast("timestamp"))
    return _by_bucket(rows, Hold(seconds, True), HOLD_ROW, "ProcessingTime", buckets)


class Ready(Bucket):
    """Per media: [said, required references seen so far...]; speaks once, when the last one is there."""

    def __init__(self, required: list[tuple[str, str]]):
        self.required = {f"{a} {b}" for a, b in required}

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        _, held = self._held()
        touched: dict[tuple, list] = {}
        for k, link, model in self._rows(rows, "link", "model"):
            x = touched[k] = held.setdefault(k, [False])
            if link == "complete":
                x[0] = True
            elif (ref := f"{link} {model}") in self.required and ref not in x:
                x.append(ref)
        ready = [(k,) for k, x in touched.items() if not x[0] and self.required and len(x) > len(self.required)]
        for k, in ready:
            held[k][0] = True
        self._keep(held)
        yield from self._frame(ready)


def ready_marks(refs: DataFrame, required: list[tuple[str, str]], buckets: int = BUCKETS) -> DataFrame:
    """Media that now hold every required reference, once each. A row with link `complete` is a mark already there."""
    return _by_bucket(refs, Ready(required), "store string, iri string", "None", buckets)


# ── feeds and metrics ───────────────────────────────────────────────────────────────────────────────────────

def latest_marks(changes: DataFrame, delay: str | None = None) -> DataFrame:
    """Latest marks per image from `changes(store, iri, at, seq, rating, is_picked, is_rejected)`, for update mode.
    With `delay`, repeats of a change within it are dropped first."""
    rows = changes.withColumn("at", F.col("at").cast("timestamp"))
    if delay is not None:
        rows = rows.withWatermark("at", delay).dropDuplicatesWithinWatermark(["store", "iri", "seq"])
    return rows.groupBy("store", "iri").agg(F.max(F.struct("at", "seq", "rating", "is_picked", "is_rejected")).alias("x")).select("store", "iri", "x.*")


def newest(batches: DataFrame, keys: list[str], by: str = "seq") -> DataFrame:
    """The last word per key over all landed batches of an update stream."""
    rest = [c for c in batches.columns if c not in keys and c != "batch"]
    return batches.groupBy(*keys).agg(F.max(F.struct("batch", by, *[c for c in rest if c != by])).alias("x")).select(
        *keys, *[F.col(f"x.{c}").alias(c) for c in rest])


def call_metrics(calls: DataFrame, width: str = "1 minute", delay: str = "10 minutes") -> DataFrame:
    """Calls per tumbling window, stage and outcome; rows later than the watermark are dropped."""
    rows = classify(calls).withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", delay)
    return rows.groupBy(F.window("at", width).alias("w"), "stage", "outcome").agg(
        F.count("*").alias("calls"), F.sum("latency_ms").alias("latency_ms")).select(
        F.col("w.start").alias("start"), "stage", "outcome", "calls", "latency_ms")


def counts_stream(changed: DataFrame, quads: Callable[[], DataFrame], out: str, checkpoint: str,
                  trigger: dict | None = None) -> StreamingQuery:
    """Store counts, recomputed when something changed and at most once a minute: no new input, no batch."""
    def land(batch: DataFrame, batch_id: int) -> None:
        R.counts(quads()).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return (changed.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"processingTime": "60 seconds"})).start())


COUNTS = ["images", *R.COUNTED]


class Held(Bucket):
    """Per media: how many it holds of each thing that is counted. A bucket says by how much the images that count for one change, a row a store."""

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        _, held = self._held()
        for k, *n in self._rows(iter([initialState]), *COUNTS):
            held[k] = [int(v) for v in n]
        self._keep(held)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        _, held = self._held()
        added: dict[tuple, list[int]] = {}
        for k, what, n in self._rows(rows, "what", "n"):
            x = added.setdefault(k, [0] * len(COUNTS))
            if what in COUNTS:
                x[COUNTS.index(what)] += int(n)
        counted = lambda x: [int(x[0] > 0 and v > 0) for v in x]
        change: dict[str, list[int]] = {}
        for k, more in added.items():
            was = held.get(k, [0] * len(COUNTS))
            held[k] = [a + b for a, b in zip(was, more, strict=True)]
            total = change.setdefault(k[0], [0] * len(COUNTS))
            for i, (a, b) in enumerate(zip(counted(was), counted(held[k]), strict=True)):
                total[i] += b - a
        self._keep(held)
        told = [(store, *d) for store, d in change.items() if any(d)]
        if told:
            yield pd.DataFrame(told, columns=["store", *COUNTS])


def held_state(changes: DataFrame) -> DataFrame:
    """(store, iri, one column for each thing that is counted): the state that `changes(store, iri, what, n)` leave."""
    return changes.groupBy("store", "iri").agg(*[F.coalesce(F.sum(F.when(F.col("what") == c, F.col("n"))), F.lit(0)).alias(c) for c in COUNTS])


def counts_of(held: DataFrame) -> DataFrame:
    """Counts per store of such a state, equal to `reads.counts` but for stores without an image, whose row says 0."""
    return held.groupBy("store").agg(*[F.count_if((F.col("images") > 0) & (F.col(c) > 0)).alias(c) for c in COUNTS])


def counts_by_delta(changes: DataFrame, out: str, checkpoint: str, known: DataFrame | None = None, trigger: dict | None = None,
                    buckets: int = BUCKETS) -> StreamingQuery:
    """Store counts kept by what changed, at most once a minute: no scan of the graph. `changes(store, iri, what, n)` as `reads.count_changes` makes them,
    in any order; each adds to its image's state, and a batch writes the totals of the one before plus its own to `out/batch=N`.

    `known` is a `held_state` to begin from. A batch that runs again reads the same batch before it, so its totals are the same. With no known state
    and no change there is no row.
    """
    totals = ", ".join(f"{c} bigint" for c in COUNTS)
    first = None if known is None else counts_of(known)
    told = _by_bucket(changes, Held(), f"store string, {totals}", "None", buckets, None if known is None else known.select("store", "iri", *COUNTS))

    def land(batch: DataFrame, batch_id: int) -> None:
        s = batch.sparkSession
        before = max((int(n[6:]) for n in VS.names(s, out) if n.startswith("batch=") and int(n[6:]) < batch_id and finished(s, f"{out}/{n}")), default=None)
        prior = first if before is None else s.read.schema(batch.schema).parquet(f"{out}/batch={before}")
        rows = batch if prior is None else prior.select(*batch.columns).unionByName(batch)
        rows.groupBy("store").agg(*[F.sum(c).alias(c) for c in COUNTS]).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return (told.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"processingTime": "60 seconds"})).start())


def latest_counts(spark: SparkSession, out: str) -> DataFrame:
    """The totals of the newest finished batch."""
    done = [int(n[6:]) for n in VS.names(spark, out) if n.startswith("batch=") and finished(spark, f"{out}/{n}")]
    if not done:
        raise FileNotFoundError(f"no finished counts under {out}")
    return spark.read.parquet(f"{out}/batch={max(done)}")
