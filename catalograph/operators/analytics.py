"""Analytics over calls, files, packets, ledgers and the vocabulary."""

from __future__ import annotations

import hashlib
import zlib
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from catalograph import names as N
from catalograph.operators import patterns as P
from catalograph.session import cut_lineage


def outcome(status: Column, error: Column) -> Column:
    """recorded / terminal / quota / unreachable / transient, in that precedence."""
    ok = status.between(200, 299)
    terminal = F.coalesce(status == 422, F.lit(False)) | (F.coalesce(~ok, F.lit(False)) & ~F.coalesce(
        status.isin(402, 429) | status.between(500, 599), F.lit(False)))
    msg = F.coalesce(error, F.lit(""))
    down = reduce(lambda a, b: a | b, [msg.contains(x) for x in N.UNREACHABLE_SAYS])
    return (F.when(ok & error.isNull(), "recorded").when(terminal, "terminal")
            .when((status == 402) | msg.contains(N.QUOTA_SAYS), "quota").when(down, "unreachable").otherwise("transient"))


def classify(calls: DataFrame) -> DataFrame:
    return calls.withColumn("outcome", outcome(F.col("status"), F.col("error")))


def call_stats(calls: DataFrame, day: Column) -> DataFrame:
    """Per day, stage and outcome: calls, latency, bytes. The median is exact, the least latency that half of the calls do not exceed: calls are
    counted by latency map-side, and a group's distinct latencies are summed up in order, so no group of calls is held."""
    key = ["day", "stage", "outcome"]
    by_ms = calls.groupBy(day.alias("day"), "stage", "outcome", "latency_ms").agg(F.count("*").alias("n"), F.sum("request_bytes").alias("b"))
    timed = F.when(F.col("latency_ms").isNotNull(), F.col("n")).otherwise(0)
    group = Window.partitionBy(*key)
    upto = F.sum(timed).over(group.orderBy("latency_ms").rowsBetween(Window.unboundedPreceding, 0))
    ranked = by_ms.withColumns({"upto": upto, "of": F.sum(timed).over(group)})
    return ranked.groupBy(*key).agg(
        F.sum("n").alias("calls"), (F.sum(F.col("latency_ms") * F.col("n")) / F.nullif(F.sum(timed), F.lit(0))).alias("mean_ms"),
        F.min(F.when(F.col("upto") * 2 >= F.col("of"), F.col("latency_ms"))).alias("median_ms"),
        F.max("latency_ms").alias("max_ms"), F.sum("b").alias("request_bytes"))


# ── duplicates ──────────────────────────────────────────────────────────────────────────────────────────────

PNG_SCHEMA = "sha256 string, request string, fault string"
_TEXTS = (b"tEXt", b"zTXt", b"iTXt")


def _chunk_text(kind: bytes, data: bytes) -> str:
    """The text of a PNG text chunk behind its keyword, inflated if need be."""
    body = data.split(b"\0", 1)[1]
    if kind == b"tEXt":
        return body.decode("latin-1")
    if kind == b"zTXt":
        return zlib.decompress(body[1:]).decode("latin-1")
    flags, rest = body[:2], body[2:].split(b"\0", 2)
    if len(flags) < 2 or len(rest) < 3:
        raise ValueError("it is cut short")
    return (zlib.decompress(rest[2]) if flags[0] == 1 else rest[2]).decode("utf-8", "replace")


def _png_read(b: bytes) -> tuple[str | None, str | None, str | None]:
    """(hash, render request, fault) of a PNG in one pass; all None for anything not a whole PNG.

    The hash is over kind and data of every chunk but the rewritable metadata text. The first text chunk of the request's keyword says the
    request; one that cannot be read is a fault.
    """
    none = (None, None, None)
    if b[:8] != b"\x89PNG\r\n\x1a\n":
        return none
    h, i, kind, request, fault = hashlib.sha256(), 8, b"", None, None
    while i + 8 <= len(b) and kind != b"IEND":
        n, kind = int.from_bytes(b[i:i + 4], "big"), b[i + 4:i + 8]
        if i + 12 + n > len(b):
            return none
        data = b[i + 8:i + 8 + n]
        keyword, ended, _ = data.partition(b"\0") if kind in _TEXTS else (b"", b"", b"")
        if keyword != b"XML:com.adobe.xmp":
            h.update(kind)
            h.update(data)
        if ended and keyword == N.RENDER_REQUEST_CHUNK.encode() and request is None and fault is None:
            try:
                request = _chunk_text(kind, data)
            except (ValueError, zlib.error) as e:
                fault = f"its render request cannot be read: {e}"
        i += 12 + n
    return ("sha256:" + h.hexdigest(), request, fault) if kind == b"IEND" else none


def png_read(content: Column) -> Column:
    """Picture hash (fixed while the metadata chunk is rewritten), render request and fault of PNG bytes, as one struct; fields are NULL for other bytes."""
    @F.arrow_udf(PNG_SCHEMA)
    def read(batch: pa.Array) -> pa.Array:
        found = [(None,) * 3 if not x.is_valid else _png_read(x.as_py()) for x in batch]
        return pa.StructArray.from_arrays([pa.array(c, pa.string()) for c in (zip(*found, strict=True) if found else [[]] * 3)], ["sha256", "request", "fault"])
    return read(content)


def png_hash(content: Column) -> Column:
    """The picture hash of PNG bytes, else NULL."""
    return png_read(content)["sha256"]


def exact_dups(files: DataFrame, mode: str = "bytes") -> DataFrame:
    """`files(path, content)` with equal content: `(path, hash, kept, duplicate)`. The least path is kept.

    The minimum combines map-side, so a group of copies costs one row a task; only hashes with copies are joined
    back, and AQE splits a hot hash there.
    """
    digest = F.sha2("content", 256) if mode == "bytes" else png_hash(F.col("content"))
    rows = files.select("path", digest.alias("hash")).filter("hash IS NOT NULL")
    kept = rows.groupBy("hash").agg(F.min("path").alias("kept"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return rows.join(kept, "hash").select("path", "hash", "kept", (F.col("path") != F.col("kept")).alias("duplicate"))


# ── corpus profile ──────────────────────────────────────────────────────────────────────────────────────────

def row_index(df: DataFrame, by: list[str], name: str = "row") -> DataFrame:
    """Position of each row in a global order, without a one-task window: range partitions, numbered inside, each
    shifted by the rows before it (one count a partition)."""
    parts = cut_lineage(df.repartitionByRange(*by).withColumn("__part", F.spark_partition_id()))
    sizes = sorted((r["__part"], r["count"]) for r in parts.groupBy("__part").count().collect())
    before, starts = 0, []
    for p, n in sizes:
        starts.append((p, before))
        before += n
    start = F.try_element_at(F.create_map(*[F.lit(x) for kv in starts for x in kv]), F.col("__part")) if starts else F.lit(0)
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(*by)) - 1
    return parts.withColumn(name, (start + inside).cast("bigint")).drop("__part")


def stride(df: DataFrame, by: list[str], step: int) -> DataFrame:
    """Every `step`-th row in order."""
    return df if step == 1 else row_index(df, by, "__row").filter(F.col("__row") % step == 0).drop("__row")


def _after(text: Column, mark: str) -> Column:
    """What follows each `mark` of a text, up to the next."""
    parts = F.split(F.coalesce(text, F.lit("")), mark, -1)
    return F.slice(parts, F.lit(2), F.size(parts))


def _tag_names(text: Column) -> Column:
    """Qualified names of the opening tags, in order."""
    opened = F.transform(_after(text, "<"), lambda t: F.regexp_extract(t, r"^[\w-]+:\w+", 0))
    return F.filter(opened, lambda n: (n != "") & ~n.startswith("rdf:") & ~n.startswith("x:"))


def profile(packets: DataFrame, step: int = 1, region: str = "Region:", pose: str = "Pose:", caption_ns: str = "legacy") -> DataFrame:
    """What a corpus of packets `(month, path, packet)` holds: `(metric, key, total, greatest)`.

    A packet is a row of description blocks. The first speaks of the media; the later ones of regions and poses, by their subject. A prefix
    that later blocks use and none of them binds is `unbound`. Each packet yields its counts as rows, summed in one map-side aggregation.
    """
    df = stride(packets, ["month", "path"], step)
    blocks = _after(F.col("packet"), "<rdf:Description")
    df = df.select("month", "packet", blocks.alias("b")).withColumn("later", F.array_join(F.slice("b", F.lit(2), F.greatest(F.size("b"), F.lit(1))), "<rdf:Description"))
    about = lambda what: F.size(F.filter("b", lambda x: x.contains(f'about="{what}')))
    prefixes = F.array_distinct(F.transform(_tag_names(F.col("later")), lambda n: F.substring_index(n, ":", 1)))
    bound = F.transform(_after(F.col("later"), "xmlns:"), lambda t: F.trim(F.substring_index(t, "=", 1)))
    df = df.withColumns({"names": _tag_names(F.col("packet")), "unbound": F.array_except(prefixes, bound), "regions": about(region), "poses": about(pose)})
    there, month = F.col("packet").isNotNull(), F.col("month")
    row = lambda m, k, x: F.struct(F.lit(m).alias("metric"), k.cast("string").alias("key"), x.cast("bigint").alias("x"))
    total = lambda m, x, k=F.lit(""): row(m, k, x)
    each = lambda m, items, key: F.transform(items, lambda n: row(m, key(n), F.lit(1)))
    captions = F.filter("names", lambda n: n.startswith(f"{caption_ns}:") & F.lower(n).endswith("caption"))
    counts = F.concat(
        F.array(total("read", F.lit(1)), total("found", there), total("missing", ~there), total("read_in_month", F.lit(1), month),
                total("several_blocks", F.size("b") > 1), total("unbound_packets", F.size("unbound") > 0),
                total("unbound_in_month", F.size("unbound") > 0, month), total("region_packets", F.col("regions") > 0),
                total("region_blocks", F.col("regions")), total("pose_packets", F.col("poses") > 0)),
        each("unbound_prefix", F.col("unbound"), lambda n: n), each("caption_field", captions, lambda n: F.substring_index(n, ":", -1)),
        each("field_in_month", F.col("names"), lambda n: F.concat(month, F.lit(" "), n)))
    rows = df.select(F.explode(counts).alias("c")).select("c.*").filter("x > 0")
    return rows.groupBy("metric", "key").agg(F.sum("x").alias("total"), F.max("x").alias("greatest"))


# ── ledger ──────────────────────────────────────────────────────────────────────────────────────────────────

def reconcile(ledger: DataFrame) -> DataFrame:
    """Per source path of `ledger(seq, source_path, status)`: done by any stored row, uncertain when the last row
    says `delivering`."""
    per = ledger.groupBy("source_path").agg(F.max(F.col("status").isin("stored", "stored-not-moved")).alias("done"),
                                            F.max(F.struct("seq", "status"))["status"].alias("last_status"), F.count("*").alias("rows"))
    return per.withColumn("uncertain", F.col("last_status") == "delivering")


def ledger_counts(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("status").agg(F.count("*").alias("n"))


def already_stored(q: DataFrame, facts: DataFrame, moment_predicate: str, moment_ns: str) -> DataFrame:
    """Uncertain files `facts(store, path, media_created_date, moment)` found again by media date and moment.

    Exactly one hit counts as stored; none or several do not. The media of a date, and of a date and moment, are counted before files meet
    them (by their least and greatest, map-side), so a file meets one row, however many media share its date.
    """
    dated = q.filter(F.col("p") == N.v("mediaCreatedDate")).select("store", "s", F.col("o").alias("media_created_date"))
    date, moment = ["store", "media_created_date"], ["store", "media_created_date", "moment"]
    ends = lambda d, key: d.groupBy(*key).agg(F.min("s").alias("s"), F.max("s").alias("last"))
    by_hash = F.col("moment").startswith("sha256:")
    said = q.filter((F.col("p") == moment_predicate) & (F.col("o_kind") == "literal")).select("store", "s", F.col("o").alias("moment"))
    linked = q.filter((F.col("p") == N.v("relatedToId")) & F.col("o").startswith(moment_ns)).select(
        "store", "s", F.substring("o", len(moment_ns) + 1, 1 << 30).alias("moment"))
    alone = facts.filter("moment IS NULL").join(ends(dated, date), date)
    named = facts.filter(~by_hash).join(ends(dated.join(said, ["store", "s"]), moment), moment)
    hashed = facts.filter(by_hash).join(ends(dated.join(linked, ["store", "s"]), moment), moment)
    found = [d.select("store", "path", "s", "last") for d in (alone, named, hashed)]
    one = reduce(DataFrame.unionByName, found).groupBy("store", "path").agg(F.min("s").alias("s"), F.max("last").alias("last"))
    return one.filter("s = last").drop("last")


# ── audits ──────────────────────────────────────────────────────────────────────────────────────────────────

def declared_predicates(ontology: DataFrame | None = None) -> list[str]:
    """Full IRIs of the declared vocabulary, from the fixed values or a loaded vocabulary (a few hundred names)."""
    if ontology is not None:
        return [N.v(r.local) for r in ontology.select("local").distinct().collect()]
    return [N.v(n) for rows in N.DATATYPE_PROPERTIES.values() for n, _ in rows] + [N.v(n) for n in N.OBJECT_PROPERTIES]


def audit_vocab(q: DataFrame, declared: list[str]) -> DataFrame:
    """Predicates outside the vocabulary: (p, n, verdict). The counts combine per partition of `p`."""
    used = q.groupBy("p").agg(F.count("*").alias("n")).filter(~F.col("p").isin(*declared, N.RDF_TYPE))
    return used.withColumn("verdict", F.when(F.col("p").startswith(N.VOCAB), "undeclared").otherwise("foreign"))


def lineage(class_: str) -> list[str]:
    out = [class_]
    while out[-1] in N.SUPERCLASS:
        out.append(N.SUPERCLASS[out[-1]])
    return out


def audit_cardinality(q: DataFrame) -> DataFrame:
    """(store, s, class, property, n, rule) of nodes with too few or too many values of a property.

    The rules of a class are a literal map. A node's counts (one a ruled predicate, combined map-side) come to it as a map,
    against which its rules are checked in place; only violations become rows, and a missing value counts 0.
    """
    classes_ = sorted({c for c in [*N.CARDINALITY, *N.SUPERCLASS]})
    exact = {c: [p for k in lineage(c) for p in N.CARDINALITY.get(k, ([], []))[0]] for c in classes_}
    most = {c: [p for k in lineage(c) for p in N.CARDINALITY.get(k, ([], []))[1]] for c in classes_}
    as_map = lambda d: F.create_map(*[x for c, ps in d.items() for x in (F.lit(c), F.array(*[F.lit(p) for p in ps]).cast("array<string>"))])
    ruled = sorted({p for d in (exact, most) for ps in d.values() for p in ps})
    nodes = q.filter((F.col("p") == N.RDF_TYPE) & F.col("o").isin(*[N.v(c) for c in classes_])).select(
        "store", "s", F.substring_index("o", "/", -1).alias("class")).dropDuplicates()
    counts = (q.filter(F.col("p").isin(*[N.v(p) for p in ruled])).groupBy("store", "s", "p").agg(F.count("*").alias("n"))
              .groupBy("store", "s").agg(F.map_from_entries(F.collect_list(F.struct(F.substring_index("p", "/", -1), "n"))).alias("have")))
    found = nodes.join(counts, ["store", "s"], "left")
    have = lambda p: F.coalesce(F.try_element_at(F.col("have"), p), F.lit(0).cast("bigint"))
    judged = lambda d, rule: F.transform(F.try_element_at(as_map(d), F.col("class")), lambda p: F.struct(p.alias("property"), have(p).alias("n"), F.lit(rule).alias("rule")))
    wrong = F.concat(F.filter(judged(exact, "exactly 1"), lambda x: x["n"] != 1), F.filter(judged(most, "at most 1"), lambda x: x["n"] > 1))
    return found.select("store", "s", "class", F.explode(wrong).alias("x")).select("store", "s", "class", "x.*")
