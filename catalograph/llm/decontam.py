"""Benchmark decontamination: size-partitioned MinHash containment search, in DataFrame functions only.

An item is found in a document if at least `threshold` of its distinct 5-word shingles are there. A short item and a long document have a
Jaccard similarity near zero, where a sketch of the whole document is blind. So items are partitioned by size, and for each
partition both sides are cut into all windows of as many consecutive shingles as the partition's items must still share in one run
(`run_length`); a window's signature is its MinHash. An equal run has equal windows, so the search misses no item that was copied with
edits within the threshold. Windows come from the shingle hashes by doubling (minima of 1, 2, 4, 8, ...), and a document keeps each distinct
minimum once, about 2 / (width + 1) of its shingles. Candidates are then verified by exact shingles of the whole document.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, functions as F

from catalograph.llm.tables import let, text_or_empty, written
from catalograph.operators.sizes import small

K = 5
FEW = 200_000  # distinct texts named in a broadcast, 32 bytes each; more are joined by shuffle
THRESHOLD = 0.8


def run_length(q: int, threshold: float = THRESHOLD, k: int = K) -> int:
    """Shingles in a row that a copy of an item with `q` of them must hold at `threshold`.

    An edit inside the item costs k - 1 shingles at least, so few edits fit into what may be missing, and they cut what is left into one
    more run than there are edits.
    """
    kept = math.ceil(threshold * q - 1e-9)
    return max(1, math.ceil(kept / ((q - kept) // (k - 1) + 1)))


def width(q: Column, threshold: float, k: int) -> Column:
    """The partition of an item: the greatest power of two within its run length."""
    kept = F.ceil(threshold * q - 1e-9)
    run = F.ceil(kept / (F.floor((q - kept) / (k - 1)) + 1))
    return F.pow(F.lit(2), F.floor(F.log2(F.greatest(run, F.lit(1)).cast("double") + 1e-9))).cast("int")


def words(text: str | Column = "text") -> Column:
    """Lower-case runs of letters and digits."""
    return F.array_remove(F.split(F.lower(text_or_empty(text)), r"[^\p{L}\p{N}]+", -1), "")


def _each(w: Column, k: int, body) -> Column:
    return F.when(F.size(w) >= k, F.transform(F.sequence(F.lit(1), F.size(w) - (k - 1)), body))


def hashes(w: Column, k: int = K) -> Column:
    """One hash a shingle, in order; null with fewer than k words."""
    return let(w, lambda v: _each(v, k, lambda i: F.xxhash64(*[F.element_at(v, i + j) for j in range(k)])))


def shingles(w: Column, k: int = K) -> Column:
    """The distinct shingles as text; null with fewer than k words."""
    return F.array_distinct(let(w, lambda v: _each(v, k, lambda i: F.concat_ws(" ", *[F.element_at(v, i + j) for j in range(k)]))))


def _doubled(minima: Column, step: int) -> Column:
    """Minima of windows twice as wide; null if none fits."""
    return let(minima, lambda m: F.when(F.size(m) > step, F.transform(F.sequence(F.lit(1), F.size(m) - step), lambda i: F.least(
        F.element_at(m, i), F.element_at(m, i + step)))))


def _sketch(df: DataFrame, widths: list[int], keep: list[str], k: int) -> DataFrame:
    """(keep..., width, sig): the distinct window minima of column `_w` for each width asked for."""
    cur, at, made = df.withColumn("_m", hashes(F.col("_w"), k)).drop("_w"), 1, []

    def signed(n: int) -> Column:
        minima = F.coalesce(f"_m{n}", F.array().cast("array<bigint>"))
        return F.transform(minima, lambda x: F.struct(F.lit(n).alias("width"), x.alias("sig")))

    while at <= max(widths):
        if at in widths:
            made.append(signed(at))
            cur = cur.withColumn(f"_m{at}", F.array_distinct("_m"))
        cur = cur.withColumn("_m", _doubled(F.col("_m"), at))
        at *= 2
    parts = F.flatten(F.array(*made))
    return cur.select(*keep, F.explode(parts).alias("_x")).select(*keep, "_x.width", "_x.sig")


def blob(text: str = "text") -> Column:
    return F.unhex(F.sha2(F.encode(text_or_empty(text), "UTF-8"), 256))


def contaminated(docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text",
                 threshold: float = THRESHOLD, k: int = K) -> DataFrame:
    """(blob, item, n_shared, n_shingles) for every distinct text and item with containment >= `threshold`.

    Items of fewer than k words have no shingle and are found nowhere; equal item texts are searched once. Null texts count as empty.
    Candidates hold equal texts once, so a hot group of copies is one candidate. The item side is a written table and broadcast only
    if its measured size allows it; candidate names are counted before they are.
    """
    spark = docs.sparkSession
    rows = items.select(F.col(item_key).alias("item"), text_or_empty(item_text).alias("_t"))
    bodies = (rows.select(blob("_t").alias("body"), "_t").groupBy("body").agg(F.first("_t").alias("_t"))
              .withColumn("_w", words("_t")).withColumn("sh", shingles(F.col("_w"), k)).filter(F.size("sh") > 0)
              .withColumn("q", F.size("sh").cast("bigint")).withColumn("part", width(F.col("q"), threshold, k)))
    bodies = written(bodies.select("body", "sh", "q", "part", "_w"), "items")
    parts = sorted(r.part for r in bodies.select("part").distinct().collect())  # powers of two: a handful
    pairs_schema = "blob binary, item " + items.schema[item_key].dataType.simpleString() + ", n_shared bigint, n_shingles bigint"
    if not parts:
        return spark.createDataFrame([], pairs_schema)
    item_sigs = written(_sketch(bodies.select("body", "part", "_w"), parts, ["body", "part"], k).filter("width = part")
                        .select("body", "width", "sig").distinct(), "item-sketch")
    doc_sigs = _sketch(docs.select(blob(text).alias("blob"), words(text).alias("_w")), parts, ["blob"], k)
    cands = written(doc_sigs.join(item_sigs, ["width", "sig"]).select("blob", "body").distinct(), "candidates")

    # Exact shingles of the candidate texts, against the shingles of the items each is a candidate for.
    texts = (docs.select(blob(text).alias("blob"), text_or_empty(text).alias("_t"))
             .join(small(cands.select("blob").distinct(), FEW), "blob", "left_semi").groupBy("blob").agg(F.first("_t").alias("_t")))
    held = texts.withColumn("_w", words("_t")).select("blob", F.explode(shingles(F.col("_w"), k)).alias("s"))
    asked = cands.join(bodies.select("body", "q", F.explode("sh").alias("s")), "body")
    hit = (asked.join(held, ["blob", "s"]).groupBy("blob", "body").agg(F.count("*").alias("n_shared"), F.first("q").alias("n_shingles"))
           .filter(F.col("n_shared") >= F.ceil(threshold * F.col("n_shingles") - 1e-9)))
    named = rows.select("item", blob("_t").alias("body"))
    return written(hit.join(named, "body").select("blob", "item", "n_shared", "n_shingles"), "contaminated")


def report(docs: DataFrame, items: DataFrame, key: str = "doc_id", **kw) -> DataFrame:
    """(key, item_id, n_shared, n_shingles, containment) for every document row and item found in it."""
    text, item_key = kw.get("text", "text"), kw.get("item_key", "item_id")
    found = contaminated(docs, items, **kw)
    return docs.select(F.col(key), blob(text).alias("blob")).join(found, "blob").select(
        key, F.col("item").alias(item_key), "n_shared", "n_shingles", (F.col("n_shared") / F.col("n_shingles")).alias("containment"))


def clean(docs: DataFrame, items: DataFrame, **kw) -> DataFrame:
    """`docs` without the rows that hold an item."""
    found = small(contaminated(docs, items, **kw).select(F.col("blob").alias("_blob")).distinct(), FEW)
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), blob(kw.get("text", "text")).alias("_blob"))
    return rows.join(found, "_blob", "left_anti").select(*[F.col("_row")[c].alias(c) for c in docs.columns])


ORACLE = re.sub(r"\n +", "\n", r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
i AS (SELECT row_number() OVER () AS j, item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
ds AS (SELECT DISTINCT r, array_to_string(w[p:p + 4], ' ') AS s FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS p FROM d)),
bs AS (SELECT DISTINCT j, array_to_string(w[p:p + 4], ' ') AS s FROM (SELECT j, w, unnest(range(1, len(w) - 3)) AS p FROM i)),
q AS (SELECT j, count(*) AS n FROM bs GROUP BY j),
c AS (SELECT r, j, count(*) AS n_shared FROM ds JOIN bs USING (s) GROUP BY r, j)
SELECT doc_id, item_id, n_shared, q.n AS n_shingles, n_shared / q.n AS containment
FROM c JOIN q USING (j) JOIN d USING (r) JOIN i USING (j) WHERE 5 * n_shared >= 4 * q.n""")
