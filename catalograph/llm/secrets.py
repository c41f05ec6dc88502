"""Secret scans over an incremental ledger of blobs, in DataFrame functions only.

A text is a blob named by its SHA-256. The ledger is a table in a shared folder, one run folder a scan, with a row for every blob scanned
and the rules (kind and version) it was scanned with. A scan folds all versions of all paths to blobs, drops the (blob, rule version) pairs
the ledger has, reads each remaining text once, and joins findings back to every path that ever held the blob.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.utils import AnalysisException

from catalograph.llm.tables import text_or_empty
from catalograph.operators.sizes import small
from catalograph.session import fresh_dir


@dataclass(frozen=True)
class Rule:
    """`pattern` in Java's syntax; a match counts if group `group` has at least `least` characters."""

    kind: str
    version: int
    pattern: str
    group: int
    least: int

    @property
    def id(self) -> str:
        return f"{self.kind}@{self.version}"


# The base rules, in the order ties are listed. A run of hex digits is a match or not by its length alone, so `least` may
# stand in that pattern.
RULES = (
    Rule("assign", 1, r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", 1, r"(AKIA[A-Z0-9]+)", 1, 20),
    Rule("hex", 1, r"([0-9a-f]{24,})", 1, 24),
)

FEW = 100_000  # blobs with secrets named in a broadcast; more are joined by shuffle
HIT = "array<struct<head:int,len:int,value:int>>"
LEDGER = f"blob binary, rules array<string>, hits array<struct<rule:string,found:{HIT}>>"


def blob_of(text: str = "text") -> Column:
    return F.unhex(F.sha2(F.encode(text_or_empty(text), "UTF-8"), 256))


def _hits(text: Column, rule: Rule) -> Column:
    """Of each match, in order: the characters since the last match, its length, the length of its value."""
    p = F.lit(rule.pattern)
    cut = F.arrays_zip(F.transform(F.split(text, rule.pattern, -1), F.length).alias("head"),
                       F.transform(F.regexp_extract_all(text, p, F.lit(0)), F.length).alias("len"),
                       F.transform(F.regexp_extract_all(text, p, F.lit(rule.group)), F.length).alias("value"))
    return F.when(F.regexp_like(text, p), F.filter(cut, lambda x: x["len"].isNotNull())).otherwise(F.lit(None)).cast(HIT)


class Ledger:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def rows(self) -> DataFrame:
        """(blob, rules, hits, run) of all runs so far."""
        try:
            return self.spark.read.schema(f"{LEDGER}, run string").parquet(f"{self.folder}/runs")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], f"{LEDGER}, run string")

    def scan(self, versions: DataFrame, run: str, text: str = "text", rules: tuple[Rule, ...] = RULES) -> None:
        """Scan the blobs of `versions` that some rule version has not seen; repeating a `run` replaces it, as if it had not been.

        A null text is the empty blob. Equal texts fold before the shuffle, so a group of copies travels as few rows.
        """
        blobs = versions.select(blob_of(text).alias("blob"), text_or_empty(text).alias("t")).groupBy("blob").agg(F.first("t").alias("t"))
        seen = self.rows().filter(F.col("run") != run).select("blob", F.explode("rules").alias("rule")).groupBy("blob").agg(F.collect_set("rule").alias("seen"))
        ids = F.array(*[F.lit(r.id) for r in rules])
        left = (blobs.join(seen, "blob", "left").withColumn("rules", F.array_except(ids, F.coalesce("seen", F.array().cast("array<string>"))))
                .filter(F.size("rules") > 0))
        hits = F.array(*[F.when(F.array_contains("rules", r.id), F.struct(F.lit(r.id).alias("rule"), _hits(F.col("t"), r).alias("found")))
                         for r in rules])
        out = left.select("blob", "rules", F.filter(hits, lambda h: F.size(h["found"]) > 0).alias("hits"))
        out.write.mode("overwrite").parquet(f"{self.folder}/runs/run={run}")

    def findings(self, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """(blob, kind, version, start, end): code points, end exclusive. Places are running sums along each blob's matches."""
        order = "(PARTITION BY blob, rule ORDER BY pos ROWS UNBOUNDED PRECEDING)"
        found = (self.rows().filter(F.size("hits") > 0).select("blob", F.explode("hits").alias("h"))
                 .filter(F.col("h.rule").isin([r.id for r in rules]))
                 .select("blob", F.col("h.rule").alias("rule"), F.posexplode("h.found").alias("pos", "x"))
                 .withColumn("end", F.expr(f"sum(bigint(x.head) + x.len) OVER {order}"))
                 .withColumn("start", F.col("end") - F.col("x.len")))
        least = F.element_at(F.create_map(*[F.lit(v) for r in rules for v in (r.id, r.least)]), F.col("rule"))
        part = F.split("rule", "@")
        return found.filter(F.col("x.value") >= least).select("blob", part[0].alias("kind"), part[1].cast("int").alias("version"), "start", "end")


def digests(findings: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row a blob with findings: counts by kind and its spans `kind:start:end`, by start and then rule order."""
    rank = F.element_at(F.create_map(*[F.lit(v) for i, r in enumerate(rules) for v in (r.kind, i)]), F.col("kind"))
    span = F.concat_ws(":", "kind", "start", "end")
    return findings.groupBy("blob").agg(
        *[F.count(F.when(F.col("kind") == r.kind, 1)).alias(f"n_{r.kind}") for r in rules],
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", rank.alias("rank"), "end", span.alias("span")))),
                                 lambda x: x["span"]), ",").alias("spans"))


def _scanned(docs: DataFrame, text: str) -> Ledger:
    """A fresh ledger over `docs`; a standing one takes its place where scans repeat."""
    ledger = Ledger(docs.sparkSession, fresh_dir(docs.sparkSession, "ledger"))
    ledger.scan(docs, "0", text)
    return ledger


def report(docs: DataFrame, key: str = "doc_id", text: str = "text", ledger: Ledger | None = None) -> DataFrame:
    """(key, n_assign, n_access, n_hex, base_sha256, spans) for every row, repeated and null keys included."""
    found = digests((ledger or _scanned(docs, text)).findings())
    paths = docs.select(F.col(key).alias("key"), blob_of(text).alias("blob"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    out = paths.join(found, "blob", "left").withColumn("spans", F.coalesce("spans", F.lit("")))
    return out.select(F.col("key").alias(key), *[zero(f"n_{r.kind}") for r in RULES], F.sha2(F.encode("spans", "UTF-8"), 256).alias("base_sha256"), "spans")


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]", ledger: Ledger | None = None) -> DataFrame:
    """`docs` with every secret's span replaced by `mark`; overlapping spans are one. Other rows and columns stay as they are."""
    spans = (ledger or _scanned(docs, text)).findings()
    before = "max(`end`) OVER (PARTITION BY blob ORDER BY start, `end` ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    runs = (spans.withColumn("new", F.expr(f"CAST(start > coalesce({before}, -1) AS INT)"))
            .withColumn("run", F.expr("sum(new) OVER (PARTITION BY blob ORDER BY start, `end` ROWS UNBOUNDED PRECEDING)"))
            .groupBy("blob", "run").agg(F.min("start").alias("s"), F.max("end").alias("e")))
    cuts = runs.groupBy("blob").agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("_cuts"))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), blob_of(text).alias("_blob"))
    got = rows.join(small(cuts.withColumnRenamed("blob", "_blob"), FEW), "_blob", "left")
    t = F.col("_row")[text]
    # What lies before each cut, and the rest.
    heads = F.transform(F.col("_cuts"), lambda c, i: F.substring(t, (
        F.when(i > 0, F.get(F.col("_cuts"), i - 1)["e"]).otherwise(0) + 1).cast("int"), (
        c["s"] - F.when(i > 0, F.get(F.col("_cuts"), i - 1)["e"]).otherwise(0)).cast("int")))
    rest = F.substring(t, (F.element_at("_cuts", -1)["e"] + 1).cast("int"), F.length(t))
    clean = F.when(F.col("_cuts").isNull(), t).otherwise(F.array_join(F.concat(heads, F.array(rest)), mark))
    return got.select(*[clean.alias(c) if c == text else F.col("_row")[c].alias(c) for c in docs.columns])


def _oracle() -> str:
    key = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
    patterns = {"assign": f"""({key})["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)""", "access": "()(AKIA[A-Z0-9]+)", "hex": "()([0-9a-f]+)"}
    least = {"assign": 6, "access": 20, "hex": 24}
    parts = [f"""
  SELECT r, {i} AS rank, '{k}' AS kind, list_sum(heads[1:i]) + coalesce(list_sum(lens[1:i - 1]), 0) AS s, lens[i] AS n FROM (
    SELECT r, heads, lens, vals, unnest(range(1, len(lens) + 1)) AS i FROM (
      SELECT r, list_transform(string_split_regex(text, '{p}'), lambda x: length(x)) AS heads,
        list_transform(regexp_extract_all(text, '{p}'), lambda x: length(x)) AS lens,
        list_transform(regexp_extract_all(text, '{p}', 2), lambda x: length(x)) AS vals FROM t)) WHERE vals[i] >= {least[k]}"""
             for i, (k, p) in enumerate(patterns.items())]
    return ("WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),\nm AS ("
            + "\n  UNION ALL".join(parts) + """),
f AS (SELECT r, count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS b, count(*) FILTER (kind = 'hex') AS c,
  string_agg(concat(kind, ':', CAST(s AS BIGINT), ':', CAST(s + n AS BIGINT)), ',' ORDER BY s, rank) AS spans FROM m GROUP BY r)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex,
  sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans FROM t LEFT JOIN f ON f.r = t.r""")


ORACLE = _oracle()
