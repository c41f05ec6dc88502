"""Document rules and host verdicts, in DataFrame functions only.

Every document is measured and fails or passes the rules by itself. Failures are then counted by host, each host's rate is shrunk by a
beta prior fitted to all hosts, and a host whose rate is above `HOST_RATE` beyond doubt takes its other documents with it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from catalograph.llm.tables import let, text_or_empty, written

SPACE = r"[\x20\x09-\x0D]"
SYMBOLS = "[#*$%&|<>]"
MIN_WORDS = 50
REPEAT_SHARE = 50  # percent of words inside repeated 3-word windows
HOST_RATE = 0.5
HOST_SURE = 2.0  # posterior standard deviations the rate must lie above HOST_RATE
MAX_STRENGTH = 1e6  # of the prior, where hosts do not differ at all

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _repeat_words(words: Column) -> Column:
    """How many words lie in a 3-word window found twice or more; linear but for one sort of longs.

    Codes hold the upper bits of a window's hash and its place. Neighbours in sorted order with the same hash bits are candidates, and
    those are compared as text, so hash collisions do not count.
    """
    def windows(w: Column) -> Column:
        places = F.when(F.size(w) < 1 << 20, (1 << 20) - 1).otherwise((1 << 31) - 1).cast("bigint")

        def count(low: Column) -> Column:
            codes = F.transform(F.sequence(F.lit(1), F.size(w) - 2), lambda i: F.bitwise_not(low).bitwiseAND(
                F.xxhash64(F.element_at(w, i), F.element_at(w, i + 1), F.element_at(w, i + 2))).bitwiseOR(i))

            def candidates(c: Column) -> Column:
                top = lambda x: F.coalesce(x.bitwiseAND(F.bitwise_not(low)), F.lit(0))
                return F.filter(c, lambda x, i: (
                    ((i > 0) & (top(F.get(c, i - 1)) == top(x))) | ((i < F.size(c) - 1) & (top(F.get(c, i + 1)) == top(x)))))

            text = lambda i: F.array(*[F.element_at(w, i + k) for k in range(3)])
            found = F.transform(let(F.sort_array(codes), candidates), lambda x: x.bitwiseAND(low).cast("int"))
            named = F.sort_array(F.transform(found, lambda i: F.struct(text(i).alias("t"), i.alias("i"))))
            same = lambda s, x, j: F.coalesce(F.get(s, j)["t"] == x["t"], F.lit(False))
            twice = let(named, lambda s: F.filter(s, lambda x, j: (
                ((j > 0) & same(s, x, j - 1)) | ((j < F.size(s) - 1) & same(s, x, j + 1)))))
            return F.size(F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

        return let(places, count)

    return F.when(F.size(words) < 4, 0).otherwise(let(words, windows))


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the five counts and `base_failed`. A null text has no words and fails. Nothing is shuffled."""
    t = text_or_empty(text)
    bare = t
    for c in (" ", "\t", "\n", "\x0b", "\x0c", "\r"):
        bare = F.replace(bare, F.lit(c), F.lit(""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = docs.withColumn("_words", F.array_remove(F.split(t, f"{SPACE}+", -1), "")).withColumn("_lines", lines)
    out = out.withColumns({
        "n_words": F.size("_words").cast("bigint"),
        "word_chars": F.length(bare).cast("bigint"),
        "n_symbols": F.regexp_count(t, F.lit(SYMBOLS)).cast("bigint"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint"),
        "n_repeat_words": _repeat_words(F.col("_words")).cast("bigint"),
    }).drop("_words", "_lines")
    return out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_SHARE * F.col("n_words")))


def rejected_hosts(measured: DataFrame, host: str = "source") -> DataFrame:
    """(host, rate) of hosts to reject; null is a host like any other.

    The prior's mean is the rate of all documents and its strength follows from how much hosts differ (method of moments). `measured` is
    read once; the sums of the prior are one row.
    """
    hosts = written(measured.groupBy(F.col(host).alias("host")).agg(
        F.count("*").alias("n"), F.sum(F.col("base_failed").cast("bigint")).alias("k")), "hosts")
    s = hosts.agg(F.sum("n").alias("n"), F.sum("k").alias("k"), F.sum(F.col("k") * F.col("k") / F.col("n")).alias("kk")).first()
    n, mean = s.n or 0, (s.k or 0) / max(1, s.n or 0)
    var = (s.kk or 0.0) / max(1, n) - mean * mean
    strength = min(MAX_STRENGTH, max(1.0, mean * (1 - mean) / var - 1)) if var > 1e-12 else MAX_STRENGTH
    rate = (F.col("k") + mean * strength) / (F.col("n") + strength)
    sd = F.sqrt(rate * (1 - rate) / (F.col("n") + strength + 1))
    return hosts.withColumn("rate", rate).filter(F.col("rate") - HOST_SURE * sd > HOST_RATE).select("host", "rate")


def verdicts(docs: DataFrame, columns: list[str], host: str = "source", text: str = "text") -> DataFrame:
    """`columns`, the five counts, `base_failed` and `kept` for every row.

    Only narrow rows are written and joined; the planner broadcasts the rejected hosts if their measured size allows it.
    """
    wanted = [F.col(c).alias(f"c{i}") for i, c in enumerate(columns)]
    narrow = written(measure(docs.select(*wanted, F.col(host).alias("_host"), F.col(text).alias("_text")), "_text").drop("_text"), "measured")
    bad = rejected_hosts(narrow, "_host").select(F.col("host").alias("_bad"), F.lit(True).alias("_out"))
    out = narrow.join(bad, F.col("_host").eqNullSafe(F.col("_bad")), "left")
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)], *COUNTS, "base_failed",
                      (~F.col("base_failed") & F.col("_out").isNull()).alias("kept"))


def keep(docs: DataFrame, host: str = "source", text: str = "text") -> DataFrame:
    """The rows of `docs` that pass, with their columns. Texts are measured twice rather than shuffled or written in between."""
    names = docs.columns
    measured = measure(docs.select(F.struct(*[docs[c] for c in names]).alias("_row"), F.col(host).alias("_host"), F.col(text).alias("_text")), "_text")
    bad = rejected_hosts(measured, "_host").select(F.col("host").alias("_bad"))
    return (measured.filter(~F.col("base_failed")).join(bad, F.col("_host").eqNullSafe(F.col("_bad")), "left_anti")
            .select(*[F.col("_row")[c].alias(c) for c in names]))


ORACLE = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM t),
g AS (SELECT r, i, [ws[i], ws[i + 1], ws[i + 2]] AS win FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
dup AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS c FROM g) WHERE c > 1),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM dup) GROUP BY r),
m AS (SELECT t.r, t.doc_id, t.source, CAST(len(ws) AS BIGINT) AS n_words,
  CAST(length(regexp_replace(t.text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(t.text) - length(regexp_replace(t.text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM t JOIN w ON w.r = t.r LEFT JOIN rep ON rep.r = t.r),
f AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM m),
h AS (SELECT source, count(*) AS n, sum(base_failed::INT) AS k FROM f GROUP BY source),
s AS (SELECT sum(k) / sum(n) AS mean, sum(k * k / n) / sum(n) - (sum(k) / sum(n)) * (sum(k) / sum(n)) AS var FROM h),
p AS (SELECT mean, CASE WHEN var > 1e-12 THEN least(1e6, greatest(1.0, mean * (1 - mean) / var - 1)) ELSE 1e6 END AS strength FROM s),
q AS (SELECT source, n, strength, (k + mean * strength) / (n + strength) AS rate FROM h, p),
bad AS (SELECT source FROM q WHERE rate - 2.0 * sqrt(rate * (1 - rate) / (n + strength + 1)) > 0.5)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT EXISTS (SELECT 1 FROM bad WHERE bad.source IS NOT DISTINCT FROM f.source) AS kept FROM f"""
