"""N-Quads text to quads and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from catalograph import names as N

# The literal part is possessive: such a loop runs in constant stack, however long the text.
_NODE = "<([^<>\"{}|^`\\s]*)>|(_:[^\\s<>\"]+)"
LINE = (f"^\\s*(?:{_NODE})\\s+<([^<>\\s]*)>\\s+(?:{_NODE}|\"((?:[^\"\\\\]++|\\\\.)*+)\"(?:\\^\\^<([^<>\\s]*)>|@([A-Za-z0-9-]+))?)"
        f"\\s*(?:<([^<>\\s]*)>)?\\s*\\.\\s*(?:#.*)?$")


def _plain_controls(c: Column) -> Column:
    """Control characters as `\\u` escapes: neither a line nor JSON may hold them raw."""
    out = c
    for n in (*range(0x20), 0x7F):
        out = F.replace(out, F.lit(chr(n)), F.lit(f"\\u{n:04X}"))
    return F.when(c.rlike(r"[\x00-\x1F\x7F]"), out).otherwise(c)


def _unescape(c: Column) -> Column:
    """String escapes undone. JSON knows all of them but two, which are put in place first, as are raw control characters."""
    wide = F.aggregate(F.regexp_extract_all(c, F.lit("\\\\U([0-9A-Fa-f]{8})"), 1), c,
                       lambda acc, h: F.replace(acc, F.concat(F.lit("\\U"), h), F.decode(F.unhex(h), "UTF-32")))
    plain = _plain_controls(F.replace(wide, F.lit("\\'"), F.lit("'")))
    text = F.get(F.from_json(F.concat(F.lit('["'), plain, F.lit('"]')), "array<string>"), 0)
    return F.when(~c.contains("\\"), c).otherwise(F.coalesce(text, F.raise_error(F.concat(F.lit("bad escape in N-Quads literal: "), c))))


def parse_lines(lines: DataFrame, col: str = "value", store: Column | None = None) -> DataFrame:
    """Quads of text lines; blank and comment lines pass, a malformed line fails the read. Other columns stay."""
    # One regex pass a line: the groups come out as one delimited text, the literal last so that it may hold anything.
    groups = F.split(F.regexp_replace(col, LINE, "$1$2\u0001$3\u0001$4\u0001$5\u0001$7\u0001$8\u0001$9\u0001$6"), "\u0001", 8)
    df = lines.filter(~F.col(col).rlike("^\\s*(#.*)?$")).withColumn("__t", groups)
    df = df.withColumn("__t", F.when(F.size("__t") == 8, F.col("__t")).otherwise(
        F.raise_error(F.concat(F.lit("malformed N-Quads line: "), F.col(col))).cast("array<string>")))
    part = lambda i: F.col("__t")[i]
    kind = F.when(part(2) != "", "iri").when(part(3) != "", "bnode").otherwise("literal")
    o = F.when(kind == "literal", _unescape(part(7))).otherwise(F.concat(part(2), part(3)))
    keep = [c for c in lines.columns if c not in (col, "store")]
    st = store if store is not None else (F.col("store") if "store" in lines.columns else F.lit(None).cast("string"))
    dt = F.when(part(5) != "", F.concat(F.lit(N.RDF + "langString@"), part(5))).otherwise(F.nullif(part(4), F.lit("")))
    return df.select(st.alias("store"), part(0).alias("s"), part(1).alias("p"), o.alias("o"), kind.alias("o_kind"), dt.alias("dt"),
                     F.nullif(part(6), F.lit("")).alias("g"), *keep)


def read_nquads(spark: SparkSession, paths: str | list[str], store: str | None = None) -> DataFrame:
    """Record files as quads, with the `file` each came from."""
    lines = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("file"))
    return parse_lines(lines, store=F.lit(store).cast("string"))


def _term(value: Column, kind: Column, dt: Column) -> Column:
    esc = value
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r")):
        esc = F.replace(esc, F.lit(a), F.lit(b))
    esc = _plain_controls(esc)
    lang = F.when(dt.startswith(N.RDF + "langString@"), F.concat(F.lit("@"), F.substring_index(dt, "@", -1)))
    typed = F.coalesce(lang, F.concat(F.lit("^^<"), dt, F.lit(">")), F.lit(""))
    return F.when(kind == "literal", F.concat(F.lit('"'), esc, F.lit('"'), typed)).when(kind == "bnode", value).otherwise(
        F.concat(F.lit("<"), value, F.lit(">")))


def _subject(c: Column) -> Column:
    return F.when(c.startswith("_:"), c).otherwise(F.concat(F.lit("<"), c, F.lit(">")))


def nquads_line(graph: bool = True) -> Column:
    g = F.concat(F.lit(" <"), F.coalesce("g", F.lit(N.GRAPH)), F.lit(">")) if graph else F.lit("")
    return F.concat(_subject(F.col("s")), F.lit(" <"), F.col("p"), F.lit("> "), _term(F.col("o"), F.col("o_kind"), F.col("dt")), g, F.lit(" ."))

PLACES = 64  # places that a folder's lines are spread over before they are written


def write_nquads(quads: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """One statement a line, every line naming the graph; folders by the given columns (stage, date). A task sorts what it writes by folder, so lines are
    dealt to tasks of bounded size first, a large folder's to several."""
    lines = quads.select(*partition_by, nquads_line().alias("value"))
    if partition_by:
        lines = lines.withColumn("__place", F.pmod(F.xxhash64("value"), F.lit(PLACES))).hint("rebalance", *partition_by, "__place").drop("__place")
    w = lines.write.mode("errorifexists")
    (w.partitionBy(*partition_by) if partition_by else w).text(path)


def write_ntriples(triples: DataFrame, path: str) -> None:
    """The graphless form, for the answers of CONSTRUCT and DESCRIBE."""
    df = triples if "dt" in triples.columns else triples.withColumn("dt", F.lit(None).cast("string"))
    df.select(nquads_line(graph=False).alias("value")).write.mode("errorifexists").text(path)
