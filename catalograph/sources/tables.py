"""Call log, migration ledger and vocabulary files."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, functions as F

from catalograph import names as N

CALL_COLUMNS = [c.strip().split()[0] for c in N.CALL_SCHEMA.split(",")]


def write_calls(calls: DataFrame, path: str) -> None:
    """JSON lines in a folder per local day, the first ten characters of `time`."""
    rows = calls.select(*[c for c in CALL_COLUMNS if c in calls.columns]).withColumn("day", F.substring("time", 1, 10))
    rows.write.mode("append").partitionBy("day").json(path)


def read_calls(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(N.CALL_SCHEMA + ", day string").json(path)


def retain(calls: DataFrame, today: date, keep_days: int) -> DataFrame:
    """Rows not older than the retention; a day that is no date is kept. `day` is the partition column, so whole folders
    drop out of the scan."""
    if keep_days < 1:
        raise ValueError("keep_days must be at least 1")
    age = F.datediff(F.lit(today), F.col("day").try_cast("date"))
    return calls.filter(F.coalesce(age <= keep_days, F.lit(True)))


LEDGER_SCHEMA = ", ".join(f"`{c}` string" for c in N.LEDGER_COLUMNS)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Ledger rows with their place in the log: file time first, then position within the file."""
    rows = spark.read.schema(LEDGER_SCHEMA).option("header", "true").option("multiLine", "true").option("escape", '"').csv(path)
    return rows.withColumn("seq", F.struct(F.col("when"), F.col("_metadata.file_modification_time").alias("file_time"), F.monotonically_increasing_id().alias("row")))


def append_ledger(rows: DataFrame, path: str) -> None:
    have = set(rows.columns)
    cols = [F.col(c) if c in have else F.lit("").alias(c) for c in N.LEDGER_COLUMNS]
    rows.select(*cols).write.mode("append").option("header", "true").option("escape", '"').csv(path)


def load_ontology(spark: SparkSession, path: str, prefix: str = "cat") -> DataFrame:
    """Declared datatype properties of a Turtle file: `(local, domain, range, lo, hi, settable)`.

    The text is read in blocks that each start a definition, so a large vocabulary still reads in parallel.
    """
    blocks = spark.read.option("lineSep", f"\n{prefix}:").text(path).select(
        F.regexp_extract("value", "^(\\S+) a (\\S+)", 1).alias("local"), F.regexp_extract("value", "^(\\S+) a (\\S+)", 2).alias("type"),
        F.split("value", " \\.\\n", 2)[0].alias("block"))
    tail = lambda c: F.regexp_replace(F.regexp_replace(c, f"^{prefix}:", ""), "^xsd:", "")
    props = blocks.filter("type = 'owl:DatatypeProperty'").select(
        "local", tail(F.regexp_extract("block", "rdfs:domain ([^\\s;]+)", 1)).alias("domain"),
        F.coalesce(F.nullif(tail(F.regexp_extract("block", "rdfs:range ([^\\s;]+)", 1)), F.lit("")), F.lit("string")).alias("range"))
    bounds = blocks.filter("type = 'rdfs:Datatype'").select(
        F.col("local").alias("range"), F.regexp_extract("block", "minInclusive (-?[0-9]+)", 1).try_cast("bigint").alias("lo"),
        F.regexp_extract("block", "maxInclusive (-?[0-9]+)", 1).try_cast("bigint").alias("hi"))
    return props.join(bounds, "range", "left").select(
        "local", "domain", "range", "lo", "hi", (F.col("domain").isin("Media", "Image") | (F.col("local") == "description")).alias("settable"))


def settable_of(ontology: DataFrame) -> dict[str, str]:
    """The settable names of a loaded vocabulary with their ranges, as `set_fields` takes them (a few dozen rows)."""
    return {r.local: r.range for r in ontology.filter("settable").select("local", "range").collect()}
