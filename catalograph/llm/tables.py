"""Small helpers the operators share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from catalograph.session import fresh_dir

STEP = 256  # rows turned into Python objects at a time
SMALL_BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": "4m"}  # of long texts and packed records 10,000 rows are a whole task


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: lineage ends there, and the planner knows its size."""
    path = fresh_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def steps(batches: Iterable[pa.RecordBatch], rows: int = STEP) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


@contextmanager
def settings(spark: SparkSession, during: dict[str, str]) -> Iterator[None]:
    """`during` holds for the tables written inside, then what held before."""
    before = {name: spark.conf.get(name, None) for name in during}
    try:
        for name, value in during.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def text_or_empty(text: Column | str = "text") -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def let(value: Column, body) -> Column:
    """`body(value)` with `value` computed once: a lambda variable is not inlined into the loops inside `body`."""
    return F.element_at(F.transform(F.array(value), body), 1)


def least_rows(docs: DataFrame, linked, key: str, text: str) -> DataFrame:
    """The row of the least key of each component that `linked` finds among `rows(id, t)`, an id for each distinct text."""
    t = F.encode(text_or_empty(text), "UTF-8")
    sha = F.unhex(F.sha2(t, 256))
    name = F.unhex(F.sha2(F.concat(F.encode(F.to_json(F.struct(F.col(key).alias("k"))), "UTF-8"), t), 256))  # of key and text
    marked = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), F.substring(sha, 1, 16).alias("id"),
                         name.alias("name"), F.struct(F.col(key).isNull().alias("null"), F.col(key).alias("key"), sha.alias("sha"), name.alias("name")).alias("rank"),
                         text_or_empty(text).alias("t"))
    roots = linked(marked.select("id", "t"))
    least = marked.groupBy("id").agg(F.min("rank").alias("x"))  # one row a text, so a text of many rows is joined once
    best = least.join(roots, F.col("id") == F.col("node"), "left").groupBy(F.coalesce(F.col("root").cast("string"), F.hex("id")).alias("root")).agg(F.min("x").alias("x"))
    best = written(best.select(F.col("x.name").alias("name")), "near_best")
    return marked.select("row", "name").join(best, "name", "left_semi").dropDuplicates(["name"]).select("row.*")
