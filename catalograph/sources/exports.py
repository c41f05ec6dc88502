"""Bulk vector export: NDJSON lines or packed binary records."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from catalograph.functions.text import bracket_iri


def ndjson_line(vectors: DataFrame) -> DataFrame:
    """`{"id", "vector"}` per row; the id is the bracketed IRI, or the bare key where none is known."""
    name = bracket_iri(F.col("iri")) if "iri" in vectors.columns else F.lit(None).cast("string")
    return vectors.select(F.to_json(F.struct(F.coalesce(name, F.col("key_id").cast("string")).alias("id"), F.col("vec").alias("vector"))).alias("value"))


def packed(key: Column, vec: Column, form: str = "f32") -> Column:
    """One record: id length byte, id, then the floats little-endian as f32 or f16."""
    dtype = {"f32": "<f4", "f16": "<f2"}[form]

    @F.arrow_udf("binary")
    def pack(keys: pa.Array, vecs: pa.Array) -> pa.Array:
        flat, at = np.asarray(vecs.flatten(), dtype="f4").astype(dtype), np.asarray(vecs.offsets) - vecs.offsets[0].as_py()
        names = [k.encode() for k in keys.to_pylist()]
        return pa.array([bytes([len(k)]) + k + flat[a:b].tobytes() for k, a, b in zip(names, at[:-1], at[1:])], pa.binary())

    return pack(key.cast("string"), vec)


def export_vectors(vectors: DataFrame, path: str, form: str = "ndjson", order: str = "key_id") -> None:
    """Write an index in key order. Files hold consecutive ranges, so reading them by name keeps the order."""
    rows = vectors.orderBy(order)
    if form == "ndjson":
        ndjson_line(rows).write.mode("errorifexists").text(path)
    elif form in ("f32", "f16"):
        rows.select(packed(F.col("key_id"), F.col("vec"), form).alias("record")).write.mode("errorifexists").parquet(path)
    else:
        raise ValueError(f"format must be ndjson, f32 or f16, not {form}")
