"""Where queries register: a key, a Spark callable over a binding, and its SQL twin (or none)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from catalograph.plans.binding import Binding, open_binding, oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    def deco(fn: Callable[[Binding], DataFrame]):
        if key in QUERIES:
            raise ValueError(f"query {key} is registered twice")
        QUERIES[key] = lambda spark, sf_dir: fn(open_binding(spark, sf_dir))
        if sql is not None:
            ORACLES[key] = oracle(sql)
        return fn
    return deco
