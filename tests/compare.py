"""Run registered queries on Spark and their SQL twins on DuckDB and compare the answers."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time

import duckdb

from catalograph.plans.binding import TABLES


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(x):
    if isinstance(x, (bool, str)) or x is None:
        return x
    if isinstance(x, decimal.Decimal):
        return float(x)
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 9)
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, (list, tuple)):
        return [_plain(y) for y in x]
    if isinstance(x, (bytes, bytearray)):
        return bytes(x).hex()
    return x


def _sorted(cols, rows):
    at = [cols.index(c) for c in sorted(cols)]
    return sorted((repr([_plain(r[i]) for i in at]) for r in rows))


def compare(spark, con, sf_dir, fn, sql):
    """(ok, message, rows, seconds)."""
    t = time.time()
    df = fn(spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    took = time.time() - t
    if sql is None:
        return True, "rows only", len(rows), took
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(cols) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} != {sorted(cols)}", len(rows), took
    kinds = {d[0]: str(d[1]) for d in cur.description}
    for f in df.schema.fields:
        a, b = f.dataType.simpleString(), kinds[f.name].upper()
        if (a in ("bigint", "int") and b not in ("BIGINT", "INTEGER", "NUMBER")) or (a == "double" and b != "DOUBLE"):
            return False, f"type of {f.name}: {a} / {b}", len(rows), took
        if a in ("bigint", "int") and {"bigint": "BIGINT", "int": "INTEGER"}[a] != b and b != "NUMBER":
            return False, f"type of {f.name}: {a} / {b}", len(rows), took
    a, b = _sorted(df.columns, rows), _sorted(cols, want)
    if a != b:
        only_a, only_b = sorted(set(a) - set(b))[:2], sorted(set(b) - set(a))[:2]
        return False, f"{len(a)} rows / {len(b)} rows; spark only {only_a}; sql only {only_b}", len(rows), took
    return True, "match", len(rows), took


def main(argv):
    from catalograph import build_session
    from catalograph.plans.catalogue import ORACLES, QUERIES

    sf_dir, pick = argv[0], argv[1:]
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                                "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for k, fn in QUERIES.items():
        if pick and not any(k == p or (p.endswith("*") and k.startswith(p[:-1])) for p in pick):
            continue
        try:
            ok, msg, n, took = compare(spark, con, sf_dir, fn, ORACLES.get(k))
        except Exception as e:  # noqa: BLE001 - report and go on
            ok, msg, n, took = False, f"{type(e).__name__}: {str(e)[:700]}", -1, 0.0
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {k:28s} {n:7d} rows {took:6.2f}s {msg if not ok or msg != 'match' else ''}", flush=True)
    print("failed:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
