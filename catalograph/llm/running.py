"""Running sums within groups of any size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F, types as T

from catalograph.llm.tables import written


def running(rows: DataFrame, group: list[str], order: list[Column | str], sums: dict[str, Column]) -> DataFrame:
    """Add, for each name of `sums`, the sum of its column over the earlier rows of the same group; longs wrap around.

    Rows are range-partitioned by group and order, so a group may span many tasks; each task sums what it has. What a group had in
    earlier tasks is worked out from one row a task. `group` columns are longs without nulls; rows with equal order should be folded before.
    """
    names, own = list(sums), rows.columns
    values = rows.select("*", *[c.cast("bigint").alias(f"_v{i}") for i, c in enumerate(sums.values())])
    ranged = values.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order)
    at = [own.index(g) for g in group]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, last, carry, row = TaskContext.get().partitionId(), None, np.zeros(len(names), "i8"), 0
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            keys = np.stack([b.column(i).to_numpy() for i in at])
            new = np.concatenate([[last is None or (keys[:, 0] != last).any()], (keys[:, 1:] != keys[:, :-1]).any(axis=0)])
            first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
            out = []
            for i in range(len(names)):
                v = b.column(len(own) + i).to_numpy()
                before = np.cumsum(v) - v
                out.append(before - before[first] + np.where(np.cumsum(new) == 0, carry[i], 0))
            carry = np.array([o[-1] + b.column(len(own) + i).to_numpy()[-1] for i, o in enumerate(out)], "i8")
            last = keys[:, -1].copy()
            yield pa.RecordBatch.from_arrays([*b.columns, *map(pa.array, out), pa.array(np.full(n, pid, "i8")), pa.array(np.arange(row, row + n))],
                                             names=[*b.schema.names, *names, "_pid", "_row"])
            row += n

    schema = T.StructType([*values.schema.fields, *[T.StructField(x, T.LongType()) for x in [*names, "_pid", "_row"]]])
    local = written(ranged.mapInArrow(run, schema), "running")
    ends = F.struct(*[F.col(g) for g in group], *[F.struct(F.col(x).alias("a"), F.col(f"_v{i}").alias("b")).alias(x) for i, x in enumerate(names)])
    parts = local.groupBy("_pid").agg(F.min_by(F.struct(*group), "_row").alias("first"), F.max_by(ends, "_row").alias("last")).orderBy("_pid").collect()
    offsets, held, before = [], None, np.zeros(len(names), "i8")  # one row a task
    for p in parts:
        first, last = tuple(p.first), tuple(p.last[g] for g in group)
        carried = before if held == first else np.zeros(len(names), "i8")
        if carried.any():
            offsets.append((p["_pid"], *first, *carried.tolist()))
        inside = np.array([[p.last[x].a, p.last[x].b] for x in names], "i8").sum(axis=1)
        before, held = inside + (carried if first == last else 0), last
    if not offsets:
        return local.select(*own, *names)
    kinds = T.StructType([T.StructField(x, T.LongType()) for x in ["_pid", *[f"_g{i}" for i in range(len(group))], *[f"_o{i}" for i in range(len(names))]]])
    more = F.broadcast(rows.sparkSession.createDataFrame(offsets, kinds).withColumnRenamed("_pid", "_p"))  # one row a task at most
    on = [local["_pid"] == more["_p"], *[local[g] == more[f"_g{i}"] for i, g in enumerate(group)]]
    both = local.join(more, on, "left")
    return both.select(*own, *[F.when(F.col(f"_o{i}").isNull(), F.col(x)).otherwise(around(F.col(x), F.col(f"_o{i}"))).alias(x)
                               for i, x in enumerate(names)])


def around(a: Column, b: Column) -> Column:
    """a + b of two longs, wrapped around."""
    whole = a.cast("decimal(38,0)") + b.cast("decimal(38,0)")
    turn = F.lit(str(1 << 64)).cast("decimal(38,0)")
    return F.when(whole > F.lit((1 << 63) - 1), whole - turn).when(whole < F.lit(-(1 << 63)), whole + turn).otherwise(whole).cast("bigint")
