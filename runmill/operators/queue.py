"""Bounded FIFO queues as data: which operations of a trace are accepted, and what comes out.

A queue never blocks: an enqueue into a full queue is refused as ``full``, a
dequeue from an empty one as ``empty``.  Further columns may have any names, but for
the added ones, which are replaced.
"""

from __future__ import annotations

from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runmill.operators.sort import Key, with_position
from runmill.plans.keys import fresh, orders, sort_keys


def fill(df: DataFrame, capacity: int, *arrival: Key, queue: str | None = None) -> DataFrame:
    """Enqueues only: the first ``capacity`` rows (of each queue) are ``ok``, the others ``full``; ``slot`` is an accepted row's place."""
    if capacity < 1:
        raise ValueError("capacity must be positive")
    (at,) = fresh(df, "at")
    if queue is None:
        ranked = with_position(df, *arrival, name=at)
    else:
        ranked = df.withColumn(at, F.row_number().over(Window.partitionBy(queue).orderBy(*orders(sort_keys(*arrival)))).cast("long"))
    ok = F.col(at) <= capacity
    return ranked.select(*[F.col(f"`{c}`") for c in df.columns if c not in ("status", "slot")], F.when(ok, "ok").otherwise("full").alias("status"), F.when(ok, F.col(at) - 1).alias("slot"))


def replay(trace: DataFrame, capacity: int) -> DataFrame:
    """(queue, step, op, value) with status, result and the size after each step.

    op is ``enqueue`` or ``dequeue``.  Steps of one queue depend on each other and
    are replayed in order; queues are independent.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("step")
        held: deque = deque()
        status, result, size = [], [], []
        for op, value in zip(table["op"].to_pylist(), table["value"].to_pylist(), strict=True):
            out = None
            if op == "enqueue":
                status.append("full" if len(held) == capacity else "ok")
                if status[-1] == "ok":
                    held.append(value)
            elif op == "dequeue":
                status.append("ok" if held else "empty")
                out = held.popleft() if held else None
            else:
                raise ValueError(f"unknown operation {op}")
            result.append(out)
            size.append(len(held))
        return table.append_column("status", pa.array(status, pa.string())).append_column("result", pa.array(result, table["value"].type)).append_column("size", pa.array(size, pa.int64()))

    rows = trace.select("queue", "step", "op", "value")
    more = [T.StructField("status", T.StringType()), T.StructField("result", rows.schema["value"].dataType), T.StructField("size", T.LongType())]
    schema = T.StructType([*rows.schema.fields, *more])
    return rows.groupBy("queue").applyInArrow(run, schema)
