"""Greedy next-fit packing of an ordered sequence, in parallel.

A record starts a new bin if it doesn't fit into the current one.  Where a bin
starts decides all later starts, so the sequence is cut into chunks and each
chunk first tells what it would do: for every record that could start its first
bin of its own, the bins it opens and what is left in the last.  Those
summaries, one for each chunk and with one bin's worth of records at most, are
folded in order by one task; then every chunk knows its state at entry and packs
its own records.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runmill.plans.keys import fresh

#: Records of a chunk.
CHUNK = 1 << 20


def _starts(total: np.ndarray, capacity: int) -> np.ndarray:
    """For a bin that starts at each record: the record that starts the next one.

    total: bytes before each record, and all bytes at the end.
    """
    nxt = np.searchsorted(total, total[:-1] + capacity, "right") - 1
    return np.maximum(nxt, np.arange(1, len(total)))


def _pack(sizes: np.ndarray, carried: int | None, first_bin: int, capacity: int) -> tuple[np.ndarray, int, int | None]:
    """Bins of a chunk's records, entered with ``carried`` bytes (None: no bin open) in bin ``first_bin``."""
    total = np.concatenate(([0], np.cumsum(sizes)))
    nxt = _starts(total, capacity)
    n = len(sizes)
    bins = np.zeros(n, np.int64)
    if carried is None:
        at, number = 0, first_bin
    else:
        at = max(0, int(np.searchsorted(total, capacity - carried, "right")) - 1)
        number = first_bin + 1
        bins[:at] = first_bin
        if at >= n:
            return bins, first_bin, carried + int(total[-1])
    while at < n:
        to = int(nxt[at])
        bins[at:to] = number
        left = int(total[min(to, n)] - total[at])
        number, at = number + 1, to
    return bins, number - 1, left


def _summary(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes before each record that can be the first start, and bins and left bytes from there on."""
    total = np.concatenate(([0], np.cumsum(sizes)))
    n = len(sizes)
    nxt = _starts(total, capacity)
    # Jumps from start to start, doubled until all stand at their last one.
    jump = np.where(nxt < n, nxt, np.arange(n))
    jumps = (nxt < n).astype(np.int64)
    while jumps[jump].any():
        jumps, jump = jumps + jumps[jump], jump[jump]
    first = min(n, int(np.searchsorted(total, capacity, "right")))
    return total[: first + 1], jumps[:first] + 1, total[n] - total[jump[:first]]


def _lists(column: pa.ChunkedArray) -> list[np.ndarray]:
    """Rows of a list column as arrays, without Python numbers."""
    column = column.combine_chunks()
    values, at = column.flatten().to_numpy(), np.asarray(column.offsets)
    return [values[a:b] for a, b in zip(at[:-1] - at[0], at[1:] - at[0], strict=True)]


def next_fit(df: DataFrame, position: str, size: Column, capacity: int, name: str = "bin", chunk: int = CHUNK, oversize: str = "own") -> DataFrame:
    """``df`` with the bin (from 0) of each row, taken in the order of ``position`` (1, 2, ...).

    A record larger than the capacity gets a bin of its own (``oversize="own"``)
    or fails the job (``"raise"``).  There are no empty bins.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    p_size, p_chunk, p_carried, p_first = fresh(df, "size", "chunk", "carried", "first")
    sized = df.withColumn(p_size, size.cast("long")).withColumn(p_chunk, F.expr(f"(`{position}` - 1) div {chunk}"))
    if oversize == "raise":
        sized = sized.withColumn(p_size, F.when(F.col(p_size) > capacity, F.raise_error(F.lit(f"a record exceeds {capacity} bytes")).cast("long")).otherwise(F.col(p_size)))

    def summarise(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        before, opened, left = _summary(table["size"].to_numpy(), capacity)
        return pa.table({"chunk": table["chunk"][:1], "before": [before], "opened": [opened], "left": [left]})

    def fold(table: pa.Table) -> pa.Table:
        table = table.sort_by("chunk")
        carried, number, out = -1, 0, []
        for before, opened, left in zip(*(_lists(table[c]) for c in ("before", "opened", "left")), strict=True):
            out.append((carried, number))
            if carried < 0:
                number, carried = int(opened[0]) - 1, int(left[0])
                continue
            at = max(0, int(np.searchsorted(before, capacity - carried, "right")) - 1)
            if at >= len(opened):
                carried += int(before[-1])
            else:
                number, carried = number + int(opened[at]), int(left[at])
        return pa.table({p_chunk: table["chunk"], p_carried: pa.array([x[0] for x in out], pa.int64()), p_first: pa.array([x[1] for x in out], pa.int64())})

    def assign(table: pa.Table) -> pa.Table:
        table = table.sort_by(position)
        carried = table[p_carried][0].as_py()
        bins, *_ = _pack(table[p_size].to_numpy(), None if carried < 0 else carried, table[p_first][0].as_py(), capacity)
        return table.select(kept).append_column(name, pa.array(bins))

    kept = [c for c in df.columns if c != name]
    narrow = sized.select(F.col(f"`{position}`").alias("pos"), F.col(p_size).alias("size"), F.col(p_chunk).alias("chunk"))
    chunks = narrow.groupBy("chunk").applyInArrow(summarise, "chunk long, before array<long>, opened array<long>, left array<long>")
    # One row for each chunk, with a bin's worth of numbers.
    entry = chunks.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(lambda t: fold(t.drop_columns(["all"])), f"`{p_chunk}` long, `{p_carried}` long, `{p_first}` long")
    schema = T.StructType([*[f for f in df.schema.fields if f.name != name], T.StructField(name, T.LongType())])
    return sized.join(entry, p_chunk).groupBy(p_chunk).applyInArrow(assign, schema)
