"""Cutting lineage in the folder that all executors share, sizes of plans, and functions over whole rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runmill.plans.durable import shared_folder
from runmill.plans.durable import written as durable
from runmill.plans.keys import size_in_bytes

__all__ = ["durable", "hash_sample", "map_texts", "parts", "shared_folder", "size_in_bytes"]


def hash_sample(df: DataFrame, by: Column, rows: int, *more: str) -> DataFrame:
    """At most so many rows, by the order of a hash and ``more``.

    Of a larger table only about twice as many are sorted, those whose hash is a
    multiple of a number, so no task gets the first rows of every partition.
    """
    step = max(1, df.count() // (2 * rows))
    return df.where(F.pmod(by, F.lit(step)) == 0).orderBy(by, *more).limit(rows)


#: Rows whose texts a worker unpacks to Python objects at a time.
PART_ROWS = 256


def parts(batches: Iterator[pa.RecordBatch], rows: int = PART_ROWS) -> Iterator[pa.RecordBatch]:
    """Slices of so many rows, to bound what a worker unpacks at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def map_texts(docs: DataFrame, change: Callable[[Iterator[tuple[pa.RecordBatch, int]]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """``docs``, batches of whole rows changed by a function that gets them with the place of ``text``; columns may have any names."""
    at, names = docs.columns.index("text"), docs.columns
    # Arrow functions don't take names with dots.
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    return plain.mapInArrow(lambda batches: change((b, at) for b in parts(batches)), plain.schema).toDF(*names)
