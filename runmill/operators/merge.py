"""Merging sorted sequences, and the rounds of a k-way merge."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runmill.operators.sort import Key, with_position


def merge_sorted(sequences: Sequence[DataFrame], *keys: Key, source: str = "source") -> DataFrame:
    """All rows of the sequences in one order, with ``pos`` and the number of their sequence.

    Spark keeps no order across partitions of a union, so this is one range
    exchange over the union; empty and single sequences need no special case.
    """
    if not sequences:
        raise ValueError("no sequences to merge")
    tagged = [df.withColumn(source, F.lit(i)) for i, df in enumerate(sequences)]
    return with_position(reduce(DataFrame.unionByName, tagged), *keys)


def merge_rounds(n_runs: int, k: int) -> list[int]:
    """Files before each merge round; the last count is at most k and is merged lazily."""
    if k < 2:
        raise ValueError("a merge needs k of at least 2")
    if n_runs < 0:
        raise ValueError("n_runs must not be negative")
    counts = [n_runs]
    while counts[-1] > k:
        counts.append(-(-counts[-1] // k))
    return counts


def merge_plan(spark: SparkSession, n_runs: int, k: int) -> DataFrame:
    """(round, file, batch) of every file that a materialised round reads: files are merged k by k until k are left."""
    plan = spark.range(0).select(F.lit(0).cast("long").alias("round"), F.col("id").alias("file"), F.col("id").alias("batch"))
    for i, n in enumerate(merge_rounds(n_runs, k)[:-1]):
        plan = plan.unionByName(spark.range(n).select(F.lit(i).cast("long").alias("round"), F.col("id").alias("file"), F.expr(f"id div {k}").alias("batch")))
    return plan
