"""Run formation: which run, chunk and place a record gets.

Physical runs are the spills of Spark's sorter; this is their logical form,
for records that arrive in a given order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runmill.operators.packing import next_fit
from runmill.operators.sort import Key
from runmill.plans.keys import orders, sort_keys


def runs_fixed(df: DataFrame, arrive: str, run_bytes: int, record_bytes: int, name: str = "run_id") -> DataFrame:
    """Records of one width: floor(run_bytes / record_bytes) of them form a run, one at least."""
    if record_bytes < 1:
        raise ValueError("record_bytes must be positive")
    return df.withColumn(name, F.expr(f"(`{arrive}` - 1) div {max(1, run_bytes // record_bytes)}"))


def runs_next_fit(df: DataFrame, arrive: str, size: Column, run_bytes: int, name: str = "run_id") -> DataFrame:
    """A record opens a run if it would take the current one over run_bytes; a larger record is a run of its own."""
    return next_fit(df, arrive, size, run_bytes, name)


def sort_within_runs(df: DataFrame, *keys: Key, run: str = "run_id", name: str = "pos") -> DataFrame:
    """Each record's place in its sorted run, from 1."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(run).orderBy(*orders(sort_keys(*keys)))).cast("long"))


def chunks_of_runs(df: DataFrame, arrive: str, parts: int, run: str = "run_id", name: str = "chunk") -> DataFrame:
    """Cut each run of n records, in order of arrival, into chunks of ceil(n / parts)."""
    if parts < 1:
        raise ValueError("parts must be positive")
    of_run = Window.partitionBy(run)
    at = F.row_number().over(of_run.orderBy(arrive)) - 1
    size = F.ceil(F.count(F.lit(1)).over(of_run) / parts)
    return df.withColumn(name, F.floor(at / size).cast("long"))
