"""An append-only log with sequence numbers; also a sink of streaming queries.

Entries are a Parquet table of (lsn bigint, entry binary).  ``append`` gives
entries the numbers after the last one in a given order; ``sink`` does so for
each micro-batch of a streaming query, once: a batch that is run again
overwrites its own part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from runmill.operators.sort import Key, with_position
from runmill.plans.durable import written
from runmill.plans.keys import fresh

SCHEMA = "lsn long, entry binary"


def numbered(entries: DataFrame, *order: Key, after: int = -1) -> DataFrame:
    """Entries with ``lsn`` from after + 1, in the given order."""
    ranked = with_position(entries, *order, name="lsn")
    return ranked.withColumn("lsn", F.col("lsn") + F.lit(after).cast("long"))


class Log:
    """A log in a folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._pending: list[DataFrame] = []
        self._last: int | None = None

    def _stored(self) -> DataFrame:
        try:
            return self.spark.read.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(self.path)
        except AnalysisException:
            return self.spark.createDataFrame([], SCHEMA)

    def last(self) -> int:
        """The greatest number given so far, -1 at first."""
        if self._last is None:
            found = self._stored().agg(F.max("lsn")).first()[0]
            self._last = -1 if found is None else found
        return self._last

    def append(self, entries: DataFrame, entry: Column, *order: Key) -> int:
        """Number entries and hold them until a flush; returns the last number."""
        # Written here, so that a flush finds the numbers that were counted.
        (name,) = fresh(entries, "entry")
        rows = written(numbered(entries.withColumn(name, entry.cast("binary")), *order, after=self.last()).select("lsn", F.col(name).alias("entry")))
        self._last = self.last() + rows.count()
        self._pending.append(rows)
        return self._last

    def flush(self, upto: int | None = None) -> None:
        """Write held entries up to a number (default: all).

        What is written goes from the held ones afterwards; a flush that failed can be
        run again, since the entries of an append are written to a folder of their own.
        """
        left = []
        for rows in self._pending:
            now = rows if upto is None else rows.where(F.col("lsn") <= upto)
            first = now.agg(F.min("lsn")).first()[0]
            if first is not None:
                now.write.mode("overwrite").parquet(f"{self.path}/from={first}")
            if upto is not None and not (later := rows.where(F.col("lsn") > upto)).isEmpty():
                left.append(later)
        self._pending = left

    def scan(self, upto: int | None = None) -> DataFrame:
        """Flushed entries up to a number, in order."""
        rows = self._stored()
        return (rows if upto is None else rows.where(F.col("lsn") <= upto)).orderBy("lsn")

    def sink(self, entry: Column, *order: Key):
        """A foreachBatch function that appends every micro-batch."""

        def write(batch: DataFrame, batch_id: int) -> None:
            folder = f"{self.path}/batch={batch_id}"
            others = self._stored().where(~F.input_file_name().contains(f"batch={batch_id}/"))
            last = others.agg(F.max("lsn")).first()[0]
            numbered(batch, *order, after=-1 if last is None else last).select("lsn", entry.cast("binary").alias("entry")).write.mode("overwrite").parquet(folder)
            self._last = None

        return write
