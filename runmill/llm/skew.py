"""Keys of rows, and joins whose keys may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY_DDL = "struct<a: long, b: long>"

#: A key is hot if it has 1 / HOT_PARTS of the rows or more, so there are no more than HOT_PARTS hot keys.
HOT_PARTS = 256
#: Rows that a key needs to be hot, at least.
HOT_ROWS = 1000


def join_unique(rows: DataFrame, facts: DataFrame, keys: list[str], weight: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``facts``, which has one row for each key and in ``weight`` how many of the rows have it.

    ``facts`` is read several times and should be written.  Facts of hot keys, at
    most HOT_PARTS rows, are broadcast, so the rows of a hot key stay where they
    are; all others are joined by a shuffle in which no key has more than a
    HOT_PARTS-th of the rows.  No row is dropped or capped.
    """
    total = facts.agg(F.sum(weight)).first()[0] or 0
    limit = max(HOT_ROWS, total // HOT_PARTS + 1)
    hot = facts.where(F.col(weight) >= limit)
    if hot.isEmpty():
        return rows.join(facts, keys, how)
    told = [c for c in facts.columns if c not in keys]
    marked = rows.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), keys, "left")
    far = marked.where("_hot IS NULL").drop("_hot", *told).join(facts.where(F.col(weight) < limit), keys, how)
    return marked.where("_hot").drop("_hot").unionByName(far)


def row_key(*columns: Column | str) -> Column:
    """Two hashes of the columns: at 1e11 rows any two different ones share a single 64-bit hash with near certainty, both with a probability of about 1e-17."""
    return F.struct(F.xxhash64(*columns).alias("a"), F.xxhash64(F.lit("second"), *columns).alias("b"))
