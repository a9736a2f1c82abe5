"""The sort operator: total order, ranks and the first rows, for any schema and keys.

Run formation, spilling and multi-round merging are Spark's own sorter.  Input
order is not kept among equal keys; add a unique key for a fixed tie order.
Duplicates stay.  An empty input gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runmill.plans.durable import written
from runmill.plans.keys import SortKey, at_most, orders, sort_keys

#: Inputs of no more (see at_most) are ranked by one task, without a write.
ONE_TASK_BYTES = 64 << 20
#: monotonically_increasing_id holds the partition above, and the row of the partition in, this many bits.
_ROW_BITS = 33

Key = SortKey | Column | str


def sort(df: DataFrame, *keys: Key) -> DataFrame:
    """All rows in the order of the keys: a range exchange and a sort of each partition."""
    if df is None:
        raise ValueError("nothing to sort")
    return df.orderBy(*orders(sort_keys(*keys)))


def top(df: DataFrame, n: int, *keys: Key) -> DataFrame:
    """The first n rows, with ``pos`` from 1; tasks keep n rows each, so nothing is sorted as a whole."""
    if n < 0:
        raise ValueError("n must not be negative")
    by = orders(sort_keys(*keys))
    return df.orderBy(*by).limit(n).withColumn("pos", F.row_number().over(Window.orderBy(*by)).cast("long"))


def with_position(df: DataFrame, *keys: Key, name: str = "pos", one_task_bytes: int = ONE_TASK_BYTES) -> DataFrame:
    """``df`` with each row's place in the order of the keys, from 1.

    A small input is ranked in one task.  A larger one is range partitioned and
    sorted, and written with each row's number in its partition; the rows before
    each partition (a row for each partition) are added when it is read back.
    The write fixes the ranges, which are sampled anew by every job.  A column of
    that name is replaced; columns may have any other names.
    """
    by = sort_keys(*keys)
    if at_most(df, one_task_bytes):
        return df.withColumn(name, F.row_number().over(Window.orderBy(*orders(by))).cast("long"))
    # Ranges end inside runs of equal keys, too: ties are spread by a hash of the row (of what can be hashed).
    plain = [F.col(f"`{f.name}`") for f in df.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    packed = df.select(F.struct("*").alias("row"), *[k.column().alias(f"key{i}") for i, k in enumerate(by)], (F.xxhash64(*plain) if plain else F.lit(0)).alias("spread"))
    spread = [*[SortKey(f"key{i}", k.ascending, k.nulls_first).order() for i, k in enumerate(by)], F.asc("spread")]
    ranged = packed.repartitionByRange(*spread).sortWithinPartitions(*spread)
    rows = written(ranged.select("row", F.monotonically_increasing_id().alias("id"))).select("row", "id", F.shiftright("id", _ROW_BITS).alias("part"))
    sizes = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    at = F.col("id").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)) + F.col("before") + 1
    # One row for each shuffle partition.
    return rows.join(F.broadcast(before), "part").select(*[F.col(f"row.`{c}`") for c in df.columns if c.lower() != name.lower()], at.alias(name))
