"""Which block and slot a record gets in packed blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runmill.operators.packing import next_fit
from runmill.plans.keys import fresh

#: Bytes of the two headers, of a record's length prefix, and the longest record behind one.
FIXED_HEADER, VAR_HEADER, PREFIX, LONGEST = 12, 8, 2, 65535


def fixed_capacity(block_bytes: int, record_bytes: int) -> int:
    """Records of one width in a block."""
    if record_bytes < 1 or block_bytes < FIXED_HEADER + record_bytes:
        raise ValueError(f"a block of {block_bytes} bytes holds no record of {record_bytes}")
    return (block_bytes - FIXED_HEADER) // record_bytes


def pack_fixed(df: DataFrame, position: str, block_bytes: int, record_bytes: int) -> DataFrame:
    """Adds block_no and slot of records of one width, in the order of a position from 1."""
    n = fixed_capacity(block_bytes, record_bytes)
    return df.withColumn("block_no", F.expr(f"(`{position}` - 1) div {n}")).withColumn("slot", F.expr(f"(`{position}` - 1) % {n}"))


def pack_var(df: DataFrame, position: str, size: Column, block_bytes: int) -> DataFrame:
    """Adds block_no, slot and the byte offset of records with a length prefix; a record that no block can hold fails the job."""
    room = block_bytes - VAR_HEADER
    if room <= PREFIX:
        raise ValueError(f"a block of {block_bytes} bytes holds no record")
    checked = F.when(size > LONGEST, F.raise_error(F.lit(f"a record exceeds {LONGEST} bytes")).cast("long")).otherwise(size.cast("long"))
    (taken,) = fresh(df, "bytes")
    packed = next_fit(df.withColumn(taken, checked + PREFIX), position, F.col(taken), room, "block_no", oversize="raise")
    own = Window.partitionBy("block_no").orderBy(position)
    before = F.coalesce(F.sum(taken).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return packed.withColumn("slot", (F.row_number().over(own) - 1).cast("long")).withColumn("offset", before + VAR_HEADER).drop(taken)
