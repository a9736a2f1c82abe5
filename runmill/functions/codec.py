"""Record codecs: big-endian integers as expressions, rectangles over Arrow batches."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def int64_bytes(value: Column | str) -> Column:
    """Eight bytes, big-endian two's complement.  Such bytes do not sort like the numbers."""
    return F.to_binary(F.lpad(F.hex(_col(value).cast("long")), 16, "0"), F.lit("hex"))


def int32_bytes(value: Column | str) -> Column:
    """Four bytes, big-endian two's complement."""
    return F.to_binary(F.right(F.lpad(F.hex(_col(value).cast("int").cast("long")), 16, "0"), F.lit(8)), F.lit("hex"))


def int64_value(data: Column | str) -> Column:
    return F.conv(F.hex(_col(data)), 16, -10).cast("long")


def int32_value(data: Column | str) -> Column:
    """The sign bit is carried into the upper half."""
    wide = F.conv(F.hex(_col(data)), 16, 10).cast("long")
    return F.when(wide >= 1 << 31, wide - (1 << 32)).otherwise(wide).cast("int")


RECTANGLE = T.StructType(
    [
        T.StructField("dimension", T.IntegerType()),
        T.StructField("low_left", T.ArrayType(T.DoubleType())),
        T.StructField("up_right", T.ArrayType(T.DoubleType())),
    ]
)


def rectangle(low: Column, up: Column) -> Column:
    """An axis-parallel box; dimensions are from 0 to 65535 and both corners have as many."""
    fits = (F.size(low) == F.size(up)) & (F.size(low) <= 65535)
    wrong = F.raise_error(F.lit("a rectangle needs two corners of one dimension, at most 65535")).cast("int")
    return F.struct(F.when(fits, F.size(low)).otherwise(wrong).alias("dimension"), low.cast("array<double>").alias("low_left"), up.cast("array<double>").alias("up_right"))


def rectangle_bytes(box: Column | str) -> Column:
    """Encoded length: two bytes of dimension and two corners of doubles."""
    return (2 + 16 * _col(box)["dimension"]).cast("long")


def encode_rectangle(low: list[float], up: list[float]) -> bytes:
    if len(low) != len(up):
        raise ValueError("both corners need the same dimension")
    return struct.pack(f">H{2 * len(low)}d", len(low), *low, *up)


def decode_rectangle(data: bytes) -> dict:
    if len(data) < 2:
        raise ValueError("a rectangle has two bytes at least")
    (d,) = struct.unpack_from(">H", data)
    if len(data) < 2 + 16 * d:
        raise ValueError(f"a rectangle of dimension {d} needs {2 + 16 * d} bytes, not {len(data)}")
    corners = struct.unpack_from(f">{2 * d}d", data, 2)
    return {"dimension": d, "low_left": list(corners[:d]), "up_right": list(corners[d:])}


_ARROW_BOX = pa.struct([("dimension", pa.int32()), ("low_left", pa.list_(pa.float64())), ("up_right", pa.list_(pa.float64()))])


def _flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """All values of a list column, and how many each row has."""
    return np.asarray(column.flatten(), np.float64), np.diff(np.asarray(column.offsets, np.int64))


def _at(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Byte positions of n doubles from each begin on."""
    return np.repeat(begin - 8 * (np.cumsum(n) - n), n) + 8 * np.arange(n.sum())


def encode_batch(boxes: pa.StructArray) -> pa.Array:
    """Bytes of a batch of rectangles; null ones stay null."""
    there = np.asarray(boxes.is_valid())
    boxes = boxes.filter(pa.array(there))
    (low, n), (up, m) = _flat(boxes.field("low_left")), _flat(boxes.field("up_right"))
    if (n != m).any() or (n > 65535).any():
        raise ValueError("both corners need the same dimension, at most 65535")
    ends = np.cumsum(2 + 16 * n)
    begin = ends - 2 - 16 * n
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    out[begin[:, None] + np.arange(2)] = n.astype(">u2").view(np.uint8).reshape(-1, 2)
    for values, place in ((low, _at(begin + 2, n)), (up, _at(begin + 2 + 8 * n, n))):
        out[place[:, None] + np.arange(8)] = values.astype(">f8").view(np.uint8).reshape(-1, 8)
    found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(np.concatenate(([0], ends)).astype(np.int64)), pa.py_buffer(out)]).cast(pa.binary())
    return _with_nulls(found, there)


def decode_batch(data: pa.Array) -> pa.Array:
    """Rectangles of a batch of bytes; null ones stay null, bytes that are too short are an error."""
    there = np.asarray(data.is_valid())
    data = data.filter(pa.array(there)).cast(pa.large_binary())
    at = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(data) + 1] if len(data) else np.zeros(1, np.int64)
    raw = np.frombuffer(data.buffers()[2], np.uint8) if len(data) and data.buffers()[2] is not None else np.zeros(0, np.uint8)
    begin, size = at[:-1], np.diff(at)
    if (size < 2).any():
        raise ValueError("a rectangle has two bytes at least")
    n = raw[begin[:, None] + np.arange(2)].reshape(-1, 2).copy().view(">u2")[:, 0].astype(np.int64) if len(begin) else np.zeros(0, np.int64)
    if (size < 2 + 16 * n).any():
        k = int(np.flatnonzero(size < 2 + 16 * n)[0])
        raise ValueError(f"a rectangle of dimension {n[k]} needs {2 + 16 * n[k]} bytes, not {size[k]}")
    ends = pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32())
    corners = []
    for place in (_at(begin + 2, n), _at(begin + 2 + 8 * n, n)):
        values = raw[place[:, None] + np.arange(8)].reshape(-1, 8).copy().view(">f8")[:, 0].astype(np.float64) if len(place) else np.zeros(0)
        corners.append(pa.ListArray.from_arrays(ends, pa.array(values)))
    return _with_nulls(pa.StructArray.from_arrays([pa.array(n.astype(np.int32)), *corners], fields=list(_ARROW_BOX)), there)


def _with_nulls(values: pa.Array, there: np.ndarray) -> pa.Array:
    """The values at the places that are there, null at the others."""
    place = np.cumsum(there) - 1
    return values.take(pa.array(place, mask=~there))


def _mapped(df: DataFrame, column: str, name: str, kind: T.DataType, change: Callable[[pa.Array], pa.Array]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column(name, change(batch.column(batch.schema.get_field_index(column))))

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(name, kind)]))


def encode_rectangles(df: DataFrame, column: str, name: str = "data") -> DataFrame:
    """Adds the bytes of a rectangle column."""
    return _mapped(df, column, name, T.BinaryType(), encode_batch)


def decode_rectangles(df: DataFrame, column: str, name: str = "box") -> DataFrame:
    """Adds the rectangle of a bytes column; bytes that are too short fail the job."""
    return _mapped(df, column, name, RECTANGLE, decode_batch)


@dataclass(frozen=True)
class Codec:
    """How a record becomes bytes, and many records an Arrow array, outside of expressions; width None: of any length."""

    width: int | None
    encode: Callable
    decode: Callable[[list], pa.Array]


INT64 = Codec(8, lambda x: struct.pack(">q", x), lambda many: pa.array(np.frombuffer(b"".join(many), ">i8").astype(np.int64)))
INT32 = Codec(4, lambda x: struct.pack(">i", x), lambda many: pa.array(np.frombuffer(b"".join(many), ">i4").astype(np.int32)))
TEXT = Codec(None, lambda x: x.encode(), lambda many: pa.array([bytes(x).decode() for x in many], pa.string()))
BYTES = Codec(None, bytes, lambda many: pa.array([bytes(x) for x in many], pa.binary()))
CODECS = {"int64": INT64, "int32": INT32, "text": TEXT, "bytes": BYTES}
