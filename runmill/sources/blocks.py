"""Files of packed record blocks as Spark data sources.

``fixedblock``: blocks with a header of three big-endian uint32 (records, offset
behind the last, record width) and records of one width.  ``varblock``: blocks
with a header of two (records, offset), each record behind a uint16 length.
Every block fills ``blockSize`` bytes.  Options: path, blockSize, and codec
(int64, int32, text or bytes).  A task writes one file; reading splits files
into ranges of ``blocksPerTask`` blocks.  Files must lie on storage that driver
and executors mount alike.

    register(spark)
    df.write.format("fixedblock").option("blockSize", 4096).option("codec", "int64").mode("overwrite").save(path)
    spark.read.format("fixedblock").option("blockSize", 4096).option("codec", "int64").load(path)

Rows are (value, file, block_no, slot) when read; the first column is written.
"""

from __future__ import annotations

import os
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from runmill.functions.blocks import FIXED_HEADER, LONGEST, PREFIX, VAR_HEADER, fixed_capacity
from runmill.functions.codec import CODECS

_KINDS = {"int64": "long", "int32": "int", "text": "string", "bytes": "binary"}


class FixedBlock:
    """One block of records of one width."""

    def __init__(self, block_bytes: int, record_bytes: int):
        self.block_bytes, self.record_bytes = block_bytes, record_bytes
        self.capacity = fixed_capacity(block_bytes, record_bytes)
        self.records: list[bytes] = []

    def append(self, record: bytes) -> bool:
        """Whether there was room."""
        if len(record) != self.record_bytes:
            raise ValueError(f"a record has {len(record)} bytes, not {self.record_bytes}")
        if len(self.records) == self.capacity:
            return False
        self.records.append(record)
        return True

    def to_bytes(self) -> bytes:
        body = b"".join(self.records)
        return (struct.pack(">III", len(self.records), FIXED_HEADER + len(body), self.record_bytes) + body).ljust(self.block_bytes, b"\0")

    def reset(self) -> None:
        self.records = []

    @staticmethod
    def read(data: bytes) -> Iterator[bytes]:
        n, _, width = struct.unpack_from(">III", data)
        if FIXED_HEADER + n * width > len(data):
            raise ValueError("a block's header tells of more records than it holds")
        for i in range(n):
            yield data[FIXED_HEADER + i * width : FIXED_HEADER + (i + 1) * width]

    @staticmethod
    def body(data: bytes, width: int) -> tuple[int, list[bytes]]:
        """The number of records of that width, and all of them in one piece."""
        n, _, own = struct.unpack_from(">III", data)
        if own != width or FIXED_HEADER + n * width > len(data):
            raise ValueError("a block's header tells of other records than it holds")
        return n, [data[FIXED_HEADER : FIXED_HEADER + n * width]]


class VarBlock:
    """One block of records with length prefixes."""

    def __init__(self, block_bytes: int):
        self.block_bytes, self.used, self.records = block_bytes, VAR_HEADER, []

    def append(self, record: bytes) -> bool:
        if len(record) > LONGEST or VAR_HEADER + PREFIX + len(record) > self.block_bytes:
            raise ValueError(f"a record of {len(record)} bytes fits no block of {self.block_bytes}")
        if self.used + PREFIX + len(record) > self.block_bytes:
            return False
        self.records.append(record)
        self.used += PREFIX + len(record)
        return True

    def to_bytes(self) -> bytes:
        body = b"".join(struct.pack(">H", len(r)) + r for r in self.records)
        return (struct.pack(">II", len(self.records), self.used) + body).ljust(self.block_bytes, b"\0")

    def reset(self) -> None:
        self.used, self.records = VAR_HEADER, []

    @staticmethod
    def read(data: bytes) -> Iterator[bytes]:
        (n,) = struct.unpack_from(">I", data)
        at = VAR_HEADER
        for _ in range(n):
            (size,) = struct.unpack_from(">H", data, at)
            at += PREFIX + size
            if at > len(data):
                raise ValueError("a record reaches beyond its block")
            yield data[at - size : at]

    @staticmethod
    def body(data: bytes, width: None) -> tuple[int, list[bytes]]:
        """The number of records, and the records."""
        records = list(VarBlock.read(data))
        return len(records), records


@dataclass
class BlockRange(InputPartition):
    path: str
    first: int
    last: int


@dataclass
class Written(WriterCommitMessage):
    temporary: str
    path: str


class _Reader(DataSourceReader):
    def __init__(self, path: str, block: type, size: int, codec: str, per_task: int):
        self.path, self.block, self.size, self.codec, self.per_task = path, block, size, codec, per_task

    def partitions(self) -> list[BlockRange]:
        names = [self.path] if os.path.isfile(self.path) else sorted(os.path.join(self.path, n) for n in os.listdir(self.path) if not n.startswith((".", "_")))
        out = []
        for name in names:
            length = os.path.getsize(name)
            if length % self.size:
                raise ValueError(f"{name} is not made of blocks of {self.size} bytes")
            out += [BlockRange(name, a, min(a + self.per_task, length // self.size)) for a in range(0, length // self.size, self.per_task)]
        return out

    def read(self, part: BlockRange) -> Iterator[pa.RecordBatch]:
        """A batch for each block."""
        codec = CODECS[self.codec]
        with open(part.path, "rb") as f:
            f.seek(part.first * self.size)
            for number in range(part.first, part.last):
                data = f.read(self.size)
                if len(data) < self.size:
                    raise ValueError(f"{part.path} ends inside a block")
                n, records = self.block.body(data, codec.width)
                file = pa.array([os.path.basename(part.path)] * n, pa.string())
                yield pa.RecordBatch.from_arrays([codec.decode(records), file, pa.array(np.full(n, number)), pa.array(np.arange(n))], names=["value", "file", "block_no", "slot"])


class _Writer(DataSourceWriter):
    def __init__(self, path: str, block: type, size: int, codec: str, overwrite: bool):
        self.path, self.block, self.size, self.codec, self.overwrite = path, block, size, codec, overwrite

    def write(self, rows: Iterator) -> Written:
        from pyspark import TaskContext

        codec = CODECS[self.codec]
        block = self.block(self.size, codec.width) if self.block is FixedBlock else self.block(self.size)
        os.makedirs(self.path, exist_ok=True)
        task = TaskContext.get()
        name = f"part-{task.partitionId() if task else 0:05d}-{uuid.uuid4().hex}"
        temporary = os.path.join(self.path, f".{name}")
        with open(temporary, "wb") as f:
            for row in rows:
                record = codec.encode(row[0])
                if not block.append(record):
                    f.write(block.to_bytes())
                    block.reset()
                    block.append(record)
            if block.records:
                f.write(block.to_bytes())
        return Written(temporary, os.path.join(self.path, name))

    def commit(self, messages: list[Written | None]) -> None:
        done = [m for m in messages if m is not None]
        if self.overwrite and os.path.isdir(self.path):
            new = {os.path.basename(m.temporary) for m in done}
            for n in os.listdir(self.path):
                if n not in new:
                    os.remove(os.path.join(self.path, n))
        for m in done:
            if os.path.getsize(m.temporary):
                os.rename(m.temporary, m.path)
            else:
                os.remove(m.temporary)

    def abort(self, messages: list[Written | None]) -> None:
        for m in messages:
            if m is not None and os.path.exists(m.temporary):
                os.remove(m.temporary)


class _Source(DataSource):
    block: type

    def _how(self) -> tuple[str, type, int, str]:
        codec = self.options.get("codec", "int64" if self.block is FixedBlock else "bytes")
        if codec not in CODECS or (CODECS[codec].width is None) == (self.block is FixedBlock):
            raise ValueError(f"{self.name()} has no codec {codec}")
        if "path" not in self.options:
            raise ValueError("a path is needed")
        path = self.options["path"].removeprefix("file://").removeprefix("file:")
        if "://" in path:
            raise ValueError(f"{path}: block files lie on storage that driver and executors mount alike")
        return path, self.block, int(self.options.get("blocksize", self.options.get("blockSize", 4096))), codec

    def schema(self) -> str:
        return f"value {_KINDS[self._how()[3]]}, file string, block_no long, slot long"

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(*self._how(), int(self.options.get("blockspertask", self.options.get("blocksPerTask", 4096))))

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        return _Writer(*self._how(), overwrite)


class FixedBlockSource(_Source):
    block = FixedBlock

    @classmethod
    def name(cls) -> str:
        return "fixedblock"


class VarBlockSource(_Source):
    block = VarBlock

    @classmethod
    def name(cls) -> str:
        return "varblock"


def register(spark: SparkSession) -> None:
    """Make both formats known to a session."""
    spark.dataSource.register(FixedBlockSource)
    spark.dataSource.register(VarBlockSource)
