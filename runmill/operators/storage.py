"""Keyed pages: storages, routing, point reads and writes, cached rescans, updates and flushes.

A storage is a DataFrame of (block_nr bigint, data binary, ...); frames are
immutable, so a write makes a new version of a storage (copy on write) and
readers of the old one are undisturbed.  Writes and updates of many pages are
one join or one projection over the pages, never one for each page.  Every
CHANGES changes the pages are written to the shared folder, so that plans stay
short.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runmill.plans.durable import written
from runmill.streaming.log import Log

#: Changes of a storage between two cuts of its plan.
CHANGES = 16


def zero_page(block_bytes: int) -> Column:
    return F.to_binary(F.repeat(F.lit("00"), F.lit(block_bytes)), F.lit("hex"))


def get_bytes(page: Column, offset: int, length: int) -> Column:
    """Bytes offset..offset+length of a page; a range that leaves the page fails the job."""
    inside = F.octet_length(page) >= offset + length
    if offset < 0 or length < 0:
        raise ValueError("offset and length must not be negative")
    return F.when(inside, F.substring(page, offset + 1, length)).otherwise(F.raise_error(F.lit("bytes outside of the page")).cast("binary"))


def set_bytes(page: Column, offset: int, data: Column) -> Column:
    """A page with ``data`` from offset on; it must fit."""
    if offset < 0:
        raise ValueError("offset must not be negative")
    inside = F.octet_length(page) >= offset + F.octet_length(data)
    return F.when(inside, F.overlay(page, data, offset + 1)).otherwise(F.raise_error(F.lit("bytes outside of the page")).cast("binary"))


class Storage:
    """A named table with a key; ``deletes`` tells whether pages may be removed.

    With ``block_bytes`` every page that is written must have as many bytes of
    ``data``, else the job that computes the pages fails.
    """

    def __init__(self, name: str, pages: DataFrame, key: str = "block_nr", deletes: bool = True, block_bytes: int | None = None):
        if key not in pages.columns:
            raise ValueError(f"no column {key}")
        self.name, self.pages, self.key, self.deletes, self.block_bytes = name, pages, key, deletes, block_bytes
        self._changes, self._flushed = 0, None

    def _changed(self, pages: DataFrame) -> None:
        self._changes += 1
        self._flushed = None
        self.pages = written(pages) if self._changes % CHANGES == 0 else pages

    def read(self, *numbers: int) -> DataFrame:
        """The pages of these numbers, those that exist; the filter reaches the scan."""
        return self.pages.where(F.col(self.key).isin(*numbers))

    def fetch(self, *numbers: int) -> DataFrame:
        """The pages of these numbers; one that doesn't exist fails the job."""
        wanted = self.pages.sparkSession.createDataFrame([(n,) for n in sorted(set(numbers))], f"wanted {self.pages.schema[self.key].dataType.simpleString()}")
        found = wanted.join(self.pages.withColumn("there", F.lit(True)), F.col("wanted") == F.col(self.key), "left")
        number = F.when(F.col("there"), F.col(self.key)).otherwise(F.raise_error(F.concat(F.lit(f"storage {self.name} has no page "), F.col("wanted").cast("string"))).cast(self.pages.schema[self.key].dataType))
        return found.withColumn(self.key, number).select(*self.pages.columns)

    def write(self, rows: DataFrame, order: Column | str | None = None) -> None:
        """Replace the pages of equal key, add the others.

        Of rows with one key the last in ``order`` counts; without an order, any.
        """
        columns = self.pages.columns
        if order is None:
            rows = rows.select(*columns).dropDuplicates([self.key])
        else:
            rows = rows.groupBy(self.key).agg(F.max_by(F.struct(*columns), F.col(order) if isinstance(order, str) else order).alias("last")).select("last.*")
        if self.block_bytes is not None:
            wrong = F.raise_error(F.lit(f"a page of storage {self.name} hasn't {self.block_bytes} bytes")).cast("binary")
            rows = rows.withColumn("data", F.when(F.octet_length("data") == self.block_bytes, F.col("data")).otherwise(wrong))
        kept = self.pages.join(rows.select(self.key), self.key, "left_anti")
        self._changed(kept.select(*columns).unionByName(rows.select(*columns)))

    def fix_empty(self, number: int, block_bytes: int) -> DataFrame:
        """The page of this number as a zero page, whatever it held; returned for a first use."""
        rows = self.pages.sparkSession.range(1).select(F.lit(number).cast(self.pages.schema[self.key].dataType).alias(self.key), zero_page(block_bytes).alias("data"))
        kept = self.pages.where(F.col(self.key) != number)
        self._changed(kept.unionByName(rows, allowMissingColumns=True))
        return self.read(number)

    def next_number(self) -> DataFrame:
        """One row: the number after the greatest, 0 for an empty storage."""
        return self.pages.agg((F.coalesce(F.max(self.key), F.lit(-1)) + 1).cast("long").alias(self.key))

    def reserve(self, block_bytes: int) -> DataFrame:
        """Add a zero page under the next number; returns the number."""
        number = self.next_number()
        rows = number.withColumn("data", zero_page(block_bytes))
        self._changed(self.pages.unionByName(rows, allowMissingColumns=True))
        return number

    def delete(self, keys: DataFrame, strict: bool = False) -> None:
        """Remove pages by key.  Keys that are missing are ignored, or, if ``strict``, an error before anything is removed."""
        if not self.deletes:
            raise NotImplementedError(f"storage {self.name} doesn't delete")
        wanted = keys.select(self.key).distinct()
        if strict and not (missing := wanted.join(self.pages.select(self.key), self.key, "left_anti").limit(1)).isEmpty():
            raise KeyError(f"storage {self.name} has no page {missing.first()[0]}")
        self._changed(self.pages.join(wanted, self.key, "left_anti").select(*self.pages.columns))

    def cache(self) -> Storage:
        """Keep pages in Spark's block manager for repeated reads; the least used are evicted."""
        self.pages = self.pages.persist()
        return self

    def release(self) -> None:
        self.pages.unpersist()

    def access(self, trace: DataFrame) -> DataFrame:
        """(step, key): the page of every access of a trace."""
        return trace.join(self.pages, self.key)

    def update(self, numbers: Sequence[int], change: dict[str, Callable[[Column], Column]]) -> DataFrame:
        """Change columns of the given pages; returns the changed pages, to be flushed."""
        dirty = F.col(self.key).isin(*numbers)
        changed = {c: F.when(dirty, f(F.col(c))).otherwise(F.col(c)) for c, f in change.items()}
        self._changed(self.pages.withColumns(changed))
        return self.pages.where(dirty)

    def flush(self, path: str, log: Log | None = None, upto: int | None = None) -> None:
        """Force the log up to a number, then write the pages: log before data.

        Nothing is written if nothing has changed since the last flush there.  The
        pages are written aside first, so a storage that reads from ``path`` can be
        flushed to it, and are read from ``path`` from then on.
        """
        if log is not None:
            log.flush(upto)
        if self._flushed != path:
            written(self.pages).write.mode("overwrite").parquet(path)
            self.pages, self._flushed = self.pages.sparkSession.read.schema(self.pages.schema).parquet(path), path


class StorageManager:
    """Storages by name; a name is registered once."""

    def __init__(self) -> None:
        self._storages: dict[str, Storage] = {}

    def register(self, storage: Storage) -> None:
        if storage.name in self._storages:
            raise ValueError(f"storage {storage.name} is registered already")
        self._storages[storage.name] = storage

    def get(self, name: str) -> Storage:
        if name not in self._storages:
            raise KeyError(f"no storage {name}")
        return self._storages[name]

    def read(self, name: str, *numbers: int) -> DataFrame:
        return self.get(name).read(*numbers)

    def write(self, name: str, rows: DataFrame, order: Column | str | None = None) -> None:
        self.get(name).write(rows, order)

    def all(self) -> DataFrame:
        """(storage_id, block_nr) of all pages; a filter on storage_id reads only its storage."""
        out = None
        for name, s in self._storages.items():
            part = s.pages.select(F.lit(name).alias("storage_id"), F.col(s.key).cast("long").alias("block_nr"))
            out = part if out is None else out.unionByName(part)
        if out is None:
            raise KeyError("no storage is registered")
        return out

    def close(self) -> None:
        for s in self._storages.values():
            s.release()
        self._storages.clear()
