"""Sort keys: what a comparator becomes over DataFrames."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class SortKey:
    """An expression, its direction and the place of nulls (default: first ascending, last descending)."""

    by: Column | str
    ascending: bool = True
    nulls_first: bool | None = None

    def column(self) -> Column:
        return F.col(self.by) if isinstance(self.by, str) else self.by

    def order(self) -> Column:
        first = self.ascending if self.nulls_first is None else self.nulls_first
        name = ("asc" if self.ascending else "desc") + ("_nulls_first" if first else "_nulls_last")
        return getattr(self.column(), name)()


def asc(by: Column | str) -> SortKey:
    return SortKey(by)


def desc(by: Column | str) -> SortKey:
    return SortKey(by, False)


def sort_keys(*keys: SortKey | Column | str) -> list[SortKey]:
    """Names and expressions count as ascending; there must be a key."""
    if not keys or any(k is None for k in keys):
        raise ValueError("a sort needs at least one key")
    return [k if isinstance(k, SortKey) else SortKey(k) for k in keys]


def orders(keys: Sequence[SortKey]) -> list[Column]:
    return [k.order() for k in keys]


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of ``df`` has."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


#: Operators whose number of rows Catalyst only guesses.
_GUESSED = re.compile(r"^[ :+-]*(?:Generate|Expand|Join|MapIn|FlatMap|MapPartitions|MapGroups|CoGroup|Sample|Python|LogicalRDD)", re.MULTILINE)


def at_most(df: DataFrame, limit: int) -> bool:
    """Whether a plan's rows are proven to take no more bytes: by the size of what it scans, where nothing multiplies rows."""
    return size_in_bytes(df) <= limit and not _GUESSED.search(df._jdf.queryExecution().optimizedPlan().toString())


def size_in_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of a plan's size."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
