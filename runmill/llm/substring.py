"""Substring deduplication by levels of windows of doubled length.

A window is ``window`` (35) consecutive words of one text; words covered by a
window whose words also start anywhere else, same text included, are removed.

The levels have windows of 8, 16, 32 and 35 words: twice the length before, up
to the length wanted.  At each level a 35-word window is represented by the
window of least hash of that level's length inside it.  Equal windows have equal
representatives at every level, so what is found once at a level is unique and
goes no further; only windows whose representative was found twice are extended.
Neighbouring windows mostly share their representative and are one candidate (a
run): about one run for 14 words at level 8.

Between level 8 and 16 whole stretches are settled: a stretch is a run with all
words of its windows (up to 62).  If the same stretch occurs twice all its
windows are repeated.  Copies of a stretch are one candidate from there on,
wherever they are; and if a piece of 8 words has a single stretch nothing of it
is extended.  For the others the text is read once more, for the hashes of all
16-word windows of one copy of each stretch.  A window of 32 words is two of 16,
and one of 35 words two of 32 that overlap, so the hashes of the next level come
from those of the level before.  The verdicts of a stretch go back to all its
copies.

What is shuffled: 48 bytes a run, what the candidates of a level need, and the
texts twice, by row.  Counts are aggregated before the shuffle, and joins on keys
that may be hot (a passage that a third of all rows share) take the hot keys
apart (skew.py).  Equality is of two 64-bit hashes, of piece and window.

Cases: null or empty texts and texts under ``window`` words lose nothing;
repeated rows lose all their windows' words, each; equal ids with other texts
are rows of their own; an empty table gives an empty result; further columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runmill.llm.durable import durable
from runmill.llm.skew import KEY_DDL, join_unique, row_key
from runmill.llm.words import mix, slices, spans_hash, windows

WINDOW = 35
PIECE = 8

_LEFT, _RIGHT = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


def lengths(window: int, piece: int) -> list[int]:
    """Window lengths of the levels."""
    out = [piece]
    while out[-1] < window:
        out.append(min(2 * out[-1], window))
    return out


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, by doubling."""
    done, out = 1, values
    while done * 2 <= width:
        out = np.minimum(out[:-done], out[done:])
        done *= 2
    if done < width:
        out = np.minimum(out[: max(0, len(out) - (width - done))], out[width - done :])
    return out


def _runs(part, window: int, piece: int) -> tuple[np.ndarray, ...]:
    """Runs of one slice: (row, start in its row, windows, piece, stretch, own): own if a window may recur inside the run."""
    width = window - piece + 1
    words = np.diff(part.word_at)
    if not (words >= window).any():
        return tuple(np.zeros(0, t) for t in (np.int64, np.int32, np.int32, np.int64, np.int64, bool))
    pieces = windows(part.hash, piece)
    place = np.arange(len(pieces), dtype=np.uint64) & np.uint64(63)
    high = pieces & ~np.uint64(63)
    first, last = _least(high | place, width), _least(high | (np.uint64(63) - place), width)
    tie = (first & np.uint64(63)) != (np.uint64(63) - (last & np.uint64(63)))
    value = first >> np.uint64(6)
    row_of = np.repeat(np.arange(part.n_rows), words)[: len(value)]
    inside = np.arange(len(value)) + window <= part.word_at[1:][row_of]
    at = np.flatnonzero(inside)
    value, row, tie = value[at], row_of[at], tie[at]
    new = np.ones(len(at), bool)
    new[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    begin = np.flatnonzero(new)
    n = np.diff(np.append(begin, len(at)))
    start = at[begin]
    ties = np.add.reduceat(tie.astype(np.int64), begin) > 0
    return (
        row[begin],
        (start - part.word_at[row[begin]]).astype(np.int32),
        n.astype(np.int32),
        value[begin].astype(np.int64),
        spans_hash(part.hash, start, n + window - 1).view(np.int64),
        ties | (n > width),
    )


def _packed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all rows of a binary column, and where each row's begin."""
    column = column.cast(pa.large_binary())
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(column.buffers()[2], np.uint8)[at[0] : at[-1]] if len(column) and column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return raw.view(np.uint64), (at - at[0]) // 8


def _pack(values: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer((at * 8).astype(np.int64)), pa.py_buffer(values.tobytes())]).cast(pa.binary())


def _ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... of every range, one after the other."""
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(begin, size)


def _alive(batch: pa.RecordBatch) -> np.ndarray:
    """For each window of the batch's stretches whether it is in one of the row's ranges ``alive`` (all if that is null)."""
    n = batch["n"].to_numpy().astype(np.int64)
    first = np.cumsum(n) - n
    alive = batch["alive"]
    sizes = np.diff(np.asarray(alive.offsets, np.int64)) if len(alive) else np.zeros(0, np.int64)
    edge = np.zeros(n.sum() + 1, np.int64)
    ranges = alive.flatten()
    if len(ranges):
        at = np.repeat(first, sizes) + np.asarray(ranges.field("at"))
        np.add.at(edge, at, 1)
        np.subtract.at(edge, at + np.asarray(ranges.field("n")), 1)
    return np.cumsum(edge[:-1]) > 0


def representatives(batch: pa.RecordBatch, window: int, length: int) -> pa.RecordBatch:
    """Runs of surviving windows whose representative stands at one place: (piece, stretch, at, n, hash)."""
    n = batch["n"].to_numpy().astype(np.int64)
    h, begin = _packed(batch["hashes"])
    least = _least(h, window - length + 1)
    where = _ranges(begin[:-1], n)
    owner = np.repeat(np.arange(len(n)), n)
    at = where - begin[:-1][owner]
    take = _alive(batch)
    where, owner, at = where[take], owner[take], at[take]
    value = least[where]
    new = np.ones(len(value), bool)
    # Behind a window that begins with its representative the next one has another, be it an equal one.
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1]) | (at[1:] != at[:-1] + 1) | (h[where[:-1]] == value[:-1])
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(value)))
    which = pa.array(owner[first])
    return pa.RecordBatch.from_arrays(
        [batch["piece"].take(which), batch["stretch"].take(which), pa.array(at[first].astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(value[first].view(np.int64))],
        names=["piece", "stretch", "at", "n", "hash"],
    )


def extended(batch: pa.RecordBatch, window: int, length: int, to: int) -> pa.RecordBatch:
    """Stretches with the hashes of their windows of ``to`` words instead of ``length``."""
    n = batch["n"].to_numpy().astype(np.int64)
    h, begin = _packed(batch["hashes"])
    size = n + window - to
    at = _ranges(begin[:-1], size)
    longer = mix(h[at] * _LEFT + h[at + to - length] * _RIGHT + np.uint64(to))
    return pa.RecordBatch.from_arrays([batch["piece"], batch["stretch"], batch["n"], _pack(longer, np.concatenate(([0], np.cumsum(size)))), batch["alive"]], names=["piece", "stretch", "n", "hashes", "alive"])


def _with_key(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select("doc_id", text.alias("text")).withColumn("key", row_key("doc_id", "text"))


def remove_repeated(docs: DataFrame, window: int = WINDOW, piece: int = PIECE) -> DataFrame:
    """Rows (doc_id, n_words, n_removed, kept): kept has the remaining words, joined by one space."""
    if not 0 < piece < window or window - piece + 1 > 64:
        raise ValueError("a piece must be shorter than the window, by 63 words at most")
    levels = lengths(window, piece)

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(1)):
                row, *rest = _runs(part, window, piece)
                key = batch.column(0).take(pa.array(row + part.first_row))
                yield pa.RecordBatch.from_arrays([key, *map(pa.array, rest)], names=["key", "start", "n", "piece", "stretch", "own"])

    def second_level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column(1)
            for part in slices(batch.column(0)):
                every = windows(part.hash, levels[1])
                found, hashes = [], []
                for i in range(part.n_rows):
                    for w in wanted[part.first_row + i].as_py():
                        at = part.word_at[i] + w["start"]
                        found.append((w["piece"], w["stretch"], w["n"]))
                        hashes.append(every[at : at + w["n"] + window - levels[1]].tobytes())
                if found:
                    piece_, stretch, n = zip(*found, strict=True)
                    alive = pa.array([[{"at": 0, "n": x}] for x in n], pa.list_(pa.struct([("at", pa.int32()), ("n", pa.int32())])))
                    yield pa.RecordBatch.from_arrays([pa.array(piece_, pa.int64()), pa.array(stretch, pa.int64()), pa.array(n, pa.int32()), pa.array(hashes, pa.binary()), alive], names=["piece", "stretch", "n", "hashes", "alive"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column(2)
            for part in slices(batch.column(1)):
                total, removed, kept = [], [], []
                for i in range(part.n_rows):
                    a, b = part.word_at[i], part.word_at[i + 1]
                    gone = np.zeros(b - a + 1, np.int64)
                    for w in wanted[part.first_row + i].as_py() or ():
                        if w["whole"]:
                            gone[w["start"]] += 1
                            gone[w["start"] + w["n"] + window - 1] -= 1
                        else:
                            at = w["start"] + np.array(w["which"])
                            np.add.at(gone, at, 1)
                            np.subtract.at(gone, at + window, 1)
                    stays = np.flatnonzero(np.cumsum(gone[:-1]) == 0) + a
                    total.append(b - a)
                    removed.append(b - a - len(stays))
                    raw = part.data
                    kept.append(b" ".join(raw[s:e].tobytes() for s, e in zip(part.start[stays], part.end[stays], strict=True)).decode("utf-8"))
                ids = batch.column(0).slice(part.first_row, part.n_rows)
                yield pa.RecordBatch.from_arrays([ids, pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    rows = _with_key(docs)
    found = durable(rows.select("key", "text").mapInArrow(runs, f"key {KEY_DDL}, start int, n int, piece long, stretch long, own boolean"))
    # Level of the pieces: stretches of pieces that are found once go no further.
    stretches = found.groupBy("piece", "stretch").agg(
        F.count(F.lit(1)).alias("copies"),
        F.max("own").alias("own"),
        F.min(F.struct("key", "start", "n")).alias("one"),
    )
    pieces = stretches.groupBy("piece").agg(F.count(F.lit(1)).alias("variants"), F.max("own").alias("any_own"))
    stretches, pieces = durable(stretches), durable(pieces.where("variants > 1 OR any_own"))
    repeated = durable(
        join_unique(stretches, pieces, ["piece"], "variants", "left")
        .where("copies > 1 OR variants IS NOT NULL")
        .select("piece", "stretch", "copies", "one", F.col("variants").isNotNull().alias("open"))
    )
    wanted = repeated.where("open").select("one.*", "piece", "stretch").groupBy("key").agg(F.collect_list(F.struct("start", "n", "piece", "stretch")).alias("wanted"))
    spread = rows.select("key", "doc_id", "text")
    state_ddl = "piece long, stretch long, n int, hashes binary, alive array<struct<at: int, n: int>>"
    state = durable(spread.join(wanted.hint("shuffle_hash"), "key").select("text", "wanted").mapInArrow(second_level, state_ddl))
    for length, to in zip(levels[1:], [*levels[2:], 0], strict=True):
        alive = _found_twice(state, window, length)
        if to:
            grown = _mapped(state.drop("alive").join(alive, ["piece", "stretch"]), lambda b, length=length, to=to: extended(b, window, length, to), state_ddl)
            state = durable(grown)
    which = alive.select("piece", "stretch", F.expr("flatten(transform(alive, x -> sequence(x.at, x.at + x.n - 1)))").alias("which"))
    whole = repeated.where("copies > 1").select("piece", "stretch", "copies", F.lit(True).alias("whole"), F.lit(None).cast("array<int>").alias("which"))
    part = which.join(repeated.where("copies > 1"), ["piece", "stretch"], "left_anti").select("piece", "stretch", F.lit(1).cast("long").alias("copies"), F.lit(False).alias("whole"), "which")
    verdicts = join_unique(found, durable(whole.unionByName(part)), ["piece", "stretch"], "copies")
    by_row = verdicts.select("key", "start", "n", "whole", "which").distinct().groupBy("key").agg(F.collect_list(F.struct("start", "n", "whole", "which")).alias("wanted"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    return (
        spread.join(by_row.hint("shuffle_hash"), "key", "left")
        .select("doc_id", "text", "wanted")
        .mapInArrow(cut, f"doc_id {id_type}, n_words long, n_removed long, kept string")
    )


def _mapped(df: DataFrame, change, ddl: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield change(batch)

    return df.mapInArrow(run, ddl)


def _found_twice(state: DataFrame, window: int, length: int) -> DataFrame:
    """(piece, stretch, alive): the ranges of a stretch's windows whose representative of this length was found twice or more."""
    runs = _mapped(state, lambda b: representatives(b, window, length), "piece long, stretch long, at int, n int, hash long")
    counts = durable(runs.groupBy("piece", "hash").agg(F.count(F.lit(1)).alias("times")).where("times > 1"))
    return join_unique(runs, counts, ["piece", "hash"], "times").groupBy("piece", "stretch").agg(F.collect_list(F.struct("at", "n")).alias("alive"))
