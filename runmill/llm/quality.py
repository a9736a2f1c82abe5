"""Quality rules with adaptive thresholds from mergeable quantile sketches.

Every text is measured in one pass.  For each (lang, source) group and rate a
quantile sketch is kept: counts in buckets whose width grows with the value, so a
quantile is at most 1/64 too low (2^-20 near zero).  Sketches merge by adding
counts; so they don't depend on the order of rows or tasks, a retried task changes
nothing, and a group of any size is spread over all tasks and only counts are
shuffled.

A rate is too high above its group's fence: median + SPREAD * (median - tenth
percentile) + slack, from the documents that pass the base rules.  Up to two fifths
of a group can be junk and move these two quantiles little.  A quantile alone would
reject a share of every group, however clean; the fence rejects only what stands far
from the bulk.  Few documents tell little, so a group's fence is averaged with that
of its language (the sketches of all its sources, merged), which counts as PRIOR
documents.  The slacks keep groups with no spread (all documents without symbols,
say) from rejecting a document for a trifle.  The thresholds are joined back by
group and filter the documents.

Cases: a null text has no words and fails the base rules; null lang or source
form groups of their own; the fence of a small group is mostly its language's; repeated rows are measured each; an empty table gives an empty
result; further columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runmill.llm.durable import durable
from runmill.llm.words import Slice, slices, windows

#: Window of words whose repetition counts.
REPEAT_WORDS = 8
MIN_WORDS = 20
#: Percent of the words that may lie in repeated windows.
MAX_REPEATED_PERCENT = 30
#: How many times the distance of median and tenth percentile a rate may lie above the median.
SPREAD = 6.0
#: Documents as which a language's fence counts beside a group's own.
PRIOR = 30
#: A rate's bucket: its value in 2^-20, of which the seven highest bits are kept.
UNIT, BITS = 1 << 20, 7
#: Rates and what is added to their fences.
RATES = {"symbol_rate": 0.10, "dup_line_rate": 0.50, "long_word_rate": 3.0, "stutter_rate": 0.20}

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_BLANK = b" \t\n\x0b\x0c\r"


def _sums(flags: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))[ends]
    return np.diff(total, prepend=0)


def _dup_lines(text: bytes) -> int:
    lines = text.split(b"\n")
    if len(lines) < 2:
        return 0
    seen: set[bytes] = set()
    n = 0
    for line in lines:
        if line.strip(_BLANK):
            if line in seen:
                n += 1
            else:
                seen.add(line)
    return n


def _repeated(hashes: np.ndarray) -> int:
    """Words inside windows that occur twice or more among these."""
    h = windows(hashes, REPEAT_WORDS)
    if len(h) < 2:
        return 0
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(h), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(hashes) + 1, np.int64)
    starts = np.flatnonzero(twice)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + REPEAT_WORDS, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def _measured(part: Slice) -> list[np.ndarray]:
    data, ends = part.data, part.row_ends
    mark = np.zeros(len(data) + 1, np.int8)
    mark[part.start] += 1
    np.subtract.at(mark, part.end, 1)
    inside = np.cumsum(mark[:-1], dtype=np.int8) > 0
    n_words = np.diff(part.word_at)
    starts = np.concatenate(([0], ends[:-1]))
    # Words equal to the word before them in the same row.
    stutter = np.zeros(len(part.hash), bool)
    stutter[1:] = part.hash[1:] == part.hash[:-1]
    stutter[part.word_at[:-1][n_words > 0]] = False
    raw = data.tobytes()
    return [
        n_words,
        _sums(inside & ((data & 0xC0) != 0x80), ends),
        _sums(_SYMBOL[data], ends),
        np.array([_dup_lines(raw[a:b]) for a, b in zip(starts, ends, strict=True)], np.int64),
        np.array([_repeated(part.hash[a:b]) if b - a > REPEAT_WORDS else 0 for a, b in zip(part.word_at[:-1], part.word_at[1:], strict=True)], np.int64),
        np.array([1 + raw.count(b"\n", a, b) for a, b in zip(starts, ends, strict=True)], np.int64),
        _sums(stutter, part.word_at[1:]),
    ]


_MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stutters")


def measure(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_stutters); no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [_measured(x) for x in slices(batch.column(3))]
            if parts:
                columns = [pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*parts, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), *columns], names=["doc_id", "lang", "source", *_MEASURES])

    rows = docs.select("doc_id", F.col("lang").cast("string"), F.col("source").cast("string"), F.col("text").cast("string"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, lang string, source string, " + ", ".join(f"{x} long" for x in _MEASURES))


def bucket(rate: Column) -> Column:
    """The lower end of a rate's bucket, in 1/UNIT."""
    value = F.floor(rate * UNIT)
    low = F.greatest(F.lit(0), F.length(F.bin(value)) - BITS)
    return F.call_function("shiftleft", F.call_function("shiftright", value, low), low)


def sketch(rated: DataFrame) -> DataFrame:
    """Counts (lang, source, rate, bucket, n) of all rates; sketches merge by adding n."""
    rates = F.explode(F.array(*[F.struct(F.lit(x).alias("rate"), bucket(F.col(x)).alias("bucket")) for x in RATES])).alias("r")
    return rated.select("lang", "source", rates).groupBy("lang", "source", "r.rate", "r.bucket").agg(F.count(F.lit(1)).alias("n"))


def _fences(sketches: DataFrame, keys: list[str], spread: float) -> DataFrame:
    """(keys, rate, total, fence) of merged sketches; a group and rate has some hundred buckets at most."""
    merged = sketches.groupBy(*keys, "rate", "bucket").agg(F.sum("n").alias("n"))
    of_rate = Window.partitionBy(*keys, "rate")
    counted = merged.withColumn("upto", F.sum("n").over(of_rate.orderBy("bucket"))).withColumn("total", F.sum("n").over(of_rate))
    slack = F.lit(None).cast("double")
    for x, value in RATES.items():
        slack = F.when(F.col("rate") == x, F.lit(value)).otherwise(slack)
    at = lambda parts: F.min(F.when(F.col("upto") * parts >= F.col("total"), F.col("bucket"))) / F.lit(float(UNIT))
    quantiles = counted.groupBy(*keys, "rate").agg(F.max("total").alias("total"), at(2).alias("median"), at(10).alias("tenth"))
    return quantiles.select(*keys, "rate", "total", (F.col("median") + spread * (F.col("median") - F.col("tenth")) + slack).alias("fence"))


def judge(measured: DataFrame, spread: float = SPREAD, prior: int = PRIOR) -> DataFrame:
    """Base rules, group fences and the verdict for rows of ``measure``.

    Adds base_failed, the rates, their fences (``*_max``) and kept.  The table
    of fences has a row for each (lang, source); Spark broadcasts it only while
    it is under its own size limit, else it joins by shuffle, where skewed
    groups can be split.
    """
    words = F.col("n_words")
    rated = (
        measured.withColumn("base_failed", (words < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * words))
        .withColumn("symbol_rate", F.when(words > 0, F.col("n_symbols") / words).otherwise(0.0))
        .withColumn("dup_line_rate", F.col("n_dup_lines") / F.col("n_lines"))
        .withColumn("long_word_rate", F.when(words > 0, F.col("word_chars") / words).otherwise(0.0))
        .withColumn("stutter_rate", F.when(words > 0, F.col("n_stutters") / words).otherwise(0.0))
    )
    sketches = durable(sketch(rated.where(~F.col("base_failed"))))
    own, pooled = _fences(sketches, ["lang", "source"], spread), _fences(sketches, ["lang"], spread)
    pooled = pooled.select(F.col("lang").alias("_of"), F.col("rate").alias("_rate"), F.col("fence").alias("_pooled"))
    both = own.join(pooled, F.col("lang").eqNullSafe(F.col("_of")) & (F.col("rate") == F.col("_rate")))
    fence = (F.col("total") * F.col("fence") + float(prior) * F.col("_pooled")) / (F.col("total") + prior)
    fences = both.groupBy(F.col("lang").alias("_lang"), F.col("source").alias("_source")).agg(*[F.max(F.when(F.col("rate") == x, fence)).alias(f"{x}_max") for x in RATES])
    joined = rated.join(fences, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    over = F.lit(False)
    for x in RATES:
        over = over | F.coalesce(F.col(x) > F.col(f"{x}_max"), F.lit(False))
    return joined.drop("_lang", "_source").withColumn("kept", ~F.col("base_failed") & ~over)


def assess(docs: DataFrame, spread: float = SPREAD) -> DataFrame:
    """Measures, fences and verdict of every document.

    The measures are written once (checkpoint) and read twice, so texts are read
    and measured once.
    """
    return judge(durable(measure(docs)), spread)
