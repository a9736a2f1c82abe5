"""Mixing sources to target weights by Pfair scheduling (DataFrame functions only).

Rows of a source are cut into blocks of ``block_rows``.  With target weight w,
block k (from 0) of a source may start at slot ``floor(k / w)`` (its release)
and must end by slot ``ceil((k + 1) / w)`` (its deadline).  Slots are given
earliest-deadline-first among the released blocks.  The weights sum to 1, so
every block runs inside its window and, after any number of slots t, a source
has had w * t blocks up to less than one block.

Weights are integers over their sum: given ones exactly (0.6 is 3/5), as far as
the sum stays under WEIGHT_SUM, to which others are rounded.  Slots are scheduled
in chunks that don't wait for each other, with SQL higher-order functions on a
row each.  Which blocks are done where a chunk begins is told without the slots
before it: of a source's blocks those whose share is over, and as many of the
blocks under way as fill the slots.  For any b, those of them that end by b must
not be too many for the slots up to b, so blocks are taken at the first b that
asks for them, those released first before others; this leaves every block a
slot inside its window on either side.  A chunk is longer than any window.

Sources end at different times.  A slot of a source that has run out is left
out and the later ones move up; the rows of the other sources keep the order
and the proportions among them.  No row is dropped or repeated.

Cases: rows with a null source form one source of their own; an empty table
gives an empty result; repeated rows are kept and get different positions;
further columns pass through unchanged, whatever their names, but for those that
``mix_rows`` adds itself, which it replaces.  A chunk is as long as twice the
inverse of the least weight, so its cost grows with that.
"""

from __future__ import annotations

from fractions import Fraction
from math import gcd, lcm

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runmill.llm.durable import durable, size_in_bytes
from runmill.llm.skew import row_key

#: Slots that are scheduled in one row, at least.
CHUNK = 1000
#: Tasks of the schedule.
CHUNK_TASKS = 64
#: What the integer weights sum to at most, so that block numbers times it fit 63 bits.
WEIGHT_SUM = 1 << 31
#: Rows of a source that stay together.
BLOCK_ROWS = 8
#: Without given weights, a source's target weight is its number of rows to this power.
ALPHA = 0.5
#: Rows of a source are ranked in ranges of their hash, of so many rows, and in so many ranges at least.
RANGE_ROWS, RANGES = 1 << 16, 256
#: Bytes of a partition in the order of the mix, rows that are worth one, and rows that it has at least by its bytes.
PART_BYTES, PART_ROWS, LEAST_ROWS = 128 << 20, 1 << 10, 1 << 6


def _whole(weights: dict[str | None, float]) -> dict[str | None, int]:
    """Weights as integers in the same proportions, exact if they sum to WEIGHT_SUM at most."""
    exact = {k: Fraction(str(w)) for k, w in weights.items()}
    over = lcm(*[w.denominator for w in exact.values()])
    whole = {k: int(w * over) for k, w in exact.items()}
    common = gcd(*whole.values())
    whole = {k: w // common for k, w in whole.items()}
    total = sum(whole.values())
    return whole if total <= WEIGHT_SUM else {k: max(1, w * (WEIGHT_SUM - len(whole)) // total) for k, w in whole.items()}


def _sources(keys: DataFrame, weights: dict[str | None, float] | None, alpha: float) -> DataFrame:
    """(_mix_source, _mix_n, _mix_q, _mix_total): rows and integer weight of each source, and the sum of the weights."""
    counts = keys.groupBy("_mix_source").agg(F.count(F.lit(1)).alias("_mix_n"))
    # The table has a row a source.
    all_rows = Window.partitionBy(F.lit(1))
    if weights is None:
        w: Column = F.pow(F.col("_mix_n").cast("double"), F.lit(float(alpha)))
        q = F.greatest(F.lit(1), F.floor(w / F.sum(w).over(all_rows) * (WEIGHT_SUM >> 1))).cast("long")
    else:
        if any(not w > 0 for w in weights.values()):
            raise ValueError("target weights must be positive")
        q = F.lit(None).cast("long")
        for name, whole in _whole(weights).items():
            q = F.when(F.col("_mix_source") == F.lit("-" if name is None else f"+{name}"), F.lit(whole).cast("long")).otherwise(q)
        q = F.coalesce(q, F.raise_error(F.concat(F.lit("no target weight for source "), F.col("_mix_source"))).cast("long"))
    return counts.select("_mix_source", "_mix_n", q.alias("_mix_q")).withColumn("_mix_total", F.sum("_mix_q").over(all_rows))


def _done(t: str) -> str:
    """SQL: the blocks of each source of ``src`` that are done at slot ``t``, where a chunk begins."""
    fluid = f"{t} * x._mix_q div total"
    #: The blocks under way: release, number of the source, deadline.
    under = f"""filter(transform(src, (x, i) -> struct(({fluid}) * total div x._mix_q AS r, i AS i, (({fluid} + 1) * total + x._mix_q - 1) div x._mix_q AS d, {t} * x._mix_q % total AS f)), y -> y.f > 0)"""
    more = "concat(u, slice(array_sort(array_except({0}, u)), 1, CAST({1} - size(u) AS INT)))".format
    ask = "(s.c - b + aggregate(src, 0L, (n, x) -> n + b * x._mix_q div total))"
    taken = f"""aggregate(sequence({t} + 1, coalesce(array_max(transform(s.under, y -> y.d)), {t} + 1)), filter(s.under, y -> false),
        (u, b) -> IF({ask} > size(u), {more("filter(s.under, y -> y.d <= b)", ask)}, u),
        u -> transform({more("s.under", "s.c")}, y -> y.i))"""
    return f"""transform(transform(array(struct({under} AS under, {t} - aggregate(src, 0L, (n, x) -> n + {fluid}) AS c)), s -> {taken}),
        took -> transform(src, (x, i) -> {fluid} + IF(array_contains(took, i), 1L, 0L)))[0]"""


def _schedule(sources: DataFrame, block_rows: int) -> DataFrame:
    """The slot of every block, earliest deadline first: (_mix_source, _mix_block, _mix_release, _mix_deadline, _mix_slot, _mix_before).

    _mix_before is the number of rows in the slots before.  Windows are computed
    in integers: release k*total div q, deadline ((k+1)*total + q-1) div q.
    """
    one = sources.agg(F.array_sort(F.collect_list(F.struct("_mix_source", "_mix_n", "_mix_q"))).alias("src"), F.max("_mix_total").alias("total")).where(F.size("src") > 0)
    size = f"greatest({CHUNK}L, 2 * ((total + array_min(transform(src, x -> x._mix_q)) - 1) div array_min(transform(src, x -> x._mix_q))) + 2)"
    # Deadline of the last block of all.
    end = f"array_max(transform(src, x -> (((x._mix_n + {block_rows - 1}) div {block_rows}) * total + x._mix_q - 1) div x._mix_q))"
    chunks = (
        one.withColumn("size", F.expr(size))
        .withColumn("m", F.explode(F.expr(f"sequence(0L, ({end} - 1) div size)")))
        .repartition(CHUNK_TASKS, "m")
        .withColumn("first", F.expr("m * size"))
        .withColumn("begin", F.expr(_done("first")))
        .withColumn("finish", F.expr(_done("(first + size)")))
    )
    released = "done[i] < finish[i] AND done[i] * total div src[i]._mix_q <= t"
    deadline = "((done[i] + 1) * total + src[i]._mix_q - 1) div src[i]._mix_q"
    pick = f"array_min(transform(sequence(0, size(src) - 1), i -> CASE WHEN {released} THEN struct({deadline} AS d, i AS i) END)).i"
    # acc.picks: source and block of each slot so far; acc.done: blocks given to each source so far.
    step = f"""
        aggregate(
          sequence(first, first + size - 1),
          named_struct('done', begin, 'picks', CAST(array() AS ARRAY<STRUCT<i: INT, k: BIGINT, t: BIGINT>>)),
          (acc, t) -> transform(array(transform(array(acc.done), done -> {pick})[0]), p ->
            named_struct('done', transform(acc.done, (d, j) -> IF(j = p, d + 1, d)), 'picks', concat(acc.picks, array(struct(p AS i, acc.done[p] AS k, t AS t)))))[0],
          acc -> acc.picks)
    """
    rows_up_to = f"least(x._mix_n, {{0}} * {block_rows})".format
    slots = (
        chunks.withColumn("ahead", F.expr(f"aggregate(zip_with(src, begin, (x, d) -> {rows_up_to('d')}), 0L, (n, c) -> n + c)"))
        .withColumn("picks", F.expr(step))
        # Slots of sources that have run out are left out.
        .select("m", "ahead", "total", F.explode(F.expr(f"filter(transform(picks, y -> struct(src[y.i] AS x, y.k AS k, y.t AS t)), y -> y.k * {block_rows} < y.x._mix_n)")).alias("y"))
        .select("m", "ahead", "total", "y.x", "y.k", "y.t")
    )
    earlier = Window.partitionBy("m").orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    held = F.expr(f"least({block_rows}, x._mix_n - k * {block_rows})")
    return slots.select(
        F.col("x._mix_source").alias("_mix_source"),
        F.col("k").alias("_mix_block"),
        F.expr("k * total div x._mix_q").alias("_mix_release"),
        F.expr("((k + 1) * total + x._mix_q - 1) div x._mix_q").alias("_mix_deadline"),
        F.col("t").alias("_mix_slot"),
        (F.col("ahead") + F.coalesce(F.sum(held).over(earlier), F.lit(0))).alias("_mix_before"),
    )


def mix_rows(
    docs: DataFrame,
    weights: dict[str | None, float] | None = None,
    alpha: float = ALPHA,
    block_rows: int = BLOCK_ROWS,
    carry: list[str] | None = None,
) -> DataFrame:
    """``docs`` (or the columns ``carry`` of it) with _mix_block, _mix_release, _mix_deadline, _mix_slot and _mix_position.

    Inside a source rows stand in the order of a hash.  _mix_slot is the slot of
    the row's block if no source ever ran out, _mix_release and _mix_deadline
    are the block's window; _mix_position numbers all rows from 0 without gaps.

    Rows are ranked by (source, hash range), ranges of about RANGE_ROWS rows, so a
    source with a third of all rows is spread over many groups.  The schedule has
    a row a block and is joined by source and block; carry little.
    """
    if block_rows < 1:
        raise ValueError("block_rows must be positive")
    added = ["_mix_block", "_mix_release", "_mix_deadline", "_mix_slot", "_mix_position"]
    carried = [c for c in (docs.columns if carry is None else carry) if c not in added] or ["doc_id"]
    hash_ = F.xxhash64(F.lit("mix"), "doc_id", F.xxhash64("text"))
    source = F.coalesce(F.concat(F.lit("+"), F.col("source").cast("string")), F.lit("-"))
    keys = docs.select(source.alias("_mix_source"), F.shiftrightunsigned(hash_, 40).alias("_mix_high"))
    sources = _sources(keys, weights, alpha)
    # Bits of the hash that name a range, by the size of the source: all sources have RANGES at least.  A row a source.
    bits = F.least(F.lit(24), F.greatest(F.lit(RANGES.bit_length() - 1), F.ceil(F.log2(F.col("_mix_n") / RANGE_ROWS)))).cast("int")
    ranged = F.broadcast(sources.select("_mix_source", bits.alias("_mix_bits")))
    range_of = "shiftrightunsigned({0}, {1} - _mix_bits)".format
    earlier = Window.partitionBy("_mix_source").orderBy("_mix_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = keys.join(ranged, "_mix_source").groupBy("_mix_source", F.expr(range_of("_mix_high", 24)).alias("_mix_range")).agg(F.count(F.lit(1)).alias("c"))
    offsets = counts.select("_mix_source", "_mix_range", F.coalesce(F.sum("c").over(earlier), F.lit(0)).alias("_mix_from"))
    rows = docs.select(F.struct(*carried).alias("_mix_row"), F.col("doc_id").alias("_mix_id"), source.alias("_mix_source"), hash_.alias("_mix_hash"))
    rows = rows.join(ranged, "_mix_source").withColumn("_mix_range", F.expr(range_of("_mix_hash", 64)))
    # With the sign turned, hashes are in the order of their high bits.
    within = Window.partitionBy("_mix_source", "_mix_range").orderBy(F.col("_mix_hash").bitwiseXOR(F.lit(-(1 << 63))), "_mix_id")
    placed = (
        rows.withColumn("_mix_rank", F.row_number().over(within))
        .join(offsets, ["_mix_source", "_mix_range"])
        .withColumn("_mix_index", F.col("_mix_from") + F.col("_mix_rank") - 1)
        .withColumn("_mix_block", F.expr(f"_mix_index div {block_rows}"))
        .join(_schedule(sources, block_rows), ["_mix_source", "_mix_block"])
    )
    return placed.select(
        *[F.col(f"_mix_row.`{c}`") for c in carried],
        "_mix_block",
        "_mix_release",
        "_mix_deadline",
        "_mix_slot",
        F.expr(f"_mix_before + _mix_index % {block_rows}").cast("long").alias("_mix_position"),
    )


def mix_order(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with the same rows and columns, in the order of the mix.

    Places are found for keys of rows alone and written; then each row meets its
    place by its key (rows of equal keys take theirs in any order) and goes to the
    partition that the place names, where rows are sorted.  Files written from it
    hold consecutive pieces of the mix.
    """
    keyed = docs.select("doc_id", "text", "source", F.struct("*").alias("_whole")).withColumn("_key", row_key("doc_id", "text", "source"))
    same = Window.partitionBy("_key")
    places = durable(mix_rows(keyed, carry=["_key"], **how).select("_key", "_mix_position").withColumn("_copy", F.row_number().over(same.orderBy("_mix_position"))))
    n = places.count()
    # The size is an estimate, and a great one where nothing is known.
    by_size = min(-(-size_in_bytes(docs) // PART_BYTES), -(-n // LEAST_ROWS))
    parts = max(1, by_size, min(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // PART_ROWS)))
    each = max(1, -(-n // parts))
    # Nearly all keys have one row, which needs no more than the join by its key.
    by_key = places.groupBy("_key").agg(F.min("_mix_position").alias("_mix_position"), F.count(F.lit(1)).alias("_copies"))
    met = keyed.select("_key", "_whole").join(by_key, "_key")
    many = met.where("_copies > 1").drop("_mix_position").withColumn("_copy", F.row_number().over(same.orderBy(F.lit(1)))).join(places, ["_key", "_copy"])
    rows = met.where("_copies = 1").select("_whole", "_mix_position").unionByName(many.select("_whole", "_mix_position"))
    return rows.repartitionById(parts, F.expr(f"CAST(_mix_position div {each} AS INT)")).sortWithinPartitions("_mix_position").select("_whole.*")
