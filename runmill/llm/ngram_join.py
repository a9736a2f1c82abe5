"""Exact self-join of documents by Jaccard similarity of their 5-word shingles.

Jaccard distance is a metric, and two documents link at distance 1/4 or less.

Alone.  A document with more than a quarter of its shingles found in no other
set lies farther than 1/4 from every other document.  Shingle hashes are dealt
to ranges in packed blocks, each range finds the hashes that
one set alone has, and the counts add up per set.  A fixed part of the hash
space is enough to prove most documents alone; a second round, over the others
only, takes every hash.  Counts travel packed, a row for each range and bucket of
sets, and only for hashes that are shared.

Regions.  In each remaining set the rarest shingles come first.  Linked sets
share one of their first floor(n/4)+1 shingles, so sets that share such a
shingle, directly or in a chain, form a region, and no link leaves a region.

Voronoi recursion.  A region gets pivots.  Every set is linked to each pivot within
1/4 and belongs to the cell of its nearest one.  By the triangle inequality a
partner y of x, nearest to p, has d(x, p) <= min d(x, .) + 1/2; x is replicated
into the cells of that window, and cells are joined in the same way.  Sets within
1/4 of one pivot are connected through it and are not compared again; a cell that
holds nothing else is done.  Regions of up to ``leaf`` sets do all this in one task,
down to cells of BASE sets.  Larger ones are split over tasks, round by round:
pivots are chosen by an aggregate of ids, and meet the sets of their region in
salted parts, so no task holds a large region.  Cells that hardly shrink (all sets
about equally far from all pivots) are compared set by set; a large one in blocks,
each pair of blocks in one task, where only blocks of similar set sizes meet.

Comparisons count common shingles of many sets at once, as products of incidence
matrices, and return a tree of each connected group, not its pairs.

Equal sets are one set from the start.  Hashes have 64 bits (see words.py).

Cases: a text of fewer than five words is one shingle; texts without words, and
nulls, link with nothing and keep their own id; repeated rows share a component;
rows with a null id take part, and a component has the least id that is not
null; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runmill.llm.components import components
from runmill.llm.durable import durable, parts
from runmill.llm.skew import KEY_DDL, join_unique, row_key
from runmill.llm.words import mix, shingle_sets

SHINGLE = 5
#: Two sets link when 100 * common >= PERCENT * all.
PERCENT = 75
#: Part of the hash space that the first round looks at, in 1/65536.
SAMPLED = 26_214
#: Hashes that a range should hold.
RANGE_HASHES = 1 << 20
#: Sets that one task joins, pivots of a region, and sets of a cell that are compared without pivots.
LEAF, PIVOTS, BASE = 1024, 16, 4
#: Sets that meet their region's pivots in one part.
PART = 4096
#: A cell or a window that keeps more than this share doesn't separate.
SHRINKS = 0.5
#: Set sizes of one band; linked sets differ by a factor of 4/3 at most, so they lie in the same band or in neighbours.
BAND = 1.34

Sets = Iterator[tuple[np.ndarray, list[np.ndarray]]]


def _fingerprint(one: np.ndarray) -> int:
    return int(mix(np.array([mix(one).sum(dtype=np.uint64) + np.uint64(len(one))], np.uint64)).view(np.int64)[0])


def _range_of(h: np.ndarray, ranges: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


def _binaries(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Binary values that are consecutive parts of an array."""
    at = (np.concatenate(([0], ends)) * values.dtype.itemsize).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(at), pa.py_buffer(values.tobytes())]).cast(pa.binary())


def _packed(ids: np.ndarray, sets: list[np.ndarray], ranges: int, sampled: int) -> pa.RecordBatch:
    """A row for each range: ids of the sets that have hashes there, how many, and the hashes."""
    sizes = np.array([len(s) for s in sets], np.int64)
    h = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    if sampled < 1 << 16:
        take = (h & np.uint64(0xFFFF)) < np.uint64(sampled)
        h, owner = h[take], owner[take]
    r = _range_of(h, ranges)
    order = np.argsort(r, kind="stable")
    h, owner, r = h[order], owner[order], r[order]
    # Hashes of one range and set stand together.
    first = np.flatnonzero(np.concatenate(([True], (r[1:] != r[:-1]) | (owner[1:] != owner[:-1])))) if len(h) else np.zeros(0, np.int64)
    n = np.diff(np.append(first, len(h))).astype(np.uint32)
    which, begin = np.unique(r, return_index=True)
    ends, groups = np.append(begin, len(h))[1:], np.append(np.searchsorted(first, begin), len(first))[1:]
    return pa.RecordBatch.from_arrays(
        [pa.array(which, pa.int64()), _binaries(ids[owner[first]], groups), _binaries(n, groups), _binaries(h, ends)], names=["range", "ids", "counts", "hashes"]
    )


def _joined(column: pa.ChunkedArray, dtype: type) -> np.ndarray:
    """The values of all rows of a binary column, one after the other, without a copy of each."""
    parts = []
    for chunk in column.chunks:
        chunk = chunk.cast(pa.large_binary())
        at = np.frombuffer(chunk.buffers()[1], np.int64)[chunk.offset : chunk.offset + len(chunk) + 1]
        if len(chunk) and at[-1] > at[0]:
            parts.append(np.frombuffer(chunk.buffers()[2], np.uint8)[at[0] : at[-1]].view(dtype))
    return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, dtype)


def _unpacked(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(hash, id) of all blocks of a range, by hash and then id."""
    ids = np.repeat(_joined(table["ids"], np.int64), _joined(table["counts"], np.uint32))
    h = _joined(table["hashes"], np.uint64)
    order = np.lexsort((ids, h))
    return h[order], ids[order]


def _repeated(table: pa.Table, buckets: int) -> pa.Table:
    """How many hashes of the range each set shares with others, packed into a row for each bucket of sets."""
    h, ids = _unpacked(table)
    new = np.concatenate(([True], (h[1:] != h[:-1]) | (ids[1:] != ids[:-1])))
    h, ids = h[new], ids[new]
    same = h[1:] == h[:-1]
    shared = np.concatenate(([False], same)) | np.concatenate((same, [False]))
    some, n = np.unique(ids[shared], return_counts=True)
    bucket = (mix(some.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    some, n, bucket = some[order], n[order].astype(np.uint32), bucket[order]
    which, at = np.unique(bucket, return_index=True)
    ends = np.append(at, len(bucket))[1:]
    return pa.table({"bucket": which, "ids": _binaries(some, ends), "counts": _binaries(n, ends)})


def _summed(table: pa.Table) -> pa.Table:
    ids, n = _joined(table["ids"], np.int64), _joined(table["counts"], np.uint32).astype(np.int64)
    some, at = np.unique(ids, return_inverse=True)
    total = np.zeros(len(some), np.int64)
    np.add.at(total, at, n)
    return pa.table({"id": some, "shared": total})


def _shared(table: pa.Table) -> pa.Table:
    """The hashes of the range that two sets or more have: (id, hash, sets that have it)."""
    h, ids = _unpacked(table)
    new = np.concatenate(([True], (h[1:] != h[:-1]) | (ids[1:] != ids[:-1])))
    h, ids = h[new], ids[new]
    begin = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
    n = np.diff(np.append(begin, len(h)))
    df = np.repeat(n, n)
    many = df > 1
    return pa.table({"id": ids[many], "hash": h[many].view(np.int64), "df": df[many].astype(np.int64)})


def _by_range(rows: DataFrame, read: Callable[[Iterator[pa.RecordBatch]], Sets], total: int, sampled: int) -> tuple[DataFrame, int]:
    """Packed hashes, a row for each batch and range, and the number of ranges."""
    ranges = max(1, math.ceil(total * sampled / (1 << 16) / RANGE_HASHES))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sets in read(batches):
            yield _packed(ids, sets, ranges, sampled)

    return rows.mapInArrow(deal, "range long, ids binary, counts binary, hashes binary"), ranges


def _not_alone(sets: DataFrame, dealt: tuple[DataFrame, int]) -> DataFrame:
    """Sets (id, n, looked: hashes that were dealt) that may have a partner: those of which enough is shared."""
    rows, buckets = dealt
    counts = rows.groupBy("range").applyInArrow(lambda t: _repeated(t, buckets), "bucket long, ids binary, counts binary")
    shared = counts.groupBy("bucket").applyInArrow(_summed, "id long, shared long")
    alone = F.col("looked") - F.coalesce("shared", F.lit(0))
    return sets.join(shared, "id", "left").where(100 * (F.col("n") - alone) >= PERCENT * F.col("n")).drop("shared", "looked")


def _sets_of_texts(batches: Iterator[pa.RecordBatch], shingle: int) -> Sets:
    for batch in parts(batches, 1024):
        sets = list(shingle_sets(batch.column(0), shingle))
        yield np.array([_fingerprint(s) for s in sets], np.int64), sets


def _sets_of_rows(batches: Iterator[pa.RecordBatch]) -> Sets:
    for batch in parts(batches, 1024):
        yield batch.column(0).to_numpy(), [np.frombuffer(x, np.uint64) for x in batch.column(1).to_pylist()]


def _common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of two lists of sets."""
    out = np.zeros((len(left), len(right)), np.float32)
    a, b = np.concatenate(left), np.concatenate(right)
    ra, rb = np.repeat(np.arange(len(left)), [len(s) for s in left]), np.repeat(np.arange(len(right)), [len(s) for s in right])
    both = np.intersect1d(a, b)
    ia, ib = np.searchsorted(both, a), np.searchsorted(both, b)
    for i, h, r in ((ia, a, ra), (ib, b, rb)):
        i[i == len(both)] = 0
    oka, okb = (both[ia] == a, both[ib] == b) if len(both) else (np.zeros(len(a), bool), np.zeros(len(b), bool))
    ia, ra, ib, rb = ia[oka], ra[oka], ib[okb], rb[okb]
    oa, ob = np.argsort(ia, kind="stable"), np.argsort(ib, kind="stable")
    ia, ra, ib, rb = ia[oa], ra[oa], ib[ob], rb[ob]
    step = 4096
    for at in range(0, len(both), step):
        parts = []
        for i, r, n in ((ia, ra, len(left)), (ib, rb, len(right))):
            s, e = np.searchsorted(i, (at, at + step))
            m = np.zeros((n, min(step, len(both) - at)), np.float32)
            m[r[s:e], i[s:e] - at] = 1
            parts.append(m)
        out += parts[0] @ parts[1].T
    return np.rint(out).astype(np.int64)


def _linked(common: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 100 * common >= PERCENT * (n[:, None] + m[None, :] - common)


def _tree(ids: np.ndarray, u: np.ndarray, v: np.ndarray) -> pa.Table:
    """Each connected group of pairs (positions u, v) as edges to its least position."""
    root = np.arange(len(ids))
    while len(u):
        before = root.copy()
        low = np.minimum(root[u], root[v])
        np.minimum.at(root, u, low)
        np.minimum.at(root, v, low)
        root = root[root]
        if (root == before).all():
            break
    at = np.flatnonzero(root != np.arange(len(ids)))
    return pa.table({"a": ids[at], "b": ids[root[at]]})


class _Region:
    """Sets of one task, and the links found among them."""

    def __init__(self, ids: np.ndarray, sets: list[np.ndarray], label: np.ndarray, pivots: int):
        self.ids, self.sets, self.label, self.pivots = ids, sets, label, pivots
        self.size = np.array([len(s) for s in sets], np.int64)
        self.us: list[np.ndarray] = []
        self.vs: list[np.ndarray] = []

    def compare(self, left: np.ndarray, right: np.ndarray) -> None:
        """All pairs of two lists but those that are connected through one pivot."""
        size, label = self.size, self.label
        for i in range(0, len(left), 256):
            rows = left[i : i + 256]
            # Only sizes within the ratio can link.
            cols = right[(size[right] * 100 >= PERCENT * size[rows].min()) & (size[rows].max() * 100 >= PERCENT * size[right])]
            if not len(cols):
                continue
            near = _linked(_common([self.sets[j] for j in rows], [self.sets[j] for j in cols]), size[rows], size[cols])
            near &= (label[rows][:, None] != label[cols][None, :]) | (label[rows][:, None] == 0)
            r, c = np.nonzero(near)
            self.us.append(rows[r])
            self.vs.append(cols[c])

    def join(self, at: np.ndarray, round_: int = 0) -> None:
        """Pivots, cells with their windows, and the cells in the same way."""
        label = self.label[at]
        if len(at) < 2 or (label[0] != 0 and (label == label[0]).all()):
            return
        if len(at) <= BASE:
            self.compare(at, at)
            return
        pivots = at[np.argsort(mix(self.ids[at].view(np.uint64) + np.uint64(round_)))[: min(self.pivots, math.isqrt(len(at)))]]
        distance, linked = _to_pivots([self.sets[i] for i in at], [self.sets[i] for i in pivots])
        r, c = np.nonzero(linked)
        self.us.append(at[r])
        self.vs.append(pivots[c])
        nearest = np.where(linked, distance, 2.0).argmin(1)
        some = linked.any(1)
        self.label[at[some]] = self.ids[pivots[nearest[some]]]
        window = distance <= distance.min(1, keepdims=True) + 0.5 + 1e-9
        if window.mean() > SHRINKS and len(pivots) > 1:
            label = self.label[at]
            if label[0] == 0 or (label != label[0]).any():
                self.compare(at, at)
            return
        for cell in window.T:
            inside = at[cell]
            if len(inside) > 0.9 * len(at):
                self.compare(inside, inside)
            else:
                self.join(inside, round_ + 1)

    def tree(self) -> pa.Table:
        u, v = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (self.us, self.vs))
        return _tree(self.ids, u, v)


def _to_pivots(sets: list[np.ndarray], pivots: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distances to the pivots, and which are within 1/4."""
    n, m = (np.array([len(s) for s in x], np.int64) for x in (sets, pivots))
    common = _common(sets, pivots)
    return 1 - common / (n[:, None] + m[None, :] - common), _linked(common, n, m)


def _loaded(table: pa.Table, pivots: int) -> tuple[_Region, np.ndarray]:
    """The sets of a group, each once, and their ``half``."""
    table = table.combine_chunks()
    ids, first = np.unique(table["id"].to_numpy(), return_index=True)
    table = table.take(pa.array(first))
    sets = [np.frombuffer(x, np.uint64) for x in table["hashes"].to_pylist()]
    return _Region(ids, sets, table["pivot"].fill_null(0).to_numpy().copy(), pivots), table["half"].to_numpy()


def _leaf(table: pa.Table, pivots: int) -> pa.Table:
    """Join one region."""
    region, _ = _loaded(table, pivots)
    region.join(np.arange(len(region.ids)))
    return region.tree()


def _blocks(table: pa.Table) -> pa.Table:
    """Compare two blocks (column ``half``: 0 and 1), or one with itself (all 0)."""
    region, half = _loaded(table, 0)
    left = np.flatnonzero(half == 0)
    region.compare(left, np.flatnonzero(half == 1) if half.any() else left)
    return region.tree()


def _to_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with their region's pivots become rows of cells, and links to pivots."""
    kinds = {"hashes": pa.binary(), "nearest": pa.bool_()}
    for batch in parts(batches, 256):
        regions = batch.column(0).to_numpy()
        for region in np.unique(regions):
            rows = np.flatnonzero(regions == region)
            part = batch.take(pa.array(rows))
            pivots = part.column(4)[0].as_py()
            names = np.array([p["id"] for p in pivots], np.int64)
            ids, raw = part.column(1).to_numpy(), part.column(2).to_pylist()
            distance, linked = _to_pivots([np.frombuffer(x, np.uint64) for x in raw], [np.frombuffer(p["hashes"], np.uint64) for p in pivots])
            label = part.column(3).fill_null(0).to_numpy().copy()
            some = linked.any(1)
            label[some] = names[np.where(linked, distance, 2.0).argmin(1)[some]]
            r, c = np.nonzero(linked)
            r, c = r[ids[r] != names[c]], c[ids[r] != names[c]]
            out = {"parent": [region] * len(r), "region": [None] * len(r), "id": ids[r], "hashes": [None] * len(r), "pivot": [None] * len(r), "nearest": [None] * len(r), "link": names[c]}
            yield pa.RecordBatch.from_arrays([pa.array(x, kinds.get(k, pa.int64())) for k, x in out.items()], names=list(out))
            r, c = np.nonzero(distance <= distance.min(1, keepdims=True) + 0.5 + 1e-9)
            cells = mix(np.uint64(region.astype(np.uint64)) + np.arange(1, len(names) + 1, dtype=np.uint64)).view(np.int64)
            pivot = pa.array(label[r], mask=label[r] == 0)
            out = {"parent": [region] * len(r), "region": cells[c], "id": ids[r], "hashes": [raw[i] for i in r], "pivot": pivot, "nearest": distance.argmin(1)[r] == c, "link": [None] * len(r)}
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, kinds.get(k, pa.int64())) for k, x in out.items()], names=list(out))


_ITEM = ["region", "id", "hashes", "pivot"]
_EDGE = "a long, b long"


def _in_blocks(sets: DataFrame, leaf: int) -> DataFrame:
    """Links of regions (rows _ITEM) that pivots don't separate, by pairs of blocks of similar set sizes."""
    banded = sets.select(*_ITEM, F.floor(F.log(F.octet_length("hashes") / 8) / math.log(BAND)).cast("int").alias("band"))
    bands = durable(banded.groupBy("region", "band").agg(F.count(F.lit(1)).alias("rows")).withColumn("blocks", F.ceil(F.col("rows") / max(1, leaf // 2)).cast("int")))
    own = bands.select("region", "band", F.explode(F.expr("sequence(0, blocks - 1)")).alias("sub"))
    other = own.select("region", F.col("band").alias("band2"), F.col("sub").alias("sub2"))
    met = own.withColumn("band2", F.explode(F.array("band", F.col("band") + 1))).join(other, ["region", "band2"]).where("band2 > band OR sub2 >= sub")
    pair = ["region", "lo", "lo_sub", "hi", "hi_sub"]
    sides = met.select("region", F.col("band").alias("lo"), F.col("sub").alias("lo_sub"), F.col("band2").alias("hi"), F.col("sub2").alias("hi_sub"))
    members = sides.select(*pair, F.col("lo").alias("band"), F.col("lo_sub").alias("sub"), F.lit(0).alias("half")).unionByName(
        sides.where("lo != hi OR lo_sub != hi_sub").select(*pair, F.col("hi").alias("band"), F.col("hi_sub").alias("sub"), F.lit(1).alias("half"))
    )
    placed = join_unique(banded, bands, ["region", "band"], "rows").withColumn("sub", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    return placed.join(members, ["region", "band", "sub"]).select(*pair, "id", "hashes", "pivot", "half").groupBy(*pair).applyInArrow(_blocks, _EDGE)


def _region_links(items: DataFrame, leaf: int, pivots: int, max_rounds: int = 12) -> list[DataFrame]:
    """Links that connect every group of linked sets of (region, id, hashes, pivot)."""
    links = []
    items = items.withColumn("blocked", F.lit(False))
    for round_ in range(max_rounds + 1):
        # Pivots: the sets of the least of so many hashes of their ids.
        least = F.array_distinct(F.array(*[F.min(F.struct(F.xxhash64("id", F.lit(round_), F.lit(j)).alias("h"), "id"))["id"] for j in range(pivots)]))
        sizes = durable(
            items.groupBy("region").agg(
                F.count(F.lit(1)).alias("n"),
                # Done: all within 1/4 of one pivot.
                ((F.count("pivot") == F.count(F.lit(1))) & (F.min("pivot") == F.max("pivot"))).alias("done"),
                least.alias("chosen"),
            )
        )
        todo = sizes.where("n > 1 AND NOT done")
        sized = join_unique(items, todo.drop("chosen", "done"), ["region"], "n")
        large, small = F.col("n") > leaf, F.col("n") <= leaf
        links.append(durable(sized.where(small).withColumn("half", F.lit(0)).groupBy("region").applyInArrow(lambda t: _leaf(t, pivots), _EDGE)))
        if todo.where(large).isEmpty():
            break
        blocked = F.lit(True) if round_ == max_rounds else F.col("blocked")
        links.append(durable(_in_blocks(sized.where(large & blocked), leaf)))
        n_parts = F.ceil(F.col("n") / PART).cast("int")
        open_ = sized.where(large & ~blocked).withColumn("part", F.pmod(F.xxhash64("id"), n_parts).cast("int"))
        wanted = todo.where(large).select("region", n_parts.alias("parts"), F.explode("chosen").alias("id"))
        chosen = (
            open_.join(wanted, ["region", "id"])
            .groupBy("region", "parts")
            .agg(F.collect_list(F.struct("id", "hashes")).alias("pivots"))
            .select("region", F.explode(F.expr("sequence(0, parts - 1)")).alias("part"), "pivots")
        )
        cells = durable(
            open_.join(chosen, ["region", "part"])
            .select(*_ITEM, "pivots")
            .mapInArrow(_to_cells, "parent long, region long, id long, hashes binary, pivot long, nearest boolean, link long")
        )
        links.append(cells.where("link IS NOT NULL").select(F.col("id").alias("a"), F.col("link").alias("b")))
        # Where most sets are in most cells, the pivots don't separate them.
        spread = durable(cells.where("region IS NOT NULL").groupBy("parent").agg(F.count(F.lit(1)).alias("rows"), (F.count(F.lit(1)) > SHRINKS * pivots * F.sum(F.col("nearest").cast("int"))).alias("blocked")))
        known = join_unique(cells.where("region IS NOT NULL"), spread, ["parent"], "rows")
        items = durable(
            known.where("NOT blocked").select(*_ITEM, "blocked").unionByName(known.where("blocked AND nearest").select(F.col("parent").alias("region"), "id", "hashes", "pivot", "blocked"))
        )
    return links


#: Of the rows of a component the one of least id comes first, ids that are null last.
_RANK = "struct(doc_id IS NULL AS no_id, doc_id, key)"


def join_documents(docs: DataFrame, shingle: int = SHINGLE, leaf: int = LEAF, pivots: int = PIVOTS) -> DataFrame:
    """Rows (doc_id, key, n_shingles, component_id, first); key has two hashes of id and text and tells rows apart.

    first marks the one row of a component that stands for it (and its repetitions, of equal key).
    """
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("key", row_key("doc_id", "text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, 1024):
            sets = list(shingle_sets(batch.column(2), shingle))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([_fingerprint(s) if len(s) else None for s in sets], pa.int64()),
                    pa.array([int(((s & np.uint64(0xFFFF)) < np.uint64(SAMPLED)).sum()) for s in sets], pa.int64()),
                ],
                names=["doc_id", "key", "n", "id", "looked"],
            )

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, 1024):
            sets = list(shingle_sets(batch.column(1), shingle))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "n", "hashes"])

    known = durable(rows.select("doc_id", "key", "text").mapInArrow(sizes, f"doc_id {id_type}, key {KEY_DDL}, n long, id long, looked long"))
    classes = durable(known.where("id IS NOT NULL").groupBy("id").agg(F.min(F.expr(_RANK)).alias("least"), F.min("key").alias("key"), F.first("n").alias("n"), F.first("looked").alias("looked"), F.count(F.lit(1)).alias("copies")))
    total = known.agg(F.sum("n")).first()[0] or 0

    first = _not_alone(classes, _by_range(rows.select("text"), lambda x: _sets_of_texts(x, shingle), total, SAMPLED))
    sets = durable(
        rows.select("key", "text")
        .join(first.select("key", "id").hint("shuffle_hash"), "key")
        .select("id", "text")
        .dropDuplicates(["id"])
        .mapInArrow(hashes, "id long, n long, hashes binary")
    )
    left = sets.agg(F.sum("n")).first()[0] or 0
    sets = durable(_not_alone(sets.withColumn("looked", F.col("n")), _by_range(sets.select("id", "hashes"), _sets_of_rows, left, 1 << 16)))
    left = sets.agg(F.sum("n")).first()[0] or 0

    # Rarest first: hashes of one set alone, then by number of sets and hash.
    shared = _by_range(sets.select("id", "hashes"), _sets_of_rows, left, 1 << 16)[0].groupBy("range").applyInArrow(_shared, "id long, hash long, df long")
    ordered = shared.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("df", "hash"))).alias("order")).join(sets.select("id", "n"), "id")
    prefix = durable(ordered.select("id", F.explode(F.expr("slice(order, 1, CAST(greatest(0, n div 4 + 1 - (n - size(order))) AS INT)).hash")).alias("hash")))
    centres = durable(prefix.groupBy("hash").agg(F.min("id").alias("centre"), F.max("id").alias("other"), F.count(F.lit(1)).alias("sets")).where("centre != other"))
    chains = join_unique(prefix, centres, ["hash"], "sets").where("id != centre").select(F.col("id").alias("a"), F.col("centre").alias("b"))
    regions = components(chains)
    items = durable(sets.join(regions, "id").select(F.col("root").alias("region"), "id", "hashes", F.lit(None).cast("long").alias("pivot")))

    links = None
    for part in _region_links(items, leaf, pivots):
        links = part if links is None else links.unionByName(part)
    roots = components(links)
    member = classes.select("id", "least", "copies").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    least = durable(member.groupBy("root").agg(F.min("least").alias("least"), F.count(F.lit(1)).alias("sets")))
    named = join_unique(member.select("id", "root", "copies"), least, ["root"], "sets").select("id", "copies", F.col("least.doc_id").alias("component_id"), F.col("least.key").alias("stands"))
    return join_unique(known, durable(named), ["id"], "copies", "left").select(
        "doc_id",
        "key",
        F.col("n").alias("n_shingles"),
        F.coalesce("component_id", "doc_id").alias("component_id"),
        F.coalesce(F.col("key") == F.col("stands"), F.lit(True)).alias("first"),
    )


def one_of_each(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with one document of each component: that of least id.  Repeated rows count as one."""
    joined = join_documents(docs, **how)
    gone = joined.where("NOT first").select("key").distinct()
    keyed = docs.select(row_key("doc_id", F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("key"), F.struct("*").alias("row"))
    return keyed.join(gone, "key", "left_anti").dropDuplicates(["key"]).select("row.*")
