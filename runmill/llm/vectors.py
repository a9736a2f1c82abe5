"""Near-duplicate vectors by product quantisation.

Vectors are normalised.  On a bounded sample coarse centroids are fitted, and
for the residuals (vector minus centroid) a small code book for each subspace.
Every vector is filed under its nearest centroid within its label, with its
residual's codes.  Every distinct vector is also a query: it probes the lists
where a linked vector can lie, and a table of squared distances from the query's
residual to the code words gives, by look-ups and sums, its distance to each filed
vector.  Pairs whose estimate is near enough to the wanted cosine, with a margin
for the coding error, are reranked by their exact cosine in double precision; only
pairs that reach it are linked.

The margin of a pair is the coding error of the filed vector, which is known
when it is filed: by the triangle inequality no pair in a probed list is lost.

Lists.  Their number grows with the square root of the vectors of the largest
label, up to an eighth of the sample.  A linked vector is x = cos(t) q + sin(t) u
with u across q.  It lies in list j, not in the query's own list i, only if it is
nearer to centroid j; so far as u leans along the line of the two centroids, this
is a bound on the query's distances alone.  In a space of d dimensions a direction
that has nothing to do with the centroids leans ``sigmas`` / sqrt(d - 1) along
that line or less, with the probability of that many standard deviations.  Lists
that no x reaches even so aren't probed.  ``sigmas=None`` takes the full cap of all
u, which loses no pair but prunes little where vectors have no clusters.  Recall
is measured against brute force in the tests.

A block returns how many rows each of its queries links with and a spanning tree
of each of its components, not its pairs; so a group of near copies costs rows
in proportion to its size.

Equal vectors of a label are one filed vector with a count, so a group of copies
costs one row.  Lists are cut into blocks of ``block_rows`` filed vectors and
query blocks meet them one by one: a task holds one block of each, however large
a list is.

Vectors link with those of their own length only, and each length has quantisers of
its own; one that isn't in the sample (a rare one, then) has a single list without
codes, where every pair is reranked.

Cases: null labels, null vectors, vectors with a null or non-finite component and
zero vectors link with nothing; each still gets its row.  Repeated rows and equal ids are
kept; links are counted between rows.  An empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runmill.llm.components import components
from runmill.llm.durable import durable, hash_sample
from runmill.llm.skew import join_unique

MIN_COSINE = 0.93
#: Vectors that the quantisers are fitted on at most.
SAMPLE_ROWS = 20_000
#: Coarse lists for each square root of a label's vectors, and at least; sampled vectors for each list; subspaces, and code words of a subspace.
LISTS_X, LEAST_LISTS, SAMPLED_PER_LIST, SUBSPACES, WORDS = 2.0, 16, 8, 8, 64
#: Standard deviations that a linked vector may lean towards another list.
SIGMAS = 3.0
#: Filed vectors, and queries, that meet in one step.
BLOCK_ROWS = 2048


def _kmeans(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        nearest = _nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, x)
        n = np.bincount(nearest, minlength=k)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def _squares(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)[None], 0)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return _squares(x, centres).argmin(1)


@dataclass
class Quantiser:
    """Coarse centroids, and code books of the residuals' subspaces."""

    coarse: np.ndarray
    books: list[np.ndarray]
    parts: list[slice]

    @classmethod
    def fit(cls, x: np.ndarray, lists: int, subspaces: int, words: int) -> Quantiser:
        coarse = _kmeans(x, lists, 8, 1)
        residual = x - coarse[_nearest(x, coarse)]
        edges = np.linspace(0, x.shape[1], min(subspaces, x.shape[1]) + 1).astype(int)
        parts = [slice(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        return cls(coarse, [_kmeans(residual[:, p], words, 6, 2 + i) for i, p in enumerate(parts)], parts)

    def encode(self, x: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the residuals, and how far each vector is from what its codes stand for."""
        residual = x - self.coarse[lists]
        codes = np.array([_nearest(residual[:, p], b) for p, b in zip(self.parts, self.books, strict=True)], np.uint8).T.reshape(len(x), -1)
        error = np.zeros(len(x))
        for i, (p, b) in enumerate(zip(self.parts, self.books, strict=True)):
            error += ((residual[:, p] - b[codes[:, i]]) ** 2).sum(1)
        return codes, np.sqrt(error)

    def estimates(self, queries: np.ndarray, at: int, codes: np.ndarray) -> np.ndarray:
        """Distances of queries to filed vectors of list ``at`` by table look-ups."""
        residual = queries - self.coarse[at]
        out = np.zeros((len(queries), len(codes)))
        for i, (p, b) in enumerate(zip(self.parts, self.books, strict=True)):
            out += _squares(residual[:, p], b)[:, codes[:, i]]
        return np.sqrt(out)

    @classmethod
    def single(cls, size: int) -> Quantiser:
        """One list without codes."""
        return cls(np.zeros((1, size)), [], [])

    def probed(self, x: np.ndarray, own: np.ndarray, cosine: float, sigmas: float | None) -> tuple[np.ndarray, np.ndarray]:
        """(query, list) pairs: each query's own list and those that a linked vector can lie in."""
        c = self.coarse
        square, along = (c * c).sum(1), x @ c.T
        toward = np.take_along_axis(along, own[:, None], 1) - along
        across = np.sqrt(np.maximum(square[own][:, None] + square[None] - 2 * c[own] @ c.T - toward * toward, 0))
        lean = 1.0 if sigmas is None else min(1.0, sigmas / math.sqrt(max(1, x.shape[1] - 1)))
        # The least of cos t * toward - sin t * lean * across over the angles up to that of the wanted cosine.
        t = np.minimum(math.acos(cosine), np.arctan2(lean * across, -toward))
        near = np.cos(t) * toward - np.sin(t) * lean * across + (square[None] - square[own][:, None]) / 2 <= 1e-9
        near[np.arange(len(x)), own] = True
        return np.nonzero(near)


def _rows(batch: pa.RecordBatch, name: str, size: int) -> np.ndarray:
    """Vectors of one length as doubles."""
    return np.asarray(batch[name].flatten()).astype(np.float64).reshape(batch.num_rows, size)


def link_vectors(
    vectors: DataFrame,
    min_cosine: float = MIN_COSINE,
    sample_rows: int = SAMPLE_ROWS,
    lists: int | None = None,
    sigmas: float | None = SIGMAS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Rows (vec_id, n_links, component_id, kept) from (vec_id, embedding, label)."""
    good = F.col("label").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("embedding", lambda x: x != 0)
    # Floats stay floats, so that what is shuffled stays small; all arithmetic is in doubles.
    wide = vectors.schema["embedding"].dataType.simpleString() != "array<float>"
    plain = vectors.select("vec_id", F.col("embedding").cast("array<double>" if wide else "array<float>").alias("embedding"), "label")
    valid = plain.where(good).where(sound)
    distinct = durable(
        valid.withColumn("key", F.xxhash64("label", "embedding"))
        .groupBy("key", "label", "embedding")
        .agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least"))
        .withColumn("size", F.size("embedding"))
    )
    # A bounded sample of rows is fitted on the driver.
    sample = hash_sample(distinct.select("key", "embedding"), F.col("key"), sample_rows).select("embedding").toPandas()["embedding"].tolist()
    if not sample:
        return plain.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"), F.lit(True).alias("kept"))
    by_size: dict[int, list] = {}
    for v in sample:
        by_size.setdefault(len(v), []).append(v)
    # A row for each length in the sample.
    most = {r["size"]: r["n"] for r in distinct.where(F.col("size").isin(list(by_size))).groupBy("size", "label").count().groupBy("size").agg(F.max("count").alias("n")).collect()}
    quantisers: dict[int, Quantiser] = {}
    for size, of_size in by_size.items():
        n_lists = lists or max(LEAST_LISTS, round(LISTS_X * math.sqrt(most[size])))
        quantisers[size] = Quantiser.fit(_unit(np.array(of_size, np.float64)), max(1, min(n_lists, len(of_size) // SAMPLED_PER_LIST)), SUBSPACES, WORDS)
    reach = math.sqrt(max(0.0, 2 - 2 * min_cosine))
    dtype = np.float64 if wide else np.float32

    def filed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch["size"].to_numpy()
            for size in np.unique(sizes):
                for at in range(0, int((sizes == size).sum()), 512):
                    part = batch.take(pa.array(np.flatnonzero(sizes == size)[at : at + 512]))
                    quantiser = quantisers.get(int(size)) or Quantiser.single(int(size))
                    x = _rows(part, "embedding", int(size))
                    unit = _unit(x)
                    own = _nearest(unit, quantiser.coarse)
                    row, near = quantiser.probed(unit, own, min_cosine, sigmas)
                    codes, error = quantiser.encode(unit, own)
                    ends = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(x)))))
                    yield pa.RecordBatch.from_arrays(
                        [
                            *(part[c] for c in ("key", "label", "copies", "size")),
                            pa.array(own.astype(np.int32)),
                            pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(near.astype(np.int32))),
                            pa.array([c.tobytes() for c in codes], pa.binary()),
                            pa.array(error),
                            pa.array([v.astype(dtype).tobytes() for v in x], pa.binary()),
                        ],
                        names=["key", "label", "copies", "size", "list", "probes", "codes", "error", "raw"],
                    )

    label = distinct.schema["label"].dataType.simpleString()
    rows = durable(distinct.select("key", "label", "embedding", "copies", "size").mapInArrow(filed, f"key long, label {label}, copies long, size int, list int, probes array<int>, codes binary, error double, raw binary"))
    place = ["label", "size", "list"]
    queries = rows.select("key", "label", "size", F.explode("probes").alias("list"), "raw")
    # Blocks of a list: enough for its size; each query row meets every block of filed rows.
    blocks = durable(
        rows.groupBy(*place)
        .agg(F.count(F.lit(1)).alias("n_filed"))
        .join(queries.groupBy(*place).agg(F.count(F.lit(1)).alias("n_queries")), place)
        .withColumn("f", F.ceil(F.col("n_filed") / block_rows).cast("int"))
        .withColumn("q", F.ceil(F.col("n_queries") / block_rows).cast("int"))
    )
    keep = [*place, "fb", "qb", "key", "query", "copies", "raw", "codes", "error"]
    filed_rows = (
        join_unique(rows.drop("probes"), blocks, place, "n_filed")
        .withColumn("fb", F.expr("CAST(pmod(xxhash64(key), f) AS INT)"))
        .withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("q") - 1)))
        .withColumn("query", F.lit(False))
        .select(*keep)
    )
    query_rows = (
        join_unique(queries, blocks, place, "n_queries")
        .withColumn("qb", F.expr("CAST(pmod(xxhash64(key, 1), q) AS INT)"))
        .withColumn("fb", F.explode(F.sequence(F.lit(0), F.col("f") - 1)))
        .select(*place, "fb", "qb", "key", F.lit(True).alias("query"), F.lit(None).cast("long").alias("copies"), "raw", F.lit(None).cast("binary").alias("codes"), F.lit(None).cast("double").alias("error"))
    )

    def matched(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        is_query = table["query"].to_numpy()
        f, q = table.filter(pa.array(~is_query)), table.filter(pa.array(is_query))
        empty = pa.table({x: pa.array([], pa.int64()) for x in ("a", "b", "n")})
        if not f.num_rows or not q.num_rows:
            return empty
        at, size = table["list"][0].as_py(), table["size"][0].as_py()
        quantiser = quantisers.get(size) or Quantiser.single(size)
        codes = np.frombuffer(b"".join(f["codes"].to_pylist()), np.uint8).reshape(f.num_rows, -1)
        fx, qx = (_unit(np.frombuffer(b"".join(t["raw"].to_pylist()), dtype).astype(np.float64).reshape(-1, size)) for t in (f, q))
        fk, qk, error = f["key"].to_numpy(), q["key"].to_numpy(), f["error"].to_numpy()
        copies = f["copies"].to_numpy()
        keys, place = np.unique(np.concatenate([fk, qk]), return_inverse=True)
        fp, qp = place[: len(fk)], place[len(fk) :]
        root, counts, pairs = np.arange(len(keys)), np.zeros(len(keys), np.int64), []
        for i in range(0, len(qx), 256):
            near = quantiser.estimates(qx[i : i + 256], at, codes) <= reach + error[None, :] + 1e-9
            r, c = np.nonzero(near)
            exact = (np.einsum("ij,ij->i", qx[i + r], fx[c]) >= min_cosine) & (qk[i + r] != fk[c])
            r, c = r[exact], c[exact]
            np.add.at(counts, qp[i + r], copies[c])
            pairs.append(np.stack([qp[i + r], fp[c]]))
        u, v = np.concatenate(pairs, 1)
        while len(u):
            low = np.minimum(root[u], root[v])
            before = root.copy()
            np.minimum.at(root, u, low)
            np.minimum.at(root, v, low)
            root = root[root]
            if (root == before).all():
                break
        linked, star = np.flatnonzero(counts), np.flatnonzero(root != np.arange(len(keys)))
        return pa.table(
            {
                "a": np.concatenate([keys[linked], keys[root[star]]]),
                "b": pa.array([None] * len(linked) + keys[star].tolist(), pa.int64()),
                "n": np.concatenate([counts[linked], np.zeros(len(star), np.int64)]),
            }
        )

    # From each block: how many rows a query links with, and a tree of each of the block's components.
    found = durable(filed_rows.unionByName(query_rows).groupBy(*place, "fb", "qb").applyInArrow(matched, "a long, b long, n long"))
    roots = components(found.where("b IS NOT NULL").select("a", "b"))
    others = found.where("b IS NULL").groupBy("a").agg(F.sum("n").alias("linked"))
    known = distinct.select("key", "copies", "least").join(others.withColumnRenamed("a", "key"), "key", "left").join(roots.withColumnRenamed("id", "key"), "key", "left")
    known = known.withColumn("root", F.coalesce("root", "key"))
    least = known.groupBy("root").agg(F.min("least").alias("component_id"))
    facts = known.join(least, "root").select("key", (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), "component_id")
    keyed = plain.select("vec_id", F.when(good & sound, F.xxhash64("label", "embedding")).alias("key"))
    return keyed.join(facts, "key", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").cast("long").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("component_id", "vec_id"), F.lit(True)).alias("kept"),
    )


def _unit(x: np.ndarray) -> np.ndarray:
    """Vectors of length 1; scaled first, so that squares neither overflow nor vanish."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))
