"""Connected components by large-star and small-star rounds over DataFrames.

Every round is two joins and aggregates on vertex ids and is written to the
shared checkpoint folder; nothing is collected but a count and a checksum.  Stars
pull their members to the smallest neighbour, so the number of rounds grows
with the logarithm of the longest path.  A vertex with very many edges is
pre-aggregated (a minimum) before the shuffle, and its edges meet that minimum
where they are (skew.py).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runmill.llm.durable import durable
from runmill.llm.skew import join_unique


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step: neighbours of each vertex (larger ones, or smaller ones) are linked to its smallest neighbour.

    What the large step repeats goes in the small step that follows.
    """
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = durable(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count(F.lit(1)).alias("degree")))
    linked = join_unique(both, least, ["a"], "degree")
    if large:
        out = linked.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = linked.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    out = out.where("a != b")
    return out if large else out.distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, root) for every vertex of ``edges`` (a, b): root is the smallest id of its component.

    Edges with a null end and loops are ignored.
    """
    now = durable(edges.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL AND a != b").distinct())
    mark = None
    for _ in range(max_rounds):
        now = durable(_star(_star(now, True), False))
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(state) == mark:
            break
        mark = tuple(state)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    stars = now.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("id"), "root")
    return stars.unionByName(stars.select(F.col("root").alias("id"), "root").distinct())
