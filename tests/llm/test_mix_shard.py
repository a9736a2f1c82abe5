import random
import zlib
from fractions import Fraction

import pytest

from runmill.llm.mixing import mix_order, mix_rows
from runmill.llm.sharding import Leaf, grown, shard_documents, shard_of, topology

ROWS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, n=700):
    r = random.Random(4)
    rows = [(i if i % 40 else None, r.choice([None, "", f"t{i}", "same é"]), "en", r.choice(["a"] * 6 + ["b", "b", "c", None]), i) for i in range(n)]
    return spark.createDataFrame(rows + rows[:20], ROWS)


@pytest.mark.parametrize("weights", [None, {"a": 5, "b": 1, "c": 1, None: 0.5}])
def test_mix_of_odd_rows(spark, weights):
    df = documents(spark)
    got = mix_rows(df.selectExpr("*", "1 AS _mix_hash", "2 AS rank"), weights, block_rows=4).orderBy("_mix_position").collect()
    assert [x._mix_position for x in got] == list(range(720))
    assert all(x._mix_release <= x._mix_slot < x._mix_deadline for x in got)
    # Each source's blocks stand in order and hold four rows, the last one the rest; sources don't share a slot.
    blocks = {}
    for x in got:
        blocks.setdefault((x.source or "", x._mix_block), []).append(x)
    assert len({x._mix_slot for x in got}) == len(blocks)
    for (source, k), own in blocks.items():
        assert len({x._mix_slot for x in own}) == 1 and (len(own) == 4 or (source, k + 1) not in blocks)
        assert k == 0 or blocks[source, k - 1][0]._mix_slot < own[0]._mix_slot
        assert [x._mix_position for x in own] == list(range(own[0]._mix_position, own[0]._mix_position + len(own)))


def test_ranges_by_counts_keep_the_order(spark, monkeypatch):
    from runmill.llm import mixing

    df = documents(spark)
    want = sorted((str(x), x._mix_position) for x in mix_rows(df, carry=["doc_id", "text", "source"]).collect())
    for rows, ranges in ((4, 1), (50, 1), (1 << 16, 64)):
        monkeypatch.setattr(mixing, "RANGE_ROWS", rows)
        monkeypatch.setattr(mixing, "RANGES", ranges)
        assert sorted((str(x), x._mix_position) for x in mix_rows(df, carry=["doc_id", "text", "source"]).collect()) == want


@pytest.mark.parametrize("w", [{"a": 0.6, "b": 0.3, "c": 0.1}, {"a": 0.6, "b": 0.399, "c": 0.001}, {"a": 17, "b": 12, "c": 3}])
def test_less_than_one_block_from_the_given_weights(spark, w):
    df = spark.range(30000).selectExpr("id AS doc_id", "'x' AS text", "'en' AS lang", "CASE WHEN id < 18000 THEN 'a' WHEN id < 29997 THEN 'b' ELSE 'c' END AS source", "1L AS n_chars")
    rows = mix_rows(df, w, block_rows=5).select("source", "_mix_block", "_mix_release", "_mix_deadline", "_mix_slot", "_mix_position").collect()
    assert sorted(x._mix_position for x in rows) == list(range(30000))
    blocks = {x._mix_slot: x for x in rows}
    total = sum(Fraction(str(x)) for x in w.values())
    share = {s: Fraction(str(x)) / total for s, x in w.items()}
    for x in blocks.values():
        k, p = x._mix_block, share[x.source]
        assert (x._mix_release, x._mix_deadline) == (k // p, -(-(k + 1) // p)) and x._mix_release <= x._mix_slot < x._mix_deadline
    last = min(max(x._mix_slot for x in blocks.values() if x.source == s) for s in w)
    done = dict.fromkeys(w, 0)
    for t in range(last + 1):
        done[blocks[t].source] += 1
        assert all(abs(done[s] - share[s] * (t + 1)) < 1 for s in w)


def test_more_sources_than_a_thousand(spark):
    df = spark.range(6000).selectExpr("id AS doc_id", "'x' AS text", "'en' AS lang", "CASE WHEN id < 3600 THEN 'hot' ELSE concat('s', id % 1200) END AS source", "1L AS n_chars")
    got = mix_rows(df, block_rows=2).select("_mix_release", "_mix_slot", "_mix_deadline", "_mix_position").collect()
    assert sorted(x._mix_position for x in got) == list(range(6000))
    assert all(x._mix_release <= x._mix_slot < x._mix_deadline for x in got)


def test_mixing_edges(spark):
    df = documents(spark)
    assert mix_rows(df.limit(0)).count() == 0
    ordered = mix_order(df)
    assert ordered.columns == df.columns and sorted(map(str, ordered.collect())) == sorted(map(str, df.collect()))
    # Files in the order of their names hold the mix; equal rows may change places.
    placed = mix_rows(df, carry=["doc_id", "text", "source"]).orderBy("_mix_position").collect()
    assert [(x.doc_id, x.text, x.source) for x in ordered.collect()] == [(x.doc_id, x.text, x.source) for x in placed]
    assert mix_order(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        mix_rows(df, block_rows=0)
    with pytest.raises(Exception, match="no target weight"):
        mix_rows(df, {"a": 1}).collect()


def test_shards(spark):
    df = documents(spark)
    got = shard_documents(df.selectExpr("*", "1 AS shard", "2 AS bucket", "3 AS size")).collect()
    assert len(got) == 720 and {x.law for x in got} == {"key"}
    for s in range(8):
        assert sorted(x.slot for x in got if x["shard"] == s) == list(range(sum(x["shard"] == s for x in got)))
    assert {x.grown_shard for x in got if x.grown_shard != x["shard"]} == {8}
    by_id = {}
    for x in got:
        assert by_id.setdefault(x.doc_id, x["shard"]) == x["shard"]
    text = {(r.doc_id, r.text) for r in df.collect()}
    assert {(x.doc_id, x.size, x.text_crc32) for x in got} == {(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in text}
    assert shard_documents(df.limit(0)).count() == 0


def test_weights_and_confined_movement(spark):
    df = spark.range(20000)
    heavy = (Leaf(0, 0, 0, 3.0), Leaf(0, 0, 1, 1.0), Leaf(0, 1, 2, 2.0), Leaf(1, 2, 3, 2.0))
    n = {r.s: r["count"] for r in df.select(shard_of(df.id, heavy).alias("s")).groupBy("s").count().collect()}
    assert all(abs(n[k] / 20000 - w / 8) < 0.02 for k, w in ((0, 3), (1, 1), (2, 2), (3, 2)))
    # A heavier shard draws keys into its own region and rack; elsewhere nothing moves.
    more = (Leaf(0, 0, 0, 6.0), *heavy[1:])
    moved = df.select(shard_of(df.id, heavy).alias("a"), shard_of(df.id, more).alias("b")).where("a != b").distinct().collect()
    assert {(x.a, x.b) for x in moved} <= {(1, 0), (2, 0), (2, 1), (3, 0), (3, 1), (3, 2)}
    tree = topology()
    for _ in range(3):
        new = grown(tree)
        rows = df.select(shard_of(df.id, tree).alias("a"), shard_of(df.id, new).alias("b")).where("a != b").select("b").distinct().collect()
        assert [x.b for x in rows] == [max(x.shard for x in new)]
        tree = new
    with pytest.raises(ValueError):
        shard_of(df.id, ())
