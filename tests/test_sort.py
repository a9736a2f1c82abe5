import random

import pytest
from pyspark.sql import functions as F

from runmill.operators.merge import merge_plan, merge_rounds, merge_sorted
from runmill.operators.sort import sort, top, with_position
from runmill.plans.keys import SortKey, asc, desc, sort_keys


def ints(spark, values):
    return spark.createDataFrame([(v,) for v in values], "v long")


@pytest.mark.parametrize("n", [0, 1, 2, 100])
def test_sorts_a_shuffled_sequence(spark, n):
    values = list(range(n))
    random.Random(42).shuffle(values)
    assert [r.v for r in sort(ints(spark, values), "v").collect()] == list(range(n))


def test_extremes_duplicates_nulls_and_nan(spark):
    low, high = -(2**63), 2**63 - 1
    assert [r.v for r in sort(ints(spark, [high, 0, low, 0, None]), "v").collect()] == [None, low, 0, 0, high]
    assert [r.v for r in sort(ints(spark, [1, None, 2]), SortKey("v", False, True)).collect()] == [None, 2, 1]
    doubles = spark.createDataFrame([(float("nan"),), (float("inf"),), (-0.5,)], "v double")
    assert str([r.v for r in sort(doubles, "v").collect()]) == "[-0.5, inf, nan]"


@pytest.mark.parametrize("limit", [-1, 1 << 40])
def test_positions_in_one_task_and_in_ranges(spark, limit):
    values = [random.Random(i).randint(0, 9) for i in range(500)] + [None] * 5
    got = with_position(ints(spark, values), desc("v"), one_task_bytes=limit).orderBy("pos").collect()
    assert [r.pos for r in got] == list(range(1, 506))
    assert [r.v for r in got] == sorted((v for v in values if v is not None), reverse=True) + [None] * 5
    assert with_position(ints(spark, []), "v", one_task_bytes=limit).collect() == []


def test_top(spark):
    assert [(r.v, r.pos) for r in top(ints(spark, [3, 9, 1]), 2, desc("v")).collect()] == [(9, 1), (3, 2)]
    with pytest.raises(ValueError):
        top(ints(spark, [1]), -1, "v")


def test_keys_are_checked(spark):
    with pytest.raises(ValueError):
        sort_keys()
    with pytest.raises(ValueError):
        sort(None, asc("v"))


def test_merges_uneven_and_empty_sequences(spark):
    parts = [[1, 4, 7], [], [2], list(range(10, 20)), [3, 3]]
    got = merge_sorted([ints(spark, p) for p in parts], "v").orderBy("pos").collect()
    assert [r.v for r in got] == sorted(x for p in parts for x in p)
    assert {r.source for r in got} == {0, 2, 3, 4}
    assert merge_sorted([ints(spark, [])], "v").count() == 0
    with pytest.raises(ValueError):
        merge_sorted([], "v")


def test_merge_rounds(spark):
    assert merge_rounds(235, 4) == [235, 59, 15, 4]
    assert merge_rounds(48, 64) == [48]
    with pytest.raises(ValueError):
        merge_rounds(3, 1)
    plan = merge_plan(spark, 10, 2)
    assert plan.count() == 10 + 5 + 3
    assert plan.where("round = 0").agg(F.max("batch")).first()[0] == 4


def test_spilling_sort_keeps_all_rows(spark):
    rows = spark.range(200_000).select(F.xxhash64("id").alias("v"))
    got = sort(rows, "v").selectExpr("v", "lag(v) OVER (ORDER BY v) AS b").where("b > v").count()
    assert got == 0 and sort(rows, "v").count() == 200_000


@pytest.mark.parametrize("limit", [-1, 1 << 40])
def test_columns_of_any_names_stay(spark, limit):
    rows = [(10 * i, i % 3, str(i), {"k": i}, i / 2, [i]) for i in (3, 1, 2)]
    df = spark.createDataFrame(rows, "_id long, _part long, _before string, row map<string,long>, `a.b` double, spread array<long>")
    got = with_position(df, desc("_id"), one_task_bytes=limit).orderBy("pos").collect()
    assert [tuple(x) for x in got] == [(*r, i) for i, r in enumerate(sorted(rows, reverse=True), 1)]
    assert [x.pos for x in with_position(df.withColumn("pos", F.lit(7)), "_id", one_task_bytes=limit).orderBy("_id").collect()] == [1, 2, 3]
    # Only a map, which can't be hashed.
    maps = spark.createDataFrame([({"k": i},) for i in range(3)], "m map<string,long>")
    assert sorted(x.pos for x in with_position(maps, F.col("m")["k"], one_task_bytes=limit).collect()) == [1, 2, 3]


def test_a_small_input_is_proven(spark):
    from runmill.plans.keys import at_most

    small = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").select("o_orderkey")
    assert at_most(small, 1 << 26) and not at_most(small, 10)
    # Plans that multiply rows have no proven size.
    assert not at_most(small.select(F.explode(F.sequence(F.lit(1), F.col("o_orderkey"))).alias("x")), 1 << 26)
    assert not at_most(small.join(small.withColumnRenamed("o_orderkey", "b"), F.col("o_orderkey") > F.col("b")), 1 << 26)


def test_tables_are_released(spark):
    from runmill.plans.durable import release, written

    df = written(spark.range(5))
    assert df.count() == 5
    release(spark)
    with pytest.raises(Exception):
        spark.read.parquet(df.inputFiles()[0]).count()
