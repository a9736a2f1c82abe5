import os
import random
import struct

import pytest
from pyspark.sql import functions as F

from runmill.functions.blocks import fixed_capacity, pack_fixed, pack_var
from runmill.functions.codec import (
    decode_rectangle,
    decode_rectangles,
    encode_rectangle,
    encode_rectangles,
    int32_bytes,
    int32_value,
    int64_bytes,
    int64_value,
    rectangle,
)
from runmill.operators.packing import next_fit
from runmill.operators.runs import chunks_of_runs, runs_fixed, runs_next_fit, sort_within_runs
from runmill.sources.blocks import FixedBlock, VarBlock, register


def greedy(sizes, capacity):
    out, used, bin_ = [], 0, -1
    for s in sizes:
        if bin_ < 0 or used + s > capacity:
            bin_, used = bin_ + 1, 0
        used += s
        out.append(bin_)
    return out


def test_next_fit_equals_the_greedy_loop(spark):
    r = random.Random(1)
    for capacity, top, n, chunk in ((100, 60, 300, 7), (10, 25, 200, 16), (1000, 5, 300, 64), (5, 5, 1, 4), (64, 64, 120, 1)):
        sizes = [r.choice([0, 1, top, r.randint(0, top)]) for _ in range(n)]
        df = spark.createDataFrame([(i + 1, s) for i, s in enumerate(sizes)], "pos long, s long")
        got = next_fit(df, "pos", F.col("s"), capacity, chunk=chunk).orderBy("pos").collect()
        assert [x["bin"] for x in got] == greedy(sizes, capacity)
    assert next_fit(df.limit(0), "pos", F.col("s"), 5).count() == 0


def test_runs_of_fixed_width(spark):
    values = list(range(158))
    random.Random(42).shuffle(values)
    df = spark.createDataFrame([(i + 1, v) for i, v in enumerate(values)], "arrive long, v int")
    runs = sort_within_runs(runs_fixed(df, "arrive", 256, 4), "v").collect()
    assert {k: sum(x.run_id == k for x in runs) for k in range(3)} == {0: 64, 1: 64, 2: 30}
    for k in range(3):
        assert [x.v for x in sorted((x for x in runs if x.run_id == k), key=lambda x: x.pos)] == sorted(values[64 * k : 64 * k + 64])
    chunks = chunks_of_runs(runs_fixed(df, "arrive", 256, 4), "arrive", 4).groupBy("run_id", "chunk").count().collect()
    assert sorted(x["count"] for x in chunks) == [6, 8, 8, 8] + [16] * 8


def test_an_oversize_record_is_a_run_of_its_own(spark):
    df = spark.createDataFrame([(1, 99), (2, 3), (3, 99), (4, 1)], "pos long, s long")
    assert [x.run_id for x in runs_next_fit(df, "pos", F.col("s"), 10).orderBy("pos").collect()] == [0, 1, 2, 3]


def test_block_capacities():
    assert [fixed_capacity(*x) for x in ((54, 4), (64, 4), (128, 8), (4096, 8))] == [10, 13, 14, 510]
    with pytest.raises(ValueError):
        fixed_capacity(12, 4)


def test_a_fixed_block_is_full_reset_and_read():
    block = FixedBlock(54, 4)
    assert [block.append(struct.pack(">i", i)) for i in range(12)] == [True] * 10 + [False] * 2
    data = block.to_bytes()
    assert len(data) == 54 and struct.unpack(">III", data[:12]) == (10, 52, 4)
    assert [struct.unpack(">i", x)[0] for x in FixedBlock.read(data)] == list(range(10))
    block.reset()
    assert [block.append(struct.pack(">i", i)) for i in range(100, 104)] == [True] * 4
    with pytest.raises(ValueError):
        block.append(b"123")


def test_a_var_block_bounds_records():
    block = VarBlock(80_000)
    assert block.append(b"x" * 65_535) and list(VarBlock.read(block.to_bytes())) == [b"x" * 65_535]
    with pytest.raises(ValueError):
        block.append(b"x" * 65_536)
    small = VarBlock(20)
    assert small.append(b"12345678") and not small.append(b"1") and small.append(b"")
    assert small.to_bytes()[:8] == struct.pack(">II", 2, 20)


def test_pack_var(spark):
    names = ["a" * n for n in (5, 0, 20, 7, 22)]
    df = spark.createDataFrame(list(enumerate(names, 1)), "pos long, name string")
    got = pack_var(df, "pos", F.octet_length("name"), 32).orderBy("pos").collect()
    assert [(x.block_no, x.slot, x.offset) for x in got] == [(0, 0, 8), (0, 1, 15), (1, 0, 8), (2, 0, 8), (3, 0, 8)]
    with pytest.raises(Exception, match="exceeds"):
        pack_var(df, "pos", F.octet_length("name"), 20).collect()
    assert [x.slot for x in pack_fixed(df, "pos", 20, 4).orderBy("pos").collect()] == [0, 1, 0, 1, 0]


@pytest.mark.parametrize("kind,codec,values", [("fixedblock", "int64", list(range(100)) + [-(2**63), 2**63 - 1]), ("fixedblock", "int32", [-5, 0, 2**31 - 1]), ("varblock", "text", ["", "é" * 40, "x" * 50]), ("varblock", "bytes", [b"", b"\0\xff"])])
def test_data_source_round_trip(spark, tmp_path, kind, codec, values):
    register(spark)
    df = spark.createDataFrame([(v,) for v in values], {"int64": "v long", "int32": "v int", "text": "v string", "bytes": "v binary"}[codec]).coalesce(1)
    path = str(tmp_path / "blocks")
    for _ in range(2):
        df.write.format(kind).option("blockSize", 128).option("codec", codec).mode("overwrite").save(path)
    got = spark.read.format(kind).option("blockSize", 128).option("codec", codec).option("blocksPerTask", 2).load(path).orderBy("block_no", "slot").collect()
    assert [bytes(x.value) if codec == "bytes" else x.value for x in got] == values
    assert all(os.path.getsize(tmp_path / "blocks" / f) % 128 == 0 for f in os.listdir(path))


def test_integer_codecs(spark):
    v = [0, 1, -1, 2**31 - 1, -(2**31)]
    df = spark.createDataFrame([(x, x * 2**31) for x in v], "a int, b long")
    got = df.select(int32_bytes("a").alias("p"), int64_bytes("b").alias("q"), int32_value(int32_bytes("a")).alias("a"), int64_value(int64_bytes("b")).alias("b")).collect()
    for x, g in zip(v, got, strict=True):
        assert bytes(g.p) == struct.pack(">i", x) and bytes(g.q) == struct.pack(">q", x * 2**31) and (g.a, g.b) == (x, x * 2**31)


def test_rectangles(spark):
    for d in (0, 1, 2, 16):
        low, up = [float("-inf"), -0.0, float("nan"), 5e-324][:d] + [1.5] * max(0, d - 4), [float("inf")] * d
        data = encode_rectangle(low, up)
        assert len(data) == 2 + 16 * d
        box = decode_rectangle(data)
        assert encode_rectangle(box["low_left"], box["up_right"]) == data and box["dimension"] == d
        with pytest.raises(ValueError):
            decode_rectangle(data[:-1])
    with pytest.raises(ValueError):
        encode_rectangle([1.0], [])
    df = spark.createDataFrame([([1.0, 2.0], [3.0, 4.0]), ([], [])], "l array<double>, u array<double>").select(rectangle(F.col("l"), F.col("u")).alias("box"))
    got = decode_rectangles(encode_rectangles(df, "box"), "data", "again").collect()
    assert all(x.box == x.again for x in got)


def test_packing_keeps_columns_of_any_names(spark):
    df = spark.createDataFrame([(i + 1, 3, i, -i, "x", {"k": i}) for i in range(20)], "pos long, _size long, size long, _chunk long, chunk string, all map<string,long>")
    got = next_fit(df, "pos", F.col("_size"), 10, chunk=4).orderBy("pos").collect()
    assert [x["bin"] for x in got] == [i // 3 for i in range(20)] and [(x.size, x._chunk, x.chunk, x["all"]) for x in got] == [(i, -i, "x", {"k": i}) for i in range(20)]
    runs = chunks_of_runs(runs_fixed(df.withColumn("_at", F.lit(1)).withColumn("_n", F.lit(2)), "pos", 40, 4), "pos", 4, name="part")
    assert {(x._at, x._n) for x in runs.collect()} == {(1, 2)} and [x.part for x in runs.orderBy("pos").limit(10).collect()] == [0, 0, 0, 1, 1, 1, 2, 2, 2, 3]
    packed = pack_var(df.withColumn("_bytes", F.lit(5)), "pos", F.col("_size"), 32)
    assert {x._bytes for x in packed.collect()} == {5}


def test_rectangles_of_mixed_dimensions_and_nulls(spark):
    rows = [([1.0, -0.0], [float("inf"), float("nan")]), None, ([], []), ([5e-324] * 3, [2.0] * 3), ([1.5], [2.5])] * 3
    df = spark.createDataFrame([(i, None if r is None else {"dimension": len(r[0]), "low_left": r[0], "up_right": r[1]}) for i, r in enumerate(rows)], "id long, box struct<dimension:int,low_left:array<double>,up_right:array<double>>")
    got = decode_rectangles(encode_rectangles(df, "box"), "data", "again").orderBy("id").collect()
    for r, x in zip(rows, got, strict=True):
        assert (x.data is None and x.again is None) if r is None else (bytes(x.data) == encode_rectangle(*r) and str(x.again) == str(x.box))
    short = spark.createDataFrame([(encode_rectangle([1.0], [2.0])[:-1],)], "data binary")
    with pytest.raises(Exception, match="needs 18 bytes"):
        decode_rectangles(short, "data").collect()


def test_block_files_lie_on_a_mount(spark):
    register(spark)
    with pytest.raises(Exception, match="mount alike"):
        spark.read.format("fixedblock").option("blockSize", 64).load("s3://x/y").collect()
