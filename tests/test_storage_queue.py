import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from runmill.operators.queue import fill, replay
from runmill.operators.storage import Storage, StorageManager, get_bytes, set_bytes
from runmill.streaming.log import Log


def pages(spark, n=8):
    return spark.createDataFrame([(i, i) for i in range(n)], "block_nr long, value long")


def test_update_changes_only_its_pages(spark):
    s = Storage("a", pages(spark)).cache()
    changed = s.update([0, 1, 2, 3], {"value": lambda v: v + 10})
    assert sorted(x.value for x in changed.collect()) == [10, 11, 12, 13]
    assert {x.block_nr: x.value for x in s.pages.collect()} == {0: 10, 1: 11, 2: 12, 3: 13, 4: 4, 5: 5, 6: 6, 7: 7}
    s.release()


def test_write_reserve_delete(spark):
    data = spark.createDataFrame([(i, bytes(range(4 * i, 4 * i + 4))) for i in range(3)], "block_nr long, data binary")
    s = Storage("a", data)
    assert s.reserve(32).first()[0] == 3
    assert bytes(s.read(3).first().data) == bytes(32)
    s.write(spark.createDataFrame([(1, b"new!"), (9, b"more")], "block_nr long, data binary"))
    assert {x.block_nr: bytes(x.data) for x in s.read(1, 9).collect()} == {1: b"new!", 9: b"more"}
    s.delete(spark.createDataFrame([(0,), (77,)], "block_nr long"))
    assert sorted(x.block_nr for x in s.pages.collect()) == [1, 2, 3, 9]
    with pytest.raises(NotImplementedError):
        Storage("f", data, deletes=False).delete(data)
    assert Storage("e", data.limit(0)).next_number().first()[0] == 0


def test_bytes_of_a_page(spark):
    df = spark.createDataFrame([(b"abcdef",)], "p binary")
    assert bytes(df.select(get_bytes(F.col("p"), 2, 4).alias("x")).first().x) == b"cdef"
    assert bytes(df.select(set_bytes(F.col("p"), 3, F.lit(b"XYZ")).alias("x")).first().x) == b"abcXYZ"
    for wrong in (get_bytes(F.col("p"), 3, 4), set_bytes(F.col("p"), 4, F.lit(b"XYZ"))):
        with pytest.raises(Exception, match="outside"):
            df.select(wrong).collect()


def test_routing(spark):
    m = StorageManager()
    m.register(Storage("a", pages(spark, 2)))
    m.register(Storage("b", pages(spark, 3)))
    assert m.read("b", 2).count() == 1 and m.read("a", 2).count() == 0 and m.all().count() == 5
    with pytest.raises(ValueError):
        m.register(Storage("a", pages(spark)))
    with pytest.raises(KeyError):
        m.get("c")
    m.close()
    with pytest.raises(KeyError):
        m.get("a")


def test_repeated_access_equals_the_stored_values(spark):
    s = Storage("a", pages(spark, 100)).cache()
    trace = spark.range(1000).select(F.col("id").alias("step"), (F.col("id") % 100).alias("block_nr"))
    assert s.access(trace).where("value != step % 100").count() == 0 and s.access(trace).count() == 1000
    s.release()


def test_log_before_data(spark, tmp_path):
    log = Log(spark, str(tmp_path / "log"))
    df = spark.createDataFrame([(i,) for i in range(10)], "v long")
    assert log.scan().count() == 0
    assert log.append(df, F.col("v").cast("string"), "v") == 9
    Storage("a", pages(spark)).flush(str(tmp_path / "pages"), log, 4)
    assert [x.lsn for x in log.scan().collect()] == [0, 1, 2, 3, 4]
    log.flush()
    assert [bytes(x.entry) for x in log.scan(7).collect()] == [str(i).encode() for i in range(8)]
    assert Log(spark, str(tmp_path / "log")).last() == 9


def test_log_as_a_streaming_sink(spark, tmp_path):
    source = str(tmp_path / "in")
    log = Log(spark, str(tmp_path / "log"))
    for part in range(2):
        spark.range(5 * part, 5 * part + 5).write.mode("append").parquet(source)
        stream = spark.readStream.schema("id long").parquet(source)
        q = stream.writeStream.foreachBatch(log.sink(F.col("id").cast("string"), "id")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        assert q.awaitTermination(60)
    assert [(x.lsn, bytes(x.entry)) for x in log.scan().collect()] == [(i, str(i).encode()) for i in range(10)]


def test_bounded_queue(spark):
    trace = [("enqueue", i) for i in range(5)] + [("dequeue", 0)] * 5 + [("enqueue", i) for i in (10, 11, 12)] + [("dequeue", 0)] * 2
    df = spark.createDataFrame([("q", i, op, v) for i, (op, v) in enumerate(trace)], "queue string, step long, op string, value long")
    got = replay(df, 4).orderBy("step").collect()
    assert [x.status for x in got] == ["ok"] * 4 + ["full"] + ["ok"] * 4 + ["empty"] + ["ok"] * 5
    assert [x.result for x in got if x.op == "dequeue"] == [0, 1, 2, 3, None, 10, 11] and got[-1]["size"] == 1
    r, held, want = random.Random(2), deque(), []
    rows = [("r", i, r.choice(["enqueue", "dequeue"]), i) for i in range(200)]
    for _, i, op, v in rows:
        ok = len(held) < 3 if op == "enqueue" else bool(held)
        (held.append(v) if op == "enqueue" else held.popleft()) if ok else None
        want.append(("ok" if ok else "full" if op == "enqueue" else "empty", len(held)))
    got = replay(spark.createDataFrame(rows, df.schema), 3).orderBy("step").collect()
    assert [(x.status, x["size"]) for x in got] == want
    filled = fill(df.select("step"), 4, "step").orderBy("step").collect()
    assert [x.slot for x in filled] == [0, 1, 2, 3] + [None] * 11


def test_the_last_write_of_a_batch_counts(spark):
    s = Storage("a", spark.createDataFrame([(1, b"old!")], "block_nr long, data binary"), block_bytes=4)
    s.write(spark.createDataFrame([(1, b"one!", 1), (1, b"two!", 2), (5, b"new!", 0)], "block_nr long, data binary, at int"), "at")
    assert {x.block_nr: bytes(x.data) for x in s.pages.collect()} == {1: b"two!", 5: b"new!"}
    s.write(spark.createDataFrame([(1, b"x"), (1, b"x")], "block_nr long, data binary"))
    with pytest.raises(Exception, match="hasn't 4 bytes"):
        s.pages.collect()


def test_missing_pages_are_errors(spark):
    s = Storage("a", pages(spark))
    assert [x.value for x in s.fetch(2, 5).orderBy("value").collect()] == [2, 5] and s.read(2, 77).count() == 1
    with pytest.raises(Exception, match="no page 77"):
        s.fetch(2, 77).collect()
    with pytest.raises(KeyError):
        s.delete(spark.createDataFrame([(0,), (77,)], "block_nr long"), strict=True)
    assert s.pages.count() == 8
    data = Storage("d", spark.createDataFrame([(0, b"abc")], "block_nr long, data binary"))
    assert bytes(data.fix_empty(0, 8).first().data) == bytes(8) and data.pages.count() == 1


def test_a_storage_is_flushed_to_where_it_reads(spark, tmp_path):
    path = str(tmp_path / "pages")
    pages(spark).write.parquet(path)
    s = Storage("a", spark.read.parquet(path))
    for i in range(20):
        s.update([i % 8], {"value": lambda v: v + 100})
    s.flush(path)
    before = sorted(tmp_path.joinpath("pages").iterdir())
    assert sum(x.value for x in spark.read.parquet(path).collect()) == sum(range(8)) + 2000
    s.flush(path)
    assert sorted(tmp_path.joinpath("pages").iterdir()) == before
    s.delete(spark.createDataFrame([(0,)], "block_nr long"))
    s.flush(path)
    assert spark.read.parquet(path).count() == 7


def test_a_log_numbers_ties_once_and_can_flush_again(spark, tmp_path):
    log = Log(spark, str(tmp_path / "log"))
    ties = spark.createDataFrame([(1, str(i)) for i in range(200)], "v long, _entry string")
    assert log.append(ties, F.col("_entry"), "v") == 199 and log.append(ties.limit(5), F.col("_entry"), "v") == 204
    log.flush(100)
    log.flush(150)
    log.flush(150)
    assert [x.lsn for x in log.scan().collect()] == list(range(151))
    log.flush()
    got = log.scan().collect()
    assert [x.lsn for x in got] == list(range(205)) and sorted(int(x.entry) for x in got[:200]) == list(range(200))


def test_queue_columns_of_any_names(spark):
    df = spark.createDataFrame([(i, "q", i) for i in range(6)], "_at long, at string, slot long")
    for queue in (None, "at"):
        got = fill(df, 4, "_at", queue=queue).orderBy("_at").collect()
        assert [x._at for x in got] == list(range(6)) and [x.slot for x in got] == [0, 1, 2, 3, None, None] and len(got[0]) == 4
