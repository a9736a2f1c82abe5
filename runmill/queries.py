"""Queries over the driver's tables, one or more for each operator, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runmill.functions.blocks import pack_fixed, pack_var
from runmill.functions.codec import decode_rectangles, encode_rectangles, int32_bytes, int32_value, int64_bytes, int64_value, rectangle, rectangle_bytes
from runmill.operators.merge import merge_plan, merge_sorted
from runmill.operators.queue import fill, replay
from runmill.operators.runs import chunks_of_runs, runs_fixed, runs_next_fit, sort_within_runs
from runmill.operators.sort import sort, top, with_position
from runmill.operators.storage import Storage, StorageManager, get_bytes, set_bytes, zero_page
from runmill.plans.durable import new_path, written
from runmill.plans.keys import asc, desc
from runmill.sources.blocks import register
from runmill.streaming.log import Log

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _query(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__], _SQL[f.__name__] = f, sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _arrived(df: DataFrame, key: str) -> DataFrame:
    """Rows in a shuffled order of arrival that any engine can reproduce."""
    return with_position(df.withColumn("_m", F.md5(F.col(key).cast("string"))), "_m", key, name="arrive").drop("_m")


_ARRIVE = "row_number() OVER (ORDER BY md5(CAST({0} AS VARCHAR)), {0})"


@_query("SELECT row_number() OVER (ORDER BY o_custkey, o_orderkey) AS pos, o_custkey, o_orderkey FROM orders")
def sort_int64(spark, sf_dir):
    return with_position(_t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey").select("pos", "o_custkey", "o_orderkey")


@_query("SELECT row_number() OVER (ORDER BY p_size, p_partkey) AS pos, p_size, p_partkey FROM part")
def sort_int32(spark, sf_dir):
    return with_position(_t(spark, sf_dir, "part").select("p_size", "p_partkey"), "p_size", "p_partkey")


@_query("SELECT row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS pos, o_totalprice, o_orderkey FROM orders")
def sort_desc(spark, sf_dir):
    return with_position(_t(spark, sf_dir, "orders").select("o_totalprice", "o_orderkey"), desc("o_totalprice"), "o_orderkey")


@_query(
    """SELECT row_number() OVER (ORDER BY l_returnflag, l_shipdate DESC, l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice) AS pos,
    l_returnflag, l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice FROM lineitem"""
)
def sort_multi_mixed(spark, sf_dir):
    keys = ["l_returnflag", "l_shipdate", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice"]
    rows = _t(spark, sf_dir, "lineitem").select(*keys)
    return with_position(rows, asc(keys[0]), desc(keys[1]), *keys[2:]).drop("l_shipdate")


@_query("SELECT row_number() OVER (ORDER BY c_mktsegment, c_custkey) AS pos, c_mktsegment, c_custkey FROM customer")
def sort_string(spark, sf_dir):
    return with_position(_t(spark, sf_dir, "customer").select("c_mktsegment", "c_custkey"), "c_mktsegment", "c_custkey")


@_query("SELECT row_number() OVER (ORDER BY ts, event_id) AS pos, event_id FROM events")
def sort_timestamp(spark, sf_dir):
    return with_position(_t(spark, sf_dir, "events").select("ts", "event_id"), "ts", "event_id").select("pos", "event_id")


@_query("SELECT row_number() OVER (ORDER BY abs(c_acctbal), c_custkey) AS pos, c_custkey, c_acctbal FROM customer")
def sort_derived_key(spark, sf_dir):
    return with_position(_t(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), F.abs("c_acctbal"), "c_custkey")


@_query("SELECT row_number() OVER (ORDER BY l_quantity) AS pos, l_quantity FROM lineitem")
def sort_duplicates(spark, sf_dir):
    return with_position(_t(spark, sf_dir, "lineitem").select("l_quantity"), "l_quantity")


@_query("SELECT row_number() OVER (ORDER BY o_custkey, o_orderkey) AS pos, o_custkey, o_orderkey FROM orders")
def sort_ranged(spark, sf_dir):
    """The form for inputs that one task can't rank."""
    return with_position(_t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey", one_task_bytes=-1)


@_query("SELECT row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS pos, o_totalprice, o_orderkey FROM orders")
def sort_total(spark, sf_dir):
    """The sort itself: places are read off its partitions and the rows' order in them."""
    rows = sort(_t(spark, sf_dir, "orders").select("o_totalprice", "o_orderkey"), desc("o_totalprice"), "o_orderkey")
    return with_position(written(rows.withColumn("at", F.monotonically_increasing_id())), "at").drop("at")


@_query("SELECT o_orderkey FROM orders WHERE false")
def sort_empty(spark, sf_dir):
    return sort(_t(spark, sf_dir, "orders").select("o_orderkey").where("false"), "o_orderkey")


@_query("SELECT row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS pos, o_orderkey, o_totalprice FROM orders ORDER BY pos LIMIT 100")
def topk_early_stop(spark, sf_dir):
    return top(_t(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), 100, desc("o_totalprice"), "o_orderkey")


@_query(
    f"""SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY o_orderkey) AS pos, o_orderkey
    FROM (SELECT ({_ARRIVE.format("o_orderkey")} - 1) // 64 AS run_id, o_orderkey FROM orders)"""
)
def run_generation_fixed(spark, sf_dir):
    rows = runs_fixed(_arrived(_t(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey"), "arrive", 512, 8)
    return sort_within_runs(rows, "o_orderkey").select("run_id", "pos", "o_orderkey")


@_query(
    """WITH RECURSIVE d AS (
      SELECT row_number() OVER (ORDER BY doc_id) AS n, doc_id, octet_length(encode(text)) AS size FROM documents
    ), r AS (
      SELECT n, doc_id, size AS used, 0::BIGINT AS run_id FROM d WHERE n = 1
      UNION ALL
      SELECT d.n, d.doc_id, CASE WHEN r.used + d.size > 65536 THEN d.size ELSE r.used + d.size END,
        CASE WHEN r.used + d.size > 65536 THEN r.run_id + 1 ELSE r.run_id END
      FROM r JOIN d ON d.n = r.n + 1
    ) SELECT doc_id, run_id FROM r"""
)
def run_generation_next_fit(spark, sf_dir):
    rows = with_position(_t(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").alias("size")), "doc_id")
    return runs_next_fit(rows, "pos", F.col("size"), 65536).select("doc_id", "run_id")


@_query(
    f"""WITH a AS (SELECT {_ARRIVE.format("o_orderkey")} AS arrive, o_orderkey FROM orders),
    r AS (SELECT *, (arrive - 1) // 64 AS run_id FROM a),
    c AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY arrive) - 1 AS off, count(*) OVER (PARTITION BY run_id) AS n FROM r)
    SELECT run_id, off // ((n + 3) // 4) AS chunk,
      row_number() OVER (PARTITION BY run_id, off // ((n + 3) // 4) ORDER BY o_orderkey) AS pos, o_orderkey FROM c"""
)
def run_chunks(spark, sf_dir):
    rows = chunks_of_runs(runs_fixed(_arrived(_t(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey"), "arrive", 512, 8), "arrive", 4)
    return sort_within_runs(rows.withColumn("both", F.struct("run_id", "chunk")), "o_orderkey", run="both").select("run_id", "chunk", "pos", "o_orderkey")


@_query("SELECT row_number() OVER (ORDER BY o_orderkey) AS pos, CAST(o_orderkey % 5 AS INTEGER) AS source, o_orderkey FROM orders")
def kway_merge(spark, sf_dir):
    rows = _t(spark, sf_dir, "orders").select("o_orderkey")
    return merge_sorted([rows.where(F.col("o_orderkey") % 5 == i) for i in range(5)], "o_orderkey").select("pos", "source", "o_orderkey")


@_query(
    """SELECT row_number() OVER (ORDER BY k, source) AS pos, source, k FROM (
      SELECT 0 AS source, o_orderkey AS k FROM orders UNION ALL SELECT 2, event_id FROM events UNION ALL SELECT 3, c_custkey FROM customer)"""
)
def kway_merge_uneven_empty(spark, sf_dir):
    parts = [(_t(spark, sf_dir, t).select(F.col(c).alias("k"))) for t, c in (("orders", "o_orderkey"), ("orders", "o_orderkey"), ("events", "event_id"), ("customer", "c_custkey"))]
    parts[1] = parts[1].where("false")
    return merge_sorted(parts, "k", "source").select("pos", "source", "k")


@_query(
    """WITH RECURSIVE r AS (
      SELECT 0::BIGINT AS round, ((SELECT count(*) FROM orders) + 63) // 64 AS n
      UNION ALL SELECT round + 1, (n + 3) // 4 FROM r WHERE n > 4
    ) SELECT round, f AS file, f // 4 AS batch FROM (SELECT round, unnest(range(n)) AS f FROM r WHERE n > 4)"""
)
def merge_plan_rounds(spark, sf_dir):
    n = _t(spark, sf_dir, "orders").count()
    return merge_plan(spark, -(-n // 64), 4)


@_query("SELECT n_nationkey, 'Record: ' || CAST(n_nationkey AS VARCHAR) AS record FROM nation")
def map_project(spark, sf_dir):
    return _t(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.lit("Record: "), F.col("n_nationkey").cast("string")).alias("record"))


@_query("SELECT (row_number() OVER (ORDER BY o_orderkey) - 1) // 14 AS block_no, (row_number() OVER (ORDER BY o_orderkey) - 1) % 14 AS slot, o_orderkey FROM orders")
def block_pack_fixed(spark, sf_dir):
    rows = with_position(_t(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")
    return pack_fixed(rows, "pos", 128, 8).select("block_no", "slot", "o_orderkey")


@_query(
    """WITH RECURSIVE d AS (
      SELECT row_number() OVER (ORDER BY c_custkey) AS n, c_custkey, 2 + octet_length(encode(c_name)) AS size FROM customer
    ), r AS (
      SELECT n, c_custkey, 8 + size AS used, 8::BIGINT AS place, 0::BIGINT AS block_no, 0::BIGINT AS slot FROM d WHERE n = 1
      UNION ALL
      SELECT d.n, d.c_custkey, CASE WHEN r.used + d.size > 4096 THEN 8 + d.size ELSE r.used + d.size END,
        CASE WHEN r.used + d.size > 4096 THEN 8 ELSE r.used END,
        CASE WHEN r.used + d.size > 4096 THEN r.block_no + 1 ELSE r.block_no END,
        CASE WHEN r.used + d.size > 4096 THEN 0 ELSE r.slot + 1 END
      FROM r JOIN d ON d.n = r.n + 1
    ) SELECT c_custkey, block_no, slot, place AS "offset" FROM r"""
)
def block_pack_varlen(spark, sf_dir):
    rows = with_position(_t(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey")
    return pack_var(rows, "pos", F.octet_length("c_name"), 4096).select("c_custkey", "block_no", "slot", "offset")


def _round_trip(spark: SparkSession, rows: DataFrame, kind: str, size: int, codec: str) -> DataFrame:
    """Rows (position from 1, value) in FILES files, written and read again: (value, file_no, block_no, slot)."""
    register(spark)
    each = F.lit(-(-rows.count() // FILES))
    path = new_path(spark, kind)
    placed = rows.withColumn("file_no", F.floor((F.col("pos") - 1) / each).cast("int"))
    placed.repartitionById(FILES, "file_no").sortWithinPartitions("pos").select(rows.columns[1]).write.format(kind).option("blockSize", size).option("codec", codec).mode("overwrite").save(path)
    read = spark.read.format(kind).option("blockSize", size).option("codec", codec).load(path)
    return read.select("value", F.substring("file", 6, 5).cast("int").alias("file_no"), "block_no", "slot")


#: Files of the block queries.
FILES = 3


@_query(
    """WITH p AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, (count(*) OVER () + 2) // 3 AS n FROM orders)
    SELECT o_orderkey, CAST(i // n AS INTEGER) AS file_no, (i % n) // 510 AS block_no, (i % n) % 510 AS slot FROM p"""
)
def block_roundtrip_fixed(spark, sf_dir):
    rows = with_position(_t(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey").select("pos", "o_orderkey")
    return _round_trip(spark, rows, "fixedblock", 4096, "int64").withColumnRenamed("value", "o_orderkey")


@_query(
    """WITH RECURSIVE p AS (
      SELECT c_name, row_number() OVER (ORDER BY c_custkey) - 1 AS i, (count(*) OVER () + 2) // 3 AS n FROM customer
    ), d AS (
      SELECT c_name, i // n AS file_no, i % n AS k, 2 + octet_length(encode(c_name)) AS size FROM p
    ), r AS (
      SELECT c_name, file_no, k, 8 + size AS used, 0::BIGINT AS block_no, 0::BIGINT AS slot FROM d WHERE k = 0
      UNION ALL
      SELECT d.c_name, d.file_no, d.k, CASE WHEN r.used + d.size > 4096 THEN 8 + d.size ELSE r.used + d.size END,
        CASE WHEN r.used + d.size > 4096 THEN r.block_no + 1 ELSE r.block_no END,
        CASE WHEN r.used + d.size > 4096 THEN 0 ELSE r.slot + 1 END
      FROM r JOIN d ON d.file_no = r.file_no AND d.k = r.k + 1
    ) SELECT c_name, CAST(file_no AS INTEGER) AS file_no, block_no, slot FROM r"""
)
def block_roundtrip_var(spark, sf_dir):
    rows = with_position(_t(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey").select("pos", "c_name")
    return _round_trip(spark, rows, "varblock", 4096, "text").withColumnRenamed("value", "c_name")


@_query(
    """SELECT o_orderkey, lpad(to_hex(o_orderkey), 16, '0') AS plus, lpad(to_hex(-o_orderkey), 16, '0') AS minus FROM orders"""
)
def codec_int64(spark, sf_dir):
    return _t(spark, sf_dir, "orders").select("o_orderkey", F.hex(int64_bytes("o_orderkey")).alias("plus"), F.hex(int64_bytes(-F.col("o_orderkey"))).alias("minus"))


@_query(
    """SELECT p_partkey, right(lpad(to_hex(p_size::BIGINT), 16, '0'), 8) AS plus, right(lpad(to_hex((-p_size)::BIGINT), 16, '0'), 8) AS minus FROM part"""
)
def codec_int32(spark, sf_dir):
    return _t(spark, sf_dir, "part").select("p_partkey", F.hex(int32_bytes("p_size")).alias("plus"), F.hex(int32_bytes(-F.col("p_size"))).alias("minus"))


@_query(
    """SELECT o_orderkey, CAST(CASE WHEN v >= 9223372036854775808::HUGEINT THEN v - 18446744073709551616::HUGEINT ELSE v END AS BIGINT) AS value, o_orderkey * -1000000007 AS again
    FROM (SELECT o_orderkey, CAST(CAST('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 16) AS UBIGINT) AS HUGEINT) AS v FROM orders)"""
)
def codec_int64_decode(spark, sf_dir):
    """Any eight bytes, and bytes of the own encoding."""
    data = F.unhex(F.substring(F.md5(F.col("o_orderkey").cast("string")), 1, 16))
    return _t(spark, sf_dir, "orders").select("o_orderkey", int64_value(data).alias("value"), int64_value(int64_bytes(F.col("o_orderkey") * -1000000007)).alias("again"))


@_query(
    """SELECT p_partkey, CAST(CASE WHEN v >= 2147483648 THEN v - 4294967296 ELSE v END AS INTEGER) AS value, -p_size AS again
    FROM (SELECT p_partkey, p_size, CAST(CAST('0x' || substr(md5(CAST(p_partkey AS VARCHAR)), 1, 8) AS UBIGINT) AS BIGINT) AS v FROM part)"""
)
def codec_int32_decode(spark, sf_dir):
    data = F.unhex(F.substring(F.md5(F.col("p_partkey").cast("string")), 1, 8))
    return _t(spark, sf_dir, "part").select("p_partkey", int32_value(data).alias("value"), int32_value(int32_bytes(-F.col("p_size"))).alias("again"))


@_query(
    """SELECT c_custkey, '00000000' || rpad(hex(c_name), 120, '0') AS page, substr(hex(c_name), 1, 16) AS got FROM customer"""
)
def page_bytes(spark, sf_dir):
    """A zero page of 64 bytes, a name set at byte 4, and its first eight bytes got again."""
    rows = _t(spark, sf_dir, "customer").select("c_custkey", set_bytes(zero_page(64), 4, F.encode("c_name", "UTF-8")).alias("page"))
    return rows.select("c_custkey", F.hex("page").alias("page"), F.hex(get_bytes(F.col("page"), 4, 8)).alias("got"))


@_query(
    """WITH batch AS (
      SELECT o_custkey AS block_nr, arg_max(o_orderkey, o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey
      UNION ALL SELECT (SELECT max(c_custkey) + 1 FROM customer) + s_suppkey, -s_suppkey FROM supplier
    ) SELECT coalesce(b.block_nr, c_custkey) AS block_nr, coalesce(b.o_orderkey, 0) AS data, c_name IS NULL AS added
    FROM customer FULL JOIN batch b ON b.block_nr = c_custkey"""
)
def page_write(spark, sf_dir):
    """Pages that are new, that are there, and that come several times in a batch: the last write counts."""
    customers, suppliers = _t(spark, sf_dir, "customer"), _t(spark, sf_dir, "supplier")
    manager = StorageManager()
    manager.register(Storage("pages", customers.select(F.col("c_custkey").alias("block_nr"), int64_bytes(F.lit(0)).alias("data"), F.lit(False).alias("added")), block_bytes=8))
    rows = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("block_nr"), "o_orderkey")
    top_page = customers.agg((F.max("c_custkey") + 1).alias("top"))
    new = suppliers.crossJoin(F.broadcast(top_page)).select((F.col("top") + F.col("s_suppkey")).alias("block_nr"), (-F.col("s_suppkey")).alias("o_orderkey"))
    batch = rows.withColumn("added", F.lit(False)).unionByName(new.withColumn("added", F.lit(True)))
    manager.write("pages", batch.select("block_nr", int64_bytes("o_orderkey").alias("data"), "added", F.col("o_orderkey").alias("step")), "step")
    return manager.get("pages").pages.select("block_nr", int64_value("data").alias("data"), "added")


@_query(
    """SELECT block_nr, slot, o_orderkey FROM (SELECT (row_number() OVER (ORDER BY o_orderkey) - 1) // 14 AS block_nr,
      (row_number() OVER (ORDER BY o_orderkey) - 1) % 14 AS slot, o_orderkey FROM orders) WHERE block_nr = 3"""
)
def page_point_read(spark, sf_dir):
    rows = pack_fixed(with_position(_t(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey"), "pos", 128, 8)
    manager = StorageManager()
    manager.register(Storage("orders", rows.withColumnRenamed("block_no", "block_nr")))
    return manager.read("orders", 3).select("block_nr", "slot", "o_orderkey")


@_query(
    """SELECT 'customer' AS storage_id, c_custkey AS block_nr FROM customer WHERE c_custkey = 7
    UNION ALL SELECT 'supplier', s_suppkey FROM supplier WHERE s_suppkey = 3"""
)
def storage_route(spark, sf_dir):
    manager = StorageManager()
    manager.register(Storage("customer", _t(spark, sf_dir, "customer"), "c_custkey"))
    manager.register(Storage("supplier", _t(spark, sf_dir, "supplier"), "s_suppkey"))
    found = [manager.read(n, k).select(F.lit(n).alias("storage_id"), F.col(c).alias("block_nr")) for n, k, c in (("customer", 7, "c_custkey"), ("supplier", 3, "s_suppkey"))]
    return found[0].unionByName(found[1])


@_query(
    """SELECT o_orderkey AS block_nr, NULL AS page FROM orders UNION ALL SELECT max(o_orderkey) + 1, repeat('00', 32) FROM orders
    UNION ALL SELECT max(o_orderkey) + 2, repeat('00', 16) FROM orders"""
)
def page_reserve(spark, sf_dir):
    """All pages after two more were reserved."""
    storage = Storage("orders", _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("block_nr"), F.lit(None).cast("binary").alias("data")))
    storage.reserve(32)
    storage.reserve(16)
    return storage.pages.select("block_nr", F.hex("data").alias("page"))


@_query("SELECT o_orderkey, CASE WHEN o_orderkey < 4 THEN o_custkey + 10 ELSE o_custkey END AS o_custkey FROM orders")
def page_update_flush(spark, sf_dir):
    storage = Storage("orders", _t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey")
    storage.update([0, 1, 2, 3], {"o_custkey": lambda c: c + 10})
    path = new_path(spark, "flushed")
    storage.flush(path)
    return spark.read.parquet(path)


@_query("SELECT c_custkey, c_name FROM customer WHERE c_custkey % 10 <> 0")
def page_delete(spark, sf_dir):
    rows = _t(spark, sf_dir, "customer").select("c_custkey", "c_name")
    storage = Storage("customer", rows, "c_custkey")
    storage.delete(rows.where("c_custkey % 10 = 0"))
    return storage.pages


@_query(
    """SELECT p.pos + r * (SELECT count(*) FROM orders) AS step, o_orderkey, o_custkey
    FROM (SELECT row_number() OVER (ORDER BY md5(CAST(o_orderkey AS VARCHAR)), o_orderkey) AS pos, o_orderkey, o_custkey FROM orders) p, (SELECT unnest(range(2)) AS r)"""
)
def cached_rescan(spark, sf_dir):
    """Every page is accessed twice, in a shuffled order."""
    orders = _t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    storage = Storage("orders", orders, "o_orderkey").cache()
    n = orders.count()
    trace = _arrived(orders.select("o_orderkey"), "o_orderkey").select("o_orderkey", F.explode(F.array(F.col("arrive"), F.col("arrive") + n)).alias("step"))
    return storage.access(trace).select("step", "o_orderkey", "o_custkey")


@_query(
    """SELECT row_number() OVER (ORDER BY ts, event_id) - 1 AS lsn, event_id, row_number() OVER (ORDER BY ts, event_id) - 1 <= (SELECT count(*) FROM events) // 2 AS early FROM events"""
)
def log_append_scan(spark, sf_dir):
    """All events are appended in two halves by id, the log is flushed up to the middle, scanned, flushed and scanned again."""
    log = Log(spark, new_path(spark, "log"))
    events = _t(spark, sf_dir, "events").select("ts", "event_id")
    last = log.append(events, F.col("event_id").cast("string"), "ts", "event_id")
    log.flush((last + 1) // 2)
    early = log.scan().select("lsn", F.lit(True).alias("early"))
    log.flush()
    return log.scan().join(early, "lsn", "left").select("lsn", F.decode("entry", "UTF-8").cast("long").alias("event_id"), F.coalesce("early", F.lit(False)).alias("early"))


@_query(
    """SELECT row_number() OVER (ORDER BY q, ts, event_id) - 1 AS lsn, event_id
    FROM (SELECT ts, event_id, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS q FROM events)"""
)
def log_two_appends(spark, sf_dir):
    """Numbers go on where the append before ended."""
    log = Log(spark, new_path(spark, "log"))
    events = _t(spark, sf_dir, "events")
    for part in (events.where("event_type != 'purchase'"), events.where("event_type = 'purchase'")):
        log.append(part.select("ts", "event_id"), F.col("event_id").cast("string"), "ts", "event_id")
    log.flush()
    return log.scan().select("lsn", F.decode("entry", "UTF-8").cast("long").alias("event_id"))


@_query(
    """SELECT user_id, event_id, CASE WHEN k <= 4 THEN 'ok' ELSE 'full' END AS status, CASE WHEN k <= 4 THEN k - 1 ELSE -1 END AS slot
    FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events)"""
)
def queue_bounded_fifo(spark, sf_dir):
    return fill(_t(spark, sf_dir, "events").select("user_id", "event_id", "ts"), 4, "ts", "event_id", queue="user_id").withColumn("slot", F.coalesce("slot", F.lit(-1))).drop("ts")


@_query(
    """WITH RECURSIVE e AS (
      SELECT event_type AS queue, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS step,
        CASE WHEN event_id % 3 = 0 THEN 'dequeue' ELSE 'enqueue' END AS op, event_id AS value FROM events
    ), r AS (
      SELECT queue, step, op, value, CASE WHEN op = 'enqueue' THEN [value] ELSE []::BIGINT[] END AS held,
        CASE WHEN op = 'enqueue' THEN 'ok' ELSE 'empty' END AS status, NULL::BIGINT AS result FROM e WHERE step = 1
      UNION ALL
      SELECT e.queue, e.step, e.op, e.value,
        CASE WHEN e.op = 'enqueue' AND len(r.held) < 4 THEN list_append(r.held, e.value) WHEN e.op = 'dequeue' THEN r.held[2:] ELSE r.held END,
        CASE WHEN e.op = 'enqueue' THEN CASE WHEN len(r.held) < 4 THEN 'ok' ELSE 'full' END WHEN len(r.held) > 0 THEN 'ok' ELSE 'empty' END,
        CASE WHEN e.op = 'dequeue' THEN r.held[1] END
      FROM r JOIN e ON e.queue = r.queue AND e.step = r.step + 1
    ) SELECT queue, step, op, value, status, coalesce(result, -1) AS result, len(held) AS size FROM r"""
)
def queue_replay(spark, sf_dir):
    rows = _t(spark, sf_dir, "events").select(F.col("event_type").alias("queue"), "ts", "event_id")
    trace = sort_within_runs(rows, "ts", "event_id", run="queue", name="step")
    op = F.when(F.col("event_id") % 3 == 0, "dequeue").otherwise("enqueue")
    return replay(trace.select("queue", "step", op.alias("op"), F.col("event_id").alias("value")), 4).withColumn("result", F.coalesce("result", F.lit(-1)))


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector as a box: its first half is one corner, its second half the other."""
    v, d = F.col("embedding").cast("array<double>"), F.floor(F.size("embedding") / 2).cast("int")
    return _t(spark, sf_dir, "embeddings").select("vec_id", rectangle(F.slice(v, F.lit(1), d), F.slice(v, d + 1, d)).alias("box"))


def _axes(df: DataFrame, *more: str) -> DataFrame:
    return df.select("vec_id", *more, F.posexplode(F.arrays_zip("box.low_left", "box.up_right")).alias("axis", "c")).select(
        "vec_id", F.col("axis").cast("long").alias("axis"), F.col("c.low_left").alias("low"), F.col("c.up_right").alias("up"), *more
    )


_AXES = "(SELECT vec_id, embedding, len(embedding) // 2 AS d, unnest(range(len(embedding) // 2)) AS i FROM embeddings)"


@_query(f"SELECT vec_id, i AS axis, CAST(embedding[i + 1] AS DOUBLE) AS low, CAST(embedding[i + 1 + d] AS DOUBLE) AS up, CAST(2 + 16 * d AS BIGINT) AS bytes FROM {_AXES}")
def rect_build_size(spark, sf_dir):
    return _axes(_boxes(spark, sf_dir).withColumn("bytes", rectangle_bytes("box")), "bytes")


@_query(f"SELECT vec_id, i AS axis, CAST(embedding[i + 1] AS DOUBLE) AS low, CAST(embedding[i + 1 + d] AS DOUBLE) AS up FROM {_AXES}")
def rect_codec_roundtrip(spark, sf_dir):
    data = encode_rectangles(_boxes(spark, sf_dir), "box").select("vec_id", "data")
    return _axes(decode_rectangles(data, "data"))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
