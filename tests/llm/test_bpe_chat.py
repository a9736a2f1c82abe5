import base64
import hashlib
import random

import duckdb
import pytest

import __spark_entry__ as entry
from runmill.llm.bpe import decode_documents, encode_documents, encode_text, round_trip_digests, vocabulary
from runmill.llm.chat import OP2_SQL, format_preferences

P = pytest.importorskip("public_tokenizers")
PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_chunks_equal_the_library(library):
    v, r = vocabulary(PATH, P.PATTERN), random.Random(2)
    letters = ["a", "b", " ", "  ", "\n", "'s", "1", "é", "!", "漢", "\t", "'", " ", "\x1c"]
    for _ in range(1500):
        text = "".join(r.choice(letters[: r.randint(1, 14)]) * r.choice([1, 1, 2, 9]) for _ in range(r.randint(0, 120)))
        chunk = r.randint(4, 30)
        assert encode_text(v, text, chunk, r.randint(3, chunk)).tolist() == library.encode_ordinary(text)


def test_documents_round_trip(spark, library):
    texts = ["", None, "Hello world's  end\n\n x", "<|endoftext|>", "a" * 5000, "word " * 3000, "x\n" * 2000 + " " * 900 + "é漢" * 500] * 2
    df = spark.createDataFrame([(i % 7 or None, t) for i, t in enumerate(texts)], "doc_id long, text string").selectExpr("*", "1 AS ids", "2 AS k")
    enc = encode_documents(df, PATH, P.PATTERN, 1000, 100)
    got = sorted((list(x.ids) for x in enc.collect()), key=str)
    assert got == sorted((library.encode_ordinary(t or "") for t in texts), key=str)
    assert sorted(bytes(x.data) for x in decode_documents(enc, PATH, P.PATTERN).collect()) == sorted((t or "").encode() for t in texts)
    want = sorted((len(i := library.encode_ordinary(t or "")), hashlib.sha256(" ".join(map(str, i)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for t in texts)
    assert sorted((x.n_tokens, x.ids_sha256, x.decoded_sha256) for x in round_trip_digests(enc, PATH, P.PATTERN).collect()) == want
    assert encode_documents(df.limit(0), PATH, P.PATTERN).count() == 0


SF = "/root/testdata/sf0.001"


def test_most_texts_have_several_chunks(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for how in ({}, {"chunk_chars": 300, "overlap_chars": 40}):
        rows = docs.unionByName(docs.where("doc_id < 3"))
        got = encode_documents(rows, PATH, P.PATTERN, **how).collect()
        want = [(x.doc_id, library.encode_ordinary(x.text or "")) for x in rows.collect()]
        assert sorted((x.doc_id, list(x.ids)) for x in got) == sorted(want)
    v = vocabulary(PATH, P.PATTERN)
    for x in docs.collect():
        for chunk, overlap in ((60, 20), (200, 50), (2048, 128)):
            assert encode_text(v, x.text, chunk, overlap).tolist() == library.encode_ordinary(x.text)
    assert sum(len(x.text) > 200 for x in docs.collect()) > 0.7 * docs.count()


def test_the_query_equals_the_library(spark, library):
    texts = {x.doc_id: x.text or "" for x in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = entry.queries()["op3_bpe"](spark, SF).collect()
    for x in got:
        ids = library.encode_ordinary(texts[x.doc_id])
        assert (x.n_tokens, x.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert x.decoded_sha256 == hashlib.sha256(texts[x.doc_id].encode()).hexdigest()
    assert len(got) == len(texts)


def test_preferences_equal_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    df = entry.queries()["op2_preferences"](spark, SF)
    want = con.sql(f"SELECT {', '.join(df.columns)} FROM ({OP2_SQL})").fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(want)


def test_preferences_equal_sql_on_odd_conversations(spark, tmp_path):
    """Repeated turns, null numbers and roles, conversations of one turn, gaps between ids."""
    rows = [(1, 0, "user", "A"), (1, 1, "assistant", "B"), (1, 1, "assistant", "B"), (2, None, "user", "A"), (2, None, None, None), (2, 0, "assistant", "B"), (2, 3, "assistant", "é"), (3, 0, "user", "A"), (5, 0, "user", "x"), (5, 1, "assistant", ""), (6, 0, "user", "x"), (6, 1, "assistant", "")]
    rows += [(10 + c, t, ["user", "assistant"][t % 2], f"t{t}" if t < 4 else f"{c}{t}") for c in range(6) for t in range(3 + c)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    got = entry.queries()["op2_preferences"](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == sorted(con.sql(f"SELECT {', '.join(got.columns)} FROM ({OP2_SQL})").fetchall())
    by_id = {x.pair_id: x for x in got.collect()}
    assert (by_id[5].n_prompt_turns, by_id[5].chosen, by_id[5].rejected) == (2, "", "")
    assert by_id[14].n_prompt_turns == 4 and by_id[14].chosen.count("<|end|>") == 3 and by_id[14].rejected.count("<|end|>") == 4


def test_longest_common_prefix_and_masks(spark):
    rows = [
        (1, "chosen", 0, "user", "hi"), (1, "rejected", 0, "user", "hi"), (1, "chosen", 1, "assistant", "A"), (1, "rejected", 1, "assistant", "Bé"), (1, "rejected", 2, "user", "?"),
        (2, "chosen", 0, "user", "same"), (2, "rejected", 0, "user", "same"),
        (3, "chosen", 0, None, None), (None, "rejected", None, "assistant", "x"), (None, "rejected", None, "assistant", "x"),
    ]
    df = spark.createDataFrame(rows, "pair_id long, side string, turn long, role string, text string")
    got = {x.pair_id: x for x in format_preferences(df.selectExpr("*", "1 AS prompt")).collect()}
    assert got[1].prompt == "<|user|>\nhi<|end|>\n" and got[1].chosen == "<|assistant|>\nA<|end|>\n"
    a, b = map(int, got[1].rejected_mask.split(":"))
    assert got[1].rejected[a:b] == "Bé<|end|>\n"
    assert (got[2].n_prompt_turns, got[2].chosen, got[2].rejected, got[2].chosen_mask) == (1, "", "", "")
    assert (got[3].n_prompt_turns, got[3].prompt, got[3].chosen) == (0, "", "<||>\n<|end|>\n")
    assert got[None].rejected == "<|assistant|>\nx<|end|>\n" * 2 and len(got[None].rejected_mask.split(",")) == 2
    assert format_preferences(df.limit(0)).count() == 0
