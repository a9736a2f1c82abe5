import hashlib

import corpus_pipeline
from runmill.llm.ngram_join import join_documents
from runmill.llm.secret_scan import base_spans, redact
from runmill.llm.toxicity import Lexicon, learn

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == columns
        kept[name] = {x.doc_id: x.text for x in docs.collect()}
    lexicon = Lexicon(learn(before, spark.read.parquet(f"{SF}/labels.parquet")))
    texts = {x.doc_id: x.text for x in before.collect()}
    assert kept["toxicity"] == {i: t for i, t in texts.items() if lexicon.score(t) < 0.7}
    first = before.where(before.doc_id.isin(list(kept["toxicity"])))
    assert set(kept["ngram_join"]) == {x.component_id for x in join_documents(first).collect()}
    assert set(kept["secrets"]) == set(kept["ngram_join"]) == set(kept["mixing"])
    assert not any(base_spans(t) for t in kept["secrets"].values())
    assert kept["secrets"] == {i: redact(t) for i, t in kept["ngram_join"].items()} and kept["mixing"] == kept["secrets"]
    tokens = library()
    want = {i: tokens(t) for i, t in kept["mixing"].items()}
    last = corpus_pipeline.run(spark, SF).collect()
    assert {x.doc_id: (x.n_tokens, x.ids_sha256) for x in last} == want


def library():
    import base64

    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    encoding = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def tokens(text):
        ids = encoding.encode_ordinary(text or "")
        return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()

    return tokens


ROWS = "doc_id long, text string, lang string, source string, n_chars long, key string, `a.b` long"


def test_odd_and_empty_tables(spark, tmp_path):
    """Nulls in any column, empty and repeated rows, ties, a long text, further columns with the operators' own names."""
    long_text = "".join(f"word{i} " for i in range(40_000))
    rows = [
        (1, "one two three four five six seven eight", "en", "a", 1, "k", 1), (2, "one two three four five six seven EIGHT", "en", "b", 1, "k", 2), (3, None, None, None, None, None, None), (None, "a text without id", None, "a", 5, "x", 0),
        (4, "", "en", None, 0, "", 3), (5, "token=abcdefgh and a few more words", "de", "a", 9, "q", 4), (5, "token=abcdefgh and a few more words", "de", "a", 9, "q", 4), (6, long_text, "en", "a", 1, "l", 5),
        (7, "you idiot you", "en", "c", 1, "t", 6),
    ]
    clean = [(100 + i, f"clean{i} words{i} of{i} a{i} text{i} here{i}", "en", "a", 1, "c", i) for i in range(60)]
    toxic = [(200 + i, f"such{i} an{i} idiot this{i} is{i} now{i}", "en", "a", 1, "c", i) for i in range(40)]
    spark.createDataFrame(rows + clean + toxic, ROWS).write.parquet(f"{tmp_path}/odd/documents.parquet")
    labels = [(x[0], 1, int(x[0] >= 200)) for x in clean + toxic] + [(None, None, None), (1, 1, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/odd/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/odd/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, f"{tmp_path}/odd").write.parquet(f"{tmp_path}/stages/{name}")
        after = spark.read.parquet(f"{tmp_path}/stages/{name}")
        assert after.columns == docs.columns
        docs = after
    got = docs.collect()
    assert sorted((x.doc_id for x in got if x.doc_id is None or x.doc_id < 100), key=str) == sorted([1, 3, None, 4, 5, 6], key=str)
    assert {x.doc_id for x in got if x.doc_id and x.doc_id >= 100} == {x[0] for x in clean}
    assert [x.text for x in got if x.doc_id == 5] == ["[SECRET] and a few more words"] and [x.text for x in got if x.doc_id == 6] == [long_text]
    tokens = library()
    last = corpus_pipeline.run(spark, f"{tmp_path}/odd").collect()
    assert sorted(((x.doc_id, (x.n_tokens, x.ids_sha256)) for x in last), key=str) == sorted(((x.doc_id, tokens(x.text)) for x in got), key=str)
    for table in ("documents", "labels"):
        spark.read.parquet(f"{tmp_path}/odd/{table}.parquet").limit(0).write.parquet(f"{tmp_path}/empty/{table}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").collect() == []
