import random
import re
from collections import Counter

from runmill.llm.quality import assess
from runmill.llm.toxicity import Lexicon, Term, Terms, learn, score_documents, without_toxic

ROWS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def measured(text):
    text = text or ""
    words, seen, dup = WORD.findall(text), set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    n, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if n[w] > 1:
            covered |= set(range(i, i + 8))
    symbols = sum(text.count(c) for c in "#*$%&|<>")
    return len(words), sum(map(len, words)), symbols, dup, len(covered), len(words) < 20 or 100 * len(covered) > 30 * len(words)


def test_measures_and_verdicts(spark):
    r = random.Random(5)
    clean = [" ".join(r.choice(["alpha", "beta", "gamma", "délta", "of", f"w{i}_{j}"]) for j in range(60)) for i in range(40)]
    odd = ["### $$$ " * 30 + clean[0], "\n".join(["one line of words"] * 12), "a a " * 40, None, "", " \t\n ", "é\x0b\x0cü" * 30, clean[1] + "\n" + clean[1], "x" * 100_000]
    rows = [(i if i % 9 else None, t, r.choice(["en", None]), r.choice(["s", None]), 1) for i, t in enumerate(clean + odd + clean[:3])]
    df = spark.createDataFrame(rows, ROWS).selectExpr("*", "1 AS n_words", "2 AS kept")
    got = assess(df).collect()
    assert sorted((x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.base_failed) for x in got) == sorted(measured(t) for _, t, *_ in rows)
    assert not any(x.kept for x in got if x.base_failed) and not any(x.kept for x in got if x.n_symbols > 100)
    assert sum(x.kept for x in got) >= 43
    assert assess(df.limit(0)).count() == 0


LETTERS = "idotsupcmwrhle"


def edits(w):
    s = {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in LETTERS} | {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in LETTERS}
    return s | {w[:i] + w[i + 1] + w[i] + w[i + 2 :] for i in range(len(w) - 1)}


def distance(a, b):
    """Changed, missing, additional and swapped characters; swapped ones are not edited again."""
    d = [[max(i, j) if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_edits_match_brute_force():
    """One edit for terms of four letters and more, two for terms of eight and more, one within a beginning."""
    terms, stem = ["idiot", "stupid", "scum", "worthless"], "pomed"
    lexicon = Lexicon([Term(t, True, 0.9, 0.8) for t in terms] + [Term(stem, False, 0.9, 0.5), Term("gemei", False, 0.9)])
    r = random.Random(6)
    for _ in range(6000):
        t = r.choice([*terms, stem])
        w = t
        for _ in range(r.randint(0, 3)):
            w = r.choice(sorted(edits(w)) or [w])
        if t == stem:
            w += r.choice(["", "i", "tor"])
        near = any(distance(x, w) <= 1 + (len(x) >= 8) for x in terms) or any(distance(stem, w[:k]) <= 1 for k in range(len(w) + 1))
        found = lexicon.match(w)
        exact = w in terms or w.startswith(stem)
        assert (found is not None) == (exact or near), w
        assert found is None or found[2] == (not exact), w
    assert lexicon.match("gemeiner")[1] == 5 and lexicon.match("gemeXner") is None


def test_quotation_counts_less():
    lexicon = Lexicon(Terms([Term("idiot", True, 0.95, 0.8)], 0.35, {"said": 0.6}))
    plain, quoted, reported = (lexicon.score(t) for t in ("you are an idiot there", 'the sign read "you idiot" in red', "he said that I am an idiot once"))
    assert plain >= 0.7 > reported > quoted and lexicon.score("") == lexicon.score(None) == 0
    both = lexicon.score('the sign read "you idiot" in red ' + "and much more of other words " * 3 + "you idiot")
    assert both >= plain


def test_context_and_counts_are_learned_from_the_sample(spark):
    r = random.Random(3)
    rows, labels = [], []
    for i in range(2400):
        words = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(50)]
        toxic = i % 4 == 0
        at = r.randrange(5, 45)
        if toxic:
            # Toxic texts use a word, or a beginning three times and more, that clean ones use now and then.
            if i % 8:
                words[at] = "idiot"
            else:
                for k in range(4):
                    words[(at + 7 * k) % 50] = "schim" + r.choice(["pf", "pfe", "mel"])
        elif i % 16 == 1:
            words[at : at + 1] = ["mentions", "the", '"idiot"', "word"] if i % 32 == 1 else ["paper", "mentions", "idiot"]
        elif i % 16 == 3:
            words[at] = "schimmel"
        rows.append((i, " ".join(words), "en", "s", 1))
        labels.append((i, 1, int(toxic)))
    docs, known = spark.createDataFrame(rows, ROWS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    terms = learn(docs, known)
    assert "mentions" in terms.reports and terms.quoted < 0.35
    got = [x for x in score_documents(docs, terms).collect() if x.held_out]
    wrong = [x for x in got if x.predicted != (x.doc_id % 4 == 0)]
    assert len(got) > 500 and len(wrong) <= 0.02 * len(got)


def test_held_out_accuracy_on_labelled_documents(spark):
    """Nine of 144 toxic documents of this table hold no word that tells them from clean ones."""
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    rows = score_documents(docs, learn(docs, labels)).where("held_out").join(labels, "doc_id").groupBy("toxic", "predicted").count().collect()
    n = {(x.toxic, x.predicted): x["count"] for x in rows}
    found, missed, false = n[1, 1], n.get((1, 0), 0), n.get((0, 1), 0)
    assert found / (found + missed) >= 0.92 and found / (found + false) >= 0.97


def corpus(spark, n=900):
    r = random.Random(7)
    rows, labels = [], []
    for i in range(n):
        words = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(60)]
        toxic = i % 8 == 0
        if toxic:
            for _ in range(3):
                words[r.randrange(60)] = r.choice(["idiot", "moron", "trash", "pathetic"])
        rows.append((i, " ".join(words), "en", "s", 1))
        labels.append((i, 1, int(toxic)))
    return spark.createDataFrame(rows, ROWS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy_and_edges(spark):
    docs, labels = corpus(spark)
    terms = learn(docs, labels)
    assert {t.text for t in terms} >= {"idiot", "moron", "trash", "pathetic"}
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "an idiot and idoit moron " * 20_000, "en", "s", 0)], ROWS)
    truth = {x.doc_id: x.toxic for x in labels.collect()}
    got = [x for x in score_documents(docs, terms).collect() if x.held_out]
    assert len(got) > 200 and sum(x.predicted == truth[x.doc_id] for x in got) >= 0.98 * len(got)
    scores = score_documents(odd.selectExpr("*", "1 AS score"), terms).collect()
    assert sorted(x.predicted for x in scores) == [0, 0, 0, 1] and all(0 <= x.score <= 1 for x in scores)
    kept = without_toxic(docs, terms)
    assert kept.columns == docs.columns and {x.doc_id for x in kept.collect()} >= {i for i, t in truth.items() if not t}
    assert learn(docs, labels.limit(0)) == [] and score_documents(docs.limit(0), terms).count() == 0
    assert {x.score for x in score_documents(docs.limit(5), []).collect()} == {0.0}
    assert learn(docs, labels.selectExpr("doc_id", "quality", "CAST(NULL AS INT) AS toxic")) == []


def test_fences_of_contaminated_and_small_groups(spark):
    r = random.Random(8)
    text = lambda junk: " ".join(r.choice(["alpha", "beta", "gamma", "delta"]) + f"{r.randint(0, 999)}" + (" # $ %" if junk else "") for _ in range(60))
    # Two fifths of a group, and half of four documents, are junk.
    groups = [("en", "hot", 200, 80), ("en", "tiny", 4, 2), ("fr", "only", 50, 15), ("de", "clean", 60, 0)]
    rows = [(1000 * g + i, text(i < junk), lang, source, 1) for g, (lang, source, n, junk) in enumerate(groups) for i in range(n)]
    got = {x.doc_id: x.kept for x in assess(spark.createDataFrame(rows, ROWS)).collect()}
    assert got == {1000 * g + i: i >= junk for g, (_, _, n, junk) in enumerate(groups) for i in range(n)}


def test_sketches_merge_in_any_order(spark):
    from pyspark.sql import functions as F

    from runmill.llm.quality import RATES, bucket, judge, measure, sketch

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    fences = [f"{x}_max" for x in RATES]
    runs = [sorted(map(tuple, judge(measure(d)).select("doc_id", "kept", *fences).collect())) for d in (docs, docs.repartition(7), docs.orderBy(F.desc("doc_id")))]
    assert runs[0] == runs[1] == runs[2]
    # Sketches of parts add up to that of the whole.
    rated = measure(docs).select("doc_id", "lang", "source", *[(F.col("word_chars") / (i + F.col("n_lines"))).alias(x) for i, x in enumerate(RATES)])
    parts = sketch(rated.where("doc_id % 3 = 0")).unionByName(sketch(rated.where("doc_id % 3 > 0"))).groupBy("lang", "source", "rate", "bucket").agg(F.sum("n").alias("n"))
    assert sorted(map(str, parts.collect())) == sorted(map(str, sketch(rated).collect()))
    values = spark.createDataFrame([(x,) for x in (0.0, 1e-7, 0.013, 0.5, 1.0, 4.999, 123.456, 1e6)], "v double")
    for x in values.select("v", bucket(F.col("v")).alias("b")).collect():
        assert x.b / 2**20 <= x.v <= x.b / 2**20 * (1 + 1 / 64) + 2**-20
