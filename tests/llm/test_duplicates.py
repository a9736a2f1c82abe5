import collections
import hashlib
import random
import re

import numpy as np
import pytest

from runmill.llm.components import components
from runmill.llm.ngram_join import join_documents, one_of_each
from runmill.llm.substring import remove_repeated
from runmill.llm.vectors import link_vectors

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


class Union:
    def __init__(self, n):
        self.of = list(range(n))

    def find(self, i):
        while self.of[i] != i:
            self.of[i] = self.of[self.of[i]]
            i = self.of[i]
        return i

    def join(self, i, j):
        self.of[self.find(i)] = self.find(j)


def test_components(spark):
    r = random.Random(8)
    edges = [(i, i + 1) for i in range(60)] + [(200, i) for i in range(100, 180)] + [(r.randint(300, 400), r.randint(300, 400)) for _ in range(60)] + [(5, 5), (None, 3)]
    u = Union(500)
    for a, b in edges:
        if a is not None:
            u.join(a, b)
    least = {}
    for i in range(500):
        least.setdefault(u.find(i), i)
    got = {x.id: x.root for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: least[u.find(i)] for i in {x for a, b in edges if a is not None and a != b for x in (a, b)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def near_texts(n=260):
    r, rows = random.Random(7), []
    for i in range(n):
        k = r.randint(0, 6)
        if k <= 3:
            w = [f"b{k}_{j}" for j in range(60)]
            for _ in range(r.randint(0, 4)):
                w[r.randrange(60)] = f"e{r.randint(0, 40)}"
            t = " ".join(w)
        elif k == 4:
            t = " ".join(r.choice(["A", "a", "B"]) for _ in range(r.randint(0, 12)))
        elif k == 5:
            t = None if i % 2 else ""
        else:
            t = " ".join(f"u{i}_{j}" for j in range(r.randint(1, 50)))
        rows.append((i if i % 50 else None, t))
    return rows + rows[:9]


def joined(rows):
    sets = []
    for _, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    u = Union(len(rows))
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and 100 * both >= 75 * (len(a) + len(sets[j]) - both):
                u.join(i, j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[u.find(i)] = min(least.get(u.find(i), d), d)
    return sorted(((d, len(sets[i]), least.get(u.find(i), d)) for i, (d, _) in enumerate(rows)), key=str)


@pytest.mark.parametrize("how", [{}, {"leaf": 16, "pivots": 5}, {"leaf": 4, "pivots": 2}])
def test_ngram_join_equals_brute_force(spark, how):
    rows = near_texts()
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS key", "2 AS id", "3 AS n")
    assert sorted(((x.doc_id, x.n_shingles, x.component_id) for x in join_documents(df, **how).collect()), key=str) == joined(rows)


@pytest.mark.parametrize("kind", ["far", "chain", "near", "mixed"])
def test_regions_by_pivots_equal_all_pairs(spark, kind):
    """Cells, windows and blocks, in one task and over tasks."""
    from runmill.llm.ngram_join import _in_blocks, _linked, _common, _region_links, _Region

    r, sets = np.random.default_rng(9), []
    hashes = lambda n: r.choice(2**62, n, replace=False).astype(np.uint64)
    one = hashes(40)
    for i in range(150):
        if kind == "far":
            s = np.concatenate([one[:1], hashes(int(r.integers(5, 60)))])
        elif kind == "chain":
            s = hashes(40) if i == 0 else np.concatenate([sets[-1][int(r.integers(1, 5)) :], hashes(int(r.integers(1, 5)))])
        elif kind == "near":
            s = np.concatenate([one[int(r.integers(0, 3)) :], hashes(int(r.integers(0, 3)))])
        else:
            base = sets[int(r.integers(len(sets)))] if sets and r.random() < 0.7 else hashes(int(r.integers(1, 80)))
            s = np.concatenate([base[int(r.integers(0, max(1, len(base) // 3))) :], hashes(int(r.integers(1, 6)))])
        sets.append(np.unique(s))
    n = np.array([len(s) for s in sets])
    u = Union(len(sets))
    for i, j in zip(*np.nonzero(_linked(_common(sets, sets), n, n)), strict=True):
        u.join(i, j)
    want = collections.Counter(frozenset(j for j in range(len(sets)) if u.find(j) == u.find(i)) for i in range(len(sets)))

    def groups(edges):
        v = Union(len(sets))
        for i, j in edges:
            v.join(i, j)
        return collections.Counter(frozenset(j for j in range(len(sets)) if v.find(j) == v.find(i)) for i in range(len(sets)))

    region = _Region(np.arange(len(sets)), sets, np.zeros(len(sets), np.int64), 16)
    region.ids = region.ids + 1  # labels are ids, and 0 is none
    region.join(np.arange(len(sets)))
    assert groups((a - 1, b - 1) for a, b in zip(*(x.to_pylist() for x in region.tree().columns), strict=True)) == want
    rows = spark.createDataFrame([(7, i + 1, s.tobytes(), None) for i, s in enumerate(sets)], "region long, id long, hashes binary, pivot long")
    for leaf in (8, 40):
        assert groups((x.a - 1, x.b - 1) for part in _region_links(rows, leaf, 4) for x in part.collect()) == want
    assert groups((x.a - 1, x.b - 1) for x in _in_blocks(rows, 20).collect()) == want


def test_one_of_each(spark):
    rows = [(d, t) for d, t in near_texts(90) if d is not None]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS key", "2 AS row")
    kept = one_of_each(df)
    assert kept.columns == df.columns
    assert sorted(x.doc_id for x in kept.collect()) == sorted({c for _, _, c in joined(rows)})
    assert one_of_each(df.limit(0)).count() == 0
    # Ids that are null or repeat leave one document of each group, too.
    odd = spark.createDataFrame([(None, "a b c d e f"), (None, "A b c d e f"), (5, "g h"), (5, "G h"), (6, "g  h"), (7, None), (7, None), (8, None)], "doc_id long, text string")
    assert sorted(((x.doc_id, (x.text or "").lower()) for x in one_of_each(odd).collect()), key=str) == sorted([(None, "a b c d e f"), (5, "g h"), (7, ""), (8, "")], key=str)


def kept_words(rows, size=35):
    texts = [WORD.findall(t or "") for _, t in rows]
    n = collections.Counter(tuple(w[i : i + size]) for w in texts for i in range(len(w) - size + 1))
    out = []
    for (d, _), w in zip(rows, texts, strict=True):
        gone = {j for i in range(len(w) - size + 1) if n[tuple(w[i : i + size])] > 1 for j in range(i, i + size)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def test_substrings_equal_brute_force(spark):
    r, base, rows = random.Random(3), [f"w{i}" for i in range(300)], []
    for i in range(80):
        k, a = r.randint(0, 6), r.randint(0, 200)
        t = [
            " ".join(r.choice("ab") for _ in range(r.randint(0, 200))), " ".join(["x"] * r.randint(0, 100)), " ".join(base[a : a + r.randint(20, 100)]),
            " ".join(base[:40] + [f"u{i}"] + base[60:100] + base[:40]), " ".join(["p", "q", "r"] * r.randint(5, 30)), None if i % 2 else "", " \té\n".join(base[a : a + 60]),
        ][k]
        rows.append((i if i % 7 else None, t))
    rows += rows[:5] + [(999, " ".join(base * 20))]
    # Windows that recur in their own text alone, near and far.
    rows += [(1000 + k, " ".join(f"own{k}_{j % k}" for j in range(90))) for k in (1, 2, 5, 19, 27, 28, 29, 34, 35, 36, 54, 55, 56)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS key", "2 AS n", "3 AS piece")
    got = [(x.doc_id, x.n_words, x.n_removed, hashlib.sha256(x.kept.encode()).hexdigest()) for x in remove_repeated(df).collect()]
    assert sorted(got, key=str) == kept_words(rows)
    assert remove_repeated(df.limit(0)).count() == 0


def vector_links(rows):
    """(id, links, least id reached) of all rows, and the number of links."""
    u, n = Union(len(rows)), [0] * len(rows)
    unit = {}
    for i, (_, v, label) in enumerate(rows):
        if v and label is not None and None not in v and np.isfinite(v).all() and any(v):
            unit[i] = np.array(v, float) / np.linalg.norm(np.array(v, float))
    groups = collections.defaultdict(list)
    for i, v in unit.items():
        groups[rows[i][2], len(v)].append(i)
    for own in groups.values():
        m = np.stack([unit[i] for i in own])
        for a, b in zip(*np.nonzero(m @ m.T >= 0.93), strict=True):
            if a != b:
                n[own[a]] += 1
                u.join(own[a], own[b])
    least = {}
    for i, (d, *_) in enumerate(rows):
        least[u.find(i)] = min(least.get(u.find(i), d), d)
    return sorted((d, n[i], least[u.find(i)]) for i, (d, *_) in enumerate(rows)), sum(n)


VECTORS = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("how", [{"block_rows": 64}, {"sigmas": None, "lists": 40}, {"sample_rows": 60}])
def test_vectors_equal_brute_force(spark, how):
    r = np.random.default_rng(5)
    base = r.normal(size=(30, 16))
    rows = [(i, (base[r.integers(30)] + r.normal(size=16) * r.choice([0, 0.1, 0.25])).tolist(), int(r.integers(3))) for i in range(400)]
    rows += [(400, None, 1), (401, [0.0] * 16, 1), (402, [None] + [1.0] * 15, 1), (403, [float("nan")] * 16, 1), (404, [1.0] * 16, None), (405, [float("inf")] + [1.0] * 15, 2), (406, [1.0] * 8, 1), (407, [], 1), rows[0]]
    # Lengths that few vectors have, one of them in no small sample.
    rows += [(500 + i, [1.0, 0.01 * i], 1) for i in range(3)] + [(510 + i, [1.0, 0.01 * i, 0.0], i // 3) for i in range(6)]
    df = spark.createDataFrame(rows, VECTORS).selectExpr("*", "1 AS key", "2 AS copies")
    want, total = vector_links([tuple(x)[:3] for x in df.collect()])
    got = link_vectors(df, **how).collect()
    found = sorted((x.vec_id, x.n_links, x.component_id) for x in got)
    assert sum(x[1] for x in found) >= 0.9 * total and found == want
    assert all(x.kept == (x.vec_id == x.component_id) for x in got)
    assert link_vectors(df.limit(0)).count() == 0


def test_recall_of_pairs_at_the_threshold(spark):
    """Pairs with cosines from 0.93 on, in a space without clusters: the hardest case for lists."""
    r = np.random.default_rng(6)
    rows = []
    for i in range(3000):
        q, u = r.normal(size=(2, 64))
        q /= np.linalg.norm(q)
        u -= (u @ q) * q
        u /= np.linalg.norm(u)
        c = r.uniform(0.9301, 0.95)
        rows += [(2 * i, q.tolist(), i % 2), (2 * i + 1, (c * q + np.sqrt(1 - c * c) * u).tolist(), i % 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    want, total = vector_links(rows)
    for how, least in (({}, 0.99), ({"sigmas": None}, 1.0)):
        got = sum(x.n_links for x in link_vectors(df, **how).collect())
        assert least * total <= got <= total and total >= 6000


def test_levels_keep_what_is_found_twice(spark):
    from runmill.llm.substring import _found_twice, extended, lengths
    from runmill.llm.words import windows as window_hashes

    assert lengths(35, 8) == [8, 16, 32, 35] and lengths(64, 8) == [8, 16, 32, 64] and lengths(10, 8) == [8, 10]
    r = np.random.default_rng(4)
    base = r.integers(1, 2**63, 400).astype(np.uint64)
    words = []
    for i in range(40):
        a, n = int(r.integers(0, 300)), int(r.integers(35, 63))
        w = base[a : a + n].copy()
        for _ in range(int(r.integers(0, 4))):
            w[r.integers(n)] = r.integers(1, 2**63)
        words.append(w)
    seen = {length: collections.Counter(tuple(w[i : i + length]) for w in words for i in range(len(w) - length + 1)) for length in (16, 32, 35)}
    rows = [(1, j, len(w) - 34, window_hashes(w, 16).tobytes(), [(0, len(w) - 34)]) for j, w in enumerate(words)]
    ddl = "piece long, stretch long, n int, hashes binary, alive array<struct<at: int, n: int>>"
    state, sizes = spark.createDataFrame(rows, ddl), []
    for length, to in ((16, 32), (32, 35), (35, 0)):
        alive = {(x.stretch, i) for x in _found_twice(state, 35, length).collect() for a in x.alive for i in range(a["at"], a["at"] + a["n"])}
        sizes.append(len(alive))
        want = {(j, i) for j, w in enumerate(words) for i in range(len(w) - 34) if seen[35][tuple(w[i : i + 35])] > 1}
        assert want <= alive and (length < 35 or want == alive)
        # A survivor holds a window of this length that is found twice.
        assert all(any(seen[length][tuple(words[j][k : k + length])] > 1 for k in range(i, i + 36 - length)) for j, i in alive)
        grown = [(1, j, len(w) - 34, window_hashes(w, 16).tobytes(), [(i, 1) for i in range(len(w) - 34) if (j, i) in alive]) for j, w in enumerate(words)]
        state = spark.createDataFrame(grown, ddl)
        if to:
            for a, b in ((16, 32), (32, 35)):
                if b <= to:
                    state = state.mapInArrow(lambda batches, a=a, b=b: (extended(x, 35, a, b) for x in batches), ddl)
    assert sum(len(w) - 34 for w in words) >= sizes[0] >= sizes[1] >= sizes[2] > 0


def test_hot_keys_join_as_others(spark):
    from runmill.llm.skew import join_unique

    rows = spark.range(9000).selectExpr("CASE WHEN id % 3 = 0 THEN 7 ELSE id END AS k", "id AS v")
    facts = rows.groupBy("k").count().where("k % 2 = 1").withColumnRenamed("count", "c").cache()
    for how in ("inner", "left"):
        got = sorted(map(tuple, join_unique(rows, facts, ["k"], "c", how).collect()), key=str)
        assert got == sorted(map(tuple, rows.join(facts, "k", how).collect()), key=str)
