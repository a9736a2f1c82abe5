"""Toxicity scores: Levenshtein automata intersected with a lexicon trie, and context windows.

Learning.  From at most ``sample_rows`` labelled rows (those of the smallest
hash of their id) the words and word beginnings that tell toxic from clean
documents are counted, and a lexicon of at most MAX_TERMS terms is chosen: every
term of overwhelming evidence, and by greedy cover weaker ones that explain
toxic documents which no chosen term explains.  A term is a whole word or a
beginning of words (stems of languages that build words).  Then the sample is
matched with the lexicon, and for each term it is counted how many toxic documents
have it once, twice, three times or more often, and how often it stands by chance
in clean documents.  So a beginning that clean texts have now and then needs more
matches, and a long text more than a short one.

Matching.  The terms form a trie.  A text's words run through it together with
a Levenshtein automaton: one edit for terms of four letters and more, and within
beginnings, two edits for terms of eight and more.  How much a misspelt match is
worth is counted on the sample, so a term whose neighbours are words of clean texts
loses them.  Each distinct word is matched once and remembered.

Scoring.  Each match is weighed by its context window: inside quotation marks,
or near words that report speech, a match counts less (it is quoted, not
uttered).  The weight of quoted matches, and which words report speech, are learned
from sample documents with matches.  Terms combine as 1 - product(1 - p).

Cases: null and empty texts score 0; null labels are not learned from; without
any labels all scores are 0; long texts are scored whole; repeated rows are
scored each; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runmill.llm.durable import durable, hash_sample, map_texts, parts

#: Labelled rows that are learned from at most.
SAMPLE_ROWS = 20_000
#: Terms of a lexicon, and candidates whose clean counts are taken (bounds of the fit, as the sample is one).
MAX_TERMS, MAX_CANDIDATES = 512, 5_000
#: Lengths of word beginnings, in characters.
STEMS = (4, 5, 6, 7, 8, 9)
#: Log likelihood ratio of a term that stands alone, and of one that covers documents nothing else covers.
STRONG, WEAK = 20.7, 6.0
#: Least share of toxic documents among those with a term, and with a term of overwhelming evidence, which may need several matches.
PRECISION, STRONG_PRECISION = 0.9, 0.5
#: Letters of a term that may have one edit, and two.
ONE_EDIT, TWO_EDITS = 4, 8
#: Lengths of words from here on count as one.
LONGEST = 64
#: Misspelt matches of a term count if so many of the documents with them are toxic; else the words near the term are other words.
LEAST_MISSPELT = 0.3
#: Matches of a term in a document that are told apart.
COUNTED = 4
#: Words on each side of a match that are its context, and the weight of a quoted match before anything is learned, as much as so many documents.
CONTEXT, QUOTED, QUOTED_PRIOR = 8, 0.35, 5
#: Clean documents that a word near matches needs to count as one that reports speech, and their least share.
REPORTS, REPORT_SHARE = 5, 0.5
THRESHOLD = 0.7
REMEMBERED = 100_000

_WORD = re.compile(r"[^\W_]+")
_QUOTES = {'"': '"', "“": "”", "«": "»", "„": "“"}


@dataclass
class Term:
    """A lexicon entry: a whole word, or the beginning of words.

    toxic: sample documents that have it once, twice, ... (COUNTED: so often or
    more); clean: clean documents with a word of its first letters; rate: its
    matches for each of their words.  Without them ``exact`` holds for any number.
    """

    text: str
    whole: bool
    exact: float
    misspelt: float = 0.0
    toxic: tuple[int, ...] = ()
    clean: int = 0
    rate: float = 0.0

    @property
    def edits(self) -> int:
        return 0 if not self.misspelt or len(self.text) < ONE_EDIT else 2 if self.whole and len(self.text) >= TWO_EDITS else 1

    def probability(self, matches: int, words: int) -> float:
        """That a document of so many words is toxic, of which so many match."""
        if not self.toxic:
            return self.exact
        k, mean = min(matches, COUNTED), self.rate * words
        below = math.exp(-mean) * sum(mean**i / math.factorial(i) for i in range(k))
        chance = 1 - below if k == COUNTED else math.exp(-mean) * mean**k / math.factorial(k)
        have = self.toxic[k - 1] + 0.5
        return have / (have + self.clean * chance + 0.5)


@dataclass
class _Node:
    below: dict[str, _Node] = field(default_factory=dict)
    term: int = -1  # a whole word ends here
    stem: int = -1  # a beginning ends here
    edits: int = 0  # what a term below may have


class Terms(list):
    """Terms, the weight of a match in quotation marks, and the weights of matches near words that report speech."""

    def __init__(self, terms: list[Term], quoted: float = QUOTED, reports: dict[str, float] | None = None):
        super().__init__(terms)
        self.quoted, self.reports = quoted, reports or {}


class Lexicon(dict):
    """Words and their match: (weight, term, misspelt) or None; filled as words come."""

    def __init__(self, terms: Terms | list[Term]):
        super().__init__()
        self.terms = terms
        self.quoted, self.reports = (terms.quoted, terms.reports) if isinstance(terms, Terms) else (QUOTED, {})
        self.root = _Node()
        #: Pairs of letters at the beginning, the end and about the fourth letter, and the lengths of words there that can misspell a term.
        self.heads: dict[str, set[int]] = {}
        self.tails: dict[str, set[int]] = {}
        self.middles: dict[str, set[int]] = {}
        for i, t in enumerate(terms):
            path = [self.root]
            for c in t.text:
                path.append(path[-1].below.setdefault(c, _Node()))
            for node in path:
                node.edits = max(node.edits, t.edits)
            if t.whole:
                path[-1].term = i
            else:
                path[-1].stem = i
            if t.edits:
                # Pairs of letters with one between them: an edit, a swap too, reaches one of them only.
                size = len(t.text)
                lengths = set(range(size - t.edits, size + t.edits + 1 if t.whole else LONGEST))
                pairs = [(self.heads, t.text[:2])]
                if size == ONE_EDIT:
                    pairs.append((self.heads, t.text[0] + t.text[2]))
                if t.whole:
                    pairs.append((self.tails, t.text[-2:]))
                if t.edits == 2 or not t.whole:
                    pairs.append((self.middles, t.text[3:5] if size > ONE_EDIT else t.text[2:4]))
                for of, pair in pairs:
                    of.setdefault(pair, set()).update(lengths)

    def may_misspell(self, word: str) -> bool:
        """Whether one of the word's pairs of letters stands where that of a term does; what can't, misspells none."""
        n = min(len(word), LONGEST - 1)
        for of, pair in ((self.heads, word[:2]), (self.tails, word[-2:])):
            if pair in of and n in of[pair]:
                return True
        if self.middles:
            for i in (1, 2, 3, 4):
                if word[i : i + 2] in self.middles and n in self.middles[word[i : i + 2]]:
                    return True
        return False

    def __missing__(self, word: str) -> tuple[float, int, bool] | None:
        if len(self) >= REMEMBERED:
            self.clear()
        found = self.match(word)
        self[word] = found
        return found

    def match(self, word: str) -> tuple[float, int, bool] | None:
        node, best = self.root, None
        for i, c in enumerate(word):
            node = node.below.get(c)
            if node is None:
                break
            if node.stem >= 0:
                best = max(best or (0.0, 0, False), (self.terms[node.stem].exact, node.stem, False))
            if node.term >= 0 and i + 1 == len(word):
                best = max(best or (0.0, 0, False), (self.terms[node.term].exact, node.term, False))
        if best is None and self.may_misspell(word):
            hit = self.near(word)
            if hit is not None:
                best = (self.terms[hit].misspelt, hit, True)
        return best

    def near(self, word: str) -> int | None:
        """The term of the highest weight that ``word`` misspells.

        Walks the trie with the Levenshtein automaton of the word.  A state is
        (characters of the word read, edits, character owed by a swap); edits are
        a changed, missing, additional, or swapped character.  A beginning is
        found wherever the word goes on.
        """
        n, found = len(word), None
        stack: list[tuple[_Node, frozenset[tuple[int, int, str]]]] = [(self.root, frozenset({(0, 0, "")}))]
        while stack:
            node, states = stack.pop()
            for at, whole in ((node.term, True), (node.stem, False)):
                if at >= 0 and (found is None or self.terms[at].misspelt > self.terms[found].misspelt):
                    most = self.terms[at].edits
                    if any(not owed and 0 < e + (n - i if whole else 0) <= most for i, e, owed in states):
                        found = at
            for c, below in node.below.items():
                nxt = set()
                for i, e, owed in states:
                    if owed:
                        if c == owed:
                            nxt.add((i, e, ""))
                        continue
                    # Characters that the word has more come before one that it shares or lacks.
                    for more in range(min(below.edits - e, n - i) + 1):
                        j, d = i + more, e + more
                        if j < n and word[j] == c:
                            nxt.add((j + 1, d, ""))
                        if d < below.edits:
                            nxt.add((j, d + 1, ""))
                            if j < n:
                                nxt.add((j + 1, d + 1, ""))
                            if j + 1 < n and word[j + 1] == c:
                                nxt.add((j + 2, d + 1, word[j]))
                if nxt:
                    stack.append((below, frozenset(nxt)))
        return found

    def hits(self, text: str) -> tuple[list[tuple[float, int, bool, bool, int]], list[str]]:
        """Matches as (weight in context, term, misspelt, quoted, position of the word), and all words."""
        low = text.lower()
        words = _WORD.findall(low)
        at = [i for i, m in enumerate(map(self.__getitem__, words)) if m is not None]
        if not at:
            return [], words
        places = [m.start() for m in _WORD.finditer(low)]
        out = []
        for i in at:
            weight, term, misspelt = self[words[i]]
            weight = weight / self.terms[term].exact if misspelt else 1.0
            quoted = _quoted(low, places, i)
            if quoted:
                weight *= self.quoted
            elif self.reports:
                weight *= min(self.reports.get(w, 1.0) for w in words[max(0, i - CONTEXT) : i + CONTEXT + 1])
            out.append((weight, term, misspelt, quoted, i))
        return out, words

    def score(self, text: str | None) -> float:
        if not text or not self.terms:
            return 0.0
        hits, words = self.hits(text)
        weights: dict[int, list[float]] = {}
        for weight, term, *_ in hits:
            weights.setdefault(term, []).append(weight)
        left = 0.0
        for term, own in weights.items():
            # The matches of greatest weight, as many as tell most: quoted ones don't lessen the others.
            own.sort(reverse=True)
            p = max(self.terms[term].probability(k, len(words)) * sum(own[:k]) / k for k in range(1, min(len(own), COUNTED) + 1))
            left += math.log1p(-min(p, 0.999999))
        return 1.0 - math.exp(left)


def _quoted(text: str, places: list[int], i: int) -> bool:
    """Whether a quotation opens before word i and closes after it, both within the context window and one line."""
    first, last = places[max(0, i - CONTEXT)], places[i]
    to = places[i + CONTEXT + 1] if i + CONTEXT + 1 < len(places) else len(text)
    before = text[max(0, first - 1) : last].rpartition("\n")[2]
    after = text[last:to].partition("\n")[0]
    for a, b in _QUOTES.items():
        inside = before.count(a) % 2 == 1 if a == b else before.rfind(a) > before.rfind(b)
        if inside and b in after:
            return True
    return False


def _names(word: str) -> list[str]:
    """A word's features: itself (marked by an ending blank) and its beginnings."""
    return ([word + " "] if len(word) >= 3 else []) + [word[:k] for k in STEMS if len(word) > k]


def features(text: str) -> set[str]:
    """Features of all words of one text."""
    return {name for word in set(_WORD.findall(text.lower())) for name in _names(word)}


def placed_features(text: str) -> set[tuple[str, int]]:
    """Features with a hash of the word and its two neighbours."""
    words = ["", *_WORD.findall(text.lower()), ""]
    return {(name, hash_of(f"{a} {b} {c}")) for a, b, c in zip(words, words[1:], words[2:], strict=False) for name in _names(b)}


def choose(toxic: list[tuple[str, int, int]], members: dict[str, list[int]], n_toxic: int, n_clean: int) -> list[Term]:
    """Terms from (feature, evidence among toxic documents, clean documents); members: toxic documents of each feature.

    Evidence is the number of toxic documents or of different places (a word
    with its neighbours), whichever is less: the near copies of one document
    share their places and count about once.
    """
    base = n_toxic / max(1, n_toxic + n_clean)
    rated = []
    for name, a, b in toxic:
        p = a / (a + b)
        if p < STRONG_PRECISION or p <= base:
            continue
        ratio = a * math.log(p / base) + (b * math.log((1 - p) / (1 - base)) if b else 0.0)
        if ratio >= (WEAK if p >= PRECISION else STRONG):
            rated.append((-a, not name.endswith(" "), -len(name), name, b, ratio))
    rated.sort()
    chosen: list[Term] = []
    explained: dict[str, set[int]] = {}

    def add(name: str, a: int, b: int) -> None:
        whole = name.endswith(" ")
        chosen.append(Term(name.rstrip(" "), whole, (a + 1) / (a + b + 2)))
        explained[name] = set(members[name])
        covered.update(members[name])

    def related(name: str) -> set[int]:
        """Documents explained by chosen terms that begin like this one, or that this one begins."""
        return set().union(*(d for n, d in explained.items() if n.startswith(name.rstrip(" ")) or name.startswith(n.rstrip(" "))))

    covered: set[int] = set()
    for a, _, _, name, b, ratio in rated:
        if ratio >= STRONG and len(chosen) < MAX_TERMS and len(set(members[name]) - related(name)) >= 3:
            add(name, -a, b)
    weak = [(name, -a, b) for a, _, _, name, b, ratio in rated if ratio < STRONG]
    while weak and len(chosen) < MAX_TERMS:
        gain, name, a, b = max(((len(set(members[n]) - covered), n, a, b) for n, a, b in weak), key=lambda x: (x[0], x[1].endswith(" "), x[1]))
        if gain < 3:
            break
        add(name, a, b)
        weak = [x for x in weak if x[0] != name]
    return chosen


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from: crc32 of the id as text, mod 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(True))


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Terms:
    """Terms from labelled rows that are not held out.

    The sample of ids is bounded by sample_rows and broadcast to the scan of
    ``docs``, so texts are not shuffled; its texts are written once and counted
    in two passes.  What reaches the driver is bounded by MAX_CANDIDATES and the
    sample's toxic rows.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    sample = hash_sample(known, F.xxhash64("doc_id"), sample_rows, "doc_id", "toxic").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = durable(docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id").select("text", "toxic").where(F.col("text").isNotNull()))
    sizes = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if not sizes.get(1) or not sizes.get(0):
        return Terms([])

    def toxic_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            for text in batch.column(0).to_pylist():
                found = list(placed_features(text))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([hash_of(text)] * len(found), pa.int64()), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.int64())],
                    names=["doc", "name", "place"],
                )

    found = rows.where("toxic = 1").select("text").mapInArrow(toxic_features, "doc long, name string, place long")
    least = max(3, math.ceil(WEAK / max(1e-9, -math.log(sizes[1] / (sizes[0] + sizes[1])))))
    # Both sets are bounded by the sample's toxic rows.
    groups = found.groupBy("name").agg(F.collect_set("doc").alias("docs"), F.countDistinct("place").alias("places"))
    groups = groups.withColumn("n", F.least(F.size("docs"), "places")).where(F.col("n") >= least)
    top = groups.orderBy(F.desc("n"), "name").limit(MAX_CANDIDATES).select("name", "docs", "n").collect()
    members = {r["name"]: list(r["docs"]) for r in top}
    evidence = {r["name"]: r["n"] for r in top}
    names = frozenset(members)

    def clean_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in parts(batches):
            for text in batch.column(0).to_pylist():
                seen.update(features(text) & names)
        yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], names=["name", "n"])

    clean = {r["name"]: r["n"] for r in rows.where("toxic = 0").select("text").mapInArrow(clean_counts, "name string, n long").groupBy("name").agg(F.sum("n").alias("n")).collect()}
    terms = choose([(n, a, clean.get(n, 0)) for n, a in evidence.items()], members, sizes[1], sizes[0])
    return _calibrated(rows, terms)


def hash_of(text: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text) - (1 << 63)


def _counted(rows: DataFrame, terms: Terms) -> DataFrame:
    """What the sample tells of its terms: (kind, term, word, toxic, k, n)."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, seen = Lexicon(terms), Counter()
        starts = {t.text[:3] for t in terms}
        for batch in parts(batches):
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                hits, words = lexicon.hits(text)
                exact = [x for x in hits if not x[2]]
                # Matches that their context makes less than half a match don't count.
                own: Counter[int] = Counter(term for weight, term, *_ in exact if weight >= 0.5)
                seen.update(("matches", term, "", toxic, min(k, COUNTED)) for term, k in own.items())
                seen.update(("misspelt", term, "", toxic, 0) for term in {term for _, term, misspelt, *_ in hits if misspelt and not own[term]})
                if not toxic:
                    for start in starts & {w[:3] for w in words}:
                        seen["documents", -1, start, 0, 0] += 1
                        seen["words", -1, start, 0, 0] += len(words)
                    for term, k in own.items():
                        seen["all", term, "", 0, 0] += k
                # Beginnings stand in clean texts by chance; whole words do so for a reason.
                exact = [x for x in exact if terms[x[1]].whole]
                if exact and all(x[3] for x in exact):
                    seen["quoted", -1, "", toxic, 0] += 1
                near = {w for *_, quoted, i in exact if not quoted for w in words[max(0, i - CONTEXT) : i + CONTEXT + 1]}
                seen.update(("near", -1, w, toxic, 0) for w in near if lexicon[w] is None)
        columns = list(zip(*[(*k, n) for k, n in seen.items()], strict=True)) or [()] * 6
        kinds = [pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], names=["kind", "term", "word", "toxic", "k", "n"])

    return durable(rows.select("text", "toxic").mapInArrow(counts, "kind string, term int, word string, toxic int, k int, n long").groupBy("kind", "term", "word", "toxic", "k").agg(F.sum("n").alias("n")))


def _totals(found: DataFrame) -> Counter[tuple]:
    """A few rows a term."""
    got: Counter[tuple] = Counter()
    for r in found.where("kind != 'near'").collect():
        got[r["kind"], r["term"], r["word"], r["toxic"], r["k"]] += r["n"]
    return got


def _calibrated(rows: DataFrame, chosen: list[Term]) -> Terms:
    """The terms with what the sample tells of them: first of their contexts and misspellings, then, by these, of their numbers.

    Of a document with several terms each counts for itself.  Misspelt matches
    have a prior of 0.75, counted as three documents, quoted ones that of QUOTED.
    """
    for t in chosen:
        t.misspelt = 0.75 if len(t.text) >= ONE_EDIT else 0.0
    found = _counted(rows, Terms(chosen, 1.0))
    got = _totals(found)
    a, b = got["quoted", -1, "", 1, 0], got["quoted", -1, "", 0, 0]
    quoted = (a + QUOTED * QUOTED_PRIOR) / (a + b + QUOTED_PRIOR)
    of = lambda toxic: F.sum(F.when(F.col("toxic") == toxic, F.col("n")).otherwise(0))
    near = found.where("kind = 'near'").groupBy("word").agg(of(1).alias("toxic"), of(0).alias("clean"))
    reporting = near.where((F.col("clean") >= REPORTS) & (F.col("clean") >= REPORT_SHARE * (F.col("clean") + F.col("toxic")))).orderBy(F.desc("clean"), "word").limit(MAX_TERMS).collect()
    terms = Terms(chosen, quoted, {r["word"]: (r["toxic"] + 0.5) / (r["toxic"] + r["clean"] + 1) for r in reporting})
    for i, t in enumerate(terms):
        a, b = got["misspelt", i, "", 1, 0], got["misspelt", i, "", 0, 0]
        t.misspelt = (a + 2.25) / (a + b + 3) if t.misspelt else 0.0
        if t.misspelt < LEAST_MISSPELT:
            t.misspelt = 0.0
    got = _totals(_counted(rows, terms))
    for i, t in enumerate(terms):
        t.toxic = tuple(got["matches", i, "", 1, k] for k in range(1, COUNTED + 1))
        t.clean = got["documents", -1, t.text[:3], 0, 0]
        t.rate = (got["all", i, "", 0, 0] + 0.5) / (got["words", -1, t.text[:3], 0, 0] + 1000)
    return terms


def score_documents(docs: DataFrame, terms: list[Term], threshold: float = THRESHOLD) -> DataFrame:
    """Rows (doc_id, held_out, score, predicted); no shuffle."""
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(terms)
        for batch in parts(batches):
            scores = [lexicon.score(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array([int(x >= threshold) for x in scores], pa.int32())],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    return rows.mapInArrow(run, f"doc_id {id_type}, held_out boolean, score double, predicted int")


def without_toxic(docs: DataFrame, terms: list[Term], threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the documents that score ``threshold`` or more; rows and columns else unchanged."""

    def run(batches: Iterator[tuple[pa.RecordBatch, int]]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(terms)
        for batch, at in batches:
            yield batch.filter(pa.array([lexicon.score(x) < threshold for x in batch.column(at).to_pylist()], pa.bool_()))

    return map_texts(docs, run)
