"""DuckDB SQL of operations that SQL can express on small tables, by plain counting and comparing."""

from __future__ import annotations

_WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"

#: Smallest id reachable by links, from (a, b) pairs in both directions.
_REACH = """reach AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
)"""

OP7_SQL = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, greatest(2, len(ws) - 3))) AS i FROM w WHERE len(ws) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.k = y.k AND x.doc_id <> y.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)
), {_REACH}
SELECT w.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, least(w.doc_id, coalesce(min(r.b), w.doc_id)) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN reach r ON r.a = w.doc_id GROUP BY w.doc_id
"""

OP8_SQL = f"""
WITH w AS (
  SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 34], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w WHERE len(ws) >= 35)
), twice AS (
  SELECT doc_id, i FROM windows WHERE k IN (SELECT k FROM windows GROUP BY k HAVING count(*) > 1)
), words AS (
  SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS j FROM w
), marked AS (
  SELECT x.doc_id, x.word, x.j, coalesce(max(t.i) OVER (PARTITION BY x.doc_id ORDER BY x.j) + 34 >= x.j, false) AS gone
  FROM words x LEFT JOIN twice t ON t.doc_id = x.doc_id AND t.i = x.j
)
SELECT w.doc_id, CAST(len(any_value(w.ws)) AS BIGINT) AS n_words, count(*) FILTER (gone) AS n_removed,
  sha256(coalesce(string_agg(word, ' ' ORDER BY j) FILTER (NOT gone), '')) AS kept_sha256
FROM w LEFT JOIN marked m ON m.doc_id = w.doc_id GROUP BY w.doc_id
"""

OP10_SQL = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), sound AS (
  SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM sound x JOIN sound y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.e) = len(y.e)
  WHERE list_cosine_similarity(x.e, y.e) >= 0.93
), {_REACH}, found AS (
  SELECT v.vec_id, (SELECT count(*) FROM links l WHERE l.a = v.vec_id) AS n_links, least(v.vec_id, coalesce((SELECT min(r.b) FROM reach r WHERE r.a = v.vec_id), v.vec_id)) AS component_id FROM v
)
SELECT vec_id, n_links, component_id, vec_id = component_id AS kept FROM found
"""

#: Median and tenth percentile of merged bucket counts, by the given columns.
_QUANTILES = """SELECT {0}, rate, max(total) AS total, min(bucket) FILTER (upto * 2 >= total) / 1048576.0::DOUBLE AS median, min(bucket) FILTER (upto * 10 >= total) / 1048576.0::DOUBLE AS tenth FROM (
    SELECT {0}, rate, bucket, sum(n) OVER (PARTITION BY {0}, rate ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY {0}, rate) AS total
    FROM (SELECT {0}, rate, bucket, sum(n) AS n FROM sketch GROUP BY ALL)
  ) GROUP BY {0}, rate"""
_FENCE = "max(CASE WHEN rate = '{0}' THEN fence END) AS {0}_max"
_RATES = ("symbol_rate", "dup_line_rate", "long_word_rate", "stutter_rate")

OP9_SQL = f"""
WITH w AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS text, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents
), words AS (
  SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS j FROM w
), per_word AS (
  SELECT doc_id, count(*) AS n, sum(length(word)) AS chars, count(*) FILTER (word = before) AS stutters
  FROM (SELECT *, lag(word) OVER (PARTITION BY doc_id ORDER BY j) AS before FROM words) GROUP BY doc_id
), windows AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)
), twice AS (
  SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, k) AS c FROM windows) WHERE c > 1
), repeats AS (
  SELECT doc_id, count(*) FILTER (last + 7 >= j) AS n FROM (
    SELECT x.doc_id, x.j, max(t.i) OVER (PARTITION BY x.doc_id ORDER BY x.j) AS last FROM words x LEFT JOIN twice t ON t.doc_id = x.doc_id AND t.i = x.j
  ) GROUP BY doc_id
), lines AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w)
  WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id
), m AS (
  SELECT w.doc_id, lang, source, coalesce(p.n, 0) AS n_words, CAST(coalesce(chars, 0) AS BIGINT) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(l.n, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
    coalesce(stutters, 0) AS stutters, len(string_split(text, chr(10))) AS n_lines
  FROM w LEFT JOIN per_word p USING (doc_id) LEFT JOIN repeats r USING (doc_id) LEFT JOIN lines l USING (doc_id)
), rated AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
    CASE WHEN n_words > 0 THEN n_symbols / n_words ELSE 0.0 END AS symbol_rate, n_dup_lines / n_lines AS dup_line_rate,
    CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0.0 END AS long_word_rate, CASE WHEN n_words > 0 THEN stutters / n_words ELSE 0.0 END AS stutter_rate
  FROM m
), rates AS (
  UNPIVOT (SELECT lang, source, {", ".join(_RATES)} FROM rated WHERE NOT base_failed) ON {", ".join(_RATES)} INTO NAME rate VALUE value
), scaled AS (
  SELECT lang, source, rate, CAST(floor(value * 1048576) AS BIGINT) AS v FROM rates
), sketch AS (
  SELECT lang, source, rate, (v >> greatest(0, length(bin(v)) - 7)) << greatest(0, length(bin(v)) - 7) AS bucket, count(*) AS n FROM scaled GROUP BY ALL
), slacks AS (
  SELECT * FROM (VALUES ('symbol_rate', 0.10::DOUBLE), ('dup_line_rate', 0.50::DOUBLE), ('long_word_rate', 3.0::DOUBLE), ('stutter_rate', 0.20::DOUBLE)) AS t(rate, slack)
), own AS (
  SELECT q.*, median + 6.0::DOUBLE * (median - tenth) + slack AS fence FROM ({_QUANTILES.format("lang, source")}) q JOIN slacks USING (rate)
), pooled AS (
  SELECT q.*, median + 6.0::DOUBLE * (median - tenth) + slack AS fence FROM ({_QUANTILES.format("lang")}) q JOIN slacks USING (rate)
), blended AS (
  SELECT o.lang, o.source, o.rate, (CAST(o.total AS DOUBLE) * o.fence + 30.0::DOUBLE * p.fence) / CAST(o.total + 30 AS DOUBLE) AS fence
  FROM own o JOIN pooled p ON o.lang IS NOT DISTINCT FROM p.lang AND o.rate = p.rate
), fences AS (
  SELECT lang, source, {", ".join(_FENCE.format(x) for x in _RATES)} FROM blended GROUP BY lang, source
)
SELECT doc_id, n_words, word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce(symbol_rate > symbol_rate_max OR dup_line_rate > dup_line_rate_max OR long_word_rate > long_word_rate_max OR stutter_rate > stutter_rate_max, false) AS kept
FROM rated r LEFT JOIN fences f ON r.lang IS NOT DISTINCT FROM f.lang AND r.source IS NOT DISTINCT FROM f.source
"""
