"""Chat formatting of preference pairs (DataFrame functions only).

A pair has a chosen and a rejected conversation.  The longest common prefix of
turns (equal role and text) is rendered once, as the prompt; the turns after it
are rendered as the two completions.  Loss masks mark the text of assistant
turns in the completions; the prompt is never trained on.

A turn is rendered as ``<|role|>\\ntext<|end|>\\n``.  Masks are strings of
``start:end`` spans (code points, end exclusive) into a completion, in order and
joined by commas; a span holds a turn's text and its end mark.

Cases: null roles and texts count as empty; turns of equal number stand in the
order of role and text, null numbers first; a repeated turn is kept each time;
a side without turns has an empty completion, as has a side that the prompt
covers whole; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

END = "<|end|>\n"
TRAINED_ROLE = "assistant"


def _side(name: str) -> Column:
    turn = F.struct(F.col("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return F.array_sort(F.collect_list(F.when(F.col("side") == name, turn))).alias(name)


def _rendered(turns: str) -> str:
    return f"concat_ws('', transform({turns}, x -> concat('<|', x.role, '|>\n', x.text, '{END}')))"


def _mask(turns: str) -> str:
    """Running start of each turn, then the spans of trained ones."""
    head = "length(x.role) + 5"
    end = len(END)
    return f"""
        aggregate({turns}, named_struct('at', 0, 'spans', CAST(array() AS ARRAY<STRING>)),
          (acc, x) -> named_struct(
            'at', acc.at + {head} + length(x.text) + {end},
            'spans', IF(x.role = '{TRAINED_ROLE}', concat(acc.spans, array(concat(acc.at + {head}, ':', acc.at + {head} + length(x.text) + {end}))), acc.spans)),
          acc -> array_join(acc.spans, ','))
    """


def format_preferences(turns: DataFrame) -> DataFrame:
    """Rows (pair_id, n_prompt_turns, prompt, chosen, rejected, chosen_mask, rejected_mask) from (pair_id, side, turn, role, text).

    side is ``chosen`` or ``rejected``.  One shuffle, by pair; a pair's turns
    meet in one row, since its output is one row.
    """
    pairs = turns.groupBy("pair_id").agg(_side("chosen"), _side("rejected"))
    same = "x.role = y.role AND x.text = y.text"
    common = f"""
        coalesce(
          array_position(zip_with(slice(chosen, 1, least(size(chosen), size(rejected))), slice(rejected, 1, least(size(chosen), size(rejected))), (x, y) -> {same}), false) - 1, -1)
    """
    cut = pairs.withColumn("stop", F.expr(common)).withColumn("n", F.expr("CAST(IF(stop < 0, least(size(chosen), size(rejected)), stop) AS INT)"))
    parts = cut.select(
        "pair_id",
        F.col("n").cast("long").alias("n_prompt_turns"),
        F.expr("slice(chosen, 1, n)").alias("p"),
        F.expr("slice(chosen, n + 1, size(chosen))").alias("c"),
        F.expr("slice(rejected, n + 1, size(rejected))").alias("r"),
    )
    return parts.select(
        "pair_id",
        "n_prompt_turns",
        F.expr(_rendered("p")).alias("prompt"),
        F.expr(_rendered("c")).alias("chosen"),
        F.expr(_rendered("r")).alias("rejected"),
        F.expr(_mask("c")).alias("chosen_mask"),
        F.expr(_mask("r")).alias("rejected_mask"),
    )


def swapped_ends(conversations: DataFrame) -> DataFrame:
    """Pairs made of a table of conversations: chosen is the conversation; rejected has its first half (n div 2 turns) and goes on with what conversation conv_id + 1 has behind as many turns (nothing if there is none).

    So the sides part in the middle and differ in length.  Turns are numbered anew
    by (turn, role, text), null numbers first; a repeated turn counts each time.
    """
    own = Window.partitionBy("conv_id")
    turns = conversations.select("conv_id", "turn", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")])
    ranked = turns.withColumn("k", F.row_number().over(own.orderBy(F.asc_nulls_first("turn"), "role", "text"))).withColumn("half", F.floor(F.count(F.lit(1)).over(own) / 2))
    halves = ranked.groupBy("conv_id").agg(F.max("half").alias("half"))
    ends = ranked.select((F.col("conv_id") - 1).alias("conv_id"), "k", "role", "text").join(halves, "conv_id").where("k > half")
    pick = [F.col("conv_id").alias("pair_id"), F.lit("rejected").alias("side"), F.col("k").alias("turn"), "role", "text"]
    return ranked.select(pick[0], F.lit("chosen").alias("side"), *pick[2:]).unionByName(ranked.where("k <= half").select(*pick)).unionByName(ends.select(*pick))


OP2_SQL = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k,
         count(*) OVER (PARTITION BY conv_id) AS n FROM t
), rejected AS (
  SELECT conv_id, k, role, text FROM ranked WHERE k <= n // 2
  UNION ALL
  SELECT c.conv_id, r.k, r.role, r.text FROM (SELECT conv_id, any_value(n) AS n FROM ranked GROUP BY conv_id) c JOIN ranked r ON r.conv_id = c.conv_id + 1 WHERE r.k > c.n // 2
), prefix AS (
  SELECT c.conv_id, coalesce(min(CASE WHEN r.k IS NULL OR c.role <> r.role OR c.text <> r.text THEN c.k END) - 1, max(c.k)) AS p
  FROM ranked c LEFT JOIN rejected r ON r.conv_id = c.conv_id AND r.k = c.k GROUP BY c.conv_id
), pieces AS (
  SELECT conv_id, 'c' AS side, k, role, text FROM ranked
  UNION ALL SELECT conv_id, 'r', k, role, text FROM rejected
), drawn AS (
  SELECT q.conv_id, p.p, q.side, q.k, q.role, q.k <= p.p AS shared,
         '<|' || q.role || '|>' || chr(10) || q.text || '<|end|>' || chr(10) AS piece, length(q.role) + 5 AS head
  FROM pieces q JOIN prefix p USING (conv_id)
), placed AS (
  SELECT *, coalesce(sum(length(piece)) OVER (PARTITION BY conv_id, side, shared ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begun
  FROM drawn
)
SELECT conv_id AS pair_id, CAST(max(p) AS BIGINT) AS n_prompt_turns,
  coalesce(string_agg(CASE WHEN shared AND side = 'c' THEN piece END, '' ORDER BY k), '') AS prompt,
  coalesce(string_agg(CASE WHEN NOT shared AND side = 'c' THEN piece END, '' ORDER BY k), '') AS chosen,
  coalesce(string_agg(CASE WHEN NOT shared AND side = 'r' THEN piece END, '' ORDER BY k), '') AS rejected,
  coalesce(string_agg(CASE WHEN NOT shared AND side = 'c' AND role = 'assistant' THEN CAST(begun + head AS VARCHAR) || ':' || CAST(begun + length(piece) AS VARCHAR) END, ',' ORDER BY k), '') AS chosen_mask,
  coalesce(string_agg(CASE WHEN NOT shared AND side = 'r' AND role = 'assistant' THEN CAST(begun + head AS VARCHAR) || ':' || CAST(begun + length(piece) AS VARCHAR) END, ',' ORDER BY k), '') AS rejected_mask
FROM placed GROUP BY conv_id
"""
