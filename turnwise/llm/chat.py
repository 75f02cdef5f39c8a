"""Preference formatting of conversations, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"


def conversations_as_rows(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turns): each conversation's turns in order as array<struct<role, text>>.

    Null turn numbers come first, ties are ordered by role and text; a null role is `user`, a null text empty. Turns with a null
    conversation are left out. A conversation is one row, as its rendering is, so its length bounds what a task holds.
    """
    one = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("user")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ordered = turns.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("conv_id")).agg(F.sort_array(F.collect_list(one)).alias("t"))
    return ordered.select("conv_id", F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))


def pair_neighbours(conversations: DataFrame) -> DataFrame:
    """(pair_id, chosen_id, rejected_id, chosen, rejected): conversations 2k and 2k + 1 make pair k, for negative k too; the side that is missing is null."""
    sided = conversations.select(F.expr("(conv_id - pmod(conv_id, 2)) div 2").alias("pair_id"), (F.pmod("conv_id", F.lit(2)) == 0).alias("even"), "conv_id", "turns")
    pick = lambda c, even: F.max(F.when(F.col("even") if even else ~F.col("even"), F.col(c)))
    return sided.groupBy("pair_id").agg(pick("conv_id", True).alias("chosen_id"), pick("conv_id", False).alias("rejected_id"), pick("turns", True).alias("chosen"), pick("turns", False).alias("rejected"))


def render(turns: Column) -> Column:
    """Each turn between its markers; markers inside a text are broken up so that they cannot end it."""
    clean = lambda s: F.replace(s, F.lit("<|im_"), F.lit("<\u200b|im_"))
    return F.array_join(F.transform(turns, lambda x: F.concat(F.lit(START), clean(x["role"]), F.lit("\n"), clean(x["text"]), F.lit(END + "\n"))), "")


def spans(turns: Column, before: Column, role: str) -> Column:
    """[begin, end) in code points of the text after `before` that is trained on: the turns of `role`, their end marker with them."""
    sizes = F.transform(turns, lambda x: F.struct(x["role"].alias("role"), F.char_length(render(F.array(x))).alias("n"), F.char_length(x["role"]).alias("r")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<begin:int,end:int>>").alias("out"))
    head = len(START) + 1

    def step(acc, x):
        here = F.array(F.struct((acc["at"] + head + x["r"]).alias("begin"), (acc["at"] + x["n"] - 1).alias("end")))
        return F.struct((acc["at"] + x["n"]).alias("at"), F.when(x["role"] == role, F.concat(acc["out"], here)).otherwise(acc["out"]).alias("out"))

    return F.transform(F.aggregate(sizes, start, step)["out"], lambda s: F.struct((s["begin"] + before).alias("begin"), (s["end"] + before).alias("end")))


def preference_pairs(pairs: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """Add n_prompt_turns, prompt, chosen_text, rejected_text, chosen_spans, rejected_spans to (chosen, rejected) arrays of turns.

    The longest common prefix of turns (equal role and text) is rendered once as prompt; the completions hold the rest. Spans are
    [begin, end) code points of a completion that carry loss: contents of `trained_role` turns with their end marker; all else is masked, the
    prompt wholly. If one conversation is a prefix of the other, its completion is empty. A missing side gives a null completion
    and null spans, and the prompt is then what comes before the last turn of the other side. Markers in texts are broken up.
    """
    least = F.greatest(F.lit(0), F.least(F.size("chosen"), F.size("rejected")))
    same = F.zip_with(F.slice("chosen", F.lit(1), least), F.slice("rejected", F.lit(1), least), lambda x, y: x.eqNullSafe(y))
    first = F.array_position(same, F.lit(False)).cast("int")
    shared = F.when(first > 0, first - 1).otherwise(least)
    one = F.coalesce("chosen", "rejected")
    n = F.when(F.col("chosen").isNull() | F.col("rejected").isNull(), F.greatest(F.lit(0), F.size(one) - 1)).otherwise(shared)
    out = pairs.withColumn("n_prompt_turns", n)
    rest = lambda c: F.slice(c, F.col("n_prompt_turns") + 1, F.greatest(F.lit(0), F.size(c) - F.col("n_prompt_turns")))
    out = out.withColumn("prompt", render(F.slice(one, F.lit(1), F.col("n_prompt_turns"))))
    for side in ("chosen", "rejected"):
        there = F.col(side).isNotNull()
        out = out.withColumn(f"_{side}", F.when(there, rest(F.col(side))))
        out = out.withColumn(f"{side}_text", F.when(there, render(F.col(f"_{side}")))).withColumn(f"{side}_spans", F.when(there, spans(F.col(f"_{side}"), F.lit(0), trained_role)))
    return out.drop("_chosen", "_rejected")


#: What preference_pairs gives for neighbouring conversations, for DuckDB.
NEIGHBOURS_SQL = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k, (conv_id - (conv_id % 2 + 2) % 2) // 2 AS pair_id, conv_id % 2 = 0 AS even,
  '{START}' || replace(role, '<|im_', '<\u200b|im_') || chr(10) || replace(text, '<|im_', '<\u200b|im_') || '{END}' || chr(10) AS s FROM t),
sizes AS (SELECT pair_id, max(conv_id) FILTER (WHERE even) AS chosen_id, max(conv_id) FILTER (WHERE NOT even) AS rejected_id,
  count(*) FILTER (WHERE even) AS nc, count(*) FILTER (WHERE NOT even) AS nr FROM r GROUP BY pair_id),
differ AS (SELECT a.pair_id, min(a.k) AS k FROM r a LEFT JOIN r b ON b.pair_id = a.pair_id AND NOT b.even AND b.k = a.k AND b.role = a.role AND b.text = a.text
  WHERE a.even AND b.k IS NULL GROUP BY a.pair_id),
p AS (SELECT sizes.*, CASE WHEN nc = 0 OR nr = 0 THEN greatest(nc, nr) - 1 ELSE least(coalesce(k - 1, nc), nr) END AS n FROM sizes LEFT JOIN differ USING (pair_id)),
x AS (SELECT r.*, p.n, p.nc, r.k > p.n AS after, sum(CASE WHEN r.k > p.n THEN length(s) ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY r.k) AS stop FROM r JOIN p USING (pair_id))
SELECT p.pair_id, p.chosen_id, p.rejected_id, CAST(p.n AS INTEGER) AS n_prompt_turns,
  coalesce(string_agg(s, '' ORDER BY k) FILTER (WHERE NOT after AND even = (x.nc > 0)), '') AS prompt,
  CASE WHEN p.nc > 0 THEN coalesce(string_agg(s, '' ORDER BY k) FILTER (WHERE after AND even), '') END AS chosen_text,
  CASE WHEN p.nr > 0 THEN coalesce(string_agg(s, '' ORDER BY k) FILTER (WHERE after AND NOT even), '') END AS rejected_text,
  CASE WHEN p.nc > 0 THEN coalesce(string_agg((stop - length(s) + {len(START) + 1} + length(role)) || '-' || (stop - 1), ',' ORDER BY k) FILTER (WHERE after AND even AND role = 'assistant'), '') END AS chosen_trained,
  CASE WHEN p.nr > 0 THEN coalesce(string_agg((stop - length(s) + {len(START) + 1} + length(role)) || '-' || (stop - 1), ',' ORDER BY k) FILTER (WHERE after AND NOT even AND role = 'assistant'), '') END AS rejected_trained
FROM p JOIN x ON x.pair_id = p.pair_id GROUP BY p.pair_id, p.chosen_id, p.rejected_id, p.n, p.nc, p.nr
"""


def spans_text(column: str) -> Column:
    return F.array_join(F.transform(column, lambda s: F.concat_ws("-", s["begin"].cast("string"), s["end"].cast("string"))), ",")
