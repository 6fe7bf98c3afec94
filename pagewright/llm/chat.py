"""Preference formatting with DataFrame functions only.

A pair holds a chosen and a rejected conversation. Their longest common prefix of
turns is the prompt and is rendered once; what follows on either side is a completion
whose mask marks the characters that carry loss.

Turns are compared by counting, for each (pair, turn, role, text), how often it stands
on either side: the prefix ends at the smallest turn where the counts differ. That is
two aggregations with partial sums and one join, so no conversation is gathered to be
compared. ``assemble_pairs`` then joins the rendered turns to one row a pair; a conversation
of more than ``segment`` turns goes on in further rows, so that no row or task has to hold
a conversation of any length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Marks of the template around role and text.
OPEN, BETWEEN, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"
TRAINED_ROLE = "assistant"
#: Turns of a conversation that one row holds.
SEGMENT = 512


def pair_sides(conversations: DataFrame) -> DataFrame:
    """pair_id, chosen, turn, role, text: conversation 2k is chosen over 2k + 1 in pair k.

    A null conv_id gives a null pair_id and a null ``chosen``.
    """
    pair = F.floor(F.col("conv_id") / F.lit(2)).cast("long") if dict(conversations.dtypes)["conv_id"] not in ("int", "bigint") else F.shiftright(F.col("conv_id").cast("long"), 1)
    return conversations.select(pair.alias("pair_id"), (F.pmod(F.col("conv_id"), F.lit(2)) == 0).alias("chosen"), F.col("turn").cast("long").alias("turn"), "role", "text")


def format_preferences(sides: DataFrame, *, trained_role: str = TRAINED_ROLE, opening: str = OPEN, between: str = BETWEEN, close: str = CLOSE) -> DataFrame:
    """Rows of prompt and completions from ``sides`` (pair_id, chosen, turn, role, text).

    Returns pair_id, part ('prompt', 'chosen' or 'rejected'), turn, role, copies, rendered,
    loss_from, loss_to (characters of ``rendered`` that carry loss, from 0, end excluded;
    both 0 for none). In order of turn, the rows of a part make its text.

    Prompt turns are rendered once for both sides. Equal conversations give a prompt and
    no completion; a conversation without partner gives one completion and no prompt. A
    null turn comes before all others. Null role or text is rendered as empty; null and
    empty are different turns. Equal rows at one turn are one row with their number in
    ``copies``; other rows at one turn are told apart by role and text. Rows with null
    pair_id form one pair; a null ``chosen`` counts as rejected. Other columns are ignored.
    """
    one = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    chosen = F.coalesce(F.col("chosen"), F.lit(False))
    counted = sides.groupBy("pair_id", "turn", "role", "text").agg(one(chosen).alias("n_chosen"), one(~chosen).alias("n_rejected"))
    at = F.coalesce(F.col("turn"), F.lit(-(2**63)))
    split = counted.where("n_chosen <> n_rejected").groupBy("pair_id").agg(F.min(at).alias("first_apart")).select(F.col("pair_id").alias("split_id"), "first_apart")
    joined = counted.join(split, F.col("pair_id").eqNullSafe(F.col("split_id")), "left")
    common = F.col("first_apart").isNull() | (at < F.col("first_apart"))
    parts = F.when(common, F.array(F.struct(F.lit("prompt").alias("part"), F.col("n_chosen").alias("copies")))).otherwise(
        F.filter(F.array(F.struct(F.lit("chosen").alias("part"), F.col("n_chosen").alias("copies")), F.struct(F.lit("rejected").alias("part"), F.col("n_rejected").alias("copies"))), lambda x: x["copies"] > 0)
    )
    text = F.coalesce(F.col("text"), F.lit(""))
    head: Column = F.concat(F.lit(opening), F.coalesce(F.col("role"), F.lit("")), F.lit(between))
    trained = (F.col("p.part") != "prompt") & F.coalesce(F.col("role") == trained_role, F.lit(False))
    start = F.char_length(head)
    rows = joined.withColumn("p", F.explode(parts))
    return rows.select(
        "pair_id",
        F.col("p.part").alias("part"),
        "turn",
        "role",
        F.col("p.copies").alias("copies"),
        F.concat(head, text, F.lit(close)).alias("rendered"),
        F.when(trained, start).otherwise(F.lit(0)).cast("int").alias("loss_from"),
        F.when(trained, start + F.char_length(text) + F.char_length(F.lit(close.rstrip("\n")))).otherwise(F.lit(0)).cast("int").alias("loss_to"),
    )


def assemble_pairs(rows: DataFrame, *, segment: int = SEGMENT) -> DataFrame:
    """Paired completions from the rows of ``format_preferences``.

    Returns pair_id, segment, prompt, chosen, rejected, chosen_loss, rejected_loss,
    chosen_turns, rejected_turns. The rendered turns of a part follow each other in order of
    turn, role, text (nulls first), a turn as often as it stands there. A mask lists the
    ranges of a completion's characters that carry loss, as 'from-to' from 0, end excluded,
    joined by commas; the rest, like the whole prompt, carries none. Segment 0 has the turns
    below ``segment`` and those without number, segment 1 the next, and so on; a conversation's
    text is that of its segments in order. A part without turns is empty, and so is its mask.
    Equal conversations give a prompt and two empty completions, a conversation without
    partner no prompt and one empty completion. Other columns are ignored.
    """
    n = F.floor(F.greatest(F.coalesce("turn", F.lit(0)), F.lit(0)) / F.lit(segment)).cast("int")
    turns = rows.select("pair_id", n.alias("segment"), "part", "turn", "role", "rendered", "loss_from", "loss_to", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    order = ["turn", "role", "rendered", "copy"]
    before = Window.partitionBy("pair_id", "segment", "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = turns.repartition("pair_id", "segment").withColumn("at", F.coalesce(F.sum(F.char_length("rendered")).over(before), F.lit(0)))
    mask = F.when(F.col("loss_to") > F.col("loss_from"), F.concat_ws("-", F.col("at") + F.col("loss_from"), F.col("at") + F.col("loss_to")))
    listed = lambda part, what: F.transform(F.array_sort(F.collect_list(F.when(F.col("part") == part, F.struct("at", *order, what.alias("x"))))), lambda x: x["x"])
    joined = lambda part: F.array_join(listed(part, F.col("rendered")), "")
    masked = lambda part: F.array_join(listed(part, mask), ",")
    number = lambda part: F.count_if(F.col("part") == part)
    return placed.groupBy("pair_id", "segment").agg(
        joined("prompt").alias("prompt"), joined("chosen").alias("chosen"), joined("rejected").alias("rejected"),
        masked("chosen").alias("chosen_loss"), masked("rejected").alias("rejected_loss"),
        number("chosen").alias("chosen_turns"), number("rejected").alias("rejected_turns"),
    )


SQL = """
WITH sides AS (
  SELECT conv_id >> 1 AS pair_id, conv_id % 2 = 0 AS chosen, CAST(turn AS BIGINT) AS turn, role, text FROM conversations
), counted AS (
  SELECT pair_id, turn, role, text, count(*) FILTER (WHERE chosen) AS n_chosen, count(*) FILTER (WHERE NOT chosen) AS n_rejected
  FROM sides GROUP BY ALL
), split AS (
  SELECT pair_id AS split_id, min(turn) AS first_apart FROM counted WHERE n_chosen <> n_rejected GROUP BY ALL
), parts AS (
  SELECT c.*, 'prompt' AS part, n_chosen AS copies FROM counted c LEFT JOIN split ON pair_id = split_id WHERE first_apart IS NULL OR turn < first_apart
  UNION ALL SELECT c.*, 'chosen', n_chosen FROM counted c JOIN split ON pair_id = split_id WHERE turn >= first_apart AND n_chosen > 0
  UNION ALL SELECT c.*, 'rejected', n_rejected FROM counted c JOIN split ON pair_id = split_id WHERE turn >= first_apart AND n_rejected > 0
), turns AS (
  SELECT pair_id, CAST(turn // 512 AS INTEGER) AS segment, part, turn, role, copy, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS rendered,
    part <> 'prompt' AND role = 'assistant' AS trained, 13 + length(role) AS loss_from, 23 + length(role) + length(text) AS loss_to
  FROM (SELECT *, unnest(range(copies)) AS copy FROM parts)
), placed AS (
  SELECT *, coalesce(sum(length(rendered)) OVER (PARTITION BY pair_id, segment, part ORDER BY turn, role, rendered, copy ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begins FROM turns
)
SELECT pair_id, segment,
  coalesce(string_agg(rendered, '' ORDER BY begins) FILTER (WHERE part = 'prompt'), '') AS prompt,
  coalesce(string_agg(rendered, '' ORDER BY begins) FILTER (WHERE part = 'chosen'), '') AS chosen,
  coalesce(string_agg(rendered, '' ORDER BY begins) FILTER (WHERE part = 'rejected'), '') AS rejected,
  coalesce(string_agg(CAST(begins + loss_from AS BIGINT) || '-' || CAST(begins + loss_to AS BIGINT), ',' ORDER BY begins) FILTER (WHERE part = 'chosen' AND trained), '') AS chosen_loss,
  coalesce(string_agg(CAST(begins + loss_from AS BIGINT) || '-' || CAST(begins + loss_to AS BIGINT), ',' ORDER BY begins) FILTER (WHERE part = 'rejected' AND trained), '') AS rejected_loss,
  count(*) FILTER (WHERE part = 'chosen') AS chosen_turns, count(*) FILTER (WHERE part = 'rejected') AS rejected_turns
FROM placed GROUP BY pair_id, segment
"""
