"""Conversation history (W12) and prompt assembly.

A conversation can be long (assume one holds a third of all rows), so the
history is kept as ordered rows, never collected into one value: positions
and running context sizes are segmented running sums over turn buckets;
the previous role comes from a lag inside the bucket or, for a bucket's
first row, from the last row of the nearest earlier bucket (a small table).
Prompt assembly collects at most ``k`` hits per question, a bounded group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as L

TURN_BUCKET = 256


def conversation_history(conv: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
                         bucket_turns: int = TURN_BUCKET) -> DataFrame:
    """(conv_id, turn, role, position, chars_before, prev_role).

    One aggregate over (conversation, turn bucket) gives every bucket's row
    count, text length and last role; a window over that small table turns
    them into the offsets of each bucket; one window inside each bucket and
    one join finish the job.
    """
    base = (conv.select(conv_col, turn_col, "role", F.length("text").cast("long").alias("_len"))
            .withColumn("_b", F.floor(F.col(turn_col) / bucket_turns)))
    buckets = base.groupBy(conv_col, "_b").agg(
        F.count(F.lit(1)).alias("_bn"), F.sum("_len").alias("_bl"),
        F.max_by("role", F.col(turn_col)).alias("_last_role"))
    wb = Window.partitionBy(conv_col).orderBy("_b")
    before = wb.rowsBetween(Window.unboundedPreceding, -1)
    offsets = buckets.select(
        conv_col, "_b",
        F.coalesce(F.sum("_bn").over(before), F.lit(0)).alias("_pos0"),
        F.coalesce(F.sum("_bl").over(before), F.lit(0)).alias("_len0"),
        F.lag("_last_role").over(wb).alias("_carry"))
    wl = Window.partitionBy(conv_col, "_b").orderBy(turn_col)
    upto = wl.rowsBetween(Window.unboundedPreceding, -1)
    local = base.select(
        conv_col, turn_col, "role", "_b",
        F.row_number().over(wl).alias("_rn"),
        F.coalesce(F.sum("_len").over(upto), F.lit(0)).alias("_lenb"),
        F.lag("role").over(wl).alias("_lp"))
    # null conversations and turns are keys like any other
    offsets = offsets.withColumnsRenamed({conv_col: "_oc", "_b": "_ob"})
    out = local.join(offsets, local[conv_col].eqNullSafe(offsets["_oc"]) & local["_b"].eqNullSafe(offsets["_ob"]))
    return out.select(conv_col, turn_col, "role",
                      (F.col("_pos0") + F.col("_rn")).cast("long").alias("position"),
                      (F.col("_len0") + F.col("_lenb")).cast("long").alias("chars_before"),
                      F.when(F.col("_rn") == 1, F.col("_carry")).otherwise(F.col("_lp")).alias("prev_role"))


def fill_template(template: str, values: dict) -> "F.Column":
    """Single-pass ``{name}`` substitution: the template's literal pieces and the
    value columns are concatenated, so text inside a value is never substituted."""
    import re
    parts = []
    pos = 0
    for m in re.finditer(r"\{(\w+)\}", template):
        parts.append(F.lit(template[pos:m.start()]))
        parts.append(values[m.group(1)] if m.group(1) in values else F.lit(m.group(0)))
        pos = m.end()
    parts.append(F.lit(template[pos:]))
    return F.concat(*parts)


def assemble_context(hits: DataFrame, questions: DataFrame, qid: str = "qid",
                     rank_col: str = "rank", text_col: str = "text",
                     question_col: str = "question",
                     system_prompt: str = L.SYSTEM_PROMPT,
                     template: str = L.USER_QUESTION_TEMPLATE) -> DataFrame:
    """Hit texts joined by a blank line in rank order, put into the template.

    ``hits`` holds at most k rows per question (bounded collect).
    Output: (qid, context, n_docs, prompt); questions without hits get an empty context.
    """
    ctx = (hits.groupBy(qid)
           .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(rank_col, text_col))),
                                         lambda s: s[text_col]), "\n\n").alias("context"),
                F.count(F.lit(1)).alias("n_docs")))
    j = questions.select(qid, question_col).join(ctx, qid, "left") \
        .withColumn("context", F.coalesce("context", F.lit(""))) \
        .withColumn("n_docs", F.coalesce("n_docs", F.lit(0)).cast("long"))
    user = fill_template(template, {"context": F.col("context"), "question": F.col(question_col)})
    return j.select(qid, "context", "n_docs", F.concat(F.lit(system_prompt + "\n\n"), user).alias("prompt"))
