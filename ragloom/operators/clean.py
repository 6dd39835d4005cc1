"""Corpus cleaning (P1-P3) and cleaning statistics (A1).

Everything is one projection over the document row: the text is split into
lines, every line is normalised and tagged with a drop reason, the survivors
are joined by a blank line. No shuffle; a document is processed where it is
read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions.text import any_contains, normalise_line

REASONS = ("empty", "spam", "short")


def tag_lines(text, min_length: int = L.MIN_USEFUL_LENGTH, spam_keywords=None):
    """array<struct<line,reason>>: reason is empty -> spam -> short, or null (kept).

    Staged transforms so every per-line expression is evaluated once (lambda
    bodies get no common-subexpression elimination).
    """
    words = [w.lower() for w in (spam_keywords or L.SPAM_KEYWORDS)]
    lines = F.transform(F.split(text, "\n", -1), normalise_line)
    pairs = F.transform(lines, lambda l: F.struct(l.alias("line"), F.lower(l).alias("low")))

    def tag(s):
        line = s["line"]
        reason = (F.when(line == "", F.lit("empty"))
                  .when(any_contains(s["low"], words, lower=False), F.lit("spam"))
                  .when(F.length(line) < min_length, F.lit("short")))
        return F.struct(line.alias("line"), reason.alias("reason"))

    return F.transform(pairs, tag)


def clean_documents(df: DataFrame, text_col: str = "text",
                    min_length: int = L.MIN_USEFUL_LENGTH, spam_keywords=None,
                    keep_columns=("doc_id",)) -> DataFrame:
    """P3 + A1 per document: cleaned text and the five line counters.

    ``min_length=0`` means 0 (no short-line filter).
    """
    tagged = df.select(*keep_columns,
                       tag_lines(F.col(text_col), min_length, spam_keywords).alias("_t"))
    kept = F.filter("_t", lambda s: s["reason"].isNull())
    def reason_is(r):
        return lambda s: s["reason"] == r
    counts = {r: F.size(F.filter("_t", reason_is(r))) for r in REASONS}
    return tagged.select(
        *keep_columns,
        F.array_join(F.transform(kept, lambda s: s["line"]), "\n\n").alias("clean_text"),
        F.size("_t").alias("total_lines"),
        (F.size("_t") - F.size(kept)).alias("removed_lines"),
        counts["spam"].alias("spam_lines"),
        counts["empty"].alias("empty_lines"),
        counts["short"].alias("short_lines"),
    )


def cleaning_totals(cleaned: DataFrame, group_cols=()) -> DataFrame:
    """A1 overall: files processed, summed counters, removal percentage."""
    agg = cleaned.groupBy(*group_cols).agg(
        F.count(F.lit(1)).alias("files_processed"),
        F.sum("total_lines").alias("total_lines"),
        F.sum("removed_lines").alias("removed_lines"),
        F.sum("spam_lines").alias("spam_lines"),
        F.sum("empty_lines").alias("empty_lines"),
        F.sum("short_lines").alias("short_lines"),
    )
    t, r = F.col("total_lines"), F.col("removed_lines")
    # one decimal, half-up, exact from the integer counts
    return agg.withColumn("removed_pct", F.when(t > 0, F.floor((2000 * r + t) / (2.0 * t)) / 10.0)
                          .otherwise(F.lit(0.0)))
