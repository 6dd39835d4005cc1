"""Question validation (F1-F4, P24) as one ``when`` chain.

Order of checks follows the service: blank -> strip -> length (cut or reject)
-> blocklist -> probe patterns -> technical terms. The text beyond the length
limit is never inspected. All checks are JVM expressions; no shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions.text import py_strip


def probe_match(lowered: Column, patterns=None) -> Column:
    """any probe pattern found (``.`` stops at ``\\n`` only)."""
    pats = patterns or L.SYSTEM_PROBE_PATTERNS
    return reduce(lambda a, b: a | b, [lowered.rlike("(?d)" + p) for p in pats])


def validate_questions(df: DataFrame, text_col: str = "text",
                       max_length: int = L.MAX_INPUT_LENGTH, truncate: bool = True,
                       security: bool = True, blocked=None, patterns=None,
                       tech_terms=None) -> DataFrame:
    """adds ok / text / error / reason (text replaced by the processed text).

    Staged projections: strip and cut once, lower once, then one reason
    chain over those columns (keeps every stage inside whole-stage codegen).
    """
    rest = [c for c in df.columns if c != text_col]
    raw = F.col(text_col)
    s1 = df.withColumn("_st", py_strip(raw)).withColumn("_null", raw.isNull())
    s1 = s1.withColumn("_n", F.length("_st"))
    s2 = s1.withColumn("_cut", F.when(F.col("_n") > max_length, F.substring("_st", 1, max_length))
                       .otherwise(F.col("_st")))
    s2 = s2.withColumn("_low", F.lower("_cut"))
    low = F.col("_low")
    chain = F.when(F.col("_null") | (F.col("_st") == ""), F.lit("empty"))
    if not truncate:
        chain = chain.when(F.col("_n") > max_length, F.lit("too_long"))
    if security:
        # literal lists as array lambdas: small generated code when fused with routing
        bl = F.array(*[F.lit(w.lower()) for w in (blocked or L.BLOCKED_KEYWORDS)])
        tt = F.array(*[F.lit(w.lower()) for w in (tech_terms or L.TECH_TERMS)])
        chain = (chain
                 .when(F.exists(bl, lambda k: low.contains(k)), F.lit("blocked_keyword"))
                 .when(probe_match(low, patterns), F.lit("system_probe"))
                 .when(F.size(F.filter(tt, lambda k: low.contains(k))) >= L.TECH_TERMS_LIMIT,
                       F.lit("tech_terms")))
    chain = chain.when(F.col("_n") > max_length, F.lit("truncated")).otherwise(F.lit("ok"))
    s3 = s2.withColumn("reason", chain)
    r = F.col("reason")
    ok = r.isin("ok", "truncated")
    too_long_msg = F.format_string(
        L.MSG_TOO_LONG.replace("{max}", str(max_length)).replace("{n}", "%d"), F.col("_n"))
    error = (F.when(r == "empty", F.lit(L.MSG_EMPTY))
             .when(r == "too_long", too_long_msg)
             .when(ok, F.lit(None).cast("string"))
             .otherwise(F.lit(L.MSG_SECURITY)))
    return s3.select(*rest, ok.alias("ok"), F.when(ok, F.col("_cut")).otherwise(F.lit("")).alias("text"),
                     error.alias("error"), "reason")


def filter_profile(validated: DataFrame) -> DataFrame:
    """A10: rejections (and passes) by reason."""
    return validated.groupBy("reason").agg(F.count(F.lit(1)).alias("n"),
                                           F.max(F.col("ok").cast("int")).cast("boolean").alias("ok"))


def filter_settings(spark, max_length: int = L.MAX_INPUT_LENGTH, truncate: bool = True,
                    security: bool = True, blocked=None) -> DataFrame:
    """A10 (static part): enabled flag, limits, keyword count and the first five keywords."""
    kws = list(blocked or L.BLOCKED_KEYWORDS)
    return spark.createDataFrame(
        [(security, max_length, truncate, len(kws), kws[:5])],
        "enabled boolean, max_input_length int, truncation_enabled boolean, "
        "blocked_keywords_count int, blocked_keywords array<string>")
