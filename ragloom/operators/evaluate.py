"""Retrieval-quality evaluation (C4 and its parts: P12, P20-P22, A3-A6, J7, A13).

Input: ``hits(qid, rank, chunk_id, similarity, text)`` with at most k rows
per question, and ``cases(qid, keywords array<string>)``. Every group is a
question's k hits, so all aggregates are bounded; the only joins are equi
joins on ``qid``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions.text import words


def case_keywords(text: Column, n: int | None = None) -> Column:
    """Expected keywords of a question: its distinct words as written, longest first
    (ties by word); ``n`` keeps the first ones only."""
    def cmp(a, b):
        return (F.when(F.length(a) > F.length(b), -1).when(F.length(a) < F.length(b), 1)
                .when(a < b, -1).when(a > b, 1).otherwise(0))
    found = F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r"(\p{L}+)"), 1)), cmp)
    return found if n is None else F.slice(found, 1, n)


def keyword_rank_stats(hits: DataFrame, cases: DataFrame) -> DataFrame:
    """A4 + J7: per (qid, keyword): best rank and number of hits containing it.

    Keywords never found keep a row with null best_rank (the missed ones).
    Substring test is case-sensitive (P12).
    """
    # a repeated keyword is one keyword; only the raw list length counts repeats (P20)
    kw = (cases.select("qid", F.posexplode("keywords").alias("kw_pos", "keyword"))
          .groupBy("qid", "keyword").agg(F.min("kw_pos").alias("kw_pos")))
    found = (kw.join(hits.select("qid", "rank", "text"), "qid")
             .filter(F.col("text").contains(F.col("keyword")))
             .groupBy("qid", "keyword")
             .agg(F.min("rank").alias("best_rank"), F.count(F.lit(1)).alias("n_hits")))
    return (kw.join(found, ["qid", "keyword"], "left")
            .withColumn("n_hits", F.coalesce("n_hits", F.lit(0))))


def _ladder(x: Column, steps) -> Column:
    chain = None
    for bound, pts in steps:
        chain = F.when(x >= bound, F.lit(pts)) if chain is None else chain.when(x >= bound, F.lit(pts))
    return chain.otherwise(F.lit(0))


def grade(score: Column) -> Column:
    chain = None
    for bound, label in L.QUALITY_GRADES:
        chain = (F.when(score >= bound, F.lit(label)) if chain is None
                 else chain.when(score >= bound, F.lit(label)))
    return chain


def evaluate_cases(hits: DataFrame, cases: DataFrame) -> DataFrame:
    """C4 per question: similarity stats (A3), score and grade (P20), threshold
    suggestions (P21) and advice (P22)."""
    sims = hits.groupBy("qid").agg(
        F.count(F.lit(1)).alias("n_hits"),
        F.max("similarity").alias("max_similarity"),
        F.avg("similarity").alias("avg_similarity"),
        (F.sum(F.when(F.col("rank") <= 3, F.col("similarity")).otherwise(0.0)) / 3.0).alias("top3_mean"),
        (F.sum(F.when(F.col("rank") <= 5, F.col("similarity")).otherwise(0.0)) / 5.0).alias("top5_mean"))
    ks = keyword_rank_stats(hits, cases)
    kagg = ks.groupBy("qid").agg(
        F.count(F.col("best_rank")).alias("keywords_found"),
        F.avg("best_rank").alias("avg_best_rank"),
        F.array_join(F.transform(F.array_sort(F.collect_list(
            F.when(F.col("best_rank").isNull(), F.struct("kw_pos", "keyword")))),
            lambda s: s["keyword"]), ", ").alias("_missed"),
        F.array_join(F.transform(F.array_sort(F.collect_list(
            F.when(F.col("best_rank") > 10, F.struct("kw_pos", "keyword")))),
            lambda s: s["keyword"]), ", ").alias("_low"))
    c = (cases.select("qid", "keywords").join(sims, "qid", "left").join(kagg, "qid", "left")
         .fillna({"n_hits": 0, "max_similarity": 0.0, "avg_similarity": 0.0,
                  "top3_mean": 0.0, "top5_mean": 0.0, "keywords_found": 0}))
    n_kw = F.size("keywords")
    mx, av = F.col("max_similarity"), F.col("avg_similarity")
    # same accumulation order as the reference: max, mean, hit rate, rank
    kw_hit = F.when(n_kw > 0, F.col("keywords_found") / n_kw * 15.0).otherwise(0.0)
    kw_rank = F.when((n_kw > 0) & (F.col("keywords_found") > 0),
                     F.when(F.col("avg_best_rank") <= 3, 15)
                     .when(F.col("avg_best_rank") <= 5, 10)
                     .when(F.col("avg_best_rank") <= 10, 5).otherwise(0)).otherwise(0)
    score = ((_ladder(mx, [(0.7, 40), (0.6, 30), (0.5, 20), (0.4, 10)])
              + _ladder(av, [(0.6, 30), (0.5, 20), (0.4, 10)])).cast("double")
             + kw_hit + kw_rank.cast("double"))
    c = c.withColumn("score", score)
    has_hits = F.col("n_hits") > 0
    advice = F.filter(F.array(
        F.when(mx < 0.5, F.lit(L.SUGGEST_LOW_MAX)),
        F.when(av < 0.4, F.lit(L.SUGGEST_LOW_AVG)),
        F.when((n_kw > 0) & (F.coalesce(F.col("_missed"), F.lit("")) != ""),
               F.replace(F.lit(L.SUGGEST_MISSED), F.lit("{kws}"), F.col("_missed"))),
        F.when((n_kw > 0) & (F.coalesce(F.col("_low"), F.lit("")) != ""),
               F.replace(F.lit(L.SUGGEST_LOW_RANK), F.lit("{kws}"), F.col("_low"))),
        F.when((mx >= 0.6) & (av >= 0.5), F.lit(L.SUGGEST_GOOD))), lambda x: x.isNotNull())
    advice = F.when(F.size(advice) == 0, F.array(F.lit(L.SUGGEST_FINE))).otherwise(advice)
    return c.select(
        "qid", "n_hits", "max_similarity", "avg_similarity", "top3_mean", "top5_mean",
        F.array_join("keywords", ",").alias("keywords"),
        F.col("keywords_found").cast("long").alias("keywords_found"),
        "score", grade(F.col("score")).alias("grade"),
        F.when(has_hits, F.greatest(F.lit(0.3), F.col("top3_mean") - 0.05)).alias("strict"),
        F.when(has_hits, F.greatest(F.lit(0.25), F.col("top5_mean") - 0.08)).alias("balanced"),
        F.when(has_hits, F.greatest(F.lit(0.2), F.col("top5_mean") - 0.15)).alias("loose"),
        F.array_join(advice, "\n").alias("suggestions"))


def evaluation_summary(per_case: DataFrame) -> DataFrame:
    """A5: means over cases and global thresholds from mean top-3 / top-5."""
    return per_case.agg(
        F.count(F.lit(1)).alias("cases"),
        F.avg("score").alias("avg_score"),
        F.avg("max_similarity").alias("avg_max_similarity"),
        F.avg("avg_similarity").alias("avg_avg_similarity"),
        F.greatest(F.lit(0.3), F.avg("top3_mean") - 0.05).alias("strict"),
        F.greatest(F.lit(0.25), F.avg("top5_mean") - 0.08).alias("balanced"),
        F.greatest(F.lit(0.2), F.avg("top5_mean") - 0.15).alias("loose"))


def grade_distribution(per_case: DataFrame) -> DataFrame:
    """Cases per grade word, ordered by label descending."""
    word = F.split(F.col("grade"), " ", -1).getItem(0)
    return (per_case.groupBy(word.alias("grade")).agg(F.count(F.lit(1)).alias("cases"))
            .orderBy(F.col("grade").desc()))


def category_metrics(hits: DataFrame, cases: DataFrame, category_col: str = "category") -> DataFrame:
    """Per category, keyword-based precision / recall / F1.

    A hit is relevant when it contains at least one expected keyword;
    precision = relevant hits / hits, recall = keywords found / keywords
    expected, F1 their harmonic mean (0 when both are 0).
    """
    kws = cases.select("qid", category_col, "keywords")
    rel = (hits.join(kws, "qid")
           .withColumn("_rel", F.exists("keywords", lambda k: F.col("text").contains(k)).cast("int")))
    prec = rel.groupBy(category_col).agg(F.sum("_rel").alias("relevant"), F.count(F.lit(1)).alias("hits"))
    ks = keyword_rank_stats(hits, cases).join(cases.select("qid", category_col), "qid")
    rec = ks.groupBy(category_col).agg(F.count("best_rank").alias("found"),
                                       F.count(F.lit(1)).alias("expected"))
    m = prec.join(rec, category_col, "full")
    p = F.when(F.col("hits") > 0, F.col("relevant") / F.col("hits")).otherwise(0.0)
    r = F.when(F.col("expected") > 0, F.col("found") / F.col("expected")).otherwise(0.0)
    return (m.withColumn("precision", p).withColumn("recall", r)
            .withColumn("f1", F.when((F.col("precision") + F.col("recall")) > 0,
                                     2 * F.col("precision") * F.col("recall")
                                     / (F.col("precision") + F.col("recall"))).otherwise(0.0)))

