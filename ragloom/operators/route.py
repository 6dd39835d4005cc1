"""Question routing (C1 without/with model, J2-J4, W6, W7, F8, A12).

The cascade rules -> keywords -> model -> default is a ``coalesce`` of JVM
expressions generated from the lexicons, so a question is routed inside one
projection (no join, no shuffle). The policy lookup is a broadcast join with
a fixed six-row table. For large, user-supplied lexicons the keyword step is
also offered as a broadcast theta join (``keyword_join``).
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions.mathx import pct2
from ..functions.text import py_strip


def routing_text(text: Column) -> Column:
    """Routing compares ``text.lower().strip()``."""
    return py_strip(F.lower(text))


def search_form(pattern: str) -> str:
    """Drop a leading and a trailing unquantified ``.*``.

    Under search (find) semantics ``.*X.*`` matches exactly when ``X`` does,
    because both ``.*`` may match the empty string; Java's backtracking
    engine, however, spends quadratic time on the outer ``.*``.
    """
    p = pattern
    if p.startswith(".*") and not p.startswith(".*?") and p[2:3] not in ("*", "+", "?", "{"):
        p = p[2:]
    if p.endswith(".*") and not p.endswith("\\.*") and len(p) > 2:
        p = p[:-2]
    return p


def rule_intent(t: Column, rules=None) -> Column:
    """J3 + W6: the intent of the first matching rule (dict order, then list order)."""
    rules = rules or L.INTENT_RULES
    return F.coalesce(*[F.when(t.rlike("(?iud)" + search_form(p)), F.lit(intent))
                        for intent, pats in rules.items() for p in pats])


def _contains(t: Column, keyword: str, whole_word: bool) -> Column:
    """The keyword anywhere in the text, or (Latin keywords only) as a word of its own."""
    if whole_word and keyword.isascii():
        return t.rlike(r"(?<![A-Za-z0-9])" + re.escape(keyword) + r"(?![A-Za-z0-9])")
    return t.contains(keyword)


def keyword_scores(t: Column, keywords=None, whole_word: bool = False) -> list[tuple[str, Column]]:
    """Per intent: 10 per keyword equal to the text, else 1 per keyword contained."""
    keywords = keywords or L.INTENT_KEYWORDS
    out = []
    for intent, kws in keywords.items():
        terms = [F.when(t == k.lower(), 10).when(_contains(t, k.lower(), whole_word), 1).otherwise(0)
                 for k in kws]
        out.append((intent, reduce(lambda a, b: a + b, terms)))
    return out


def keyword_intent(t: Column, keywords=None) -> Column:
    """J2 + W7: highest scoring intent; ties go to the earlier intent; null if no hit."""
    scores = keyword_scores(t, keywords)
    best = F.greatest(*[s for _, s in scores]) if len(scores) > 1 else scores[0][1]
    chain = None
    for intent, s in scores:
        cond = (s == best) & (best > 0)
        chain = F.when(cond, F.lit(intent)) if chain is None else chain.when(cond, F.lit(intent))
    return chain


def policy_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(L.INTENT_POLICIES,
                                 "intent string, skip_rag boolean, response string")


def attach_policy(df: DataFrame, spark: SparkSession | None = None) -> DataFrame:
    """Equi lookup of (skip_rag, response); unknown intents get the knowledge policy."""
    spark = spark or df.sparkSession
    pol = F.broadcast(policy_table(spark))  # fixed six rows
    default = dict((i, (s, r)) for i, s, r in L.INTENT_POLICIES)["knowledge"]
    j = df.join(pol, "intent", "left")
    # intents without a policy row fall back to the knowledge policy
    return (j.withColumn("response", F.when(F.col("skip_rag").isNull(), F.lit(default[1]))
                         .otherwise(F.col("response")))
             .withColumn("skip_rag", F.coalesce("skip_rag", F.lit(default[0]))))


def route_questions(df: DataFrame, text_col: str = "text", rules=None, keywords=None,
                    model_intent: str | None = None, model_conf: str | None = None,
                    min_confidence: float = L.ML_MIN_CONFIDENCE, whole_word: bool = False,
                    profile: str = "configured") -> DataFrame:
    """Intent, confidence, method, skip_rag, response for every row.

    ``model_intent`` / ``model_conf`` name columns produced by a classifier
    (M2) on the rows; the model answer is used only when confident and not
    ``knowledge`` (F8). ``whole_word`` matches Latin keywords as words only;
    ``profile="extended"`` takes the wider lists (with chitchat rules).
    """
    if profile not in ("configured", "extended"):
        raise ValueError(f"unknown profile {profile!r}")
    if profile == "extended":
        rules, keywords = rules or L.EXTENDED_INTENT_RULES, keywords or L.EXTENDED_INTENT_KEYWORDS
    # materialise the two lexicon verdicts once; the cascade reads them by name
    t = routing_text(F.col(text_col))
    staged = df.withColumn("_t", t)
    staged = staged.withColumn("_r", rule_intent(F.col("_t"), rules))
    scores = keyword_scores(F.col("_t"), keywords, whole_word)
    staged = staged.withColumns({f"_s{i}": s for i, (_, s) in enumerate(scores)})
    names = [n for n, _ in scores]
    best = F.greatest(*[F.col(f"_s{i}") for i in range(len(names))]) if len(names) > 1 \
        else F.col("_s0")
    staged = staged.withColumn("_best", best)
    kchain = None
    for i, n in enumerate(names):
        cond = (F.col(f"_s{i}") == F.col("_best")) & (F.col("_best") > 0)
        kchain = F.when(cond, F.lit(n)) if kchain is None else kchain.when(cond, F.lit(n))
    staged = staged.withColumn("_k", kchain)
    r, k = F.col("_r"), F.col("_k")
    if model_intent:
        gate = (F.col(model_conf) >= min_confidence) & (F.col(model_intent) != "knowledge")
        m = F.when(gate, F.col(model_intent))
        mc = F.when(gate, F.col(model_conf))
    else:
        m = F.lit(None).cast("string")
        mc = F.lit(None).cast("double")
    routed = staged.withColumns({
        "intent": F.coalesce(r, k, m, F.lit("knowledge")),
        "confidence": (F.when(r.isNotNull(), F.lit(L.RULE_CONFIDENCE))
                       .when(k.isNotNull(), F.lit(L.KEYWORD_CONFIDENCE))
                       .when(m.isNotNull(), mc)
                       .otherwise(F.lit(L.DEFAULT_CONFIDENCE))),
        "method": (F.when(r.isNotNull(), F.lit("rule"))
                   .when(k.isNotNull(), F.lit("keyword"))
                   .when(m.isNotNull(), F.lit("ml"))
                   .otherwise(F.lit("default"))),
    }).drop("_t", "_r", "_k", "_best", *[f"_s{i}" for i in range(len(names))])
    return attach_policy(routed)


LEXICON_BROADCAST_ROWS = 200_000


def keyword_join(texts: DataFrame, lexicon: DataFrame, id_col: str = "qid",
                 text_col: str = "text", strategy: str = "automaton") -> DataFrame:
    """J2 for large lexicons ``(intent, intent_ord, keyword)``: best intent per text with a hit.

    A keyword counts once per text however often it occurs, tenfold if it is
    the text; best intent by score, ties by intent order. ``strategy``:
    ``"automaton"`` reads every text once (``operators.automaton``);
    ``"substrings"`` is the same in SQL functions only: every text is exploded
    into its substrings of the keyword lengths, hash-joined with the keywords.
    """
    lex = (lexicon.select("intent", F.col("intent_ord").cast("int").alias("intent_ord"), F.lower("keyword").alias("keyword"))
           .filter(F.length("keyword") > 0).dropDuplicates(["intent", "keyword"]))
    t = texts.select(id_col, routing_text(F.col(text_col)).alias("_t"))
    if strategy == "automaton":
        from .automaton import keyword_scores as automaton_scores
        scored = automaton_scores(t, lex, id_col, "_t")
    elif strategy == "substrings":
        scored = _substring_scores(t, lex, id_col)
    else:
        raise ValueError(f"unknown strategy {strategy!r}")
    w = Window.partitionBy(id_col).orderBy(F.desc("score"), "intent_ord")
    return (scored.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1")
            .drop("_rn", "intent_ord"))


def _substring_scores(t: DataFrame, lex: DataFrame, id_col: str) -> DataFrame:
    """"keyword contained in text" as an equi join: some substring of the text equals the keyword."""
    lengths = [r[0] for r in lex.select(F.length("keyword")).distinct().collect()]  # distinct lengths only
    initials = [r[0] for r in lex.select(F.substring("keyword", 1, 1)).distinct().collect()]  # distinct characters only
    # positions, then one substring per keyword length: plain (code-generated) projections
    pos = t.select(id_col, "_t", F.explode(F.sequence(F.lit(1), F.greatest(F.length("_t"), F.lit(1))))
                   .alias("_p")).where(F.substring(F.col("_t"), F.col("_p"), F.lit(1)).isin(initials))
    grams = pos.select(id_col, F.length("_t").alias("_n"), F.explode(F.array(*[
        F.substring(F.col("_t"), F.col("_p"), F.lit(size)) for size in sorted(lengths)])).alias("keyword"))
    # whether it is the whole text, instead of the text itself, goes on into the join
    grams = grams.select(id_col, "keyword", (F.length("keyword") == F.col("_n")).alias("_whole"))
    # lexicon side broadcast only under a measured bound; otherwise a shuffle hash join
    lex_side = F.broadcast(lex) if lex.count() <= LEXICON_BROADCAST_ROWS else lex
    # a keyword counts once per text: de-duplicate the (small) matched set
    hits = grams.join(lex_side, "keyword").dropDuplicates([id_col, "intent", "keyword"])
    return hits.groupBy(id_col, "intent", "intent_ord").agg(F.sum(F.when(F.col("_whole"), 10).otherwise(1)).alias("score"))


def routing_profile(routed: DataFrame) -> DataFrame:
    """Questions per intent x method with share in percent (2 decimals)."""
    g = routed.groupBy("intent", "method", "skip_rag").agg(F.count(F.lit(1)).alias("n"))
    # the grouped table has at most (#intents x #methods) rows
    total = F.sum("n").over(Window.partitionBy())
    return g.withColumn("share_pct", pct2(F.col("n"), total))


def router_settings(spark: SparkSession, rules=None, keywords=None) -> DataFrame:
    """A12 (static part): number of rule intents, keyword count, known intents."""
    rules = rules or L.INTENT_RULES
    keywords = keywords or L.INTENT_KEYWORDS
    intents = sorted(set(rules) | set(keywords))
    return spark.createDataFrame([(len(rules), sum(len(v) for v in keywords.values()), intents)],
                                 "rules_count int, keywords_count int, intents array<string>")
