"""J2 by Aho-Corasick against the substring join and plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from ragloom.operators import automaton, route
from ragloom.plans import catalog as C
from ragloom.sources.labelled import lexicon_tables

from .conftest import SF_SMALL


def rows(df):
    return sorted((str(r["qid"]), r["intent"], r["score"]) for r in df.collect())


def test_equals_the_substring_join_on_user_turns(spark):
    turns = C._user_turns(spark, SF_SMALL).withColumn("qid", F.struct("conv_id", "turn"))
    lex = lexicon_tables(spark)["keywords"]
    got = rows(route.keyword_join(turns, lex))
    assert got and got == rows(route.keyword_join(turns, lex, strategy="substrings"))


def plain(texts, lexicon):
    out = []
    for i, t in texts:
        score = {}
        for intent, order, k in set(lexicon):
            if k and t and k in t:
                score[intent, order] = score.get((intent, order), 0) + (10 if k == t else 1)
        out += [(i, intent, order, s) for (intent, order), s in score.items()]
    return sorted(out)


@pytest.mark.parametrize("part_chars", [1 << 20, 40])
def test_scores_against_plain_search(spark, part_chars):
    r = random.Random(1)
    words = ["".join(r.choices("abé漢", k=r.randint(1, 4))) for _ in range(60)] + [""]
    lexicon = [(f"i{k % 3}", k % 3, w) for k, w in enumerate(words)] + [("i0", 0, words[5]), ("i1", 1, words[5])]
    texts = [(k, "".join(r.choices("abé漢 ", k=r.randint(0, 12)))) for k in range(80)] + [(900, None), (901, words[3]), (902, "")]
    df = spark.createDataFrame(texts, "doc long, body string").repartition(3)
    lex = spark.createDataFrame(lexicon, "intent string, intent_ord int, keyword string")
    got = automaton.keyword_scores(df, lex, "doc", "body", part_chars=part_chars)
    assert sorted(map(tuple, got.collect())) == plain(texts, lexicon)


def test_many_occurrences_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "ab" * 200_000)], "doc long, body string")
    lex = spark.createDataFrame([("x", 0, "ab"), ("x", 0, "ba"), ("y", 1, "aa")], "intent string, intent_ord int, keyword string")
    assert [tuple(r) for r in automaton.keyword_scores(df, lex, "doc", "body").collect()] == [(1, "x", 0, 2)]
    assert automaton.keyword_scores(df, lex.where("false"), "doc", "body").count() == 0
    assert automaton.keyword_scores(df.where("false"), lex, "doc", "body").count() == 0
