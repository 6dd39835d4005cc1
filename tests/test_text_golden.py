"""Golden rows for the text operators (FIXTURES.md section 2)."""

from pyspark.sql import functions as F

from ragloom.functions import lexicon as L
from ragloom.functions.text import clean_query, compression_ratio, normalise_line, split_sentences
from ragloom.operators import clean, route, validate


def one(spark, col_expr, value, schema="t string"):
    return spark.createDataFrame([(value,)], schema).select(col_expr.alias("r")).first()["r"]


def test_cleaning_reasons_and_join(spark):
    long_a = "a" * 60
    long_b = "b" * 55
    text = "\n".join(["x" * 10, "  ", "HTTPS://X " + "y" * 50, "www." + "z" * 6, long_a, long_b])
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    r = clean.clean_documents(df).first()
    assert r["clean_text"] == long_a + "\n\n" + long_b
    assert (r["total_lines"], r["removed_lines"]) == (6, 4)
    assert (r["empty_lines"], r["spam_lines"], r["short_lines"]) == (1, 2, 1)


def test_unicode_whitespace_collapses(spark):
    assert one(spark, normalise_line(F.col("t")), "　 a　　b\t c  ") == "a b c"


def test_min_length_zero_means_zero(spark):
    df = spark.createDataFrame([(1, "ab\ncd")], "doc_id long, text string")
    assert clean.clean_documents(df, min_length=0).first()["clean_text"] == "ab\n\ncd"


def test_clean_is_idempotent(spark):
    df = spark.createDataFrame([(1, "  " + "q " * 40 + "\n\n" + "w" * 70 + "  ")], "doc_id long, text string")
    once = clean.clean_documents(df).first()["clean_text"]
    df2 = spark.createDataFrame([(1, once)], "doc_id long, text string")
    assert clean.clean_documents(df2).first()["clean_text"] == once


def test_query_cleanup(spark):
    assert one(spark, clean_query(F.col("t")), "1. 狗\n2) 猫") == "狗 猫"
    assert one(spark, clean_query(F.col("t")), "a" * 60) == "a" * 50


def test_split_sentences(spark):
    r = one(spark, split_sentences(F.col("t")), "第一句话很长。短。\n第三句话也很长！第四句话很长吗？")
    assert r == ["第一句话很长", "第三句话也很长", "第四句话很长吗"]


def test_validation_golden(spark):
    rows = [(1, "   "), (2, "a" * 101), (3, "a" * 100 + "model"), (4, "resource 怎么用"),
            (5, "api server"), (6, "server"), (7, "knowledge of content")]
    df = spark.createDataFrame(rows, "id long, text string")
    out = {r["id"]: r for r in validate.validate_questions(df).collect()}
    assert not out[1]["ok"] and out[1]["error"] == L.MSG_EMPTY
    assert out[2]["ok"] and out[2]["text"] == "a" * 100
    assert out[3]["ok"]
    assert not out[4]["ok"] and out[4]["reason"] == "blocked_keyword"
    assert not out[5]["ok"] and out[5]["reason"] == "tech_terms"
    assert out[6]["ok"]
    assert not out[7]["ok"] and out[7]["reason"] == "system_probe"


def test_validation_reject_mode(spark):
    df = spark.createDataFrame([(1, "a" * 101)], "id long, text string")
    r = validate.validate_questions(df, truncate=False).first()
    assert not r["ok"] and "101" in r["error"] and "100" in r["error"]


def test_routing_golden(spark):
    rows = [(1, "你好"), (2, "hello 你好"), (3, "狗狗需要每天遛吗"), (4, "这个狗狗怎么喂"),
            (5, "chihuahua 吃什么"), (6, "今天天气怎么样")]
    df = spark.createDataFrame(rows, "id long, text string")
    out = {r["id"]: (r["intent"], r["confidence"], r["method"]) for r in route.route_questions(df).collect()}
    assert out[1] == ("greeting", 1.0, "rule")
    assert out[2] == ("greeting", 0.9, "keyword")
    assert out[3] == ("knowledge", 0.5, "default")
    assert out[4] == ("unknown", 0.9, "keyword")
    assert out[5] == ("greeting", 0.9, "keyword")
    assert out[6] == ("knowledge", 0.5, "default")


def test_routing_model_gate(spark):
    rows = [(1, "狗狗需要每天遛吗", "chitchat", 0.8), (2, "狗狗需要每天遛吗", "chitchat", 0.6),
            (3, "狗狗需要每天遛吗", "knowledge", 0.99)]
    df = spark.createDataFrame(rows, "id long, text string, mi string, mc double")
    out = {r["id"]: (r["intent"], r["method"], r["skip_rag"])
           for r in route.route_questions(df, model_intent="mi", model_conf="mc").collect()}
    assert out[1] == ("chitchat", "ml", True)
    assert out[2] == ("knowledge", "default", False)
    assert out[3] == ("knowledge", "default", False)


def test_search_form_equivalence():
    assert route.search_form(".*(a|b).*") == "(a|b)"
    assert route.search_form("^(a)$") == "^(a)$"


def test_keyword_join_matches_expression(spark):
    # "hi" inside "hit" is a hit: substring semantics are kept on purpose
    rows = [(1, "hello 你好"), (2, "这个狗狗怎么喂"), (3, "no hit here"), (4, "xyz"), (5, "谢谢 bye")]
    df = spark.createDataFrame(rows, "qid long, text string")
    lex = spark.createDataFrame(L.keyword_rows(), "intent string, intent_ord int, keyword string, keyword_ord int")
    j = {r["qid"]: r["intent"] for r in route.keyword_join(df, lex).collect()}
    assert j == {1: "greeting", 2: "unknown", 3: "greeting", 5: "politeness"}
    e = {r["qid"]: r["k"] for r in df.select("qid", route.keyword_intent(route.routing_text(F.col("text"))).alias("k")).collect()}
    assert {q: i for q, i in e.items() if i is not None} == j


def test_compression_ratio_numbers(spark):
    df = spark.createDataFrame([(843, 187), (756, 201), (1599, 388), (0, 0)], "b long, a long")
    got = [round(r[0], 1) for r in df.select(compression_ratio("b", "a")).collect()]
    assert got == [77.8, 73.4, 75.7, 0.0]


def test_static_profiles(spark):
    f = validate.filter_settings(spark).first()
    assert f["blocked_keywords_count"] == 36 and f["blocked_keywords"][0] == "系统提示词"
    r = route.router_settings(spark).first()
    assert (r["rules_count"], r["keywords_count"]) == (4, 49)
    assert r["intents"] == ["greeting", "politeness", "system", "unknown"]
