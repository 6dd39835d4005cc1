"""Plug-in surfaces: query expansion generators (P7) and embedders."""

import numpy as np
import pandas as pd

from ragloom.operators import answer, embed


def test_expand_with_custom_generator(spark):
    df = spark.createDataFrame([(1, "狗狗吃什么"), (2, "猫咪")], "qid long, text string")

    def gen(s: pd.Series) -> pd.Series:  # receives the expansion prompts
        return s.map(lambda t: "1. 狗粮\n2) 营养 " if "用户问题：狗" in t else "   ")

    out = {r["qid"]: r["query"] for r in answer.expand_queries(df, generator=gen).collect()}
    assert out == {1: "狗粮 营养", 2: "猫咪"}  # cleaned (P6); blank -> original question


def test_expand_failure_and_disabled(spark):
    df = spark.createDataFrame([(1, "question one")], "qid long, text string")

    def broken(s):
        raise RuntimeError("generator down")

    assert answer.expand_queries(df, generator=broken).first()["query"] == "question one"
    assert answer.expand_queries(df, enabled=False).first()["query"] == "question one"
    assert answer.expand_queries(df).first()["query"] == "question one"  # default keywords


class ConstantEmbedder:
    dim = 3

    def embed(self, texts):
        return np.array([[len(t or ""), 1.0, 0.0] for t in texts])


def test_custom_embedder_factory(spark):
    df = spark.createDataFrame([("abc",), ("hello",)], "text string")
    rows = embed.embed(df, embedder_factory=ConstantEmbedder).orderBy("text").collect()
    assert [list(r["embedding"]) for r in rows] == [[3.0, 1.0, 0.0], [5.0, 1.0, 0.0]]
