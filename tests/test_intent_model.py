"""Classifier split, metrics and model."""

import random
from collections import Counter

from pyspark.sql import functions as F

from ragloom.operators import intent_model as im


def test_stratified_split_exact_and_repeatable(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"c{i % 5}") for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, label string")
    a = {r["id"]: r["is_test"] for r in im.stratified_split(df, "label", "id", 0.2, 42).collect()}
    b = {r["id"]: r["is_test"] for r in im.stratified_split(df, "label", "id", 0.2, 42).collect()}
    assert a == b and len(a) == 3000
    n = Counter(l for _, l in rows)
    t = Counter(l for i, l in rows if a[i])
    assert all(t[c] == round(n[c] * 0.2) for c in n)


def test_classification_report_matches_definition(spark):
    rnd = random.Random(3)
    pairs = [(rnd.choice("abc"), rnd.choice("abcd")) for _ in range(200)]
    df = spark.createDataFrame(pairs, "e string, p string")
    got = {r["label"]: r for r in im.classification_report(df, "e", "p").collect()}
    labels = sorted(set(e for e, _ in pairs) | set(p for _, p in pairs))
    f1s, ps, rs = [], [], []
    for c in labels:
        tp = sum(1 for e, p in pairs if e == c and p == c)
        sup = sum(1 for e, _ in pairs if e == c)
        pred = sum(1 for _, p in pairs if p == c)
        prec = tp / pred if pred else 0.0
        rec = tp / sup if sup else 0.0
        f1 = 2 * prec * rec / (prec + rec) if prec + rec else 0.0
        assert abs(got[c]["precision"] - prec) < 1e-12 and abs(got[c]["recall"] - rec) < 1e-12
        assert abs(got[c]["f1"] - f1) < 1e-12 and got[c]["support"] == sup
        f1s.append(f1)
    assert abs(got["macro avg"]["f1"] - sum(f1s) / len(f1s)) < 1e-12
    acc = sum(1 for e, p in pairs if e == p) / len(pairs)
    assert abs(got["accuracy"]["precision"] - acc) < 1e-12


def test_model_learns_separable_classes(spark):
    rnd = random.Random(5)
    rows = []
    for i in range(300):
        c = i % 3
        v = [rnd.gauss(0, 0.1) for _ in range(4)]
        v[c] += 2.0
        rows.append((i, c, v))
    df = spark.createDataFrame(rows, "id long, label int, embedding array<double>")
    split = im.stratified_split(df, "label", "id", 0.2, 42)
    model = im.train_intent_model(split.filter(~F.col("is_test")), max_iter=50)
    pred = im.classify(model, split.filter("is_test"), class_names=["x", "y", "z"])
    acc = im.accuracy(pred, "label", "predicted").first()["accuracy"]
    assert acc > 0.95
    r = pred.select(im.top_probabilities(F.col("probabilities"), 3).alias("t"), "confidence").first()
    assert len(r["t"]) == 3 and abs(sum(e["value"] for e in r["t"]) - 1.0) < 1e-9
    assert abs(r["t"][0]["value"] - r["confidence"]) < 1e-12


def test_report_agrees_with_mllib_metrics(spark):
    from pyspark.mllib.evaluation import MulticlassMetrics
    rnd = random.Random(9)
    pairs = [(float(rnd.randrange(3)), float(rnd.randrange(3))) for _ in range(300)]
    df = spark.createDataFrame(pairs, "e double, p double")
    rep = {r["label"]: r for r in im.classification_report(
        df.selectExpr("cast(cast(e as int) as string) as e", "cast(cast(p as int) as string) as p"), "e", "p").collect()}
    m = MulticlassMetrics(spark.sparkContext.parallelize([(p, e) for e, p in pairs]))
    for c in ("0", "1", "2"):
        assert abs(rep[c]["precision"] - m.precision(float(c))) < 1e-12
        assert abs(rep[c]["recall"] - m.recall(float(c))) < 1e-12
        assert abs(rep[c]["f1"] - m.fMeasure(float(c))) < 1e-12
    assert abs(rep["accuracy"]["precision"] - m.accuracy) < 1e-12
    assert abs(rep["weighted avg"]["f1"] - m.weightedFMeasure()) < 1e-12
