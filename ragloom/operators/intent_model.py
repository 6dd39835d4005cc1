"""Trainable classifier and its metrics.

* W8 ``stratified_split``: exact per-class hold-out. Rows are ordered inside
  their class by a seeded hash; the rank is a segmented running count over
  hash buckets, so even a class holding a third of all rows is ranked by
  many tasks. Disjoint, complete and repeatable.
* M1 ``train_intent_model``: one-vs-rest logistic regression on embedding
  vectors (MLlib), L2 strength ``C=1`` expressed as ``regParam = 1/n``.
* M2 ``classify``: per-class margins -> sigmoid -> normalised to sum 1,
  computed with column expressions over ``vector_to_array(rawPrediction)``.
* A7/A8: accuracy and the per-class report from one small confusion table.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, OneVsRest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicon as L
from .traffic import running_sum

HASH_BUCKETS = 1024
CLASS_BROADCAST_ROWS = 100_000


def stratified_split(df: DataFrame, label_col: str, key_col: str, test_fraction: float = 0.2,
                     seed: int = 42) -> DataFrame:
    """Adds ``is_test``; per class the first round(frac * n) rows by seeded hash."""
    h = F.xxhash64(F.col(key_col), F.lit(seed))
    staged = (df.withColumn("_h", h)
              .withColumn("_hb", F.pmod(F.col("_h"), F.lit(HASH_BUCKETS)))
              .withColumn("_one", F.lit(1).cast("long")))
    # order inside a class by (bucket, hash, key): buckets are monotone in that order
    ranked = running_sum(staged, "_one", [F.col("_hb"), F.col("_h"), F.col(key_col)], "_hb",
                         [label_col], out="_rank")
    sizes = df.groupBy(label_col).agg(F.count(F.lit(1)).alias("_n"))
    # one row per class: broadcast (measured) so the ranked rows never shuffle by label,
    # which would put a hot class into one task
    if sizes.count() <= CLASS_BROADCAST_ROWS:
        sizes = F.broadcast(sizes)
    out = ranked.join(sizes, label_col)
    return (out.withColumn("is_test", F.col("_rank") <= F.round(F.col("_n") * test_fraction))
            .drop("_h", "_hb", "_one", "_rank", "_n"))


def train_intent_model(train: DataFrame, vec_col: str = "embedding", label_col: str = "label",
                       max_iter: int = 1000, c: float = 1.0, parallelism: int = 10) -> PipelineModel:
    """M1: one-vs-rest logistic regression on (vector, numeric label), at most
    ``max_iter`` iterations (training stops earlier on convergence)."""
    n = train.count()
    lr = LogisticRegression(maxIter=max_iter, regParam=1.0 / (c * max(n, 1)), elasticNetParam=0.0,
                            standardization=False, featuresCol="_features", labelCol="_label")
    ovr = OneVsRest(classifier=lr, featuresCol="_features", labelCol="_label", parallelism=parallelism)
    prep = train.withColumn("_features", array_to_vector(F.col(vec_col))) \
                .withColumn("_label", F.col(label_col).cast("double"))
    return Pipeline(stages=[ovr]).fit(prep)


def classify(model: PipelineModel, df: DataFrame, vec_col: str = "embedding",
             class_names: list[str] | None = None) -> DataFrame:
    """M2: adds predicted (index), intent (name), confidence, probabilities map."""
    scored = model.transform(df.withColumn("_features", array_to_vector(F.col(vec_col))))
    raw = vector_to_array("rawPrediction")
    n_classes = len(model.stages[-1].models)  # as many as the model was trained on
    names = [*(class_names or [])[:n_classes], *[str(i) for i in range(len(class_names or []), n_classes)]]
    sig = [F.lit(1.0) / (F.lit(1.0) + F.exp(-raw[i])) for i in range(n_classes)]
    total = sig[0]
    for s in sig[1:]:
        total = total + s
    probs = [s / total for s in sig]
    pmap = F.map_from_arrays(F.array(*[F.lit(nm) for nm in names]), F.array(*probs))
    pred = F.col("prediction").cast("int")
    return (scored.withColumn("probabilities", pmap)
            .withColumn("predicted", pred)
            .withColumn("intent", F.element_at(F.array(*[F.lit(nm) for nm in names]), pred + 1))
            .withColumn("confidence", F.array_max(F.array(*probs)))
            .drop("_features", "rawPrediction", "probability", "prediction"))


def top_probabilities(probs: Column, n: int = 3) -> Column:
    """The n most likely (label, probability) entries, probability desc then label."""
    def cmp(a, b):
        return (F.when(a["value"] > b["value"], -1).when(a["value"] < b["value"], 1)
                .when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))
    return F.slice(F.array_sort(F.map_entries(probs), cmp), 1, n)


def accuracy(df: DataFrame, expected: str, predicted: str) -> DataFrame:
    """Correct / total (0 when empty)."""
    return df.agg(F.count(F.lit(1)).alias("total"),
                  F.sum((F.col(expected) == F.col(predicted)).cast("long")).alias("correct")) \
             .withColumn("accuracy", F.when(F.col("total") > 0, F.col("correct") / F.col("total"))
                         .otherwise(F.lit(0.0)))


def classification_report(df: DataFrame, expected: str, predicted: str) -> DataFrame:
    """Per class precision / recall / f1 / support, then macro avg, weighted avg
    and accuracy rows (label string). Built from one (expected, predicted) count table,
    whose size is bounded by classes squared."""
    conf = (df.select(F.col(expected).cast("string").alias("e"), F.col(predicted).cast("string").alias("p"))
            .groupBy("e", "p").agg(F.count(F.lit(1)).alias("n")))
    # the report reads the confusion table in four branches; compute the predictions once
    conf = conf.checkpoint(eager=True)
    support = conf.groupBy(F.col("e").alias("label")).agg(F.sum("n").alias("support"))
    pred_n = conf.groupBy(F.col("p").alias("label")).agg(F.sum("n").alias("pred"))
    tp = conf.filter(F.col("e") == F.col("p")).select(F.col("e").alias("label"), F.col("n").alias("tp"))
    per = (support.join(pred_n, "label", "full").join(tp, "label", "left")
           .fillna(0, ["support", "pred", "tp"]))
    p = F.when(F.col("pred") > 0, F.col("tp") / F.col("pred")).otherwise(F.lit(0.0))
    r = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(F.lit(0.0))
    per = per.withColumn("precision", p).withColumn("recall", r)
    per = per.withColumn("f1", F.when((F.col("precision") + F.col("recall")) > 0,
                                      2 * F.col("precision") * F.col("recall")
                                      / (F.col("precision") + F.col("recall"))).otherwise(F.lit(0.0)))
    per = per.select("label", "precision", "recall", "f1", F.col("support").cast("long").alias("support"),
                     F.col("tp"))
    agg = per.agg(F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1").alias("mf"),
                  F.sum("support").alias("s"), F.sum("tp").alias("t"),
                  F.sum(F.col("precision") * F.col("support")).alias("wp"),
                  F.sum(F.col("recall") * F.col("support")).alias("wr"),
                  F.sum(F.col("f1") * F.col("support")).alias("wf"))
    macro = agg.select(F.lit("macro avg").alias("label"), F.col("mp").alias("precision"),
                       F.col("mr").alias("recall"), F.col("mf").alias("f1"), F.col("s").cast("long").alias("support"))
    w = F.col("s")
    weighted = agg.select(F.lit("weighted avg").alias("label"),
                          F.when(w > 0, F.col("wp") / w).otherwise(0.0).alias("precision"),
                          F.when(w > 0, F.col("wr") / w).otherwise(0.0).alias("recall"),
                          F.when(w > 0, F.col("wf") / w).otherwise(0.0).alias("f1"),
                          F.col("s").cast("long").alias("support"))
    acc = agg.select(F.lit("accuracy").alias("label"),
                     F.when(w > 0, F.col("t") / w).otherwise(0.0).alias("precision"),
                     F.when(w > 0, F.col("t") / w).otherwise(0.0).alias("recall"),
                     F.when(w > 0, F.col("t") / w).otherwise(0.0).alias("f1"),
                     F.col("s").cast("long").alias("support"))
    return per.drop("tp").unionByName(macro).unionByName(weighted).unionByName(acc)


def label_index(spark: SparkSession, classes: list[str] | None = None) -> DataFrame:
    """M3: fixed class order (not frequency order)."""
    classes = classes or L.INTENT_CLASSES
    return spark.createDataFrame([(c, i) for i, c in enumerate(classes)], "intent string, label int")


def save_model(model: PipelineModel, path: str, spark: SparkSession, classes: list[str]) -> None:
    """Model plus its label and policy tables next to it."""
    model.write().overwrite().save(f"{path}/model")
    label_index(spark, classes).write.mode("overwrite").parquet(f"{path}/labels")
    spark.createDataFrame(L.INTENT_POLICIES, "intent string, skip_rag boolean, response string") \
        .write.mode("overwrite").parquet(f"{path}/policies")


def load_policies(path: str, spark: SparkSession) -> DataFrame:
    """The policies that were saved with the model."""
    return spark.read.parquet(f"{path}/policies")


def load_model(path: str, spark: SparkSession) -> tuple[PipelineModel, list[str]]:
    model = PipelineModel.load(f"{path}/model")
    labels = [r["intent"] for r in spark.read.parquet(f"{path}/labels").orderBy("label").collect()]
    return model, labels
