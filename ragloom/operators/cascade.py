"""The whole routing cascade: rules, keywords, then the trained model on what they left open."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as L
from . import embed as embed_ops
from . import intent_model as im
from . import route as route_ops


def train_on_texts(labelled: DataFrame, text_col: str = "text", intent_col: str = "intent", classes: list[str] | None = None,
                   embedder_factory=None, max_iter: int = 1000) -> PipelineModel:
    """S9 rows -> P8 vectors -> M1, with the label codes of M3; rows of other intents are left out."""
    labels = im.label_index(labelled.sparkSession, classes)
    rows = labelled.select(F.col(intent_col).alias("intent"), F.col(text_col).alias("_t")).where("_t is not null")
    coded = rows.join(F.broadcast(labels), "intent")  # as many rows as classes
    vectors = embed_ops.embed(coded, "_t", "_vec", embedder_factory).select("_vec", "label").checkpoint(eager=True)
    return im.train_intent_model(vectors, "_vec", "label", max_iter=max_iter)


def route_with_model(questions: DataFrame, model: PipelineModel, text_col: str = "text", classes: list[str] | None = None,
                     embedder_factory=None, min_confidence: float = L.ML_MIN_CONFIDENCE) -> DataFrame:
    """C1 with the model stage: only questions that rules and keywords leave open are embedded and classified.

    The model's answer counts from ``min_confidence`` on and unless it is
    ``knowledge``; other open questions keep the default.
    """
    columns = questions.columns
    first = route_ops.route_questions(questions, text_col).checkpoint(eager=True)
    open_ = first.where("method = 'default'").select(*columns)
    scored = im.classify(model, embed_ops.embed(open_, text_col, "_vec", embedder_factory), "_vec", classes or L.INTENT_CLASSES)
    scored = scored.select(*columns, F.col("intent").alias("_model_intent"), F.col("confidence").alias("_model_conf"))
    second = route_ops.route_questions(scored, text_col, model_intent="_model_intent", model_conf="_model_conf",
                                       min_confidence=min_confidence).drop("_model_intent", "_model_conf")
    return first.where("method <> 'default'").unionByName(second)
