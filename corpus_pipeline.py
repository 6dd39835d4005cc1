"""The corpus pipeline: five stages over ``documents``, each one operator of ``ragloom.llm``.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir)
and returns a DataFrame, which is written as Parquet and read again as the
next stage's ``docs``. All stages but the last return the columns of
``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragloom.llm import decontaminate, language_id, mixing, simhash
from ragloom.llm.common import input_table, remove, scratch
from ragloom.llm.queries import token_rows


#: A document goes if no learned language is at least as likely as all others together.
LEAST_SCORE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents whose language cannot be told: null text, no letter in it, or no prediction of LEAST_SCORE.

    Repeated rows are judged alike; an empty table, or one without a labelled
    text to learn from, gives no rows. A column ``__language`` would be replaced.
    """
    found = language_id.identify(docs, out="__language")
    told = (F.col("__language.lang_pred") != language_id.UNKNOWN) & (F.col("__language.score") >= LEAST_SCORE)
    return found.where(told).drop("__language")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep of each SimHash component the document with the smallest id; of repeated rows one, null ids last."""
    return simhash.keep_one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a twentieth or more of benchmark words; null and empty texts hold none.

    Without a benchmark all stay. A column ``__hits`` would be replaced.
    """
    found = decontaminate.with_hits(docs, input_table(spark, sf_dir, "benchmark"), out="__hits")
    return found.where(~F.col("__hits.contaminated")).drop("__hits")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take every document as often as the mix asks: repeated, once, or not at all; texts without a word as often as their source's epochs."""
    return mixing.mixed(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write the mix as token files and return what is read back from them; a null text holds the end id alone."""
    return token_rows(spark, docs)


STAGES = [
    ("language_id", identify_language),
    ("simhash_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mix", mix_sources),
    ("token_files", write_tokens),
]

#: Code lengths of the language stage and fingerprint components are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; a stage's input is deleted when its output is written."""
    docs, before = input_table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        path = scratch(spark, f"pipeline-{k}-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            remove(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
