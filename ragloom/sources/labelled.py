"""Labelled text files, lexicon tables and report/model sinks.

* S9: JSON objects ``{intent: [text, ...]}`` read whole, parsed with
  ``from_json`` to ``map<string,array<string>>`` and exploded twice; only
  known intents are kept (left-semi join with the class table); missing
  files are skipped; an empty result is an error.
* S10: case files with named groups of ``{text, expected_intent,
  description}``; every group present is exploded and unioned with its
  group name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicon as L

def path_exists(spark: SparkSession, path: str) -> bool:
    """Asked of the store that holds the path, not of the driver's disk."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


CASE_GROUPS = ("test_cases", "edge_cases", "mixed_language")
CASE_STRUCT = "array<struct<text:string,expected_intent:string,description:string>>"


def read_labelled_utterances(spark: SparkSession, files: list[str],
                             classes: list[str] | None = None) -> DataFrame:
    """S9 + F7: (intent, text, source) rows of known intents."""
    present = [f for f in files if path_exists(spark, f)]
    if not present:
        raise ValueError("no training file found")
    raw = spark.read.option("wholetext", True).text(present).withColumn("source", F.input_file_name())
    parsed = raw.select("source", F.from_json("value", "map<string,array<string>>").alias("m"))
    rows = (parsed.select("source", F.explode("m").alias("intent", "texts"))
            .select("intent", F.explode("texts").alias("text"), "source"))
    known = spark.createDataFrame([(c,) for c in (classes or L.INTENT_CLASSES)], "intent string")
    out = rows.join(F.broadcast(known), "intent", "left_semi")  # class list: fixed, small
    if out.limit(1).count() == 0:
        raise ValueError("no labelled rows of a known intent")
    return out


def read_intent_cases(spark: SparkSession, path: str) -> DataFrame:
    """S10 + O4: (group, text, expected_intent, description) of all present groups."""
    # with a schema the fields are taken by name, in whatever order the files hold them
    raw = spark.read.schema(", ".join(f"{g} {CASE_STRUCT}" for g in CASE_GROUPS)).option("multiLine", True).json(path)
    present = raw.agg(*[F.count(g).alias(g) for g in CASE_GROUPS]).first()
    parts = [raw.select(F.lit(g).alias("group"), F.inline(g)) for g in CASE_GROUPS if present[g]]
    if not parts:
        raise ValueError("no case group found")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def lexicon_tables(spark: SparkSession) -> dict[str, DataFrame]:
    """The fixed lexicons as small tables."""
    return {
        "rules": spark.createDataFrame(L.rule_rows(), "intent string, intent_ord int, pattern string, pattern_ord int"),
        "keywords": spark.createDataFrame(L.keyword_rows(), "intent string, intent_ord int, keyword string, keyword_ord int"),
        "blocklist": spark.createDataFrame([(k, i) for i, k in enumerate(L.BLOCKED_KEYWORDS)], "keyword string, ord int"),
        "policies": spark.createDataFrame(L.INTENT_POLICIES, "intent string, skip_rag boolean, response string"),
        "spam": spark.createDataFrame([(k, i) for i, k in enumerate(L.SPAM_KEYWORDS)], "keyword string, ord int"),
    }


def write_eval_report(per_case: DataFrame, hits: DataFrame, path: str, top: int = 5,
                      preview_chars: int = 150) -> None:
    """Per case the scores plus the top hits with a short preview, as JSON; the number of
    cases and the overall means next to it (``<path>_summary``)."""
    from ..functions.text import preview
    top_hits = (hits.filter(F.col("rank") <= top)
                .select("qid", F.struct("rank", "chunk_id", "similarity",
                                        preview("text", preview_chars).alias("preview")).alias("h"))
                .groupBy("qid").agg(F.array_sort(F.collect_list("h")).alias("top_hits")))  # <= top per case
    per_case.join(top_hits, "qid", "left").write.mode("overwrite").json(path)
    means = [F.avg(c).alias(f"avg_{c}") for c in ("score", "max_similarity", "avg_similarity") if c in per_case.columns]
    per_case.agg(F.count(F.lit(1)).alias("cases"), *means).write.mode("overwrite").json(f"{path.rstrip('/')}_summary")
