"""Keyword matching in one pass a text (J2): an Aho-Corasick automaton in every task.

The lexicon is broadcast in parts of bounded size (one part for any usual
lexicon; keywords are dealt to parts by hash) and every worker builds a part's
automaton once. A text is read once a part, whatever the number of keywords;
what leaves a task is a row per text and intent, so nothing grows with the
number of occurrences.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of keywords of one part; a node of the automaton takes some 60 bytes.
PART_CHARS = 1 << 20
_BUILT: dict[str, ahocorasick.Automaton] = {}


def automaton_of(name: str, rows: list[tuple[str, list[tuple[str, int]]]]) -> ahocorasick.Automaton:
    """The worker's automaton of this part; one is kept."""
    if name not in _BUILT:
        _BUILT.clear()
        auto = ahocorasick.Automaton()
        for keyword, intents in rows:
            auto.add_word(keyword, (keyword, intents))
        if rows:
            auto.make_automaton()
        _BUILT[name] = auto
    return _BUILT[name]


def scores_of(auto: ahocorasick.Automaton, text: str, exact: int) -> dict[tuple[str, int], int]:
    """Per intent: 1 for every keyword in the text, ``exact`` for the one that is the text."""
    found: dict[tuple[str, int], int] = {}
    for keyword, intents in {k: i for _, (k, i) in auto.iter(text)}.items():
        for i in intents:
            found[i] = found.get(i, 0) + (exact if len(keyword) == len(text) else 1)
    return found


def keyword_scores(texts: DataFrame, lexicon: DataFrame, id_col: str, text_col: str, exact: int = 10,
                   part_chars: int = PART_CHARS) -> DataFrame:
    """(id, intent, intent_ord, score) for every text and intent with a keyword in the text.

    ``lexicon``: (intent, intent_ord, keyword), compared as it is; a keyword
    of several intents counts for each, a repeated one once, an empty one
    never. Null and empty texts match nothing. Ids may be of any type that
    groups; rows with equal ids add up.
    """
    spark = texts.sparkSession
    words = lexicon.where(F.length("keyword") > 0).groupBy("keyword").agg(
        F.sort_array(F.collect_set(F.struct("intent", "intent_ord"))).alias("intents"))
    parts = max(1, -(-(words.agg(F.sum(F.length("keyword"))).first()[0] or 0) // part_chars))
    dealt = words.withColumn("part", F.pmod(F.xxhash64("keyword"), F.lit(parts)))
    if parts > 1:
        dealt = dealt.checkpoint(eager=True)
    rows = texts.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).where("length(_t) > 0")
    schema = rows.select("_id", F.lit("").alias("intent"), F.lit(0).alias("intent_ord"), F.lit(0).cast("long").alias("score")).schema

    def matched(part: int) -> DataFrame:
        held = [(r["keyword"], [(i["intent"], i["intent_ord"]) for i in r["intents"]]) for r in dealt.where(F.col("part") == part).collect()]
        name, shared = uuid.uuid4().hex, spark.sparkContext.broadcast(held)

        def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            auto = automaton_of(name, shared.value)
            for b in batches:
                at, intents, orders, scores = [], [], [], []
                for k, text in enumerate(b.column(1).to_pylist() if len(auto) else ()):
                    for (intent, order), score in scores_of(auto, text, exact).items():
                        at.append(k)
                        intents.append(intent)
                        orders.append(order)
                        scores.append(score)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(intents, pa.string()),
                                                  pa.array(orders, pa.int32()), pa.array(scores, pa.int64())],
                                                 names=["_id", "intent", "intent_ord", "score"])

        return rows.mapInArrow(match, schema)

    found = reduce(DataFrame.unionByName, [matched(k) for k in range(parts)])
    return found.groupBy("_id", "intent", "intent_ord").agg(F.sum("score").alias("score")).withColumnRenamed("_id", id_col)
