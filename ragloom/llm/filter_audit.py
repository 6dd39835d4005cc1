"""Filter interaction audit by the Hart-Mas-Colell potential of the removal game.

Every document fails a set of filters. A coalition S of filters removes
v(S) documents: those that fail any filter of S. The potential is the
recursion P(S) = (v(S) + sum of P(S without i) over i in S) / |S|, P of
nothing is 0, and the Shapley value of i is P(all) - P(all without i). The
values of v at the 32 coalitions also give every step of every order: a
filter applied after the coalition S removes v(S and it) - v(S).

Spark counts documents by part and set of failed filters; the recursion runs
on 32 numbers a part. n! P(S) is an integer, so nothing is rounded.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragloom.llm.common import cut, prepare

NAMES = "ABCDE"
SPACE = " \t\n\x0b\f\r"
WORD_BREAK = r"[\x20\x09-\x0D]+"
LEAST_WORDS = 200
#: What is counted of every set of failed filters.
COUNTS = ("n", "good", "toxic")


def text_failures(text: Column) -> list[Column]:
    """Failure conditions of the filters that see one text: A too short, B repetitive, C capitals, D signs."""
    trimmed = F.btrim(text, F.lit(SPACE))

    def of_words(w: Column) -> Column:
        n = F.when(trimmed == "", 0).otherwise(F.size(w)).cast("long")
        distinct = F.when(trimmed == "", 0).otherwise(F.size(F.array_distinct(w)))
        return F.struct((n < LEAST_WORDS).alias("a"), (100 * distinct.cast("long") < 50 * n).alias("b"))

    words = F.element_at(F.transform(F.array(F.split(trimmed, WORD_BREAK)), of_words), 1)  # split once for both
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return [words["a"], words["b"], 100 * capitals.cast("long") > 3 * F.length(text), text.rlike(r"[#$%&*|]")]


def potentials(v: np.ndarray) -> np.ndarray:
    """n! times the potential of every coalition, from ``v`` (games in rows, coalitions as bit sets in columns)."""
    n = v.shape[1].bit_length() - 1
    p = np.zeros_like(v)
    for s in sorted(range(1, 1 << n), key=int.bit_count):
        inside = [i for i in range(n) if s >> i & 1]
        p[:, s] = (factorial(n) * v[:, s] + sum(p[:, s ^ 1 << i] for i in inside)) // len(inside)
    return p


def removed(counts: np.ndarray) -> np.ndarray:
    """v(S) of every coalition from counts by set of failed filters."""
    size = counts.shape[1]
    return np.stack([counts[:, [m for m in range(size) if m & s]].sum(axis=1) for s in range(size)], axis=1)


def steps(part: pd.Series, counts: dict[str, np.ndarray], names: str = NAMES) -> Iterator[pd.DataFrame]:
    """Rows of every order and step, for all parts at a time."""
    n, total = len(names), counts["n"].sum(axis=1)
    v = {c: removed(x) for c, x in counts.items()}
    everyone = (1 << n) - 1
    p = potentials(v["n"])
    for order in permutations(range(n)):
        before = 0
        for at, f in enumerate(order):
            after, gone = before | 1 << f, {}
            for c in COUNTS:
                gone[c] = v[c][:, after] - v[c][:, before]
            yield pd.DataFrame({
                "part": part, "filter_order": "".join(names[i] for i in order), "step": at + 1,
                "kept": total - v["n"][:, after], "removed": gone["n"], "redundant": v["n"][:, 1 << f] - gone["n"],
                "unique_fails": v["n"][:, everyone] - v["n"][:, everyone ^ 1 << f], "good_lost": gone["good"], "toxic_lost": gone["toxic"],
                "shapley": p[:, everyone] - p[:, everyone ^ 1 << f]})
            before = after


RESULT = ("part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
          "good_lost long, toxic_lost long, shapley long")


def audit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """One row per part, order of the five filters and step (RESULT).

    Null texts are empty, a null part is the empty string. Filter E fails a
    document if any smaller id has its text anywhere in the table; a null id
    is neither smaller nor greater and never fails, rows of one id do not
    fail for each other. Repeated rows are documents each. A document is good
    (toxic) if any label row of its id says 1; null or missing labels are
    neither. Other columns are ignored. No documents: no rows.

    Texts are read once and not shuffled: rows of id, digest and failures
    are, counted before they are shuffled, and joined by (digest, id), so
    that no text that many documents share meets in one task.
    """
    prepare(docs.sparkSession)
    whole = docs.select(F.col(doc_id).cast("long").alias("i"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
                        F.coalesce(F.col(text), F.lit("")).alias("t"))
    fails = text_failures(F.col("t"))
    mask = sum((f.cast("int") * (1 << k) for k, f in enumerate(fails)), F.lit(0))
    rows = whole.select("i", "part", F.unhex(F.sha2("t", 256)).alias("h"), mask.alias("m")).groupBy("h", "i", "part", "m").agg(F.count(F.lit(1)).alias("n"))
    one = labels.select(F.col("doc_id").cast("long").alias("i"), *[F.coalesce((F.col(c) == 1), F.lit(False)).alias(c) for c in ("quality", "toxic")])
    one = one.where("i is not null").groupBy("i").agg(F.max("quality").alias("good"), F.max("toxic").alias("toxic"))
    rows = cut(rows.join(one, "i", "left").select("h", "i", "part", "m", "n", *[F.coalesce(c, F.lit(False)).alias(c) for c in COUNTS[1:]]))
    least = rows.groupBy("h").agg(F.min("i").alias("i"))
    firsts = rows.join(least, ["h", "i"]).select(*rows.columns).union(rows.where("i is null"))

    def counted(df: DataFrame, m: Column, sign: int) -> DataFrame:
        return df.groupBy("part", m.alias("m")).agg(
            (sign * F.sum("n")).alias("n"), *[(sign * F.sum(F.when(F.col(c), F.col("n")).otherwise(0))).alias(c) for c in COUNTS[1:]])

    copy = F.col("m") + F.lit(1 << 4)
    # all rows fail E but the first of their text, so those are taken off again and counted without it
    by_set = counted(rows, copy, 1).union(counted(firsts, copy, -1)).union(counted(firsts, F.col("m"), 1))
    by_part = by_set.groupBy("part").agg(*[
        F.array(*[F.sum(F.when(F.col("m") == s, F.col(c)).otherwise(0)) for s in range(1 << len(NAMES))]).alias(c) for c in COUNTS])

    def spell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 256):
                some = b.iloc[at:at + 256].reset_index(drop=True)
                yield pd.concat(steps(some["part"], {c: np.stack(some[c].to_numpy()).astype(np.int64) for c in COUNTS}))

    return by_part.mapInPandas(spell, RESULT)
