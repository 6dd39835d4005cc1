"""Awkward inputs and plain re-statements of the operators."""

from __future__ import annotations

import random

import pandas as pd

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SYLLABLES = "an the on er in re ti es or ha en st nd ea is it of to".split()


def prose(seed: int, words: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choices(SYLLABLES, k=r.randint(1, 3))) for _ in range(words))


def awkward_rows() -> list[tuple]:
    a, b = prose(1, 80), prose(2, 80)
    rows = [
        (5, a, "en", "s1", 1), (7, a + " tail", "en", "s1", 2), (5, a, "en", "s1", 1),  # near copy, repeated row
        (9, b, "fr", None, None), (None, b, None, "s2", 3), (None, None, None, None, None),
        (11, None, "en", "s2", 0), (12, "", "en", "s2", 0), (13, " \t\n\x0b", None, "s2", 4),
        (14, "123 !?", "de", "s3", 6), (15, "Ünïcödé wörds — \U0001f600  x", "de", "s3", 6),
        (16, prose(3, 60_000), "en", "s3", 1), (17, "one two three", "es", "s1", 3), (18, "one two three", "es", "s1", 3),
        (19, "x" * 50_000, "en", "s4", 1), (20, "a\r\n\r\nb", "en", "s4", 1),
    ]
    rows += [(100 + k, prose(100 + k, 20 + 7 * k), ("en", "de", "fr")[k % 3], f"s{k % 5}", k) for k in range(40)]
    rows += [(200 + k, a, "en", "s1", 1) for k in range(30)]
    return rows


def awkward(spark, clash: tuple[str, ...] = ()):
    df = spark.createDataFrame(awkward_rows(), DOCS).repartition(5)
    for name in clash:  # extra columns with names that operators use themselves
        df = df.selectExpr("*", f"'mine' AS {name}")
    return df


def empty(spark):
    return spark.createDataFrame([], DOCS)


def pandas_sorted(df, *by: str) -> pd.DataFrame:
    return df.toPandas().sort_values(list(by), na_position="last").reset_index(drop=True)


def closure(n: int, linked) -> list[int]:
    """Smallest reachable position of each of n nodes."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x
    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def smallest_ids(ids: list, roots: list[int]) -> list:
    best: dict[int, int] = {}
    for d, r in zip(ids, roots):
        if d is not None:
            best[r] = min(d, best.get(r, d))
    return [best.get(r) for r in roots]
