"""Embedding near-duplicates: int8 tile products with rigorous error bounds.

Unit vectors are quantised to int8 with one scale each, u = s q + r; the
norm e of the remainder r is kept. For two vectors |u.v - s_u s_v q_u.q_v|
<= e_u (1 + e_v) + e_v (1 + e_u) + e_u e_v, so a pair whose integer product
plus this bound stays below the threshold cannot be a link; all others are
recomputed in double precision. The integer products are exact: codes are
multiplied as float32 in strips of at most 1024 dimensions, where sums stay
below 2 ** 24.

Equal vectors are one class with a multiplicity, so copies are not compared
with each other. A pair of tiles returns link counts and a spanning forest of
its links, never the links themselves.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragloom.llm.common import cut, prepare
from ragloom.llm.components import connected_components
from ragloom.llm.simhash import unite

THRESHOLD = 0.9
#: Rows of a tile: this many at least, growing with the square root of the number of
#: vectors (so what is sent grows by the power 1.5, not 2), within TILE_BYTES of doubles.
TILE_ROWS = 8192
TILE_BYTES = 128 << 20
_STRIP = 1024
#: Covers the rounding of the double-precision bounds themselves.
_SLACK = 1e-9
_CELLS = 1 << 22


class Tile:
    """A block of vectors: double precision, int8 codes, scales and error norms."""

    def __init__(self, ids: np.ndarray, weight: np.ndarray, vectors: np.ndarray):
        self.ids, self.weight = ids, weight
        v = vectors / np.abs(vectors).max(axis=1, keepdims=True)  # squares neither overflow nor vanish
        self.unit = v / np.sqrt((v * v).sum(axis=1, keepdims=True))
        self.scale = np.abs(self.unit).max(axis=1) / 127
        self.codes = np.rint(self.unit / self.scale[:, None]).astype(np.int8)
        self.error = np.sqrt(((self.unit - self.scale[:, None] * self.codes) ** 2).sum(axis=1)) + 1e-12


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if a.shape[1] <= _STRIP:
        return a.astype(np.float32) @ b.astype(np.float32).T
    return sum((a[:, i:i + _STRIP].astype(np.float32) @ b[:, i:i + _STRIP].astype(np.float32).T).astype(np.float64)
               for i in range(0, a.shape[1], _STRIP))


def links_between(a: Tile, b: Tile, threshold: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) positions of linked pairs, strip by strip; within one tile both orders, without i = j."""
    step = max(1, _CELLS // max(1, len(b.ids)))
    for s in range(0, len(a.ids), step):
        rows = slice(s, s + step)
        e_a = a.error[rows, None]
        bound = e_a + b.error[None, :] + 3 * e_a * b.error.max()
        maybe = _products(a.codes[rows], b.codes) * b.scale[None, :] * a.scale[rows, None] + bound >= threshold - _SLACK
        if maybe.mean() > 1 / 16:  # most pairs are needed: the whole strip in double precision
            i, j = np.nonzero(maybe & (a.unit[rows] @ b.unit.T >= threshold))
            i += s
        else:
            i, j = np.nonzero(maybe)
            i += s
            keep = np.zeros(len(i), bool)
            width = max(1, _CELLS // a.unit.shape[1])
            for k in range(0, len(i), width):
                part = slice(k, k + width)
                keep[part] = np.einsum("ij,ij->i", a.unit[i[part]], b.unit[j[part]]) >= threshold
            i, j = i[keep], j[keep]
        if same:
            apart = i != j
            i, j = i[apart], j[apart]
        yield i, j


def tile_links(a: Tile, b: Tile | None, threshold: float) -> tuple[pd.DataFrame, pd.DataFrame]:
    """(id, links) with other classes' multiplicities, and a spanning forest (a, b) of the links."""
    same, other = b is None, a if b is None else b
    base = 0 if same else len(a.ids)
    ids = a.ids if same else np.concatenate([a.ids, b.ids])
    parent, count = np.arange(len(ids)), np.zeros(len(ids), np.int64)
    for i, j in links_between(a, other, threshold, same):
        np.add.at(count, i, other.weight[j])
        if not same:
            np.add.at(count, base + j, a.weight[i])
        unite(parent, i, base + j)
    while not np.array_equal(parent, parent[parent]):
        parent = parent[parent]
    has, child = np.flatnonzero(count), np.flatnonzero(parent != np.arange(len(ids)))
    return (pd.DataFrame({"id": ids[has], "n": count[has]}),
            pd.DataFrame({"id": ids[child], "to": ids[parent[child]]}))


def rows_of_tile(n: int, dims: int) -> int:
    return max(256, min(TILE_BYTES // (8 * dims), max(TILE_ROWS, 36 * math.isqrt(n))))


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding",
                    threshold: float = THRESHOLD, tile_rows: int | None = None) -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept.

    Vectors that are null, empty, zero, or hold null or non-finite
    components link with nothing (component_id = vec_id, kept). Vectors of
    different length do not link. Rows with equal ids are vectors of their
    own; null ids never name a component unless all its ids are null, and
    ``kept`` compares null-safe. Other columns are ignored. No rows: none.
    The driver sees one count per vector length.
    """
    prepare(vectors.sparkSession)
    e = F.col("e")
    fine = F.coalesce((F.size(e) > 0) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
                      & F.exists(e, lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).alias("e")).withColumn("fine", fine)
    classes = rows.where("fine").groupBy("e").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("first"))
    classes = cut(classes.withColumn("c", F.monotonically_increasing_id()).withColumn("d", F.size("e")))
    tiles_of = {r["d"]: -(-r["count"] // (tile_rows or rows_of_tile(r["count"], r["d"])))
                for r in classes.groupBy("d").count().collect()}
    if tiles_of:
        per_dim = F.element_at(F.create_map(*[F.lit(x) for kv in tiles_of.items() for x in kv]), F.col("d"))
        dealt = classes.select("d", F.pmod(F.xxhash64("c"), per_dim).cast("int").alias("t"), "c", "n",
                               F.col("e").cast("array<double>").alias("e"))

        def pack(g: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"d": g["d"].iloc[:1], "t": g["t"].iloc[:1], "ids": [g["c"].to_numpy(np.int64).tobytes()],
                                 "weight": [g["n"].to_numpy(np.int64).tobytes()], "e": [np.stack(g["e"].to_numpy()).tobytes()]})

        tiles = dealt.groupBy("d", "t").applyInPandas(pack, "d int, t int, ids binary, weight binary, e binary")
        last = per_dim - 1
        ends = F.explode(F.transform(F.sequence(F.lit(0), last), lambda o: F.struct(
            F.least(o, F.col("t")).alias("x"), F.greatest(o, F.col("t")).alias("y"))))
        pairs = tiles.withColumn("p", ends).select("d", "p.x", "p.y", "t", "ids", "weight", "e")

        def compare(g: pd.DataFrame) -> pd.DataFrame:
            got = {t: Tile(np.frombuffer(i, np.int64), np.frombuffer(w, np.int64), np.frombuffer(v, np.float64).reshape(-1, d))
                   for d, t, i, w, v in zip(g["d"], g["t"], g["ids"], g["weight"], g["e"])}
            x, y = int(g["x"].iloc[0]), int(g["y"].iloc[0])
            if x not in got or y not in got:  # a tile that the hash left empty
                return pd.DataFrame({"id": [], "to": [], "n": []}, dtype=np.int64)
            counts, forest = tile_links(got[x], None if x == y else got[y], threshold)
            return pd.concat([counts.assign(to=None), forest.assign(n=None)])[["id", "to", "n"]].astype("Int64")

        found = cut(pairs.groupBy("d", "x", "y").applyInPandas(compare, "id long, to long, n long"))
    else:
        found = vectors.sparkSession.createDataFrame([], "id long, to long, n long")
    sums = found.where("n is not null").groupBy(F.col("id").alias("c")).agg(F.sum("n").alias("others"))
    comps = connected_components(found.where("to is not null").select("id", "to"), "id", "to")
    named = (classes.join(sums, "c", "left").join(comps, F.col("c") == F.col("node"), "left")
             .select("e", "first", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("root", "c").alias("root")))
    named = cut(named)
    ids = named.groupBy("root").agg(F.min("first").alias("component_id"))
    linked = rows.where("fine").join(named.join(ids, "root").select("e", "n_links", "component_id"), "e").select(
        "vec_id", "n_links", "component_id")
    alone = rows.where("not fine").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
