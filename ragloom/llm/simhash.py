"""SimHash near-duplicates by tiled exact comparison.

Fingerprints are majority bits over the XXH64 of word shingles. Distinct
fingerprints are dealt into tiles by population count (and a hash where a
count is common); only tiles whose population counts differ by no more than
the radius meet, because k differing bits change the count by at most k. In
a tile pair numpy compares exclusive-or bit counts, again skipping blocks
whose population counts (of the four 16-bit quarters) differ beyond the
radius. A pair of tiles emits a spanning forest of its links instead of the
links themselves, so a group of n near copies costs n rows, not n squared;
the forests of all pairs together connect exactly what the links connect.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ragloom.llm.common import cut, prepare
from ragloom.llm.components import connected_components

SHINGLE = 4
MAX_DISTANCE = 4
#: Rows of a tile: this many at least, growing with the square root of the number of
#: fingerprints (so what is sent grows by the power 1.5, not 2), up to 8 MB of them.
TILE_ROWS = 65_536
MOST_TILE_ROWS = 1 << 20
#: Bits that one numpy step expands (bounds the memory of a very long text).
_STEP = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = 42) -> int:
    """SimHash of one text: A-Z lower-cased, words split at ASCII white space, repeats counted."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    joined, ends, at = b" ".join(words), [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *(e + 1 for e in ends[:n - 1])]
    last = ends[shingle - 1:] if len(words) >= shingle else [len(joined)]
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(joined[s:e], seed) for s, e in zip(starts, last)), dtype="<u8", count=n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, _STEP):
        part = h[i:i + _STEP].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def with_fingerprint(docs: DataFrame, text: str, out: str, shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with a signed 64-bit ``out`` column (null text: no words, fingerprint zero)."""
    prepare(docs.sparkSession)

    @F.pandas_udf("long")
    def marks(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield pd.Series(np.array([fingerprint(t, shingle) for t in s], np.uint64).view(np.int64))

    return docs.withColumn(out, marks(F.col(text)))


# --- links between distinct fingerprints -------------------------------------------------------

def _roots(parent: np.ndarray, x: np.ndarray) -> np.ndarray:
    while True:
        up = parent[x]
        if np.array_equal(up, x):
            return x
        x = up


def unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the sets of ``a[i]`` and ``b[i]`` in a parent array whose roots are minima."""
    while len(a):
        a, b = _roots(parent, a), _roots(parent, b)
        apart = a != b
        a, b = a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))


def _quarters(fps: np.ndarray) -> np.ndarray:
    return np.bitwise_count(np.ascontiguousarray(fps).view(np.uint16).reshape(-1, 4)).astype(np.int16)


def tile_forest(a: np.ndarray, b: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links within ``a`` (``b`` None) or between ``a`` and ``b``."""
    both = a if b is None else np.concatenate([a, b])
    base = 0 if b is None else len(a)
    other = a if b is None else b
    parent = np.arange(len(both))
    qa, qb = _quarters(a), _quarters(other)
    kinds, kind_of = np.unique(qa, axis=0, return_inverse=True)
    kind_of = kind_of.reshape(-1)
    order = np.argsort(kind_of, kind="stable")
    bounds = np.searchsorted(kind_of[order], np.arange(len(kinds) + 1))
    kinds_b, kind_b = np.unique(qb, axis=0, return_inverse=True)
    kind_b = kind_b.reshape(-1)
    for k in range(len(kinds)):
        near_kind = np.abs(kinds_b - kinds[k]).sum(axis=1) <= radius
        cols = np.flatnonzero(near_kind[kind_b])
        if not len(cols):
            continue
        rows = order[bounds[k]:bounds[k + 1]]
        step = max(1, (1 << 22) // len(cols))
        for i in range(0, len(rows), step):
            part = rows[i:i + step]
            r, c = np.nonzero(np.bitwise_count(a[part][:, None] ^ other[cols][None, :]) <= radius)
            if len(r):
                unite(parent, part[r], base + cols[c])
    root = _roots(parent, np.arange(len(both)))
    linked = np.flatnonzero(root != np.arange(len(both)))
    return both[linked], both[root[linked]]


def fingerprint_links(fps: DataFrame, col: str, radius: int = MAX_DISTANCE,
                      tile_rows: int | None = None) -> DataFrame:
    """(a, b): links that connect all ``col`` values within ``radius`` bits of one another.

    ``fps`` holds distinct non-null 64-bit values. The class sizes that plan
    the tiles are at most 65 rows.
    """
    pop = fps.select(F.col(col).alias("fp"), F.bit_count(col).cast("int").alias("p"))
    sizes = {r["p"]: r["count"] for r in pop.groupBy("p").count().collect()}
    if not sizes:
        return fps.sparkSession.createDataFrame([], "a long, b long")
    tile_rows = tile_rows or min(MOST_TILE_ROWS, max(TILE_ROWS, 64 * math.isqrt(sum(sizes.values()))))
    chunks = {p: -(-n // tile_rows) for p, n in sizes.items()}
    n_chunks = F.element_at(F.create_map(*[F.lit(x) for kv in chunks.items() for x in kv]), F.col("p"))
    dealt = pop.withColumn("c", F.pmod(F.xxhash64("fp"), n_chunks).cast("int"))

    def pack(g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"p": g["p"].iloc[:1], "c": g["c"].iloc[:1], "blob": [g["fp"].to_numpy(np.int64).tobytes()]})

    tiles = dealt.groupBy("p", "c").applyInPandas(pack, "p int, c int, blob binary")

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in batches:
            for p, c, blob in zip(g["p"].tolist(), g["c"].tolist(), g["blob"]):
                rows = []
                for q in range(p, p + radius + 1):
                    rows += [(p, c, q, d, 0, blob) for d in range(c if q == p else 0, chunks.get(q, 0))]
                for o in range(p - radius, p + 1):
                    rows += [(o, d, p, c, 1, blob) for d in range(0, c if o == p else chunks.get(o, 0))]
                for i in range(0, len(rows), 64):
                    yield pd.DataFrame(rows[i:i + 64], columns=["p", "c", "q", "d", "side", "blob"])

    def compare(g: pd.DataFrame) -> pd.DataFrame:
        sides = {s: np.frombuffer(x, np.int64).view(np.uint64) for s, x in zip(g["side"], g["blob"])}
        if 0 not in sides:
            return pd.DataFrame({"a": [], "b": []}, dtype=np.int64)
        same = (g["p"].iloc[0], g["c"].iloc[0]) == (g["q"].iloc[0], g["d"].iloc[0])
        if not same and 1 not in sides:
            return pd.DataFrame({"a": [], "b": []}, dtype=np.int64)
        a, b = tile_forest(sides[0], None if same else sides[1], radius)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    pairs = tiles.mapInPandas(meet, "p int, c int, q int, d int, side int, blob binary")
    return pairs.groupBy("p", "c", "q", "d").applyInPandas(compare, "a long, b long")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
                    radius: int = MAX_DISTANCE, tile_rows: int | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint, component_id, text_hash, root, fp.

    ``component_id`` is the smallest non-null id among rows reachable over
    links of at most ``radius`` differing bits. Null text counts as a text
    without words (fingerprint zero, linked like any other); rows with equal
    ids all stay and are nodes of their own; a component whose ids are all
    null has a null component_id. ``root`` names the component by its
    smallest signed fingerprint, ``text_hash`` is the text's xxhash64. Other
    columns of ``docs`` are ignored. An empty table gives an empty result.
    """
    marked = with_fingerprint(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text", "fp", shingle)
    marked = cut(marked.select("doc_id", F.xxhash64("text").alias("text_hash"), "fp"))
    firsts = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("first")))
    comps = connected_components(fingerprint_links(firsts.select("fp"), "fp", radius, tile_rows), "a", "b")
    named = cut(firsts.join(comps, firsts["fp"] == comps["node"], "left")
                .select("fp", "first", F.coalesce("root", "fp").alias("root")))
    ids = named.groupBy("root").agg(F.min("first").alias("component_id"))
    per_fp = named.join(ids, "root").select("fp", "root", "component_id")
    return marked.join(per_fp, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "text_hash", "root", "fp")


def keep_one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each component the row with the smallest id.

    Null ids come after all others; equal ids are decided by the text's hash;
    of fully repeated rows one stays. All columns of ``docs`` are kept.
    """
    found = near_duplicates(docs, doc_id, text, **options)
    best = found.groupBy("root").agg(F.min(F.struct(
        F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("text_hash"))).alias("best"))
    def keys(i: str, h: str) -> list:
        return [F.coalesce(F.col(i), F.lit(0)).alias("__id"), F.col(i).isNull().alias("__none"), F.col(h).alias("__hash")]

    chosen = best.select("best.doc_id", "best.text_hash").distinct().select(*keys("doc_id", "text_hash"))
    whole = docs.select(F.struct("*").alias("__row"), F.col(doc_id).alias("__did"), F.xxhash64(text).alias("__th"))
    whole = whole.select("__row", *keys("__did", "__th"))
    # of repeated rows one goes on, cut to one a task before the texts are dealt out; the join keeps that dealing
    w = Window.partitionBy("__id", "__none", "__hash").orderBy("__hash")
    single = whole.withColumn("__n", F.row_number().over(w)).where("__n = 1")
    return single.join(chosen, ["__id", "__none", "__hash"], "left_semi").select("__row.*")
