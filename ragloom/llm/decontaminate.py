"""Benchmark decontamination by Wu-Manber multi-pattern search.

Texts and benchmark items become words joined by single spaces. Each window
of an item is one byte pattern with a space at either end. A shift table
over byte blocks says how far the search may jump; where the jump is zero
the suffix block names the bucket of patterns to test, and only a direct
comparison of the whole pattern confirms an occurrence.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragloom.llm.common import cut, prepare

WINDOW = 13
#: Contaminated: at least one hit and ``SHARE * n_hit >= n_words``.
SHARE = 20
#: Benchmark text (bytes) whose tables are broadcast at once: some 170 MB in each worker, 30 MB sent. More text is
#: searched in further passes.
PASS_BYTES = 1 << 20
#: Texts with hits of several passes that may be broadcast; more are joined by shuffle.
BROADCAST_TEXTS = 100_000
BLOCK = 8
#: Patterns are searched in groups by length, so that a short one does not shorten everybody's jumps.
LENGTH_GROUPS = (8, 32)


def _fold_table() -> bytes:
    table = bytearray(range(256))
    for b in range(0x80):
        if 0x41 <= b <= 0x5A:
            table[b] = b + 32
        elif not (0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A):
            table[b] = 0x20
    return bytes(table)


_FOLD = _fold_table()


def words_of(text: str | None) -> list[bytes]:
    """Runs of digits, lower-cased ASCII letters and non-ASCII characters."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


class WuManber:
    """Search tables of patterns that share a least length."""

    def __init__(self, patterns: list[bytes], block: int = BLOCK):
        self.m = m = min(map(len, patterns))
        self.block = block = min(block, m)
        self.jump = m - block + 1
        self.shift: dict[bytes, int] = {}
        self.buckets: dict[bytes, dict[bytes, list[bytes]]] = {}
        for p in patterns:
            for q in range(block, m + 1):
                key = p[q - block:q]
                self.shift[key] = min(m - q, self.shift.get(key, self.jump))
            self.buckets.setdefault(p[m - block:m], {}).setdefault(p[:m], []).append(p)

    def occurrences(self, text: bytes) -> Iterator[tuple[int, bytes]]:
        """(start, pattern) of every occurrence, by ascending start."""
        m, block, jump, shift, buckets = self.m, self.block, self.jump, self.shift, self.buckets
        i, n = m, len(text)
        while i <= n:
            key = text[i - block:i]
            step = shift.get(key, jump)
            if step:
                i += step
                continue
            for p in buckets[key].get(text[i - m:i], ()):
                if text.startswith(p, i - m):
                    yield i - m, p
            i += 1


class Windows:
    """The windows of benchmark items, ready to search."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW):
        self.items_of: dict[bytes, set[str | None]] = {}
        for item_id, text in items:
            w = words_of(text)
            for k in range(max(1, len(w) - window + 1) if w else 0):
                self.items_of.setdefault(b" " + b" ".join(w[k:k + window]) + b" ", set()).add(item_id)
        groups: dict[int, list[bytes]] = {}
        for p in self.items_of:
            groups.setdefault(sum(len(p) >= g for g in LENGTH_GROUPS), []).append(p)
        self.searches = [WuManber(g) for g in groups.values()]

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged [start, end) ranges of hit words, and the items that occur."""
        text = b" " + b" ".join(words) + b" "
        spans, items = [], set()
        for search in self.searches:
            at = word = 0
            for pos, p in search.occurrences(text):
                word += text.count(b" ", at, pos)
                at = pos
                spans.append((word, word + p.count(b" ") - 1))
                items |= self.items_of[p]
        return merged(spans), {i for i in items if i is not None}


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


_FOUND = "n_words long, n_hit long, spans array<long>, items array<string>"


def _search(shared):
    @F.pandas_udf(_FOUND)
    def search(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        windows = shared.value
        for texts in batches:
            found = []
            for t in texts:
                words = words_of(t)
                spans, names = windows.hits(words)
                found.append((len(words), sum(e - s for s, e in spans), [x for span in spans for x in span], sorted(names)))
            yield pd.DataFrame(found, columns=["n_words", "n_hit", "spans", "items"])
    return search


def _united(lists: Iterable[Iterable[int]]) -> list[int]:
    """Spans of several passes as one list."""
    return [x for span in merged([(s, e) for flat in lists for s, e in zip(flat[::2], flat[1::2])]) for x in span]


def _in_passes(rows: DataFrame, items: DataFrame, passes: int, window: int) -> DataFrame:
    """``rows`` (__row, __text) with ``__found`` from several sets of tables, one at a time.

    Each pass reads the texts and keeps digests and hits of those with any;
    no text is written or, unless very many have hits, shuffled.
    """
    spark = rows.sparkSession
    dealt = cut(items.withColumn("b", F.pmod(F.xxhash64("t"), F.lit(passes))))
    key = F.sha2(F.col("__text"), 256)
    hits = None
    for b in range(passes):
        shared = spark.sparkContext.broadcast(Windows([(r["i"], r["t"]) for r in dealt.where(F.col("b") == b).collect()], window))
        found = rows.select(key.alias("k"), _search(shared)("__text").alias("f")).where("f.n_hit > 0").select("k", "f.spans", "f.items")
        found = cut(found.groupBy("k").agg(F.first("spans").alias("spans"), F.first("items").alias("items")))  # equal texts, equal hits
        hits = found if hits is None else hits.unionByName(found)
    # at most one row a pass and text
    hits = hits.groupBy("k").agg(F.collect_list("spans").alias("s"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))

    @F.pandas_udf("array<long>")
    def united(s: pd.Series) -> pd.Series:
        return s.map(_united)

    hits = cut(hits.select(F.col("k").alias("__k"), united("s").alias("__spans"), F.col("items").alias("__items")))
    side = F.broadcast(hits) if hits.limit(BROADCAST_TEXTS + 1).count() <= BROADCAST_TEXTS else hits
    nothing = spark.sparkContext.broadcast(Windows([], window))
    joined = rows.withColumn("__n", _search(nothing)("__text")["n_words"]).join(side, key == F.col("__k"), "left")
    spans = F.coalesce("__spans", F.array().cast("array<long>"))
    lengths = F.aggregate(F.transform(spans, lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("long"), lambda s, x: s + x)
    return joined.select("__row", F.struct(F.col("__n").alias("n_words"), lengths.alias("n_hit"), spans.alias("spans"),
                                           F.coalesce("__items", F.array().cast("array<string>")).alias("items")).alias("__found"))


def with_hits(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id",
              item_text: str = "text", window: int = WINDOW, share: int = SHARE,
              pass_bytes: int = PASS_BYTES, out: str = "hits") -> DataFrame:
    """``docs`` with a struct column ``out``: n_words, n_hit, n_items, item_ids, items_sha256, contaminated, spans.

    ``spans`` lists ranges of hit words, [start, end) after [start, end).
    Null texts have no words; a text of any length is searched whole; an
    empty benchmark hits nothing; repeated items count once by id; items with
    a null id hit words but are not listed or counted. All columns and rows
    of ``docs``, repeated ones too, stay (a column named ``out`` is
    replaced); ``docs`` is not shuffled. The tables of ``pass_bytes`` of
    benchmark text are broadcast at a time (an item is never cut); a larger
    benchmark is searched in several passes and the hits united by text.
    """
    spark = docs.sparkSession
    prepare(spark)
    items = (benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).alias("t"))
             .where("t is not null").distinct())
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    passes = -(-total // pass_bytes) or 1
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns if c != out]).alias("__row"), F.col(text).alias("__text"))
    if passes == 1:
        shared = spark.sparkContext.broadcast(Windows([(r["i"], r["t"]) for r in items.collect()], window))
        rows = rows.select("__row", _search(shared)("__text").alias("__found"))
    else:
        rows = _in_passes(rows, items, passes, window)
    f = F.col("__found")
    return rows.select("__row.*", F.struct(
        f["n_words"].alias("n_words"), f["n_hit"].alias("n_hit"), F.size(f["items"]).cast("long").alias("n_items"),
        f["items"].alias("item_ids"), F.sha2(F.array_join(f["items"], ",").cast("binary"), 256).alias("items_sha256"),
        ((f["n_hit"] > 0) & (f["n_hit"] * share >= f["n_words"])).alias("contaminated"),
        f["spans"].alias("spans")).alias(out))
