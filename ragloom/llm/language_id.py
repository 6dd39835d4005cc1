"""Language identification by prediction by partial matching (PPM).

Per language a byte context tree of order 2 is counted over all learning
texts: each position adds its byte to the contexts of length 2, 1 and 0. With
the statistics frozen, a byte costs -log2 of its probability under method C:
a context escapes with weight equal to the number of distinct bytes it has
seen, and the shorter context then excludes those bytes; the last resort is
the uniform choice among bytes not yet excluded. A text is of the language
that codes it shortest.

Letters are folded to lower case, ASCII characters that are no letters become
one break symbol (runs collapsed), bytes of other characters stay, so a
language has at most SYMBOLS ** 3 = 3.8 million counters whatever the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragloom.llm.common import prepare

#: Break, 26 letters, 128 bytes above ASCII.
SYMBOLS = 155
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
_STEP = 1 << 20


def _symbol_table() -> bytes:
    table = bytearray(256)
    for b in range(256):
        table[b] = b - 0x60 if 0x61 <= b <= 0x7A else b - 0x40 if 0x41 <= b <= 0x5A else b - 0x80 + 27 if b >= 0x80 else 0
    return bytes(table)


_SYMBOL = _symbol_table()


def symbols(text: str) -> np.ndarray:
    """Symbols of a text behind two breaks; runs of breaks collapsed."""
    s = np.frombuffer(b"\0\0" + text.lower().encode("utf-8", "surrogatepass").translate(_SYMBOL), np.uint8)
    keep = np.ones(len(s), bool)
    keep[2:] = (s[2:] != 0) | (s[1:-1] != 0)
    return s[keep].astype(np.int32)


def _grams(s: np.ndarray, base: int) -> np.ndarray:
    return (s[:-2] * base + s[1:-1]) * base + s[2:]


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id's text leaves remainder 2 by 4 (a null id counts as empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def count_grams(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """(lang, gram, n): symbol triples of all texts with a language, summed per task before the shuffle."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            for name, texts in b.groupby("lang")["text"]:
                todo, size = [], 0
                for t in [*texts, None]:
                    if t is not None:
                        todo.append(_grams(symbols(t), SYMBOLS))
                        size += len(todo[-1])
                    if todo and (t is None or size >= _STEP):
                        g, n = np.unique(np.concatenate(todo), return_counts=True)
                        if name in sums:
                            both = np.concatenate([sums[name][0], g])
                            g, where = np.unique(both, return_inverse=True)
                            n = np.bincount(where, np.concatenate([sums[name][1], n])).astype(np.int64)
                        sums[name], todo, size = (g, n), [], 0
        for name, (g, n) in sums.items():
            yield pd.DataFrame({"lang": name, "gram": g, "n": n})

    found = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text")).where("lang is not null and text is not null")
    return found.mapInPandas(count, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def code_lengths(n2: np.ndarray) -> np.ndarray:
    """Bits of every (context, symbol) under frozen counts ``n2[a, b, c]``, method C with exclusion."""
    n1, n0 = n2.sum(0), n2.sum((0, 1))
    size = len(n0)
    p = np.zeros(n2.shape)
    weight = np.ones(n2.shape[:2] + (1,))  # probability of having escaped so far
    left = np.ones(n2.shape, bool)  # symbols not excluded yet
    for n in (n2, np.broadcast_to(n1, n2.shape), np.broadcast_to(n0, n2.shape)):
        n = np.where(left, n, 0)
        total, kinds = n.sum(-1, keepdims=True), (n > 0).sum(-1, keepdims=True)
        rest = left.sum(-1, keepdims=True) > kinds  # an escape is coded only if a symbol is left for it
        bottom = np.maximum(total + np.where(rest, kinds, 0), 1)
        p += np.where(n > 0, weight * n / bottom, 0)
        weight = np.where(total > 0, weight * np.where(rest, kinds, 0) / bottom, weight)
        left = left & (n == 0)
    open_ = left.sum(-1, keepdims=True)
    p += np.where(left, weight / np.maximum(open_, 1), 0)
    assert size == n2.shape[2]
    return -np.log2(p)


class Model:
    """Frozen code lengths of all languages over the symbols that the learning texts hold."""

    def __init__(self, counts: list[tuple[str, int, int]]):
        self.langs = sorted({lang for lang, _, _ in counts})
        g = np.array([x for _, x, _ in counts], np.int64)
        parts = np.stack([g // SYMBOLS // SYMBOLS, g // SYMBOLS % SYMBOLS, g % SYMBOLS]) if len(g) else np.zeros((3, 0), int)
        used = np.unique(np.append(parts, 0))
        self.size = size = len(used) + 1  # the last stands for symbols never seen
        self.map = np.full(SYMBOLS, size - 1, np.int32)
        self.map[used] = np.arange(len(used))
        gram = (self.map[parts[0]].astype(np.int64) * size + self.map[parts[1]]) * size + self.map[parts[2]]
        which = np.array([self.langs.index(lang) for lang, _, _ in counts], np.int64)
        n = np.array([c for _, _, c in counts], np.float64)
        self.bits = np.empty((size ** 3, len(self.langs)), np.float32)
        for k in range(len(self.langs)):
            n2 = np.bincount(gram[which == k], n[which == k], size ** 3).reshape(size, size, size)
            self.bits[:, k] = code_lengths(n2).reshape(-1)

    def lengths(self, text: str) -> np.ndarray:
        """Exact code length of the text in bits, by language."""
        g = _grams(self.map[symbols(text)], self.size)
        out = np.zeros(len(self.langs))
        for i in range(0, len(g), _STEP):
            out += self.bits[g[i:i + _STEP]].sum(axis=0, dtype=np.float64)
        return out

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language with the shortest code (ties: first by name) and its posterior under equal priors."""
        if not self.langs or text is None or not _LETTER.search(text):
            return UNKNOWN, 0.0
        bits = self.lengths(text)
        best = int(bits.argmin())
        return self.langs[best], float(1 / np.exp2(np.maximum(bits[best] - bits, -1000)).sum())


def train(docs: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Count all given texts; what reaches the driver is bounded by SYMBOLS ** 3 counters a language."""
    prepare(docs.sparkSession)
    return Model([tuple(r) for r in count_grams(docs, text, lang).collect()])


def with_language(docs: DataFrame, model: Model, text: str = "text", out: str = "language") -> DataFrame:
    """``docs`` with a struct column ``out``: lang_pred, score (0 to 1).

    ``und`` with score 0 for null texts, texts without a letter, or when
    nothing could be learned. All rows and columns stay (a column named
    ``out`` is replaced); no shuffle.
    """
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for s in batches:
            yield pd.DataFrame([m.predict(t) for t in s], columns=["lang_pred", "score"])

    return docs.withColumn(out, predict(F.col(text)))


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
             out: str = "language") -> DataFrame:
    """Learn from the documents that are not held out, predict all of them."""
    return with_language(docs, train(docs.where(~held_out(F.col(doc_id))), text, lang), text, out)
