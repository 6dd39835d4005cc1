"""Embedding (P8) and the embedder plug-in surface.

An ``Embedder`` turns a batch of texts into a float matrix; ``embed`` runs it
as an Arrow iterator UDF, so the embedder is built once per task and fed at
most ``BATCH`` texts at a time.

No model weights ship with this repository. The default embedder hashes
character trigrams of the lower-cased text into ``dim`` buckets and counts
them; ``normalise=True`` scales rows to unit length. The bucket rule uses
only integer arithmetic on code points, so SQL can recompute it:

    bucket(c0, c1, c2) = ((c0 * 7919 + c1) * 7919 + c2) % 1000003 % dim

Texts shorter than three characters pad with code point 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import spread

DIM = 512
GRAM = 3
MULT = 7919
MOD = 1000003
#: Texts embedded at a time: Python strings and a float64 matrix of so many rows are held.
BATCH = 1024


class Embedder(Protocol):
    dim: int

    def embed(self, texts: list[str | None]) -> np.ndarray:  # (n, dim)
        ...


class HashedTrigramEmbedder:
    """Character-trigram count vectors (see module docstring)."""

    def __init__(self, dim: int = DIM, normalise: bool = True):
        self.dim = dim
        self.normalise = normalise

    def buckets(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, dtype=np.int64)
        cp = np.frombuffer(text.lower().encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
        if len(cp) < GRAM:
            cp = np.concatenate([cp, np.zeros(GRAM - len(cp), dtype=np.int64)])
        h = (cp[:-2] * MULT + cp[1:-1]) * MULT + cp[2:]
        return (h % MOD) % self.dim

    def counts(self, text: str | None) -> np.ndarray:
        return np.bincount(self.buckets(text), minlength=self.dim).astype(np.float64)

    def _count(self, texts, out: np.ndarray) -> None:
        """Add the bucket counts of all texts: one code point array, padded between texts."""
        low = [(t or "").lower() for t in texts]
        low = [t + "\0" * (GRAM - len(t)) if 0 < len(t) < GRAM else t for t in low]
        size = np.array([len(t) for t in low], dtype=np.int64)
        cp = np.frombuffer("".join(low).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
        if len(cp) < GRAM:
            return
        h = ((cp[:-2] * MULT + cp[1:-1]) * MULT + cp[2:]) % MOD % self.dim
        row = np.repeat(np.arange(len(low)), size)
        own = row[:-2] == row[2:]  # grams that do not reach into the next text
        out += np.bincount(row[:-2][own] * self.dim + h[own], minlength=out.size).reshape(out.shape)

    def embed(self, texts) -> np.ndarray:
        m = np.zeros((len(texts), self.dim), dtype=np.float64)
        for a in range(0, len(texts), 1024):  # one array operation for up to 1024 texts
            self._count(texts[a:a + 1024], m[a:a + 1024])
        if self.normalise:
            n = np.linalg.norm(m, axis=1, keepdims=True)
            m = np.divide(m, n, out=np.zeros_like(m), where=n > 0)
        return m


def embed_col(text: str | Column, embedder_factory=None, dtype: str = "float") -> Column:
    """P8 as a column: array<float> (or array<double>) per text.

    ``embedder_factory`` is a zero-argument callable run once per task (e.g.
    loading model weights); default: ``HashedTrigramEmbedder()``.
    """
    factory = embedder_factory or HashedTrigramEmbedder
    np_type = np.float32 if dtype == "float" else np.float64
    spark_type = T.ArrayType(T.FloatType() if dtype == "float" else T.DoubleType())

    @F.arrow_udf(spark_type)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        emb = factory()
        for texts in batches:
            parts, ends = [np.zeros(0, np_type)], [np.zeros(1, np.int32)]
            for a in range(0, len(texts), BATCH):
                m = np.ascontiguousarray(emb.embed(texts.slice(a, BATCH).to_pylist()), dtype=np_type)
                ends.append(ends[-1][-1] + np.arange(1, len(m) + 1, dtype=np.int32) * m.shape[1])
                parts.append(m.ravel())
            yield pa.ListArray.from_arrays(pa.array(np.concatenate(ends)), pa.array(np.concatenate(parts)))

    return run(F.col(text) if isinstance(text, str) else text)


def embed(df: DataFrame, text_col: str = "text", out_col: str = "embedding",
          embedder_factory=None, dtype: str = "float") -> DataFrame:
    """Add an embedding column.

    Embedding is the costly per-row step; an input that the planner
    estimates to be small is spread round-robin first (``session.spread``).
    """
    return spread(df).withColumn(out_col, embed_col(text_col, embedder_factory, dtype))


def count_vectors(df: DataFrame, text_col: str = "text", out_col: str = "embedding",
                  dim: int = DIM) -> DataFrame:
    """Un-normalised trigram counts as float32 (integers below 2^24 are exact),
    so cosines computed downstream in double are exact as well."""
    return embed(df, text_col, out_col,
                 embedder_factory=lambda: HashedTrigramEmbedder(dim, normalise=False),
                 dtype="float")
