"""Versioned vector index on Parquet.

Layout under ``root``::

    root/v=<n>/           chunk rows with their vectors (Parquet)
    root/_pointer/p=<n>/  the folders that make up the version published by save n

A folder is written completely before a pointer names it, so readers never
see a half-written index; a crashed build leaves a folder that no pointer
names. Appends (O3) add a folder and keep the others, so nothing is
rewritten and every row stays, as the reference does (``merge_index`` with
``dedupe=True`` or ``on_conflict="replace"`` gives a new whole index instead).
"""

from __future__ import annotations

import logging

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chunk as chunk_ops
from ..operators import embed as embed_ops


def build_index(corpus: DataFrame, size: int = 800, overlap: int = 150, embedder_factory=None,
                fixed: bool = False) -> DataFrame:
    """Documents -> chunks -> embeddings (lazy plan)."""
    chunker = chunk_ops.chunk_documents_fixed if fixed else chunk_ops.chunk_documents
    chunks = chunker(corpus, size, overlap)
    return (embed_ops.embed(chunks, "text", "embedding", embedder_factory)
            .withColumn("chunk_hash", F.xxhash64("text")))


def _names(spark: SparkSession, path: str) -> list[str]:
    """Names below ``path`` in whatever store holds it; none if it does not exist."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def _versions(spark: SparkSession, root: str, prefix: str) -> list[int]:
    return sorted(int(n.removeprefix(prefix)) for n in _names(spark, root) if n.startswith(prefix))


def _pointer(spark: SparkSession, root: str) -> int | None:
    """Number of the newest finished pointer; an unreadable one is an error when it is read, not an empty index."""
    done = [p for p in _versions(spark, f"{root}/_pointer", "p=")
            if "_SUCCESS" in _names(spark, f"{root}/_pointer/p={p}")]  # others were never finished
    return done[-1] if done else None


def current_version(spark: SparkSession, root: str) -> int | None:
    return _pointer(spark, root)


def _publish(spark: SparkSession, index: DataFrame, root: str, kept: list[str]) -> int:
    """Write the rows to a new folder, then a pointer to the kept folders and the new one.

    Folder and pointer numbers follow what exists and nothing is
    overwritten: a reader sees the old pointer or the new one.
    """
    v = max([*_versions(spark, root, "v="), *_versions(spark, f"{root}/_pointer", "p="), -1]) + 1
    index.write.parquet(f"{root}/v={v}")
    spark.createDataFrame([(f,) for f in [*kept, f"v={v}"]], "folder string").write.parquet(f"{root}/_pointer/p={v}")
    return v


def _folders(spark: SparkSession, root: str) -> list[str]:
    """Folders of the current version: one from the build and one from each append."""
    v = _pointer(spark, root)
    return [] if v is None else sorted((r[0] for r in spark.read.parquet(f"{root}/_pointer/p={v}").collect()),
                                       key=lambda f: int(f.removeprefix("v=")))


def save_index(spark: SparkSession, index: DataFrame, root: str) -> int:
    """Write ``index`` as a version of its own; returns the version."""
    return _publish(spark, index, root, [])


def append_index(spark: SparkSession, new: DataFrame, root: str) -> int:
    """O3 without a rewrite: a version that holds the current folders and one with the new rows."""
    return _publish(spark, new, root, _folders(spark, root))


def load_index(spark: SparkSession, root: str) -> DataFrame | None:
    found = _folders(spark, root)
    return spark.read.parquet(*[f"{root}/{f}" for f in found]) if found else None


def merge_index(current: DataFrame, new: DataFrame, dedupe: bool = False,
                on_conflict: str = "append") -> DataFrame:
    """O3: append new vectors (no de-duplication unless asked).

    ``on_conflict="replace"``: chunks of a source that is loaded again are
    dropped from the current index first (anti join on ``source``);
    ``"append"`` keeps the old ones next to the new ones, as the reference does.
    """
    if on_conflict == "replace":
        current = current.join(new.select("source").distinct(), "source", "left_anti")
    out = current.unionByName(new, allowMissingColumns=True)
    return out.dropDuplicates(["chunk_hash"]) if dedupe else out


def load_or_build_index(spark: SparkSession, root: str, corpus: DataFrame | None = None,
                        new_docs: DataFrame | None = None, **kw) -> DataFrame:
    """First run builds from ``corpus``; later runs load and append ``new_docs``.

    A failure of the append is reported and the loaded index is returned.
    """
    idx = load_index(spark, root)
    if idx is None:
        if corpus is None:
            raise ValueError("no index and no corpus to build it from")
        save_index(spark, build_index(corpus, **kw), root)
        return load_index(spark, root)
    if new_docs is not None:
        try:
            append_index(spark, build_index(new_docs, **kw), root)
            return load_index(spark, root)
        except (PySparkException, Py4JError) as failed:  # a job or the store failed: the old index goes on
            logging.getLogger(__name__).warning("incremental load failed: %s", failed)
    return idx
