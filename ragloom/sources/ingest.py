"""Drop-folder ingest into a segmented index, published by one commit.

Layout under ``root``::

    root/segments/<name>/index       chunk rows with vectors
    root/segments/<name>/ledger      files of the run: path, time, length, status (loaded or rejected), reason
    root/segments/<name>/tombstones  sources whose rows in earlier segments no longer count
    root/manifests/<n>.json          names of the segments that make up version n, in order

A run writes its segment and then a manifest that names it, by renaming a
finished file to a name that must not exist. Index, ledger and tombstones of
a run are seen together or not at all: after a crash the files are pending
as before and the orphaned segment is never read. Nothing is rewritten: a
source that is loaded again puts a tombstone on its older rows, which are
left out on read until ``compact`` folds them.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import corpus, index_store

#: Files of one run; an inbox with more is loaded in several runs.
RUN_FILES = 10_000
#: Sources with tombstones that may be broadcast; more are joined by shuffle.
BROADCAST_SOURCES = 500_000
LEDGER = "path string, modificationTime timestamp, length long, status string, reason string"


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def versions(spark: SparkSession, root: str) -> list[int]:
    names = index_store._names(spark, f"{root}/manifests")
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[:-5].isdigit())


def segments(spark: SparkSession, root: str, version: int | None = None) -> list[str]:
    """Segment names of a version (default: the newest), oldest first."""
    found = versions(spark, root)
    if not found:
        return []
    text = spark.read.option("wholetext", True).text(f"{root}/manifests/{found[-1] if version is None else version}.json").first()[0]
    return json.loads(text)


def commit(spark: SparkSession, root: str, before: list[str], names: list[str]) -> int:
    """Publish ``names`` as the version after the one that holds ``before``; an error if another writer came first."""
    if segments(spark, root) != before:
        raise RuntimeError("the index has changed since this run began")
    version = max(versions(spark, root), default=-1) + 1
    fs, target = _fs(spark, f"{root}/manifests/{version}.json")
    _, written = _fs(spark, f"{root}/manifests/.{uuid.uuid4().hex}")
    out = fs.create(written, False)
    out.write(bytearray(json.dumps(names).encode()))
    out.close()
    if fs.exists(target) or not fs.rename(written, target):
        fs.delete(written, False)
        raise RuntimeError("the index has changed since this run began")
    return version


def _each(spark: SparkSession, root: str, part: str, schema: str | None = None, names: list[str] | None = None) -> DataFrame | None:
    """Rows of one part of all segments that have it, with the segment's place as ``_seq``."""
    found = []
    for seq, name in enumerate(segments(spark, root) if names is None else names):
        path = f"{root}/segments/{name}/{part}"
        fs, p = _fs(spark, path)
        if fs.exists(p):
            found.append((spark.read.schema(schema) if schema else spark.read).parquet(path).withColumn("_seq", F.lit(seq)))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found) if found else None


def ledger(spark: SparkSession, root: str) -> DataFrame:
    """Every file that a published run has taken, with its status."""
    found = _each(spark, root, "ledger", LEDGER)
    return spark.createDataFrame([], LEDGER) if found is None else found.drop("_seq")


def load(spark: SparkSession, root: str) -> DataFrame | None:
    """Rows of the index that no later tombstone covers; None before the first run."""
    rows, graves = _each(spark, root, "index"), _each(spark, root, "tombstones", "source string")
    if rows is None:
        return None
    if graves is not None:
        last = graves.groupBy("source").agg(F.max("_seq").alias("_dead")).withColumnRenamed("source", "_source")
        side = F.broadcast(last) if last.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES else last
        rows = rows.join(side, F.col("source") == F.col("_source"), "left").where(F.coalesce("_dead", F.lit(-1)) <= F.col("_seq"))
        rows = rows.drop("_source", "_dead")
    return rows.drop("_seq")


def _segment(spark: SparkSession, root: str, before: list[str], parts: dict[str, DataFrame], at_step: Callable[[str], None]) -> int:
    name = uuid.uuid4().hex
    for part, rows in parts.items():
        rows.write.parquet(f"{root}/segments/{name}/{part}")
        at_step(part)
    version = commit(spark, root, before, [*before, name])
    at_step("manifest")
    return version


def replace_sources(spark: SparkSession, rows: DataFrame, root: str, at_step: Callable[[str], None] = lambda step: None) -> int:
    """O3 with replacement: add ``rows`` and bury what earlier segments hold of their sources; nothing old is rewritten."""
    rows = rows.checkpoint(eager=True)
    graves = rows.select("source").where("source is not null").distinct()
    return _segment(spark, root, segments(spark, root), {"index": rows, "tombstones": graves}, at_step)


def delete_sources(spark: SparkSession, sources: DataFrame, root: str) -> int:
    """Bury the rows of ``sources`` (column source)."""
    return _segment(spark, root, segments(spark, root), {"tombstones": sources.select("source").distinct()}, lambda step: None)


def ingest(spark: SparkSession, inbox: str, root: str, glob: str = "*.txt", at_step: Callable[[str], None] = lambda step: None,
           run_files: int = RUN_FILES, **options) -> dict[str, int]:
    """T1 over a drop folder: S3 -> S1 -> S4 -> S6 -> S7 until no file is pending; files loaded and rejected.

    A file is taken once as it is listed (path, time, length); a path that
    comes again with another time or length replaces its earlier rows. Only
    pending files are read. A file that is not UTF-8 is recorded as rejected,
    with the reason, and not read again. ``options`` go to ``build_index``;
    ``at_step`` is called after every step with its name.
    """
    done = {"loaded": 0, "rejected": 0}
    while True:
        before = segments(spark, root)
        seen = ledger(spark, root).select("path", "modificationTime", "length")
        files = corpus.list_files(spark, inbox, globs=(glob,))
        pending = files.join(seen, ["path", "modificationTime", "length"], "left_anti").orderBy("modificationTime", "path").limit(run_files)
        pending = pending.checkpoint(eager=True)
        paths = [r["path"] for r in pending.select("path").collect()]  # at most run_files names
        if not paths:
            return done
        named = [re.sub(r"([\\*?\[\]{}])", r"\\\1", p) for p in paths]  # names, not patterns
        raw = spark.read.format("binaryFile").load(named).select(F.col("path").alias("source"), "content", F.is_valid_utf8("content").alias("ok"))
        raw = raw.checkpoint(eager=True)  # each file is read once and stays what it was
        docs = raw.where("ok").select(corpus.doc_id_of(F.col("source")).alias("doc_id"), "source", F.col("content").cast("string").alias("text"))
        verdict = raw.select(F.col("source").alias("path"), F.when(F.col("ok"), "loaded").otherwise("rejected").alias("status"),
                             F.when(~F.col("ok"), "invalid utf-8").alias("reason"))
        taken = pending.join(verdict, "path").select("path", "modificationTime", "length", "status", "reason").checkpoint(eager=True)
        again = ledger(spark, root).select(F.col("path").alias("source")).distinct().join(docs.select("source"), "source", "left_semi")
        _segment(spark, root, before, {"index": index_store.build_index(docs, **options), "tombstones": again, "ledger": taken}, at_step)
        for r in taken.groupBy("status").count().collect():
            done[r["status"]] += r["count"]


def compact(spark: SparkSession, root: str) -> int | None:
    """One segment of the rows that count and of the whole ledger, published in place of the others; old folders stay as they are."""
    before = segments(spark, root)
    rows = load(spark, root)
    if not before:
        return None
    name = uuid.uuid4().hex
    if rows is not None:
        rows.write.parquet(f"{root}/segments/{name}/index")
    ledger(spark, root).write.parquet(f"{root}/segments/{name}/ledger")
    return commit(spark, root, before, [name])


def vacuum(spark: SparkSession, root: str) -> list[str]:
    """Delete the segments that the newest version does not name (orphans of crashes, compacted ones); their names."""
    live = set(segments(spark, root))
    gone = [n for n in index_store._names(spark, f"{root}/segments") if n not in live]
    for name in gone:
        fs, p = _fs(spark, f"{root}/segments/{name}")
        fs.delete(p, True)
    return gone
