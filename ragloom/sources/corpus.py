"""Corpus sources and sinks.

Files are read by Spark's file sources (``binaryFile`` / ``text``) so the
listing, splitting and reading are distributed; a file that is not valid
UTF-8 goes to a rejects table instead of failing the job. The set of files
still to load is a left-anti join of the listing with a ledger table keyed
by (path, modification time, length).
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Tasks a slot that a folder of many small files is read in, and bytes of a task beyond that. Files come longest first and
#: tasks take as many each, so the first task of a few would hold most of the bytes.
SCAN_WAVES = 4
SCAN_BYTES = 4 << 20
#: Files of a folder that ``write_text_files`` writes, and files listed at a time: the driver holds about a kilobyte for each.
FOLDER_FILES = 1000
LISTED_FILES = 100_000

LEDGER_SCHEMA = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("modificationTime", T.TimestampType()),
    T.StructField("length", T.LongType()),
    T.StructField("status", T.StringType()),
    T.StructField("batch_id", T.LongType()),
])


def doc_id_of(path_col) -> F.Column:
    """Stable bigint id of a source path."""
    return F.xxhash64(path_col)


def _few_tasks(files: DataFrame) -> DataFrame:
    """Small files packed by their bytes: the planner takes each for four megabytes, so a folder of many would be thousands
    of tasks, with as many files written behind them."""
    size = int(str(files._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    tasks = max(SCAN_WAVES * files.sparkSession.sparkContext.defaultParallelism, -(-size // SCAN_BYTES))
    return files.coalesce(tasks)


def _listed_together(folders: Iterable[tuple[str, int]], most: int) -> list[list[str]]:
    """(folder, files) dealt to groups of up to ``most`` files, one folder at least."""
    groups, held = [], 0
    for folder, n in sorted(folders):
        if not groups or held + n > most:
            groups.append([])
            held = 0
        groups[-1].append(folder)
        held += n
    return groups


def write_text_files(texts: DataFrame, path: str, folder_files: int = FOLDER_FILES, listed_files: int = LISTED_FILES) -> list[list[str]]:
    """Every text (the only column) as a file of its own that ends in a line break; the folders below ``path``, in groups to scan at a time.

    Hadoop's local file system starts ``chmod`` for every file it creates, and
    the driver moves each once more when the job is committed. On such a store
    tasks write their files themselves, an attempt into folders of its own:
    those of the attempts that ended are returned.
    """
    spark = texts.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.getUri().getScheme() != "file":
        texts.write.option("maxRecordsPerFile", 1).text(path)
        return [[path]]
    fs.mkdirs(p)
    root = fs.makeQualified(p).toUri().getPath()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n, folder = TaskContext.get(), 0, None
        done = []
        for batch in batches:
            for text in batch.column(0):
                if n % folder_files == 0:
                    folder = os.path.join(root, f"{task.partitionId()}-{task.taskAttemptId()}-{n // folder_files}")
                    os.makedirs(folder)
                    done.append([folder, 0])
                with open(os.path.join(folder, f"{n}.txt"), "xb") as f:
                    f.write((text.as_py() or b"") + b"\n")
                n += 1
                done[-1][1] += 1
        yield pa.RecordBatch.from_pydict({"folder": pa.array([x for x, _ in done], pa.string()), "files": pa.array([x for _, x in done], pa.int64())})

    written = texts.select(F.col(texts.columns[0]).cast("binary")).mapInArrow(write, "folder string, files long").collect()
    return _listed_together(((r["folder"], r["files"]) for r in written), listed_files) or [[path]]


def scan_text_corpus(spark: SparkSession, path: str | list[str], glob: str = "*.txt",
                     recursive: bool = True) -> tuple[DataFrame, DataFrame]:
    """One document per file of a folder or several -> (documents, rejects).

    documents: (doc_id, source, text, n_chars); rejects: (source, reason).
    """
    raw = (spark.read.format("binaryFile").option("pathGlobFilter", glob)
           .option("recursiveFileLookup", str(recursive).lower()).load(path))
    staged = _few_tasks(raw).select(F.col("path").alias("source"), F.col("content"),
                                    F.is_valid_utf8(F.col("content")).alias("_ok"))
    docs = (staged.filter("_ok")
            .select(doc_id_of(F.col("source")).alias("doc_id"), "source",
                    F.col("content").cast("string").alias("text"))
            .withColumn("n_chars", F.length("text").cast("long")))
    rejects = staged.filter(~F.col("_ok")).select("source", F.lit("invalid utf-8").alias("reason"))
    return docs, rejects


def scan_pages(pages: DataFrame, source_col: str = "source", page_col: str = "page",
               text_col: str = "text") -> DataFrame:
    """A page-grain table becomes one document per (source, page)."""
    return pages.select(F.xxhash64(F.col(source_col), F.col(page_col)).alias("doc_id"),
                        F.col(source_col).alias("source"), F.col(page_col).cast("int").alias("page"),
                        F.col(text_col).alias("text"))


def file_identity(spark: SparkSession, path: str) -> tuple[tuple[str, int, int], ...]:
    """(name, length, modification time) of the files of a table, asked of the store that holds it; nothing is read."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p)
    return tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in found))


def list_files(spark: SparkSession, path: str, globs=("*.pdf", "*.txt"),
               recursive: bool = True) -> DataFrame:
    """(path, modificationTime, length) of matching files; file contents are not read."""
    out = None
    for g in globs:
        df = (spark.read.format("binaryFile").option("pathGlobFilter", g)
              .option("recursiveFileLookup", str(recursive).lower()).load(path)
              .select("path", "modificationTime", "length"))
        out = df if out is None else out.unionByName(df)
    return out


def empty_ledger(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], LEDGER_SCHEMA)


def pending_documents(spark: SparkSession, inbox: str, ledger: DataFrame | None = None) -> DataFrame:
    """S3: files of the inbox not yet in the ledger (same path, mtime and length)."""
    files = list_files(spark, inbox)
    if ledger is None:
        return files
    done = ledger.filter(F.col("status") == "loaded").select("path", "modificationTime", "length")
    return files.join(done, ["path", "modificationTime", "length"], "left_anti")


def pending_names(pending: DataFrame) -> DataFrame:
    """S3 base names of the pending files, one row each (count with ``.count()``)."""
    return pending.select(F.element_at(F.split("path", "/"), -1).alias("name"), "path")


def mark_loaded(files: DataFrame, batch_id: int) -> DataFrame:
    """Ledger rows for loaded files (append them to the ledger table)."""
    return files.select("path", "modificationTime", "length", F.lit("loaded").alias("status"),
                        F.lit(batch_id).cast("long").alias("batch_id"))


def load_pending(spark: SparkSession, inbox: str, root: str, **options) -> int:
    """T1 over text files: loads what is pending (``sources.ingest``); the number of files loaded."""
    from . import ingest
    return ingest.ingest(spark, inbox, root, **options)["loaded"]


def write_clean_corpus(cleaned: DataFrame, out: str, root: str, mode: str = "overwrite") -> None:
    """Cleaned text per file, keyed by the path relative to ``root``."""
    rel = F.regexp_replace(F.col("source"), "^(file:)?" + root.rstrip("/") + "/", "")
    (cleaned.withColumn("relative_path", rel)
     .select("relative_path", "clean_text", "total_lines", "removed_lines")
     .write.mode(mode).parquet(out))


def clean_corpus_job(spark: SparkSession, in_dir: str, out: str, min_length: int = 50):
    """Scan (S1) -> clean (P3) -> statistics (A1) -> write.

    Returns (per-file statistics, totals, rejects) as DataFrames; the cleaned
    texts are written to ``out``.
    """
    from ..operators import clean as clean_ops
    docs, rejects = scan_text_corpus(spark, in_dir)
    cleaned = clean_ops.clean_documents(docs, min_length=min_length, keep_columns=("doc_id", "source"))
    cleaned = cleaned.checkpoint(eager=True)  # written and summarised from one pass
    write_clean_corpus(cleaned, out, in_dir)
    return cleaned.drop("clean_text"), clean_ops.cleaning_totals(cleaned), rejects
