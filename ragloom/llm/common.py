"""Helpers shared by the operators of this package."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ragloom.session import ensure_checkpoint_dir, ship_package


def prepare(spark: SparkSession) -> None:
    """Shared checkpoint folder (the cluster's own if it names one), package on the executors."""
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        ensure_checkpoint_dir(spark)
    ship_package(spark)


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder; lost executors cost no recomputation."""
    prepare(df.sparkSession)
    return df.checkpoint()


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder for files that one call writes and reads back."""
    prepare(spark)
    base = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return f"{base}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete ``path`` through the file system that holds it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def input_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def id_key(doc_id: Column, text: Column) -> Column:
    """A string key of a row: the id, or the text's digest where the id is null."""
    return F.coalesce(doc_id.cast("string"), F.md5(text), F.lit(""))


WORD_CLASS = r"[^\x20\x09-\x0D]+"
