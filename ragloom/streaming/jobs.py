"""Structured Streaming jobs.

* T1 ``incremental_index``: a file stream of new documents; every
  micro-batch is chunked, embedded and written to ``index/batch_id=<n>``
  with overwrite (foreachBatch is at-least-once, the batch directory makes
  a replay idempotent) and recorded in a ledger. The checkpoint fixes which
  files belong to which batch, so a re-run adds nothing.
* T2 ``stream_window_counts``: watermark + tumbling window counts per key.
* T2 ``stream_fixed_window_verdicts`` / T3 ``stream_moving_window_verdicts``:
  per-request admit/reject with ``applyInPandasWithState``; state per key is a
  count for every window the watermark may still reach, or the accepted
  instants of that time, and is dropped by an event-time timeout once the
  key is idle.
* T4 ``stream_screen``: validation and routing are plain column functions,
  so they run unchanged on a streaming DataFrame.

All sinks write below a caller-given folder; the registered jobs use the session's
checkpoint folder (``spark.checkpoint.dir``).
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import chunk as chunk_ops
from ..operators import embed as embed_ops
from ..operators import route as route_ops
from ..operators import traffic as traffic_ops
from ..operators import validate as val_ops

MICROS = 1_000_000


def table_stream(spark: SparkSession, directory: str, file_glob: str, schema: T.StructType,
                 max_files_per_trigger: int | None = None, fmt: str = "parquet") -> DataFrame:
    """A file stream over the files of ``directory`` matching ``file_glob``."""
    r = spark.readStream.schema(schema).format(fmt).option("pathGlobFilter", file_glob)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(directory)


def one_table_stream(spark: SparkSession, path: str, schema: T.StructType, max_files_per_trigger: int | None = None) -> DataFrame:
    """A file stream over one Parquet table, be it a file or a folder of files."""
    folder, _, name = path.rstrip("/").rpartition("/")
    r = spark.readStream.schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    # a pattern that only this name matches: for a plain path the source takes a file for the base folder of its partitions
    return r.parquet(f"{folder}/[{name[0]}]{name[1:]}")


def run_available(query_builder, checkpoint: str):
    """Start with ``trigger(availableNow=True)`` and wait for the end."""
    q = query_builder.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


# ------------------------------------------------------------------------ T1
def incremental_index(docs_stream: DataFrame, out_root: str, checkpoint: str,
                      size: int = 800, overlap: int = 150, fixed: bool = False,
                      embedder_factory=None):
    """Append chunks + vectors of every new document batch to the index."""
    def per_batch(batch: DataFrame, batch_id: int) -> None:
        batch = batch.repartition(batch.sparkSession.sparkContext.defaultParallelism)  # a few files are few tasks
        chunker = chunk_ops.chunk_documents_fixed if fixed else chunk_ops.chunk_documents
        chunks = chunker(batch, size, overlap)
        idx = embed_ops.embed(chunks, "text", "embedding", embedder_factory)
        idx.write.mode("overwrite").parquet(f"{out_root}/index/batch_id={batch_id}")
        (batch.select("doc_id", F.lit("loaded").alias("status"),
                      F.lit(batch_id).cast("long").alias("batch_id"))
         .write.mode("overwrite").parquet(f"{out_root}/ledger/batch_id={batch_id}"))

    return run_available(docs_stream.writeStream.foreachBatch(per_batch), checkpoint)


# ------------------------------------------------------------------------ T2
def stream_window_counts(requests: DataFrame, width_seconds: int, limit: int,
                         key_cols=("user_id", "event_type"), ts: str = "ts",
                         watermark: str = "2 minutes") -> DataFrame:
    """T2 counts: requests per key and tumbling window, flagged over the limit.

    Rows older than the watermark (max event time - ``watermark``) are
    dropped by the stateful aggregation.
    """
    t = F.col(ts).cast("timestamp")
    return (requests.withColumn("_t", t).withWatermark("_t", watermark)
            .groupBy(F.window("_t", f"{width_seconds} seconds").alias("w"), *key_cols)
            .agg(F.count(F.lit(1)).alias("requests"))
            .select(F.col("w.start").alias("window_start"), *key_cols, "requests",
                    (F.col("requests") > limit).alias("over_limit")))


VERDICT_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("allowed", T.BooleanType()),
])


def _set_timeout(state: GroupState, ms: int) -> None:
    """Event-time timeout no earlier than just after the current watermark."""
    wm = state.getCurrentWatermarkMs()
    state.setTimeoutTimestamp(max(ms, wm + 1))


def _in_order(pdfs: Iterator[pd.DataFrame], id_col: str) -> Iterator[tuple[int, int]]:
    """(instant, id) of a key's rows of one micro-batch in time order.

    Only two integers a row are held; ``maxFilesPerTrigger`` on the source
    bounds the micro-batch.
    """
    parts = [(p["_us"].to_numpy(np.int64), p[id_col].to_numpy(np.int64)) for p in pdfs]
    if parts:
        us, ids = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((ids, us))
        yield from zip(us[order].tolist(), ids[order].tolist())


def stream_fixed_window_verdicts(requests: DataFrame, width_seconds: int, limit: int,
                                 key_cols=("user_id", "event_type"), ts: str = "ts",
                                 id_col: str = "event_id", watermark: str = "2 minutes") -> DataFrame:
    """T2 per request: the first ``limit`` requests of a key in each window pass.

    A count is kept for every window that the watermark may still reach, so
    requests that arrive out of order are counted in their own window. First
    means first to arrive; inside a micro-batch it means first in time.
    """
    W = width_seconds * MICROS

    def fn(key, pdfs, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        counts = dict(zip(*state.get)) if state.exists else {}
        ids, allowed = [], []
        for us, eid in _in_order(pdfs, id_col):
            w = us - us % W
            counts[w] = counts.get(w, 0) + 1
            ids.append(eid)
            allowed.append(counts[w] <= limit)
        passed = state.getCurrentWatermarkMs() * 1000
        counts = {w: n for w, n in counts.items() if w + W > passed}
        if counts:
            state.update((list(counts), list(counts.values())))
            _set_timeout(state, int((max(counts) + W) // 1000) + 1)
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"event_id": pd.Series(ids, dtype="int64"),
                            "allowed": pd.Series(allowed, dtype=bool)})

    staged = (requests.withColumn("_tl", F.col(ts).cast("timestamp")).withWatermark("_tl", watermark)
              .withColumn("_us", F.unix_micros("_tl")).select(*key_cols, id_col, "_us", "_tl"))
    return staged.groupBy(*key_cols).applyInPandasWithState(
        fn, VERDICT_SCHEMA, T.StructType([T.StructField("windows", T.ArrayType(T.LongType())),
                                          T.StructField("counts", T.ArrayType(T.LongType()))]),
        "append", GroupStateTimeout.EventTimeTimeout)


def stream_moving_window_verdicts(requests: DataFrame, width_seconds: int, limit: int,
                                  key_cols=("user_id", "event_type"), ts: str = "ts",
                                  id_col: str = "event_id", watermark: str = "2 minutes") -> DataFrame:
    """Moving window counting accepted requests only (rejections do not count)."""
    W = width_seconds * MICROS

    def fn(key, pdfs, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        acc = sorted(state.get[0]) if state.exists else []
        ids, allowed = [], []
        for us, eid in _in_order(pdfs, id_col):
            # accepted requests less than a window away, earlier or (out of order) later
            ok = bisect_left(acc, us + W) - bisect_right(acc, us - W) < limit
            if ok:
                insort(acc, us)
            ids.append(eid)
            allowed.append(ok)
        passed = state.getCurrentWatermarkMs() * 1000
        acc = acc[bisect_right(acc, passed - W):]
        if acc:
            state.update((acc,))
            _set_timeout(state, int((acc[-1] + W) // 1000) + 1)
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"event_id": pd.Series(ids, dtype="int64"),
                            "allowed": pd.Series(allowed, dtype=bool)})

    staged = (requests.withColumn("_tl", F.col(ts).cast("timestamp")).withWatermark("_tl", watermark)
              .withColumn("_us", F.unix_micros("_tl")).select(*key_cols, id_col, "_us", "_tl"))
    return staged.groupBy(*key_cols).applyInPandasWithState(
        fn, VERDICT_SCHEMA, T.StructType([T.StructField("acc", T.ArrayType(T.LongType()))]),
        "append", GroupStateTimeout.EventTimeTimeout)


def late_rows_side_count(requests: DataFrame, out_root: str, checkpoint: str, ts: str = "ts",
                         delay_seconds: int = 120):
    """Side count of rows a watermarked stateful operator would drop as late.

    Spark's watermark for a micro-batch is the maximum event time of the
    earlier batches minus the delay; stateful operators silently drop rows
    older than it. This job applies the same rule per batch and writes
    ``late/batch_id=<n>`` (late row counts) and ``max/batch_id=<n>`` (running
    maximum event time, a one-row table) below ``out_root``.
    """
    def per_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        prev = None
        if batch_id > 0:
            prev = spark.read.parquet(f"{out_root}/max").filter(F.col("batch_id") < batch_id) \
                .agg(F.max("max_us")).first()[0]
        us = F.unix_micros(F.col(ts).cast("timestamp"))
        stats = batch.agg(F.max(us).alias("max_us"),
                          F.sum(F.when(F.lit(prev is not None) &
                                       (us < F.lit((prev or 0) - delay_seconds * MICROS)), 1)
                                .otherwise(0)).alias("late_rows"),
                          F.count(F.lit(1)).alias("rows")).first()
        spark.createDataFrame([(batch_id, int(stats["late_rows"] or 0), int(stats["rows"]))],
                              "batch_id long, late_rows long, rows long") \
            .write.mode("overwrite").parquet(f"{out_root}/late/batch_id={batch_id}")
        best = max(x for x in (prev, stats["max_us"]) if x is not None) \
            if (prev is not None or stats["max_us"] is not None) else None
        spark.createDataFrame([(best,)], "max_us long") \
            .write.mode("overwrite").parquet(f"{out_root}/max/batch_id={batch_id}")

    return run_available(requests.writeStream.foreachBatch(per_batch), checkpoint)


# ------------------------------------------------------------------------ T4
def stream_bots(requests: DataFrame, **options) -> DataFrame:
    """T4: bot verdict of every arriving request (stateless, the batch operator F5)."""
    return traffic_ops.detect_bots(requests, **options)


def stream_screen(questions: DataFrame, text_col: str = "text") -> DataFrame:
    """T4: validation then routing of every arriving question (stateless)."""
    v = val_ops.validate_questions(questions, text_col)
    r = route_ops.route_questions(v, text_col)
    routed_cols = ["intent", "confidence", "method", "skip_rag", "response"]
    return r.select(*[c for c in r.columns if c not in routed_cols],
                    *[F.when(F.col("ok"), F.col(c)).alias(c) for c in routed_cols])
