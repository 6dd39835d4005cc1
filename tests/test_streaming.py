"""Streaming jobs agree with their batch counterparts on the same input."""

import datetime as dt
import os
from bisect import bisect_right

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from ragloom.operators import traffic
from ragloom.plans import catalog as C

from .conftest import SF_SMALL

pytestmark = pytest.mark.skipif(not os.path.exists(SF_SMALL), reason="driver tables absent")


def test_stream_fixed_verdicts_equal_batch(spark):
    rows = E.queries()["stream_fixed_window_verdicts"](spark, SF_SMALL)
    late = rows.where("late")
    events = spark.read.parquet(f"{SF_SMALL}/events.parquet").join(late, "event_id", "left_anti")
    b = {r["event_id"]: r["allowed"] for r in traffic.fixed_window_limit(events, C.RL_LIMIT, C.RL_WINDOW_S).collect()}
    assert {r["event_id"]: r["allowed"] for r in rows.where("not late").collect()} == b
    assert 0 < late.count() < len(b) // 20 and late.where("allowed is not null").count() == 0


def test_stream_counts_equal_batch(spark):
    s = {(r["window_start"], r["user_id"], r["event_type"]): r["requests"]
         for r in E.queries()["stream_window_counts"](spark, SF_SMALL).collect()}
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    b = {(r["w"], r["user_id"], r["event_type"]): r["n"] for r in
         ev.groupBy(F.date_trunc("day", F.col("ts").cast("timestamp")).alias("w"), "user_id", "event_type")
           .count().withColumnRenamed("count", "n").collect()}
    assert s == b


def test_stream_moving_accepted_only(spark):
    rows = E.queries()["stream_moving_window_verdicts"](spark, SF_SMALL).collect()
    late = {r["event_id"] for r in rows if r["late"]}
    got = {r["event_id"]: r["allowed"] for r in rows}
    events = spark.read.parquet(f"{SF_SMALL}/events.parquet").collect()
    width, acc, exp = dt.timedelta(seconds=C.RL_WINDOW_S), {}, {i: None for i in late}
    for r in sorted(events, key=lambda r: (r["ts"], r["event_id"])):
        if r["event_id"] not in late:
            a = acc.setdefault((r["user_id"], r["event_type"]), [])
            ok = len(a) - bisect_right(a, r["ts"] - width) < C.RL_LIMIT
            exp[r["event_id"]] = ok
            if ok:
                a.append(r["ts"])
    assert got == exp and 0 < len(late) < len(events) // 20


def test_incremental_index_covers_all_documents(spark):
    idx = E.queries()["stream_incremental_index"](spark, SF_SMALL)
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").filter(F.length("text") > 0)
    assert idx.select("doc_id").distinct().count() == docs.count()
    assert len({f.split("batch_id=")[1].split("/")[0] for f in idx.inputFiles()}) > 1  # several micro-batches
    assert idx.filter(F.col("dim") != 512).count() == 0


def test_incremental_index_rerun_adds_nothing(spark, tmp_path):
    from ragloom.streaming import jobs
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "source", "text")
    inbox = str(tmp_path / "inbox")
    docs.limit(20).write.parquet(inbox)
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    jobs.incremental_index(jobs.table_stream(spark, inbox, "*.parquet", docs.schema), out, ck)
    n1 = spark.read.parquet(f"{out}/index").count()
    jobs.incremental_index(jobs.table_stream(spark, inbox, "*.parquet", docs.schema), out, ck)
    assert spark.read.parquet(f"{out}/index").count() == n1


def test_stream_screen_matches_batch(spark):
    s = {(r["conv_id"], r["turn"]): (r["ok"], r["intent"]) for r in
         E.queries()["stream_screen_questions"](spark, SF_SMALL).collect()}
    v = {(r["conv_id"], r["turn"]): r["ok"] for r in E.queries()["validate_questions"](spark, SF_SMALL).collect()}
    assert {k: ok for k, (ok, _) in s.items()} == v


def test_late_rows_side_count(spark, tmp_path):
    import datetime as dt
    from ragloom.streaming import jobs
    inbox = tmp_path / "inbox"
    schema = "event_id long, ts timestamp_ntz, user_id long"
    t0 = dt.datetime(2024, 1, 1, 12, 0, 0)
    spark.createDataFrame([(1, t0, 1), (2, t0 + dt.timedelta(minutes=10), 1)], schema) \
        .coalesce(1).write.parquet(str(inbox / "a"))
    # second drop: one row 3 minutes behind the first batch's maximum (late), one on time
    spark.createDataFrame([(3, t0 + dt.timedelta(minutes=7), 1), (4, t0 + dt.timedelta(minutes=9), 1)], schema) \
        .coalesce(1).write.parquet(str(inbox / "b"))
    sch = spark.read.parquet(str(inbox / "a")).schema
    stream = (spark.readStream.schema(sch).option("maxFilesPerTrigger", 1)
              .option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(str(inbox)))
    out = str(tmp_path / "out")
    jobs.late_rows_side_count(stream, out, str(tmp_path / "ck"), delay_seconds=120)
    late = {r["batch_id"]: r["late_rows"] for r in spark.read.parquet(out + "/late").collect()}
    assert sorted(late.values()) == [0, 1]


def test_a_table_that_is_a_folder_streams_like_a_file(spark, tmp_path):
    from ragloom.streaming import jobs
    for name in ("conversations", "events"):
        spark.read.parquet(f"{SF_SMALL}/{name}.parquet").repartition(3).write.parquet(str(tmp_path / f"{name}.parquet"))
    want = {tuple(r) for r in E.queries()["stream_screen_questions"](spark, SF_SMALL).collect()}
    got = E.queries()["stream_screen_questions"](spark, str(tmp_path)).collect()  # failed before
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    schema = spark.read.parquet(f"{SF_SMALL}/events.parquet").schema
    stream = jobs.one_table_stream(spark, str(tmp_path / "events.parquet"), schema, max_files_per_trigger=1)
    jobs.run_available(stream.select("event_id").writeStream.format("parquet").option("path", str(tmp_path / "out")), str(tmp_path / "ck"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == spark.read.parquet(f"{SF_SMALL}/events.parquet").count()
