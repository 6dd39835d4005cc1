"""Drop-folder ingest: a crash between any two steps neither repeats nor loses a file; replacements rewrite nothing."""

import os
import time

import pytest
from pyspark.sql import functions as F

from ragloom.sources import index_store, ingest


class Crash(Exception):
    pass


def crash_at(step):
    def at_step(done):
        if done == step:
            raise Crash(done)
    return at_step


def write(path, text):
    with open(path, "wb") as f:
        f.write(text if isinstance(text, bytes) else text.encode())


def rows(spark, root):
    found = ingest.load(spark, root)
    return [] if found is None else sorted((os.path.basename(r["source"]), r["chunk_no"], r["text"]) for r in found.collect())


def statuses(spark, root):
    return sorted((os.path.basename(r["path"]), r["status"]) for r in ingest.ledger(spark, root).collect())


@pytest.mark.parametrize("step", ["index", "tombstones", "ledger", "manifest"])
def test_crash_after_any_step(spark, tmp_path, step):
    inbox, root = str(tmp_path / "inbox"), str(tmp_path / "index")
    os.mkdir(inbox)
    write(f"{inbox}/a.txt", "one")
    write(f"{inbox}/b [1]{{x}}.txt", "two")
    write(f"{inbox}/bad.txt", b"\xff\xfe")
    write(f"{inbox}/skip.md", "no")
    with pytest.raises(Crash):
        ingest.ingest(spark, inbox, root, at_step=crash_at(step), fixed=True)
    if step != "manifest":  # nothing was published
        assert rows(spark, root) == [] and statuses(spark, root) == []
    ingest.ingest(spark, inbox, root, fixed=True)
    assert [r[2] for r in rows(spark, root)] == ["one", "two"]
    assert [s for _, s in statuses(spark, root)] == ["loaded", "loaded", "rejected"]
    assert ingest.ingest(spark, inbox, root, fixed=True) == {"loaded": 0, "rejected": 0}
    orphans = ingest.vacuum(spark, root)
    assert len(orphans) == (step != "manifest") and [r[2] for r in rows(spark, root)] == ["one", "two"]


def test_changed_file_replaces_its_rows_without_a_rewrite(spark, tmp_path):
    inbox, root = str(tmp_path / "inbox"), str(tmp_path / "index")
    os.mkdir(inbox)
    for n in ("a", "b", "c"):
        write(f"{inbox}/{n}.txt", f"first {n}")
    assert ingest.ingest(spark, inbox, root, run_files=2, fixed=True) == {"loaded": 3, "rejected": 0}
    assert len(ingest.segments(spark, root)) == 2  # runs of at most two files
    before = {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(f"{root}/segments") for f in fs}
    time.sleep(1.1)
    write(f"{inbox}/b.txt", "second, longer b")
    write(f"{inbox}/d.txt", "d")
    assert ingest.ingest(spark, inbox, root, fixed=True) == {"loaded": 2, "rejected": 0}
    want = [("a.txt", 0, "first a"), ("b.txt", 0, "second, longer b"), ("c.txt", 0, "first c"), ("d.txt", 0, "d")]
    assert rows(spark, root) == want
    assert all(os.stat(f).st_mtime_ns == t for f, t in before.items())
    ingest.compact(spark, root)
    assert rows(spark, root) == want and len(ingest.segments(spark, root)) == 1 and len(statuses(spark, root)) == 5
    assert all(os.path.exists(f) for f in before) and len(ingest.vacuum(spark, root)) == 3
    assert rows(spark, root) == want and ingest.ingest(spark, inbox, root, fixed=True)["loaded"] == 0


def test_two_writers(spark, tmp_path):
    root = str(tmp_path / "index")
    df = spark.createDataFrame([("s", 1)], "source string, x int")
    ingest.replace_sources(spark, df, root)
    seen = ingest.segments(spark, root)
    ingest.replace_sources(spark, df, root)
    with pytest.raises(RuntimeError):
        ingest.commit(spark, root, seen, [*seen, "late"])
    assert ingest.load(spark, root).count() == 1


def test_replace_and_delete_with_null_sources(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "index")
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2), (None, 3)], "source string, x int")
    for bound in (500_000, 0):
        monkeypatch.setattr(ingest, "BROADCAST_SOURCES", bound)
        where = f"{root}-{bound}"
        ingest.replace_sources(spark, df, where)
        ingest.replace_sources(spark, df.where("x <> 2").withColumn("x", F.col("x") * 10), where)
        ingest.delete_sources(spark, df.where("x = 2"), where)
        # rows without a source are never replaced
        assert sorted(r["x"] for r in ingest.load(spark, where).collect()) == [3, 10, 10, 30]
    assert ingest.load(spark, f"{root}-none") is None and ingest.compact(spark, f"{root}-none") is None
    assert index_store.load_index(spark, f"{root}-none") is None
