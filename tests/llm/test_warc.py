import base64
import hashlib
from collections import Counter

import pytest

from ragloom.llm import warc
from ragloom.llm.common import scratch

SCHEMA = "page_id long, url string, html string"
ROWS = [(1, "http://a/", "<p>x</p>"), (2, "http://b/ c\r\nd", "<p>x</p>"), (3, None, None), (4, "u", ""), (5, "v", "a\r\n\r\nWARC/1.1\r\n\r\nb"),
        (6, "w", "é\U0001f600" * 9000), (7, "w", "é\U0001f600" * 9000), (8, "http://ü/", "0\r\n\r\n" * 5000), (None, "n", "only"), (None, "n", "<p>x</p>"),
        (9, "r", "rep"), (9, "r", "rep"), (10, "long", "z" * 300_000), (11, "s", "q" * (warc.SEGMENT_BYTES - 200))]


def plain(rows, least=0):
    out = Counter()
    for page, _, html in rows:
        data = (html or "").encode()
        same = [p for p, _, h in rows if (h or "") == (html or "") and p is not None]
        best = max(same, default=None)
        revisit = best is not None and page != best and len(data) >= least
        out[page, data, base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", best if revisit else None] += 1
    return out


def written(spark, rows, **options):
    path = scratch(spark, "warc")
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'mine' AS payload", "'mine' AS digest", "1 AS number")
    warc.write_archives(df, path, **options)
    return path


@pytest.mark.parametrize("least", [0, 100])
def test_round_trip(spark, least):
    path = written(spark, ROWS, min_revisit=least)
    got = warc.reassembled(warc.read_records(spark, path)).collect()
    found, want = Counter(), plain(ROWS, least)
    texts = {d: b for _, b, d, _, _ in want}
    for r in got:
        if r["kind"] == "response":
            assert bytes(r["payload"]) == texts[r["digest"]]
        assert r["bytes"] == len(texts[r["digest"]])
        found[r["page_id"], texts[r["digest"]], r["digest"], r["kind"], r["refers_to"]] += 1
    assert found == want


def test_archives_are_plain_warc(spark):
    path = written(spark, ROWS)
    records = [x for r in spark.read.format("binaryFile").load(path).collect() for x in warc.parsed(bytes(r["content"]))]
    ids = [f["warc-record-id"] for f, _ in records]
    assert len(ids) == len(set(ids))
    origins = {f["warc-segment-origin-id"] for f, _ in records if f["warc-type"] == "continuation"}
    assert origins and all(len(b) <= warc.SEGMENT_BYTES for _, b in records)
    for o in origins:
        parts = sorted(((int(f["warc-segment-number"]), f, b) for f, b in records if o in (f["warc-record-id"], f.get("warc-segment-origin-id"))),
                       key=lambda x: x[0])
        assert [n for n, _, _ in parts] == list(range(1, len(parts) + 1))
        assert [f.get("warc-segment-total-length") for _, f, _ in parts] == [None] * (len(parts) - 1) + [str(sum(len(b) for _, _, b in parts))]


def test_missing_segment_is_an_error(spark):
    records = warc.read_records(spark, written(spark, ROWS))
    for broken in (records.where("number is null or number <> 2"), records.where("total is null"),
                   records.union(records.where("number = 2"))):
        with pytest.raises(Exception, match="segments"):
            warc.reassembled(broken).collect()


def test_chunked_framing():
    for n in (0, 1, 4096, 4097, 10_000):
        body = bytes(range(256)) * 40
        assert warc.unchunked(warc.chunked(body[:n])) == body[:n]
    assert warc.unchunked(b"3;x=1\r\nabc\r\n0\r\nTrailer: 1\r\n\r\n") == b"abc"
    for bad in (b"5\r\nabc\r\n0\r\n\r\n", b"3\r\nabcd\r\n0\r\n\r\n", b"3\r\nabc\r\n", b""):
        with pytest.raises(ValueError):
            warc.unchunked(bad)


def test_shuffled_classes_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_CLASSES", 0)
    got = warc.reassembled(warc.read_records(spark, written(spark, ROWS)))
    assert Counter((r["page_id"], r["digest"], r["kind"], r["refers_to"]) for r in got.collect()) == Counter(
        {(p, d, k, t): n for (p, _, d, k, t), n in plain(ROWS).items()})


def test_empty(spark):
    assert warc.reassembled(warc.read_records(spark, written(spark, []))).count() == 0
