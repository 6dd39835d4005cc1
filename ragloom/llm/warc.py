"""WARC archives: writing segmented records and reassembling them.

A page becomes a ``response`` record whose block is an HTTP message with a
chunked body, or a ``revisit`` of the response that holds the same payload.
A block longer than a segment goes on in ``continuation`` records that name
the first record's id, their number and, on the last, the total length. The
reader takes single records as they are; segments are grouped by origin,
ordered by number, checked for gaps and total length, joined and unchunked.

Records are rows of Spark's text writer with the blank lines that end a
record as row separator, so archives are committed like any other output and
may lie in any store. An archive holds at most FILE_RECORDS records of at
most SEGMENT_BYTES, which bounds what a reader holds of it.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ragloom.llm.common import prepare

SEGMENT_BYTES = 16 << 10
CHUNK_BYTES = 4 << 10
FILE_RECORDS = 4096
#: Payloads of at least so many bytes are stored once.
MIN_REVISIT = 0
#: Payload classes with copies that are broadcast (digest, id, address); more are joined by shuffle.
BROADCAST_CLASSES = 100_000
DATE = "2000-01-01T00:00:00Z"
_END = b"\r\n\r\n"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
_CHUNKED = b"Transfer-Encoding: chunked\r\n"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1."""
    def four(k: int) -> list[Column]:  # 20 bits, five hex digits, four letters
        v = F.conv(F.substring(F.sha1(payload), 1 + 5 * k, 5), 16, 10).cast("int")
        return [F.substring(F.lit(_BASE32), F.shiftright(v, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*[x for k in range(8) for x in four(k)])


# --- bytes ---------------------------------------------------------------------------------------

def chunked(body: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = [b"%x\r\n%s\r\n" % (len(body[i:i + size]), body[i:i + size]) for i in range(0, len(body), size)]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(framed: bytes) -> bytes:
    """Body of chunked framing; extensions and trailers are allowed, anything amiss is an error."""
    out, at = [], 0
    while True:
        end = framed.index(b"\r\n", at)
        size = int(framed[at:end].split(b";")[0], 16)
        at = end + 2
        if not size:
            if not framed.endswith(b"\r\n", at):
                raise ValueError("chunked body does not end")
            return b"".join(out)
        out.append(framed[at:at + size])
        if len(out[-1]) != size or framed[at + size:at + size + 2] != b"\r\n":
            raise ValueError("chunk is cut short")
        at += size + 2


def http_payload(block: bytes) -> bytes:
    """Body of an HTTP message, its transfer coding undone."""
    head, _, body = block.partition(_END)
    fields = [x.partition(b":") for x in head.lower().split(b"\r\n")[1:]]
    coded = any(k == b"transfer-encoding" and v.strip() == b"chunked" for k, _, v in fields)
    return unchunked(body) if coded else body


def _field(value) -> bytes:
    return re.sub(rb"[\x00-\x20\x7f]", lambda m: b"%%%02X" % m[0][0], str(value).encode("utf-8", "surrogatepass"))


def record(kind: str, record_id: str, fields: list[tuple[str, object]], block: bytes) -> bytes:
    """A record without the two line ends behind it; fields without a value are left out."""
    all_fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{record_id}>"), ("WARC-Date", DATE), *fields,
                  ("Content-Length", len(block))]
    return b"WARC/1.1\r\n" + b"".join(b"%s: %s\r\n" % (k.encode(), _field(v)) for k, v in all_fields if v is not None) + b"\r\n" + block


def segmented(record_id: str, fields: list[tuple[str, object]], block: bytes, size: int = SEGMENT_BYTES) -> Iterator[bytes]:
    """A response, in as many records as its block needs."""
    if len(block) <= size:
        yield record("response", record_id, [*fields, ("Content-Type", "application/http;msgtype=response")], block)
        return
    n = -(-len(block) // size)
    for k in range(n):
        part = block[k * size:(k + 1) * size]
        if not k:
            yield record("response", record_id, [*fields, ("Content-Type", "application/http;msgtype=response"), ("WARC-Segment-Number", 1)], part)
        else:
            own = str(uuid.uuid5(uuid.UUID(record_id), str(k)))
            yield record("continuation", own, [
                fields[0], ("WARC-Segment-Origin-ID", f"<urn:uuid:{record_id}>"), ("WARC-Segment-Number", k + 1),
                ("WARC-Segment-Total-Length", len(block) if k + 1 == n else None)], part)


def parsed(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields by lower-case name, block) of every record of an archive."""
    at = 0
    while at < len(archive):
        end = archive.index(_END, at)
        lines = archive[at:end].split(b"\r\n")
        if not lines[0].startswith(b"WARC/1."):
            raise ValueError(f"no record at byte {at}")
        fields = {}
        for x in lines[1:]:
            k, _, v = x.partition(b":")
            fields[k.decode().lower()] = v.strip().decode("utf-8", "surrogatepass")
        at = end + 4 + int(fields["content-length"])
        yield fields, archive[end + 4:at]
        if archive[at:at + 4] != _END:
            raise ValueError(f"record is cut short at byte {at}")
        at += 4


# --- jobs ----------------------------------------------------------------------------------------

def write_archives(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html",
                   min_revisit: int = MIN_REVISIT) -> None:
    """Write one record a row to archives below ``path``.

    Null html is an empty payload, a null url leaves the address out. Of rows
    with equal payloads those with the largest page_id are responses (all of
    them, if it is repeated; all rows, if every id is null), the others
    revisits. Other columns are ignored; no rows, no records. The pages
    themselves are shuffled only if more payload classes have copies than
    may be broadcast.
    """
    prepare(pages.sparkSession)
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"),
                        F.coalesce(F.col(html), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("bytes", F.octet_length("payload").cast("long")).withColumn("digest", base32_sha1(F.col("payload")))
    classes = (rows.select("page_id", "url", "bytes", "digest").where(F.col("bytes") >= min_revisit).groupBy("digest", "bytes")
               .agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("page_id", "url")).alias("first"))
               .where("n > 1 and first.page_id is not null")
               .select(F.col("digest").alias("__d"), F.col("bytes").alias("__b"), F.col("first.page_id").alias("of"), F.col("first.url").alias("of_url")))
    bounded = classes.limit(BROADCAST_CLASSES + 1).count() <= BROADCAST_CLASSES
    dealt = rows.join(F.broadcast(classes) if bounded else classes,
                      (F.col("digest") == F.col("__d")) & (F.col("bytes") == F.col("__b")), "left")
    dealt = dealt.withColumn("revisit", F.col("of").isNotNull() & ~F.col("of").eqNullSafe(F.col("page_id")))
    archive = uuid.uuid5(uuid.NAMESPACE_URL, path)

    def records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, n, out, size = TaskContext.get().partitionId(), 0, [], 0
        for b in batches:
            whole = zip(*(b[c].astype(object) for c in ("page_id", "url", "payload", "bytes", "digest", "revisit", "of", "of_url")))
            for page, address, payload, length, digest, revisit, of, of_url in whole:
                own = str(uuid.uuid5(archive, f"{part}/{n}"))
                n += 1
                fields = [("WARC-Target-URI", address), ("WARC-Payload-Digest", f"sha1:{digest}"),
                          ("X-Payload-Length", length), ("X-Page-ID", None if pd.isna(page) else int(page))]
                if revisit:
                    fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                               ("WARC-Refers-To-Target-URI", of_url), ("X-Refers-To-Page-ID", int(of)),
                               ("Content-Type", "application/http;msgtype=response")]
                    new = [record("revisit", own, fields, _HTTP + b"\r\n")]
                else:
                    new = list(segmented(own, fields, _HTTP + _CHUNKED + b"\r\n" + chunked(payload)))
                out += new
                size += sum(map(len, new))
                if size > 8 << 20:
                    yield pd.DataFrame({"record": out})
                    out, size = [], 0
        if out:
            yield pd.DataFrame({"record": out})

    columns = ["page_id", "url", "payload", "bytes", "digest", "revisit", "of", "of_url"]
    made = dealt.select(*columns).mapInPandas(records, "record binary")
    made.select(F.col("record").cast("string").alias("value")).write.option("lineSep", _END.decode()) \
        .option("maxRecordsPerFile", FILE_RECORDS).text(path)


_RECORD = ("kind string, page_id long, url string, digest string, bytes long, refers_to long, "
           "origin string, number int, total long, payload binary, block binary")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """All records of the archives: whole responses with their payload, segments with their block."""
    prepare(spark)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for archive in b["content"]:
                out = []
                for f, block in parsed(archive):
                    number = f.get("warc-segment-number")
                    whole = f["warc-type"] == "response" and number is None
                    as_int = lambda name: int(f[name]) if name in f else None
                    out.append((f["warc-type"], as_int("x-page-id"), f.get("warc-target-uri"),
                                f.get("warc-payload-digest", "").removeprefix("sha1:") or None, as_int("x-payload-length"), as_int("x-refers-to-page-id"),
                                f.get("warc-segment-origin-id", f["warc-record-id"]), None if number is None else int(number),
                                as_int("warc-segment-total-length"), http_payload(block) if whole else None, block if number else None))
                yield pd.DataFrame(out, columns=[c.split()[0] for c in _RECORD.split(", ")]).astype(
                    {"page_id": "Int64", "bytes": "Int64", "refers_to": "Int64", "number": "Int32", "total": "Int64"})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(read, _RECORD)


def _joined(numbers: pd.Series, blocks: pd.Series, totals: pd.Series) -> pd.Series:
    out = []
    for number, block, total in zip(numbers, blocks, totals):
        if list(number) != list(range(1, len(number) + 1)):
            raise ValueError(f"segments {list(number)[:20]} are not 1 to n")
        whole = b"".join(block)
        if len(whole) != total:
            raise ValueError(f"segments hold {len(whole)} bytes, {total} are announced")
        out.append(http_payload(whole))
    return pd.Series(out)


def reassembled(records: DataFrame) -> DataFrame:
    """One row a response or revisit: kind, page_id, url, digest, bytes, refers_to, payload (revisits: null).

    Only segments are shuffled, by origin; a group is one record. Missing,
    repeated or surplus segments, and a length or digest that does not
    agree, are errors.
    """
    join = F.pandas_udf(_joined, "binary")
    plain = ["kind", "page_id", "url", "digest", "bytes", "refers_to"]
    whole = records.where("number is null").select(*plain, "payload")
    groups = records.where("number is not null").groupBy("origin").agg(
        F.sort_array(F.collect_list(F.struct("number", "block"))).alias("parts"), F.max("total").alias("total"),
        F.max(F.when(F.col("number") == 1, F.struct(*plain))).alias("first"))
    joined = groups.select(*[F.col(f"first.{c}").alias(c) for c in plain],
                           join(F.col("parts.number"), F.col("parts.block"), F.coalesce("total", F.lit(-1))).alias("payload"))
    both = whole.union(joined)
    wrong = F.col("payload").isNotNull() & ((F.octet_length("payload") != F.col("bytes")) | (base32_sha1(F.col("payload")) != F.col("digest")))
    return both.withColumn("payload", F.when(wrong, F.raise_error(F.lit("payload does not match its record")).cast("binary")).otherwise(F.col("payload")))
