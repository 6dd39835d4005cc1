"""Chunking (P5).

Two chunkers, both per document row (no shuffle):

* ``chunk_documents`` - boundary-aware recursive splitting. Contract: every
  chunk has at most ``size`` characters; a text is cut at the strongest
  boundary present (blank line > newline > space > character); pieces are
  packed greedily; the trailing pieces of a chunk, up to ``overlap``
  characters, start the next one; chunks are stripped and empty ones
  dropped. Runs by ``mapInArrow``, a bounded piece of chunks at a time
  (linear per document).
* ``chunk_documents_fixed`` - fixed stride ``size - overlap`` with one
  ``regexp_extract_all`` a text + ``posexplode``; pure SQL, used where an
  oracle must reproduce the chunks.

Metadata columns named in ``keep`` are copied to every chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import lexicon as L

SEPARATORS = ("\n\n", "\n", " ", "")
#: Characters of chunks that leave a Python worker at a time.
PIECE_CHARS = 1 << 20


def chunk_id(doc_id, chunk_no) -> F.Column:
    """60-bit digest of the chunk's key (doc_id, chunk_no): any id type, no overflow, no packing."""
    key = F.concat_ws(":", F.col(doc_id).cast("string"), F.col(chunk_no).cast("string"))
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")


def chunk_id_sql(doc_id: str, chunk_no: str) -> str:
    """The same digest in DuckDB."""
    return f"('0x' || substr(md5(CAST({doc_id} AS VARCHAR) || ':' || CAST({chunk_no} AS VARCHAR)), 1, 15))::BIGINT"


def _pack(pieces: list[str], sep: str, size: int, overlap: int) -> list[str]:
    """Greedy packing of pieces (each <= size) joined by ``sep`` with overlap carry."""
    out: list[str] = []
    window: list[str] = []
    length = 0  # length of sep.join(window)
    for p in pieces:
        extra = len(p) + (len(sep) if window else 0)
        if window and length + extra > size:
            text = sep.join(window).strip()
            if text:
                out.append(text)
            # drop leading pieces until the carry fits the overlap and the new piece fits
            while window and (length > overlap or
                              length + len(p) + (len(sep) if window else 0) > size):
                first = window.pop(0)
                length -= len(first) + (len(sep) if window else 0)
            extra = len(p) + (len(sep) if window else 0)
        window.append(p)
        length += extra
    text = sep.join(window).strip()
    if text:
        out.append(text)
    return out


def split_text(text: str, size: int = L.CHUNK_SIZE, overlap: int = L.CHUNK_OVERLAP,
               separators=SEPARATORS) -> list[str]:
    """Recursive boundary-aware split of one text (see module contract)."""
    if not text:
        return []
    sep = separators[-1]
    rest: tuple = ()
    for i, s in enumerate(separators):
        if s == "" or s in text:
            sep, rest = s, tuple(separators[i + 1:])
            break
    parts = list(text) if sep == "" else text.split(sep)
    chunks: list[str] = []
    fitting: list[str] = []
    for p in parts:
        if len(p) <= size:
            if p:
                fitting.append(p)
            continue
        if fitting:
            chunks.extend(_pack(fitting, sep, size, overlap))
            fitting = []
        if rest:
            chunks.extend(split_text(p, size, overlap, rest))
        else:
            chunks.append(p)
    if fitting:
        chunks.extend(_pack(fitting, sep, size, overlap))
    return chunks


def chunk_documents(docs: DataFrame, size: int = L.CHUNK_SIZE, overlap: int = L.CHUNK_OVERLAP,
                    id_col: str = "doc_id", text_col: str = "text", keep=("source", "page")) -> DataFrame:
    """P5: (chunk_id, doc_id, chunk_no, text, *keep) with boundary-aware chunks."""

    keep = [c for c in keep if c in docs.columns]
    rows = docs.select(id_col, *keep, F.col(text_col).cast("string").alias("_text"))
    others = rows.schema.fields[:-1]
    schema = T.StructType([*others, T.StructField("chunk_no", T.LongType()), T.StructField("text", T.StringType())])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, at, nos, found, held = b.column(b.num_columns - 1), [], [], [], 0

            def piece() -> pa.RecordBatch:
                row = pa.array(at, pa.int64())
                return pa.RecordBatch.from_arrays([*(c.take(row) for c in b.columns[:-1]), pa.array(nos, pa.int64()), pa.array(found, texts.type)],
                                                  names=[f.name for f in schema])

            for i in range(b.num_rows):
                for no, chunk in enumerate(split_text(texts[i].as_py() or "", size, overlap)):
                    at.append(i)
                    nos.append(no)
                    found.append(chunk)
                    held += len(chunk)
                    if held >= PIECE_CHARS:
                        yield piece()
                        at, nos, found, held = [], [], [], 0
            if at:
                yield piece()

    return (rows.mapInArrow(split, schema)
            .select(chunk_id(id_col, "chunk_no").alias("chunk_id"), id_col, "chunk_no", "text", *keep))


def chunk_documents_fixed(docs: DataFrame, size: int = L.CHUNK_SIZE,
                          overlap: int = L.CHUNK_OVERLAP, id_col: str = "doc_id",
                          text_col: str = "text", keep=("source", "page")) -> DataFrame:
    """P5 fixed-stride variant: chunk i covers characters [i*step, i*step + size).

    One pass over a text cuts all of its chunks: ``substr`` would count the
    characters before a chunk again for every chunk, quadratic in long texts.
    """
    step = size - overlap
    n = F.length(F.col(text_col))
    count = F.when(n.isNull() | (n == 0), F.lit(0)).otherwise(
        F.lit(1) + F.ceil(F.greatest(n - size, F.lit(0)) / F.lit(step)).cast("int"))
    keep = [c for c in keep if c in docs.columns]
    # a match moves on by one step and shows what lies ahead of it; past the last chunk there are only parts of it
    pieces = F.regexp_extract_all(F.col(text_col), F.lit(f"(?s)(?=(.{{1,{size}}})).{{1,{step}}}"), 1)
    return (docs.select(id_col, *keep, F.col(text_col), count.alias("_n"))
            .filter(F.col("_n") > 0)
            .select(id_col, *keep, F.posexplode(F.slice(pieces, F.lit(1), F.col("_n"))).alias("chunk_no", "text"))
            .select(chunk_id(id_col, "chunk_no").alias("chunk_id"),
                    id_col, F.col("chunk_no").cast("long").alias("chunk_no"), "text", *keep))
