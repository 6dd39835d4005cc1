"""SentencePiece ids of whole texts by a table of distinct chunks.

A chunk is a run of white space markers with the characters up to the next
run. No piece of a separable model holds a marker after another character,
so no merge crosses the start of a chunk: the ids of a text are the ids of
its chunks in turn. Every worker segments a distinct chunk once, keeps its
ids in a table and joins them by position; nothing is shuffled.

Models that are not separable (a piece crosses a marker, characters are
normalised, markers are suffixes) encode their texts whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragloom.llm.common import prepare

MARK = "▁"
#: Bytes of text whose chunks are looked up together; longer texts are cut between chunks.
_STEP = 1 << 20
#: Rows taken out of Arrow at a time.
_ROWS = 128
#: Bytes of chunks, ids and their objects that each of the two generations of a table may hold.
_TABLE_BYTES = 96 << 20
_OBJECTS = 200

_CHUNKS = re.compile(rb" ( *[^ ]*)").findall
_END_OF_CHUNK = re.compile(rb"[^ ] ").search


def separable(model: bytes) -> bool:
    """Whether chunks can be segmented by themselves; a text then starts with a marker of its own."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    m = proto.ModelProto.FromString(model)
    n = m.normalizer_spec
    plain = not n.precompiled_charsmap and n.add_dummy_prefix and n.escape_whitespaces and not n.remove_extra_whitespaces
    bpe = m.trainer_spec.model_type == proto.TrainerSpec.BPE and not m.trainer_spec.treat_whitespace_as_suffix
    pieces = [p.piece for p in m.pieces]
    return bool(plain and bpe and MARK in pieces and not any(MARK in p.lstrip(MARK) for p in pieces))


def chunks_of(raw: bytes) -> list[bytes]:
    """Chunks of a text whose markers are spaces, each without its first marker (the text's own is implied)."""
    if b"  " in raw or raw[:1] == b" ":
        return _CHUNKS(b" " + raw)
    return raw.split(b" ")


def steps_of(raw: bytes, size: int) -> Iterator[bytes]:
    """A text in steps of about ``size`` bytes, cut at the marker that starts a chunk."""
    at = 0
    while (end := _END_OF_CHUNK(raw, at + size)) is not None:
        yield raw[at:end.end() - 1]
        at = end.end()
    yield raw[at:]


class ChunkTable:
    """Ids by chunk, in two generations: chunks not met while one filled are forgotten."""

    def __init__(self, model: bytes, by_chunk: bool, table_bytes: int = _TABLE_BYTES, step: int = _STEP):
        from sentencepiece import SentencePieceProcessor
        self.model = SentencePieceProcessor(model_proto=model)
        self.by_chunk, self.table_bytes, self.step = by_chunk, table_bytes, step
        self.mark = np.array([self.model.piece_to_id(MARK)], "<i4").tobytes()
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.held = 0

    def _learn(self, chunks: set[bytes]) -> None:
        if self.held > self.table_bytes:
            self.old, self.young, self.held = self.young, {}, 0
        new = []
        for c in chunks.difference(self.young):
            known = self.old.get(c)
            if known is None:
                new.append(c)
            else:
                self.young[c] = known
                self.held += len(c) + len(known) + _OBJECTS
        for i in range(0, len(new), 4096):
            part = new[i:i + 4096]
            for c, ids in zip(part, self.model.encode(part, num_threads=1)):
                packed = np.array(ids, "<i4").tobytes() if c else self.mark
                self.young[c] = packed
                self.held += len(c) + len(packed) + _OBJECTS

    def encoded(self, texts: list[bytes]) -> Iterator[tuple[int, np.ndarray]]:
        """(position of the text, ids) in order; a long text comes in several parts, each starting with a chunk."""
        if not self.by_chunk:
            for row, raw in enumerate(texts):
                yield row, np.array(self.model.encode(raw), np.int32)
            return
        group, size = [], 0
        for row, raw in enumerate(texts):
            if raw:
                for step in steps_of(raw.replace(MARK.encode(), b" "), self.step):
                    group.append((row, chunks_of(step)))
                    size += len(step)
                    if size >= self.step:
                        yield from self._joined(group)
                        group, size = [], 0
        yield from self._joined(group)

    def _joined(self, group: list[tuple[int, list[bytes]]]) -> Iterator[tuple[int, np.ndarray]]:
        self._learn(set().union(*(chunks for _, chunks in group)))
        for row, chunks in group:
            yield row, np.frombuffer(b"".join(map(self.young.__getitem__, chunks)), "<i4")

    def decoded(self, ids: list[int], first: bool) -> str:
        """Text of ids that start a text, or (``first`` false) a later chunk, whose marker the library would strip."""
        return ("" if first else " ") + self.model.decode(ids)


_TABLES: dict[tuple[bytes, bool], ChunkTable] = {}


def table_of(model: bytes, by_chunk: bool) -> ChunkTable:
    """The worker's table for this model; it lives on between tasks."""
    key = (sha256(model).digest(), by_chunk)
    if key not in _TABLES:
        _TABLES.clear()
        _TABLES[key] = ChunkTable(model, by_chunk)
    return _TABLES[key]


def _shared(df: DataFrame, model: str):
    prepare(df.sparkSession)
    with open(model, "rb") as f:
        data = f.read()
    return df.sparkSession.sparkContext.broadcast((data, separable(data)))


def _texts(column: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    for at in range(0, len(column), _ROWS):
        yield at, [t or b"" for t in column.slice(at, _ROWS).cast(pa.binary()).to_pylist()]


def with_ids(docs: DataFrame, model: str, text: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` with the ids of its whole texts (array<int>) in ``out``, which replaces a column of that name.

    ``model`` is a file that the driver can read; its content is broadcast.
    Null and empty texts have no ids. Rows, repeated ones too, and all other
    columns stay as they are. No rows: none.
    """
    shared = _shared(docs, model)

    @F.arrow_udf("array<int>")
    def encode(column: pa.Array) -> pa.Array:
        table, parts = table_of(*shared.value), []
        counts = np.zeros(len(column), np.int64)
        for at, texts in _texts(column):
            for row, ids in table.encoded(texts):
                counts[at + row] += len(ids)
                parts.append(ids)
        ends = np.concatenate([[0], counts.cumsum()]).astype(np.int32)
        return pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, np.int32), *parts])))

    return docs.withColumn(out, encode(F.col(text)))


def with_text(rows: DataFrame, model: str, ids: str = "ids", out: str = "text") -> DataFrame:
    """``rows`` with the text that the library's decode gives for ``ids``; null ids give null, no ids ''."""
    shared = _shared(rows, model)

    @F.arrow_udf("string")
    def decode(column: pa.Array) -> pa.Array:
        table = table_of(*shared.value)
        return pa.array([None if x is None else table.model.decode(x) for x in column.to_pylist()], pa.string())

    return rows.withColumn(out, decode(F.col(ids)))


def digests(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text, encoded and decoded again.

    Null texts are empty: no ids, digests of nothing. One row a row of
    ``docs``, repeated rows and null ids included; other columns are ignored
    and may have any name. A long text is encoded, hashed and decoded in
    steps of about a megabyte. No rows: none.
    """
    shared = _shared(docs, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = table_of(*shared.value)
        for b in batches:
            count, hashes, back = [0] * b.num_rows, [sha256() for _ in range(b.num_rows)], [sha256() for _ in range(b.num_rows)]
            for at, texts in _texts(b.column(1)):
                for row, ids in table.encoded(texts):
                    row += at
                    part = ids.tolist()
                    hashes[row].update(("," * (count[row] > 0) + ",".join(map(str, part))).encode())
                    back[row].update(table.decoded(part, count[row] == 0).encode())
                    count[row] += len(part)
            yield pa.RecordBatch.from_pydict({
                "doc_id": b.column(0), "n_tokens": pa.array(count, pa.int64()),
                "ids_sha256": pa.array([h.hexdigest() for h in hashes], pa.string()),
                "decoded_sha256": pa.array([h.hexdigest() for h in back], pa.string())})

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
