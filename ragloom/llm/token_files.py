"""Token-id files with directly addressable codes.

An id is cut into chunks of CHUNK_BITS bits. Level 0 holds the lowest chunk
of every id; a bit per entry says whether the id continues on the next
level, which holds the next chunks of the continuing ids only, and so on. A
rank directory (set bits before every 512) turns a position on one level into
a position on the next, so any token is read without decoding others.

A file is one shard (all integers little-endian):

    magic, u32 part, u32 shard, u64 documents, u64 tokens, u32 levels, u32 zero
    per document: i64 id; u8 1 if the id is null; u64 end (tokens up to and with it)
    per level: u64 entries, chunks (u8 each), padded to 8 bytes; on all but the
    last level the continuation bits (LSB first, padded to 8 bytes) and
    u32 ranks, one for every 512 entries, padded to 8 bytes
    magic of the end

Spark's text writer commits the files (one row a file, the row separator is
the closing magic), so a lost task leaves nothing behind.
"""

from __future__ import annotations

import codecs
import json
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ragloom.llm.common import cut, prepare

CHUNK_BITS = 8
RANK_EVERY = 512
MAGIC, END = b"DACTOK01", b"DACTOKND"
_HEAD = struct.Struct("<8sIIQQII")
#: A shard is closed by the document that brings it to so many ids.
SHARD_TOKENS = 4_000_000
#: Text encoded in one step; longer texts are cut at white space.
_STEP = 1 << 22
#: Encoded parts of words that a Python worker remembers, in each of two generations, besides those of one step.
_REMEMBER = 100_000
#: Shards whose offsets are broadcast (three numbers each); more are joined by shuffle.
BROADCAST_SHARDS = 100_000


# --- the code ------------------------------------------------------------------------------------

def _pad(b: bytes) -> bytes:
    return b + bytes(-len(b) % 8)


def pack_shard(part: int, shard: int, doc_ids: list[int | None], ends: np.ndarray, ids: np.ndarray) -> bytes:
    """Bytes of one shard, without the closing magic."""
    levels, rest = [], ids.astype(np.uint32)
    while True:
        more = rest >> CHUNK_BITS
        levels.append(((rest & ((1 << CHUNK_BITS) - 1)).astype(np.uint8), more > 0))
        rest = more[more > 0]
        if not len(rest):
            break
    out = [_HEAD.pack(MAGIC, part, shard, len(doc_ids), len(ids), len(levels), 0),
           np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes(),
           _pad(np.array([d is None for d in doc_ids], np.uint8).tobytes()), np.asarray(ends, "<u8").tobytes()]
    for k, (chunks, more) in enumerate(levels):
        out += [struct.pack("<Q", len(chunks)), _pad(chunks.tobytes())]
        if k + 1 < len(levels):
            before = np.concatenate([[0], np.add.reduceat(more, np.arange(0, len(more), RANK_EVERY), dtype=np.uint32)[:-1].cumsum()])
            out += [_pad(np.packbits(more, bitorder="little").tobytes()), _pad(before.astype("<u4").tobytes())]
    return b"".join(out)


class Shard:
    """A shard's bytes, addressable by token."""

    def __init__(self, data: bytes):
        magic, self.part, self.shard, docs, self.n_tokens, levels, _ = _HEAD.unpack_from(data)
        if magic != MAGIC or bytes(memoryview(data)[-len(END):]) != END:
            raise ValueError("not a whole shard")
        at = _HEAD.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            got = np.frombuffer(data, kind, n, at)
            at += -(-got.nbytes // 8) * 8
            return got

        ids, null = take("<i8", docs), take("u1", docs)
        self.doc_ids = [None if z else d for d, z in zip(ids.tolist(), null.tolist())]
        self.ends = take("<u8", docs)
        self.levels = []
        for k in range(levels):
            n = int(take("<u8", 1)[0])
            chunks = take("u1", n)
            self.levels.append((chunks, take("u1", -(-n // 8)), take("<u4", -(-n // RANK_EVERY))) if k + 1 < levels else (chunks, None, None))

    @staticmethod
    def _rank(bits: np.ndarray, ranks: np.ndarray, i: int) -> int:
        """Set bits before position ``i``: the directory and at most 512 bits after it."""
        if not i:
            return 0
        block = (i - 1) // RANK_EVERY
        start, stop = block * RANK_EVERY // 8, i // 8
        n = int(ranks[block]) + int(np.bitwise_count(bits[start:stop]).sum())
        return n + ((int(bits[stop]) & ((1 << (i % 8)) - 1)).bit_count() if i % 8 else 0)

    def token(self, i: int) -> int:
        """The id at position ``i`` of the shard."""
        if not 0 <= i < self.n_tokens:
            raise IndexError(i)
        out = shift = 0
        for chunks, bits, ranks in self.levels:
            out |= int(chunks[i]) << shift
            if bits is None or not bits[i // 8] >> (i % 8) & 1:
                return out
            i, shift = self._rank(bits, ranks, i), shift + CHUNK_BITS
        return out

    def tokens(self, start: int, stop: int) -> np.ndarray:
        """Ids of positions [start, stop)."""
        out = np.zeros(stop - start, np.uint32)
        where, shift = np.arange(stop - start), 0
        for chunks, bits, ranks in self.levels:
            out[where] |= chunks[start:stop].astype(np.uint32) << shift
            if bits is None or start == stop:
                break
            first = start // 8
            more = np.unpackbits(bits[first:-(-stop // 8)], bitorder="little")[start - 8 * first:stop - 8 * first].astype(bool)
            start = self._rank(bits, ranks, start)
            where, stop, shift = where[more], start + int(more.sum()), shift + CHUNK_BITS
        return out


# --- encoding ------------------------------------------------------------------------------------

#: How word_bpe_49k normalises a text and parts it; plain words are parted here in the same way, in bulk.
_NORMALIZER = {"type": "Sequence", "normalizers": [
    {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
#: Bytes of a plain word: printable ASCII without capitals, composed letters from U+00C0 to U+00FF.
_PLAIN = rb"^(?:[!-@[-~]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+$"
_PARTS = rb"'s|'t|'re|'ve|'m|'ll|'d|(?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+|[0-9]|[!-/:-@[-`{-~]+"
#: Names of special tokens hold it; they are case-sensitive and found before anything else.
_SPECIAL = b"<|"


def _byte_letters() -> list[str]:
    """Byte-level alphabet: printable bytes stand for themselves, the others for code points from 256."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + others.index(b)) for b in range(256)]


def _spelled() -> str:
    """The letter of every byte of plain words parted by spaces; after \xc3 the bytes from 0x80 to 0x9E are capitals."""
    letter = _byte_letters()
    return "".join(" " if b == 0x20 else letter[b + 0x20] if 0x80 <= b <= 0x9E else letter[b] for b in range(256))


_SPELLED = _spelled()


def _taken(ids: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """``size[k]`` ids from ``first[k]`` on, for every k in turn."""
    before = size.cumsum() - size
    return ids[np.repeat(first - before, size) + np.arange(size.sum())]


class Words:
    """Words with their ids, in arrays."""

    def __init__(self):
        self.words = pa.array([b""], pa.binary())
        self.first, self.size, self.ids = np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def __len__(self) -> int:
        return len(self.words)

    def find(self, words: pa.Array) -> np.ndarray:
        """Where each word is, -1 if nowhere."""
        return pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy().copy()

    def add(self, words: pa.Array, size: np.ndarray, ids: np.ndarray) -> None:
        self.words = pa.concat_arrays([self.words, words])
        self.first = np.concatenate([self.first, len(self.ids) + size.cumsum() - size])
        self.size, self.ids = np.concatenate([self.size, size]), np.concatenate([self.ids, ids])


class Encoder:
    """Ids of whole texts.

    ``by_word``: the tokenizer never joins characters across ASCII white
    space, lower-cases and is byte-level (as ``word_bpe_49k``), so the ids of
    a text are those of its words in turn. Words are handled in bulk, as
    Arrow and numpy arrays: distinct words of a step are parted as the
    tokenizer does, and a part met again is not encoded again.
    """

    def __init__(self, spec: str, by_word: bool):
        from tokenizers import Tokenizer, pre_tokenizers
        self.tokenizer = Tokenizer.from_str(spec)
        self.by_word = by_word
        says = json.loads(spec) if by_word else {}
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.parts = bool(suffix) and (says.get("normalizer"), says.get("pre_tokenizer")) == (_NORMALIZER, _PRE_TOKENIZER)
        # parts of plain words need no normaliser and no pattern: the same merges, parted at spaces
        self.merges = Tokenizer(self.tokenizer.model)
        self.merges.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.last = np.zeros(self.tokenizer.get_vocab_size(), bool)
        if suffix:
            self.last[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith(suffix)]] = True
        self.young, self.old = Words(), Words()

    def _plain(self, words: pa.Array) -> np.ndarray:
        """Which words can be parted here; all others are left to the tokenizer whole."""
        if not self.parts:
            return np.zeros(len(words), bool)
        plain = pc.and_not(pc.match_substring_regex(words, _PLAIN), pc.match_substring(words, _SPECIAL))
        return plain.to_numpy(zero_copy_only=False)

    def _learn(self, words: pa.Array | set[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words in turn, and how many each has."""
        if not isinstance(words, pa.Array):
            words = pa.array(list(words), pa.binary())
        spaced = pc.binary_slice(pc.replace_substring_regex(words, _PARTS, rb"\0 "), 0, -1)
        parted = pc.split_pattern(pc.if_else(pa.array(self._plain(words)), spaced, words), b" ")
        parts = parted.flatten().dictionary_encode()
        at = self._remembered(parts.dictionary)[parts.indices.to_numpy()]
        size = self.young.size[at]
        ends = np.concatenate([[0], size.cumsum()])[parted.offsets.to_numpy()]
        return _taken(self.young.ids, self.young.first[at], size), np.diff(ends)

    def _remembered(self, parts: pa.Array) -> np.ndarray:
        """Where ``young`` has each part; those that it lacks are encoded, if ``old`` lacks them too."""
        if len(self.young) > _REMEMBER:
            self.old, self.young = self.young, Words()
        at = self.young.find(parts)
        missing = np.flatnonzero(at < 0)
        if len(missing):
            new = parts.take(pa.array(missing))
            was = self.old.find(new)
            known, fresh = np.flatnonzero(was >= 0), np.flatnonzero(was < 0)
            was, plain = was[known], self._plain(new.take(pa.array(fresh)))
            order = np.concatenate([known, fresh[plain], fresh[~plain]])
            size, ids = [self.old.size[was]], [_taken(self.old.ids, self.old.first[was], self.old.size[was])]
            for which, encode in ((fresh[plain], self._merged), (fresh[~plain], self._whole)):
                left = new.take(pa.array(which)).to_numpy(zero_copy_only=False).tolist()
                for i in range(0, len(left), 10_000):
                    n, got = encode(left[i:i + 10_000])
                    size.append(n)
                    ids.append(got)
            at[missing[order]] = len(self.young) + np.arange(len(new))
            self.young.add(new.take(pa.array(order)), np.concatenate(size), np.concatenate(ids))
        return at

    def _whole(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each word has, and all ids."""
        texts = [w.decode("utf-8", "surrogatepass") for w in words]
        got = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.array([len(g) for g in got], np.int64), np.array([i for g in got for i in g], np.uint32)

    def _merged(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The same of parts of plain words, all in one text: a token with the end-of-word suffix closes a part."""
        text = codecs.charmap_decode(b" ".join(parts), "strict", _SPELLED)[0]
        ids = np.array(self.merges.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(parts):
            raise ValueError("the tokenizer does not close every word; use by_word=False")
        return np.diff(ends, prepend=0), ids

    def _steps(self, raw: bytes) -> Iterator[bytes]:
        at = 0
        while at < len(raw):
            stop = at + _STEP
            if stop < len(raw):
                ends = [k for k in (raw.find(b" ", stop), raw.find(b"\n", stop)) if k >= 0]
                stop = min(ends, default=len(raw))
            yield raw[at:stop]
            at = stop

    def _joined(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in turn and where each text's end: distinct words are looked up once, the rest is arrays."""
        words = pc.ascii_split_whitespace(texts)
        coded = words.flatten().dictionary_encode()
        ids, size = self._learn(coded.dictionary.cast(pa.binary()))
        first = size.cumsum() - size
        at = coded.indices.to_numpy()
        ends = np.concatenate([[0], size[at].cumsum()])
        out = _taken(ids, first[at], size[at])
        offsets = words.offsets.to_numpy()
        return out, ends[offsets[1:] - offsets[0]]

    def batch(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Ids of every text of a column."""
        if not self.by_word:
            for t in texts.to_pylist():
                yield np.array(self.tokenizer.encode_batch_fast([t], add_special_tokens=False)[0].ids, np.uint32)
            return
        sizes = pc.binary_length(texts).to_numpy()
        at = 0
        while at < len(texts):  # whole texts up to one step, or one longer text in steps
            stop, held = at + 1, int(sizes[at])
            while stop < len(texts) and held + sizes[stop] <= _STEP:
                held += int(sizes[stop])
                stop += 1
            some = texts.slice(at, stop - at)
            some = pc.if_else(pc.match_substring(some, _SPECIAL.decode()), some, pc.ascii_lower(some))
            if held <= _STEP:
                ids, ends = self._joined(some)
                yield from np.split(ids, ends[:-1])
            else:
                raw = some[0].cast(pa.binary()).as_py()
                yield np.concatenate([self._joined(pa.array([step], pa.binary()).cast(pa.string(), safe=False))[0] for step in self._steps(raw)])
            at = stop


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder(spec: str, by_word: bool) -> Encoder:
    """The worker's encoder for this vocabulary; it lives on between tasks."""
    key = (spec, by_word)
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(spec, by_word)
    return _ENCODERS[key]


# --- jobs ----------------------------------------------------------------------------------------

def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int, doc_id: str = "doc_id",
                      text: str = "text", by_word: bool = True, shard_tokens: int = SHARD_TOKENS) -> None:
    """Encode whole texts and write shards to ``path`` in ascending id order, part by part.

    ``tokenizer`` is a file of the tokenizers library that the driver can
    read; its content is broadcast. Null texts count as empty (they hold only
    ``end_id``); null ids come first; rows with equal ids are ordered by the
    hash of their text. The ranges are cut by id, text hash and row, so one
    id that many rows repeat is spread as well. No rows: no shard.
    """
    spark = docs.sparkSession
    prepare(spark)
    with open(tokenizer, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    ordered = rows.repartitionByRange("doc_id", "h", "row").sortWithinPartitions("doc_id", "h", "row").select("doc_id", "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, shard = encoder(spec.value, by_word), TaskContext.get().partitionId(), 0
        ids, held, pieces, ends = [], 0, [], []
        closing = np.array([end_id], np.uint32)

        def close() -> pa.RecordBatch:
            data = pack_shard(part, shard, ids, np.array(ends, np.uint64), np.concatenate(pieces))
            return pa.RecordBatch.from_pydict({"shard": pa.array([data], pa.binary())})

        for b in batches:
            for d, got in zip(b.column(0).to_pylist(), enc.batch(b.column(1))):
                ids.append(d)
                pieces += [got, closing]
                held += len(got) + 1
                ends.append(held)
                if held >= shard_tokens:
                    yield close()
                    ids, held, pieces, ends, shard = [], 0, [], [], shard + 1
        if ids:
            yield close()

    files = ordered.mapInArrow(encode, "shard binary").select(F.col("shard").cast("string").alias("value"))
    files.write.option("lineSep", END.decode()).option("maxRecordsPerFile", 1).text(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files alone.

    Per-file totals are summed per part first, so the one ordered prefix over
    all data has a row for each part.
    """
    prepare(spark)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                s = Shard(content.as_buffer())
                ends = s.ends.astype(np.int64)
                starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
                crc = [zlib.crc32(s.tokens(x, y).astype("<u4").tobytes()) for x, y in zip(starts.tolist(), ends.tolist())]
                n = len(ends)
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array(np.full(n, s.part, np.int32)), "shard": pa.array(np.full(n, s.shard, np.int32)),
                    "doc_id": pa.array(s.doc_ids, pa.int64()), "at": pa.array(starts), "n_tokens": pa.array(ends - starts),
                    "ids_crc32": pa.array(crc, pa.int64())})

    files = spark.read.format("binaryFile").load(path).select("content")
    rows = cut(files.mapInArrow(decode, "part int, shard int, doc_id long, at long, n_tokens long, ids_crc32 long"))
    shards = rows.groupBy("part", "shard").agg(F.sum("n_tokens").alias("n"))
    parts = shards.groupBy("part").agg(F.sum("n").alias("all"))
    parts = parts.withColumn("first", F.sum("all").over(Window.orderBy("part")) - F.col("all"))
    offset = F.sum("n").over(Window.partitionBy("part").orderBy("shard")) - F.col("n")
    starts = cut(shards.withColumn("within", offset).join(parts, "part").select(
        "part", "shard", (F.col("first") + F.col("within")).alias("before")))
    bounded = starts.limit(BROADCAST_SHARDS + 1).count() <= BROADCAST_SHARDS
    return rows.join(F.broadcast(starts) if bounded else starts, ["part", "shard"]).select(
        "doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
