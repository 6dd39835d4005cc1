import random
from hashlib import sha256

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import sentencepiece_model_pb2 as proto

from ragloom.llm import pieces
from tests.llm.helpers import DOCS, awkward, awkward_rows, empty

PATH = public_tokenizers.path("piece_bpe_32k.model")
with open(PATH, "rb") as f:
    MODEL = f.read()
LIBRARY = sentencepiece.SentencePieceProcessor(model_proto=MODEL)
TEXTS = st.lists(st.sampled_from([*"ab .\n\t\x00é漢", "▁", " ", "  ", "the", "\U0001f600", "\u0301", "\ufffd"]), max_size=60).map("".join)


def expected(text):
    ids = LIBRARY.encode(text or "")
    return len(ids), sha256(",".join(map(str, ids)).encode()).hexdigest(), sha256(LIBRARY.decode(ids).encode()).hexdigest()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(TEXTS, st.text(max_size=40)).map(lambda t: t.encode("utf-8", "replace").decode()), max_size=8))
def test_ids_and_text_equal_the_library(texts):
    table = pieces.ChunkTable(MODEL, True, table_bytes=3000, step=20)  # long texts in steps, chunks forgotten
    ids, back = [[] for _ in texts], [""] * len(texts)
    for row, part in table.encoded([t.encode() for t in texts]):
        back[row] += table.decoded(part.tolist(), not ids[row])
        ids[row] += part.tolist()
    assert ids == [LIBRARY.encode(t) for t in texts]
    assert back == [LIBRARY.decode(LIBRARY.encode(t)) for t in texts]


def test_bytes_that_are_no_utf8():
    table = pieces.ChunkTable(MODEL, True)
    raw = b"a \xff\xfe b\xe2\x96 c"
    assert [list(p) for _, p in table.encoded([raw])] == [LIBRARY.encode(raw)]


def test_each_distinct_chunk_is_segmented_once():
    table, seen = pieces.ChunkTable(MODEL, True, step=64), []
    encode = table.model.encode

    class Counting:
        def encode(self, part, num_threads):
            seen.extend(part)
            return encode(part, num_threads=num_threads)
    table.model = Counting()
    r = random.Random(4)
    list(table.encoded([" ".join(r.choices("one two three four".split(), k=200)).encode() for _ in range(20)]))
    assert sorted(seen) == [b"four", b"one", b"three", b"two"]


def altered(change):
    m = proto.ModelProto.FromString(MODEL)
    change(m)
    return m.SerializeToString()


@pytest.mark.parametrize("change", [
    lambda m: m.pieces.add(piece="a▁b", score=-1.0), lambda m: setattr(m.normalizer_spec, "add_dummy_prefix", False),
    lambda m: setattr(m.normalizer_spec, "remove_extra_whitespaces", True),
    lambda m: setattr(m.trainer_spec, "treat_whitespace_as_suffix", True)])
def test_other_models_encode_texts_whole(change):
    model = altered(change)
    assert pieces.separable(MODEL) and not pieces.separable(model)
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    texts = ["  two  words ", "", "a b a b"]
    got = {row: list(p) for row, p in pieces.ChunkTable(model, False).encoded([t.encode() for t in texts])}
    assert got == {k: library.encode(t) for k, t in enumerate(texts)}


def test_digests_of_awkward_rows(spark):
    df = awkward(spark, ("ids", "n_tokens", "ids_sha256"))
    got = sorted(map(tuple, pieces.digests(df, PATH).collect()), key=str)
    assert got == sorted([(d, *expected(t)) for d, t, *_ in awkward_rows()], key=str)


def test_ids_columns_there_and_back(spark):
    df = awkward(spark, ("ids",))
    got = pieces.with_text(pieces.with_ids(df, PATH), PATH, out="again")
    assert got.columns == [*df.columns, "again"]
    assert all(r["ids"] == LIBRARY.encode(r["text"] or "") and r["again"] == LIBRARY.decode(r["ids"]) for r in got.collect())


def test_empty(spark):
    assert pieces.digests(empty(spark), PATH).count() == 0
    assert pieces.with_ids(empty(spark), PATH).count() == 0
    none = pieces.digests(spark.createDataFrame([(1, None, "en", "s", 0)], DOCS), PATH).first()
    assert tuple(none) == (1, 0, sha256(b"").hexdigest(), sha256(b"").hexdigest())
