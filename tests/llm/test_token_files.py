import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from ragloom.llm import token_files
from ragloom.llm.common import scratch
from tests.llm.helpers import awkward, awkward_rows, empty

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_random_access_round_trip():
    r = np.random.default_rng(1)
    for ids in ([7], [0, 255, 256, 65_535, 65_536, 2 ** 32 - 1], r.integers(0, 300, 5000), r.integers(0, 2 ** 20, 1537), np.full(1024, 256)):
        ids = np.array(ids, np.uint32)
        s = token_files.Shard(token_files.pack_shard(3, 4, [9, None], np.array([1, len(ids)]), ids) + token_files.END)
        assert (s.part, s.shard, s.doc_ids, s.ends.tolist()) == (3, 4, [9, None], [1, len(ids)])
        assert [s.token(i) for i in range(len(ids))] == ids.tolist()
        for a, b in [(0, len(ids)), (len(ids), len(ids)), *r.integers(0, len(ids) + 1, (40, 2)).tolist()]:
            assert s.tokens(min(a, b), max(a, b)).tolist() == ids[min(a, b):max(a, b)].tolist()
    with pytest.raises(ValueError):
        token_files.Shard(token_files.pack_shard(0, 0, [1], np.array([1]), np.array([5])))


def test_words_in_turn_are_the_whole_text():
    with open(PATH, encoding="utf-8") as f:
        spec = f.read()
    whole = Tokenizer.from_file(PATH)
    texts = [r[1] for r in awkward_rows() if r[1] is not None] + [
        "It's the DOG'S, they'll we're 'S", "<|endoftext|> <|ENDOFTEXT|>x", "é É ́a", "A B C\x1cD\x85E", "ΣΑΣ ΣΑΣ.", "İI ǅ ﬁ",
        "a1b22 3.14 x_y", "x" * 5000 + "\n" + "y" * 10]
    for by_word in (True, False):
        e = token_files.Encoder(spec, by_word)
        got = [x.tolist() for x in e.batch(pa.array(texts))] + [x.tolist() for x in e.batch(pa.array(texts))]
        assert got == 2 * [whole.encode(t, add_special_tokens=False).ids for t in texts]


def test_long_text_in_steps(monkeypatch):
    monkeypatch.setattr(token_files, "_STEP", 100)
    monkeypatch.setattr(token_files, "_REMEMBER", 20)
    with open(PATH, encoding="utf-8") as f:
        e = token_files.Encoder(f.read(), True)
    texts = [r[1] for r in awkward_rows() if r[1] is not None]
    whole = Tokenizer.from_file(PATH)
    assert [x.tolist() for x in e.batch(pa.array(texts))] == [whole.encode(t, add_special_tokens=False).ids for t in texts]


def plain(rows):
    t = Tokenizer.from_file(PATH)
    ids = [t.encode(r[1] or "", add_special_tokens=False).ids + [2] for r in rows]
    return sorted((r[0] is not None, r[0] or 0, len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for r, i in zip(rows, ids))


@pytest.mark.parametrize("shard_tokens", [50, 4_000_000])
def test_awkward_rows_against_the_library(spark, shard_tokens):
    path = scratch(spark, "tokens")
    token_files.write_token_files(awkward(spark, ("shard", "part", "h", "row")), path, PATH, 2, shard_tokens=shard_tokens)
    got = token_files.read_documents(spark, path).collect()
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_tokens"], r["ids_crc32"]) for r in got) == plain(awkward_rows())
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    in_order = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert in_order == sorted(in_order, key=lambda d: (d is not None, d or 0))


def test_empty(spark):
    path = scratch(spark, "tokens")
    token_files.write_token_files(empty(spark), path, PATH, 2)
    assert token_files.read_documents(spark, path).count() == 0


def test_an_encoder_remembers_a_bounded_number_of_words():
    import public_tokenizers
    from ragloom.llm import token_files
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        enc = token_files.Encoder(f.read(), True)
    letters = "abcdefghijklmnopqrst"
    for k in range(45):  # 6,000 words at a time; up to 600,000 were held before
        enc._learn({(a + b + c + d).encode() for a in letters[:15] for b in letters for c in letters for d in (f"x{k:02d}",)})
    assert max(len(enc.young), len(enc.old)) <= 106_001 and len(enc.young) + len(enc.old) > 6_000


def test_plain_words_are_parted_in_bulk(monkeypatch):
    """Signs, digits, contractions and composed capitals do not send a word to the tokenizer whole, and a part is merged once."""
    with open(PATH, encoding="utf-8") as f:
        e = token_files.Encoder(f.read(), True)
    merged = []

    def seen(parts, encode=e._merged):
        merged.extend(parts)
        return encode(parts)

    monkeypatch.setattr(e, "_whole", None)
    monkeypatch.setattr(e, "_merged", seen)
    monkeypatch.setattr(token_files, "_STEP", 60)
    texts = ["House house, house. house*** (house) 'house'", "house's they'll it'd ''s 'stuff x'y", "Étage ÀÉÎÕÜÞ étage!! a1b22 3.14 $$$ |", "house\nétage", "", " "]
    whole = Tokenizer.from_file(PATH)
    assert [x.tolist() for x in e.batch(pa.array(texts))] == [whole.encode(t, add_special_tokens=False).ids for t in texts]
    assert merged.count(b"house") == 1 and len(merged) < 40


def test_any_mixture_of_characters_against_the_library(monkeypatch):
    monkeypatch.setattr(token_files, "_STEP", 500)
    monkeypatch.setattr(token_files, "_REMEMBER", 50)
    with open(PATH, encoding="utf-8") as f:
        e = token_files.Encoder(f.read(), True)
    kinds = [*"aszléßÿÉÞ×÷09'std.,*|<>`{~\x7f\x00\x1c\x85\xa0\xad̸́ªİſKΣσж中٣½ \n", "'re", "'VE", "<|", "<|endoftext|>", "'s", " ", " "]
    r = np.random.default_rng(5)
    texts = ["".join(kinds[k] for k in r.integers(0, len(kinds), n)) for n in r.integers(0, 60, 600)]
    whole = Tokenizer.from_file(PATH)
    for some in (texts, texts[:50]):
        assert [x.tolist() for x in e.batch(pa.array(some))] == [whole.encode(t, add_special_tokens=False).ids for t in some]


def test_a_tokenizer_that_parts_otherwise_gets_its_words_whole():
    import json
    with open(PATH, encoding="utf-8") as f:
        spec = json.load(f)
    spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] = r"[\p{L}]+|[\p{N}]+|[^\s\p{L}\p{N}]+"
    spec = json.dumps(spec)
    texts = ["it's 1234 and 56a7", "It'S !?"]
    whole = Tokenizer.from_str(spec)
    assert [x.tolist() for x in token_files.Encoder(spec, True).batch(pa.array(texts))] == [whole.encode(t, add_special_tokens=False).ids for t in texts]
