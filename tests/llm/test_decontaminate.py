import hashlib
import re

import pytest

from ragloom.llm import decontaminate
from tests.llm.helpers import awkward, awkward_rows, empty, prose

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain(text, items):
    def words(t):
        return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    w, hit, ids = words(text), set(), set()
    for item, t in items:
        v = words(t)
        length = min(13, len(v))
        windows = {tuple(v[k:k + length]) for k in range(len(v) - length + 1)} if v else set()
        for k in range(len(w) - length + 1 if v else 0):
            if tuple(w[k:k + length]) in windows:
                hit |= set(range(k, k + length))
                if item is not None:
                    ids.add(str(item))
    return (len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(),
            len(hit) > 0 and 20 * len(hit) >= len(w))


ITEMS = [(1, prose(3, 60_000)[:400]), (10, "One, two THREE"), (2, prose(101, 27)), (2, "one two three"), (None, "wörds"), (4, None), (5, "?!"),
         (6, prose(1, 40)), (7, "one"), (8, prose(2, 200))]


@pytest.mark.parametrize("pass_bytes", [1 << 24, 600])
def test_awkward_rows_against_plain_search(spark, pass_bytes):
    benchmark = spark.createDataFrame(ITEMS, "item_id long, text string").selectExpr("*", "1 AS hits")
    got = decontaminate.with_hits(awkward(spark, ("item_id", "spans", "__found", "__row")), benchmark, pass_bytes=pass_bytes).collect()
    assert len(got) == len(awkward_rows())
    for r in got:
        h = r["hits"]
        assert (h["n_words"], h["n_hit"], h["n_items"], h["items_sha256"], h["contaminated"]) == plain(r["text"], ITEMS)
        assert r["item_id"] == "mine" and sum(h["spans"][1::2]) - sum(h["spans"][::2]) == h["n_hit"]


def test_search_finds_all_overlapping_occurrences():
    patterns = [b" a b ", b" a b c ", b" b c ", b" c a b "]
    text = b" a b c a b a b "
    got = sorted(decontaminate.WuManber(patterns, block=2).occurrences(text))
    assert got == sorted((i, p) for p in patterns for i in range(len(text)) if text.startswith(p, i))


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.with_hits(empty(spark), none).count() == 0
    got = decontaminate.with_hits(awkward(spark), none).selectExpr("hits.*").collect()
    assert all(r["n_hit"] == 0 and not r["contaminated"] and r["n_items"] == 0 for r in got)
