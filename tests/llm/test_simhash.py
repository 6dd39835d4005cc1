from collections import Counter

import numpy as np
import pytest
import xxhash

from ragloom.llm import simhash
from ragloom.llm.components import connected_components
from tests.llm.helpers import awkward, awkward_rows, closure, empty, smallest_ids


def plain_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ")
             .replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def expected(rows):
    fps = [plain_fingerprint(r[1]) for r in rows]
    roots = closure(len(rows), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 4)
    ids = smallest_ids([r[0] for r in rows], roots)
    return Counter((r[0], f"{f:016x}", c) for r, f, c in zip(rows, fps, ids)), roots


@pytest.mark.parametrize("tile_rows", [4, None])
def test_awkward_rows_against_all_pairs(spark, tile_rows):
    got = simhash.near_duplicates(awkward(spark, ("fingerprint", "fp", "root", "p")), tile_rows=tile_rows)
    assert Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got.collect()) == expected(awkward_rows())[0]


def test_given_documents_against_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [tuple(r) for r in docs.collect()]
    got = simhash.near_duplicates(docs)
    assert Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got.collect()) == expected(rows)[0]


def test_keeps_one_row_of_each_component(spark):
    kept = simhash.keep_one_of_each(awkward(spark, ("fp", "root"))).collect()
    _, roots = expected(awkward_rows())
    assert len(kept) == len(set(roots))
    assert {"fp", "root", "text", "n_chars"} <= set(kept[0].asDict()) and kept[0]["fp"] == "mine"
    assert [r["doc_id"] for r in kept].count(5) == 1 and 7 not in [r["doc_id"] for r in kept]


def test_forest_of_random_tiles_connects_what_links_connect():
    r = np.random.default_rng(3)
    base = r.integers(0, 1 << 63, 12, dtype=np.uint64)
    fps = np.unique(np.concatenate([base, *[base ^ (np.uint64(1) << r.integers(0, 64, 12).astype(np.uint64)) for _ in range(9)]]))
    a, b = fps[::2], fps[1::2]
    for x, y in ((fps, None), (a, b)):
        both = x if y is None else np.concatenate([x, y])
        cross = (lambda i, j: True) if y is None else (lambda i, j: (i < len(x)) != (j < len(x)))
        want = closure(len(both), lambda i, j: cross(i, j) and (int(both[i]) ^ int(both[j])).bit_count() <= 4)
        u, v = simhash.tile_forest(x, y, 4)
        links = {(int(p), int(q)) for p, q in zip(u, v)}
        index = {int(f): k for k, f in enumerate(both)}
        pairs = {(index[p], index[q]) for p, q in links} | {(index[q], index[p]) for p, q in links}
        got = closure(len(both), lambda i, j: (i, j) in pairs)
        assert got == want


def test_empty(spark):
    assert simhash.near_duplicates(empty(spark)).count() == 0
    assert simhash.keep_one_of_each(empty(spark)).count() == 0


def test_components_of_a_long_chain_and_a_hub(spark):
    links = [(k, k + 1) for k in range(60)] + [(1000, 1000 + k) for k in range(1, 50)] + [(3, 3), (None, 1), (2000, 1999)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert got == {**{k: 0 for k in range(61)}, **{1000 + k: 1000 for k in range(50)}, 1999: 1999, 2000: 1999}


def test_texts_are_shuffled_once_and_repeated_rows_are_cut_before(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = simhash.keep_one_of_each(awkward(spark).repartition(3))
        plan = kept._jdf.queryExecution().executedPlan().toString()
        assert kept.count() > 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    texts = [line for line in plan.split("\n") if "Exchange hashpartitioning(__id" in line]
    assert plan.count("WindowGroupLimit") == 2 and "Partial" in plan
    assert len(texts) == 2  # the rows with their texts, and the chosen keys
