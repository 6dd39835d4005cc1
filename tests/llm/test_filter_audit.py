import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
from pyspark.sql import functions as F

from ragloom.llm import filter_audit as fa
from tests.llm.helpers import DOCS, awkward, awkward_rows, empty, prose

LABELS = "doc_id long, quality int, toxic int"


def plain(rows, labels):
    """Every filter applied to every document, order by order."""
    texts = [(d, t or "", lang or "") for d, t, lang, *_ in rows]
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, x in labels if x == 1 and d is not None}

    def failed(d, t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        return {f for f, bad in zip("ABCDE", (
            len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), re.search(r"[#$%&*|]", t) is not None,
            d is not None and any(u == t and e is not None and e < d for e, u, _ in texts))) if bad}
    fails = [(p, d, failed(d, t)) for d, t, p in texts]
    out = Counter()
    for part in {p for p, _, _ in fails}:
        mine = [(d, f) for p, d, f in fails if p == part]
        shapley, found = Counter(), []
        for order in permutations("ABCDE"):
            left = mine
            for k, x in enumerate(order):
                gone, left = [r for r in left if x in r[1]], [r for r in left if x not in r[1]]
                shapley[x] += len(gone)
                found.append(("".join(order), k + 1, len(left), len(gone), sum(x in f for _, f in mine) - len(gone), sum(f == {x} for _, f in mine),
                              sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone), x))
        out.update((part, *r[:-1], shapley[r[-1]]) for r in found)
    return out


def run(docs, labels):
    return Counter(map(tuple, fa.audit(docs, labels).collect()))


def mixed_rows(n):
    r = random.Random(6)
    rows = []
    for k in range(n):
        t = prose(r.randint(0, n // 2), r.choice([3, 150, 199, 200, 201, 400]))
        t = r.choice([t, t.upper(), t + " #", t + " " + "again " * 300, t.title()])
        rows.append((r.randint(0, n), t, r.choice(["en", "de", None, ""]), "s", 1))
    return rows


def test_against_plain_filters(spark):
    rows = mixed_rows(120)
    labels = [(d, d % 2, d % 3 == 0) for d in range(0, 120, 2)] + [(4, 1, 0), (4, 0, None), (None, 1, 1)]
    labels = [(d, q, None if x is None else int(x)) for d, q, x in labels]
    assert run(spark.createDataFrame(rows, DOCS).repartition(7), spark.createDataFrame(labels, LABELS)) == plain(rows, labels)


def test_awkward_rows(spark):
    labels = [(5, 1, 0), (12, 0, 1), (201, 1, 1), (9, None, None)]
    docs = awkward(spark, ("t", "h", "m", "part", "good"))
    assert run(docs, spark.createDataFrame(labels, LABELS).selectExpr("*", "'x' AS lang", "1 AS i")) == plain(awkward_rows(), labels)


def test_empty_tables(spark):
    none = spark.createDataFrame([], LABELS)
    assert fa.audit(empty(spark), none).count() == 0
    got = run(spark.createDataFrame([(1, None, None, "s", 0)], DOCS), none)
    assert sum(got.values()) == 600 and {r[0] for r in got} == {""} and got == plain([(1, None, None, "s", 0)], [])


def test_edges_of_the_conditions(spark):
    texts = {"": "A", "w " * 200: "B", " ".join(f"w{k}" for k in range(199)): "A", " ".join(f"w{k}" for k in range(200)): "",
             " ".join(f"w{k}" for k in range(100)) + " x" * 100: "", "\x0b\x1c 　": "A", "A" * 3 + "b" * 97: "A", "A" * 4 + "b" * 96: "AC",
             "é" * 10 + "|": "AD", "a\x0bb\x0cc\rd": "A", "Á É" * 9: "AB"}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", *[c.alias(n) for c, n in zip(fa.text_failures(F.col("t")), "ABCD")]).collect()
    assert {r["t"]: "".join(n for n in "ABCD" if r[n]) for r in got} == texts


def test_potential_differences_are_shapley_values():
    r = np.random.default_rng(1)
    counts = r.integers(0, 50, (3, 32))
    v = fa.removed(counts)
    p = fa.potentials(v)
    for i in range(5):
        want = sum((v[:, sum(1 << j for j in o[:o.index(i) + 1])] - v[:, sum(1 << j for j in o[:o.index(i)])]) for o in permutations(range(5)))
        assert (p[:, 31] - p[:, 31 ^ 1 << i] == want).all()
    assert (sum(p[:, 31] - p[:, 31 ^ 1 << i] for i in range(5)) == 120 * v[:, 31]).all()
