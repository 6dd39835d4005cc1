import itertools
import math
import re
import textwrap

import pytest
from pyspark.sql import functions as F

from ragloom.llm import licences
from ragloom.llm.licence_templates import TEMPLATES
from tests.llm.helpers import DOCS, awkward, awkward_rows, empty, prose

TEXTS = {
    1: ("Released under the MIT License.", "mit"), 2: ("Licensed under the Apache License, Version 2.0.", "apache"),
    3: ("This work is licensed under the GNU General Public License, version 3.", "gpl"), 4: ("Licensed under CC BY-NC 4.0.", "cc-by-nc"),
    5: ("Redistribution and use in source and binary forms, with or without modification, are permitted.", "bsd"),
    6: ("The license of the driver was renewed in the public office.", None), 7: (prose(5, 300), None),
    8: ("LICENSED UNDER THE APACHE LICENSE, VERSION 2.0", "apache"), 9: ("Note: released under the MIT License, see below.", "mit"),
}


@pytest.fixture(scope="module")
def scanner(spark):
    return licences.train(awkward(spark))


def test_families(spark, scanner):
    rows = [(k, f"{prose(k, 30)}\n{t}\n\n{prose(k + 50, 30)}", "en", "s", 1) for k, (t, _) in TEXTS.items()]
    got = {r["doc_id"]: r for r in licences.scan(spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS w", "2 AS paragraph"), scanner=scanner).collect()}
    assert {k: (r["paragraph"], r["family"], r["confirmed"]) for k, r in got.items()} == {
        k: (2, f, True) for k, (_, f) in TEXTS.items() if f}
    assert all(0.5 <= r["probability"] <= 1 and 0 <= r["overlap"] <= 1 for r in got.values())


def test_scores_against_plain_sums(spark, scanner):
    line = "Permission is granted: released under the MIT license, not licensed under the Apache license."
    one = spark.createDataFrame([(1, line)], "n int, line string")
    got = scanner.scores(licences.bigrams(one, "line", "n"), "n").first()
    w = {r["gram"]: r["w"] for r in scanner.weights.collect()}
    words = [x.strip(".,:") for x in line.lower().split()]
    pairs = spark.createDataFrame(list(zip(words, words[1:])), "a string, b string").select(F.xxhash64("a", "b")).distinct().collect()
    want = [sum(w[g][k] for (g,) in pairs if g in w) + scanner.bias[k] for k in range(len(scanner.families))]
    assert all(math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9) for x, y in zip(got["logits"], want))


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = licences.scan(docs)
    families = {"MIT License": "mit", "Apache License": "apache", "GNU General": "gpl", "CC BY-NC": "cc-by-nc", "All rights reserved": "proprietary"}
    want = {(r["doc_id"], k + 1, f) for r in docs.collect() for k, line in enumerate(r["text"].split("\n"))
            for cue, f in families.items() if cue in line}
    found = {(r["doc_id"], r["paragraph"], r["family"]) for r in got.collect() if r["confirmed"]}
    assert want and want <= found
    assert found == want
    assert "Python" not in got._jdf.queryExecution().toString()


def test_awkward_and_empty(spark, scanner):
    df = awkward(spark, ("gram", "line", "family"))
    assert licences.scan(df, scanner=scanner).count() == 0
    assert len(awkward_rows()) == df.count()
    assert licences.scan(empty(spark)).count() == 0


def test_trained_on_documents_with_notices(spark):
    notices = [TEMPLATES["bsd"][3], TEMPLATES["mit"][3], TEMPLATES["proprietary"][2], TEMPLATES["proprietary"][3], TEMPLATES["unlicense"][1]]
    families = ["bsd", "mit", "proprietary", "proprietary", "unlicense"]
    rows = [(k, prose(k, 30) + "\n" + ("\n".join(notices) if k % 3 == 0 else prose(k + 500, 30)), "en", "s", 1) for k in range(90)]
    docs = spark.createDataFrame(rows, DOCS)
    got = sorted((r["doc_id"], r["paragraph"], r["family"], r["confirmed"]) for r in licences.scan(docs).collect())
    assert got == [(k, 2 + i, f, True) for k in range(0, 90, 3) for i, f in enumerate(families)]


def test_ordinary_words_of_templates_are_unknown(spark, scanner):
    lines = ["The terms of the loan are in the source of the report.", "Any person may use this in the shop.", "She is free to copy the letter."]
    docs = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in enumerate(lines)], DOCS)
    assert licences.scan(docs, scanner=scanner).count() == 0


WRAPPED = {"bsd": TEMPLATES["bsd"][3], "mit": TEMPLATES["mit"][3], "gpl": TEMPLATES["gpl"][2], "proprietary": TEMPLATES["proprietary"][2]}


@pytest.mark.parametrize("width,mark", [(60, ""), (40, "# "), (25, " * ")])
def test_wrapped_notices(spark, scanner, width, mark):
    rows = []
    for k, t in enumerate(WRAPPED.values()):
        notice = "\n".join(mark + x for x in textwrap.wrap(t, width))
        rows += [(2 * k, f"{prose(k, 30)}\n\n{notice}\n\n{prose(k + 9, 30)}", "en", "s", 1), (2 * k + 1, f"{prose(k, 30)}\n{notice}\n{prose(k + 9, 30)}", "en", "s", 1)]
    got = sorted((r["doc_id"], r["paragraph"], r["family"], r["confirmed"]) for r in licences.scan(spark.createDataFrame(rows, DOCS), scanner=scanner).collect())
    assert got == [(2 * k + j, 3 - j, f, True) for k, f in enumerate(WRAPPED) for j in (0, 1)]


def test_blank_lines_part_notices(spark, scanner):
    lines = textwrap.wrap(WRAPPED["gpl"], 40)
    docs = spark.createDataFrame([(1, "\n\n".join(lines), "en", "s", 1), (2, "Released under the MIT License.\n" + "\n".join(lines), "en", "s", 1)], DOCS)
    got = sorted((r["doc_id"], r["paragraph"], r["family"]) for r in licences.scan(docs, scanner=scanner).collect() if r["confirmed"])
    assert got == [(2, 1, "mit"), (2, 2, "gpl")]


def plain_scan(docs, scanner, gram):
    """The rows of ``scan`` in plain Python; ``gram`` maps two words to the hash the weights are keyed by."""
    weights = {r["gram"]: r["w"] for r in scanner.weights.collect()}
    templates = [(r["template"], r["of"], set(r["expected"])) for r in scanner.templates.collect()]

    def judged(grams):
        known = {g for g in grams if g in weights}
        if not known:
            return None
        logits = [scanner.bias[k] + sum(weights[g][k] for g in known) for k in range(len(scanner.families))]
        top = max(logits)
        family = scanner.families[logits.index(top)]
        p = 1 / sum(math.exp((x - top) / scanner.temperature) for x in logits)
        if family == licences.UNKNOWN or p < licences.LEAST_PROBABILITY:
            return None
        share, template = max((len(known & e) / len(e), t) for t, of, e in templates if of == family)
        return family, p, template, share, share >= licences.LEAST_OVERLAP

    out = []
    for doc_id, text in docs:
        lines = [re.findall(r"[a-z0-9]+(?:\.[0-9]+)*", x.lower()) for x in (text or "").split("\n")]
        inner = [{gram(*p) for p in zip(w, w[1:])} for w in lines]
        seams = [{gram(a[-1], b[0])} if a and b else set() for a, b in zip(lines, lines[1:])] + [set()]
        single = {k: v for k, g in enumerate(inner) if (v := judged(g))}
        runs = set()
        for _, _, e in templates:
            if len(e & set().union(*inner, *seams)) < licences.LEAST_OVERLAP * len(e):
                continue
            held = [k for k in range(len(lines)) if e & (inner[k] | seams[k])]
            for _, island in itertools.groupby(enumerate(held), lambda x: x[1] - x[0]):
                island = [k for _, k in island]
                late = {g: max(k for k in island if g in inner[k] | seams[k]) for g in set().union(*(e & (inner[k] | seams[k]) for k in island))}
                early = {g: min([k for k in island if g in inner[k]] + [k + 1 for k in island if g in seams[k]]) for g in late}
                a, b = min(late.values()), max(early.values())
                if len(late) >= licences.LEAST_OVERLAP * len(e) and a != b:
                    runs.add((min(a, b), max(a, b)))
        found = {}
        for a, b in runs:
            v = judged(set().union(*inner[a:b + 1], *seams[a:b]))
            if v and v[4]:
                found.setdefault(v[0], []).append((a, b, v))
        kept = []
        for family, some in found.items():
            reach, notices = -1, []
            for a, b, v in sorted(some, key=lambda x: x[:2]):
                if not notices or a > reach:
                    notices.append([])
                notices[-1].append((a, b, v))
                reach = max(reach, b)
            for n in notices:
                a, b, v = max(n, key=lambda x: (x[2][3], -x[1], x[0]))
                if not any(s[4] and s[0] == family and a <= k <= b for k, s in single.items()):
                    kept.append((a, b, v))
        out += [(doc_id, k + 1, *v) for k, v in single.items() if v[4] or not any(a <= k <= b for a, b, _ in kept)]
        out += [(doc_id, a + 1, *v) for a, _, v in kept]
    return sorted((d, k, f, round(p, 9), t, round(s, 9), c) for d, k, f, p, t, s, c in out)


def test_against_a_plain_scan(spark, scanner):
    docs = [(k, t) for k, (t, _) in TEXTS.items()] + [(50, None), (51, "")]
    docs += [(100 + 7 * k + j, f"{prose(k, 12)}\n{gap}" + "\n".join(mark + x for x in textwrap.wrap(t, width)) + f"\n{prose(k + 9, 12)}")
             for k, t in enumerate(WRAPPED.values()) for j, (width, mark, gap) in enumerate([(60, "", ""), (40, "# ", "\n"), (25, " * ", ""), (500, "", "")])]
    rest = [x for texts in TEMPLATES.values() for t in texts for x in (t, t[:len(t) // 2], "\n".join(textwrap.wrap(t, 30)))]
    docs += [(1000 + k, t) for k, t in enumerate(rest)] + [(9000, "\n".join(rest)), (9001, "version 1.2.3.\n2.0b of the license a.1b\n\n.5 ...")]
    pairs = set()
    for _, t in docs:
        w = re.findall(r"[a-z0-9]+(?:\.[0-9]+)*", (t or "").lower())
        pairs |= set(zip(w, w[1:]))
    table = spark.createDataFrame(sorted(pairs), "a string, b string").select("a", "b", F.xxhash64("a", "b").alias("g")).collect()
    grams = {(r["a"], r["b"]): r["g"] for r in table}
    assert len(grams) == len(pairs)
    got = licences.scan(spark.createDataFrame([(d, t, "en", "s", 1) for d, t in docs], DOCS).repartition(4), scanner=scanner).collect()
    got = sorted((r["doc_id"], r["paragraph"], r["family"], round(r["probability"], 9), r["template"], round(r["overlap"], 9), r["confirmed"]) for r in got)
    assert got == plain_scan(docs, scanner, lambda a, b: grams[a, b])


def test_long_tokens(spark, scanner):
    texts = ["1" + ".1" * 100_000, "x" * 1_000_000, "a." * 200_000, "Released under the MIT License. " + "Q" * 500_000 + "\n" + "1.1." * 50_000]
    docs = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in enumerate(texts)], DOCS)
    assert [(r["doc_id"], r["paragraph"], r["family"]) for r in licences.scan(docs, scanner=scanner).collect()] == [(3, 1, "mit")]
