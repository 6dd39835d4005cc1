"""Licence scan of paragraphs, in DataFrame functions only.

A multinomial logistic regression over word bigrams, with an unknown class,
is trained on the templates, on text about licences that is none, and on a
bounded sample of the corpus. Sampled lines that overlap a template are left
out; the others are of the unknown class, with the bigrams they share with
the templates, whose weights are learned. A temperature fitted on held-out
rows calibrates the probabilities. A predicted family is confirmed if the
paragraph holds most of the bigrams of one of the family's templates. A
paragraph is a line, or a run of lines without a blank one between that
together hold most of a template's bigrams (hard-wrapped notices); the last
word of a line and the first of the next are a bigram of such a run.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ragloom.llm.common import cut, prepare
from ragloom.llm.licence_templates import NEAR_MISSES, TEMPLATES

UNKNOWN = "unknown"
#: Documents (first by digest of their id) whose paragraphs train the unknown class.
SAMPLE_DOCUMENTS = 500
#: Least probability of a family, and least share of a template's bigrams.
LEAST_PROBABILITY = 0.5
LEAST_OVERLAP = 0.6
TEMPERATURES = (0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0)
#: A sampled line overlaps a template with LEAST_OVERLAP, or this many, of its bigrams.
SHARED_BIGRAMS = 5
#: One in so many sets of bigrams of sampled lines is held out, for the temperature.
HELD_OUT = 5
#: Weight of all sampled lines together, in training rows.
SAMPLE_WEIGHT = 200.0


def words(paragraph: Column) -> Column:
    """Words of a lower-cased text, dotted numbers with their dots; possessive, so that no token is searched twice or nested."""
    return F.regexp_extract_all(paragraph, F.lit(r"([a-z0-9]++(?:\.[0-9]++)*+)"), F.lit(1))


def _pairs(split: DataFrame, *keep: str) -> DataFrame:
    """One row a bigram of the words in ``w``: the ``keep`` columns and ``gram``, the hash of two words in turn."""
    return split.where(F.size("w") > 1).select(*keep, F.inline(F.arrays_zip(
        F.slice("w", F.lit(1), F.size("w") - 1).alias("a"), F.slice("w", F.lit(2), F.size("w")).alias("b")))).select(
            *keep, F.xxhash64("a", "b").alias("gram"))


def bigrams(rows: DataFrame, paragraph: str, *keep: str) -> DataFrame:
    return _pairs(rows.select(*keep, words(F.lower(F.col(paragraph))).alias("w")), *keep)


def paragraphs(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """row, doc_id, paragraph (from 1), w, seam: the words of every line of every text; seam: its last word and the next line's first."""
    rows = docs.where(F.col(text).isNotNull()).select(
        F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"),
        F.transform(F.split(F.lower(F.col(text)), "\n"), words).alias("lines"))
    both = F.arrays_zip(F.col("lines").alias("w"), F.slice("lines", F.lit(2), F.size("lines")).alias("next"))
    rows = rows.select("row", "doc_id", F.posexplode(both).alias("at", "x"))
    seam = F.array_compact(F.array(F.try_element_at("x.w", F.lit(-1)), F.try_element_at("x.next", F.lit(1))))
    return rows.select("row", "doc_id", (F.col("at") + 1).alias("paragraph"), F.col("x.w").alias("w"), seam.alias("seam"))


def _examples(spark: SparkSession) -> list[tuple[int, str, str, bool]]:
    """(number, family, text, held out): templates and variants of them, near misses."""
    rows = []
    for family, texts in [*TEMPLATES.items(), (UNKNOWN, NEAR_MISSES)]:
        for t in texts:
            tail = " ".join(t.split()[1:])
            for k, x in enumerate((t, tail, f"Copyright 2021 Example Authors. {t}", f"{t} See the file for details.", f"Note: {t}")):
                if k != 1 or len(tail.split()) > 4:
                    rows.append((len(rows), family, x, k == 4))
    return rows


class Scanner:
    """A trained classifier: small tables that are joined by broadcast."""

    def __init__(self, families: list[str], weights: DataFrame, bias: list[float], temperature: float, templates: DataFrame):
        self.families, self.weights, self.bias = families, weights, bias
        self.temperature, self.templates = temperature, templates

    def scores(self, grams: DataFrame, *key: str) -> DataFrame:
        """``key`` columns, logits by family and the bigrams known, for keys with at least one of them."""
        hit = grams.join(F.broadcast(self.weights), "gram").select(*key, "gram", "w").groupBy(*key, "gram").agg(F.first("w").alias("w"))
        sums = [(F.sum(F.col("w")[k]) + self.bias[k]) for k in range(len(self.families))]
        return hit.groupBy(*key).agg(F.array(*sums).alias("logits"), F.collect_set("gram").alias("known"))

    def calibrated(self, scored: DataFrame, temperature: float | None = None) -> DataFrame:
        """``scored`` with ``family`` and ``probability`` of the best class."""
        t = float(temperature or self.temperature)
        top = F.array_max("logits")
        bottom = F.aggregate("logits", F.lit(0.0), lambda a, x: a + F.exp((x - top) / t))
        names = F.array(*[F.lit(f) for f in self.families])
        return scored.withColumn("family", F.element_at(names, F.array_position("logits", top).cast("int"))) \
            .withColumn("probability", 1 / bottom)


    def named(self, grams: DataFrame, *key: str) -> DataFrame:
        """``key`` columns, family, probability, template, overlap, confirmed for keys that are of a family."""
        found = self.calibrated(self.scores(grams, *key))
        found = found.where((F.col("family") != UNKNOWN) & (F.col("probability") >= LEAST_PROBABILITY))
        share = F.size(F.array_intersect("known", "expected")) / F.size("expected")
        held = found.join(F.broadcast(self.templates), F.col("family") == F.col("of"), "left")
        best = held.withColumn("overlap", F.coalesce(share, F.lit(0.0))).groupBy(*key, "family", "probability").agg(
            F.max(F.struct("overlap", "template")).alias("best"))
        return best.select(*key, "family", "probability", F.col("best.template").alias("template"), F.col("best.overlap").alias("overlap"),
                           (F.col("best.overlap") >= LEAST_OVERLAP).alias("confirmed"))


def _hits(lines: DataFrame, vocabulary: DataFrame, *key: str) -> DataFrame:
    """``key`` columns, gram, seam: the bigrams of the vocabulary in every line and at its seam, materialised."""
    parts = lines.select(*key, F.inline(F.array(F.struct("w", F.lit(False).alias("seam")),
                                                F.struct(F.col("seam").alias("w"), F.lit(True).alias("seam")))))
    return cut(_pairs(parts, *key, "seam").join(F.broadcast(vocabulary), "gram"))


def _runs(hits: DataFrame, templates: DataFrame) -> DataFrame:
    """row, doc_id, paragraph, until: runs of lines, more than one, that together hold LEAST_OVERLAP of a template."""
    expected = templates.select("template", F.size("expected").alias("n"), F.explode("expected").alias("gram"))
    key = ["row", "doc_id", "template", "n"]
    held = hits.join(F.broadcast(expected), "gram").groupBy(*key).agg(F.collect_list(F.struct("paragraph", "gram", "seam")).alias("at"))
    held = held.where(F.size(F.array_distinct("at.gram")) >= LEAST_OVERLAP * F.col("n")).select(*key, F.inline("at"))
    # a seam belongs to two lines; lines without a bigram of the template, so blank ones too, part the runs
    rank = F.dense_rank().over(Window.partitionBy(*key).orderBy("paragraph"))
    held = held.withColumn("island", F.col("paragraph") - rank).groupBy(*key, "island", "gram").agg(
        F.max("paragraph").alias("late"), F.min(F.col("paragraph") + F.col("seam").cast("int")).alias("early"))
    runs = held.groupBy(*key, "island").agg(F.count(F.lit(1)).alias("shared"), F.min("late").alias("a"), F.max("early").alias("b"))
    runs = runs.where((F.col("shared") >= LEAST_OVERLAP * F.col("n")) & (F.col("a") != F.col("b")))
    return runs.select("row", "doc_id", F.least("a", "b").alias("paragraph"), F.greatest("a", "b").alias("until")).distinct()


def _log_loss(temperature: float) -> Column:
    top = F.array_max("logits")
    bottom = F.aggregate("logits", F.lit(0.0), lambda a, x: a + F.exp((x - top) / temperature))
    return F.log(bottom) - (F.col("own") - top) / temperature


def _plain(sample: DataFrame, vocabulary: DataFrame, templates: DataFrame) -> DataFrame:
    """g, rows: sets of vocabulary bigrams of the sampled lines that overlap no template, alone or in a run, and their number of lines."""
    lines = cut(paragraphs(sample, "i", "t"))
    key = ["row", "doc_id", "paragraph"]
    every = _hits(lines, vocabulary, *key)
    runs = _runs(every, templates).alias("r")
    inside = (F.col("h.row") == F.col("r.row")) & F.col("h.paragraph").between(F.col("r.paragraph"), F.col("r.until"))
    hits = every.where("not seam").groupBy(*key).agg(F.sort_array(F.collect_set("gram")).alias("g")).alias("h").join(runs, inside, "left_anti")
    expected = templates.select("template", F.size("expected").alias("n"), F.explode("expected").alias("gram"))
    shared = every.where("not seam").select(*key, "gram").distinct().join(F.broadcast(expected), "gram").groupBy(*key, "template", "n").count()
    overlapping = shared.where((F.col("count") >= SHARED_BIGRAMS) | (F.col("count") >= LEAST_OVERLAP * F.col("n")))
    found = hits.join(overlapping.select("row", "paragraph").distinct(), ["row", "paragraph"], "left_anti").groupBy("g").agg(F.count(F.lit(1)).alias("rows"))
    none = lines.join(every.where("not seam"), ["row", "paragraph"], "left_anti").agg(F.array().cast("array<long>").alias("g"), F.count(F.lit(1)).alias("rows"))
    return found.unionByName(none)


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Scanner:
    """Fit on the templates and at most SAMPLE_DOCUMENTS documents; all driver-side state is as small as these."""
    spark = docs.sparkSession
    prepare(spark)
    families = [*sorted(TEMPLATES), UNKNOWN]
    examples = spark.createDataFrame(_examples(spark), "n int, family string, line string, held boolean")
    rows = docs.select(F.col(doc_id).cast("string").alias("i"), F.col(text).alias("t")).where("t is not null")
    u = F.conv(F.substring(F.md5(F.coalesce("i", F.md5("t")).cast("binary")), 1, 13), 16, 10).cast("double") / float(1 << 52)
    # about twice the sample by digest, wherever it lies; only these few rows are then ordered
    share = min(1.0, 2.0 * SAMPLE_DOCUMENTS / max(1, docs.count()))
    sample = rows.withColumn("u", u).where(F.col("u") < share).orderBy("u", "t").limit(SAMPLE_DOCUMENTS)
    grams = cut(bigrams(examples, "line", "n", "family", "held").distinct().coalesce(1))
    vocabulary = [str(r["gram"]) for r in grams.select("gram").distinct().orderBy("gram").collect()]
    named = bigrams(spark.createDataFrame([(f"{f}-{k}", f, t) for f in sorted(TEMPLATES) for k, t in enumerate(TEMPLATES[f])],
                                          "template string, of string, line string"), "line", "template", "of")
    templates = cut(named.groupBy("template", "of").agg(F.collect_set("gram").alias("expected")))
    label = F.array_position(F.array(*[F.lit(f) for f in families]), F.col("family")).cast("double") - 1
    some = examples.join(grams.groupBy("n").agg(F.collect_list(F.col("gram").cast("string")).alias("g")), "n", "left").where("not held")
    some = some.select(label.alias("label"), F.coalesce("g", F.array().cast("array<string>")).alias("g"), F.lit(1.0).alias("weight"))
    plain = cut(_plain(sample, grams.select("gram").distinct(), templates))
    kept_out = F.pmod(F.xxhash64("g"), F.lit(HELD_OUT)) == 0  # never of the lines without a bigram, which have no score
    unseen = plain.where(kept_out & (F.size("g") > 0)).withColumn("n", F.monotonically_increasing_id() + F.lit(1 << 32))
    plain = plain.where(~kept_out | (F.size("g") == 0))
    total = plain.agg(F.sum("rows")).first()[0] or 0
    plain = plain.select(F.lit(float(len(families) - 1)).alias("label"), F.transform("g", lambda x: x.cast("string")).alias("g"),
                         (F.col("rows") * (min(SAMPLE_WEIGHT, total) / max(1, total))).alias("weight"))
    vectors = CountVectorizerModel.from_vocabulary(vocabulary, "g", "features", binary=True).transform(some.union(plain)).coalesce(1).cache()
    fitted = LogisticRegression(family="multinomial", regParam=0.002, maxIter=60, weightCol="weight").fit(vectors)
    vectors.unpersist()
    n = fitted.numClasses
    matrix = fitted.coefficientMatrix.toArray()
    bias = [float(b) for b in fitted.interceptVector.toArray()] + [0.0] * (len(families) - n)
    weights = spark.createDataFrame([(int(g), [float(matrix[k, j]) for k in range(n)]) for j, g in enumerate(vocabulary)],
                                    "gram long, w array<double>")
    scanner = Scanner(families, weights, bias, 1.0, templates)
    asked = grams.where("held").select(F.col("n").cast("long").alias("n"), "family", "gram").unionByName(
        unseen.select("n", F.lit(UNKNOWN).alias("family"), F.explode("g").alias("gram")))
    held = cut(scanner.scores(asked, "n", "family").withColumn(
        "own", F.element_at("logits", F.array_position(F.array(*[F.lit(f) for f in families]), F.col("family")).cast("int"))))
    found = held.agg(*[F.avg(_log_loss(t)) for t in TEMPERATURES]).first()
    scanner.temperature = min((x, t) for x, t in zip(found, TEMPERATURES))[1]
    return scanner


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", scanner: Scanner | None = None) -> DataFrame:
    """doc_id, paragraph, family, probability, template, overlap, confirmed: one row a paragraph that is of a family.

    Paragraphs are the lines of a text, numbered from 1. Null and empty
    texts, empty tables and lines without two words give no rows; lines and
    tokens of any length are read once; repeated rows of ``docs`` give rows
    each; a null id stays null. Other columns are ignored. A paragraph without a known bigram is of the unknown class.
    A run of lines gives a row, numbered by its first line, if it confirms a
    family that none of its lines confirms alone; unconfirmed rows of its
    lines go. ``docs`` is not shuffled; only bigrams of the vocabulary are
    written and reach the aggregations. With a ready scanner ``docs`` is read
    once; training reads it twice more, for a count and for the sample.
    """
    scanner = scanner or train(docs, doc_id, text)
    key = ("row", "doc_id", "paragraph")
    hits = _hits(paragraphs(docs, doc_id, text), scanner.weights.select("gram"), *key)
    lines = scanner.named(hits.where("not seam").select(*key, "gram"), *key).withColumn("until", F.col("paragraph"))
    runs = _runs(hits, scanner.templates)
    unit = ("row", "doc_id", "paragraph", "until")
    inside = (F.col("h.row") == F.col("r.row")) & F.col("h.paragraph").between(F.col("r.paragraph"), F.col("r.until") - F.col("h.seam").cast("int"))
    joined = hits.alias("h").join(runs.alias("r"), inside).select("r.row", "r.doc_id", "r.paragraph", "r.until", "h.gram")
    joined = scanner.named(joined, *unit).where("confirmed")
    # runs of a family that share lines are one notice: the run that holds most of its template stands for it
    before = Window.partitionBy("row", "doc_id", "family").orderBy("paragraph", "until")
    reach = F.max("until").over(before.rowsBetween(Window.unboundedPreceding, -1))
    joined = joined.withColumn("opens", F.coalesce(F.col("paragraph") > reach, F.lit(True)).cast("int"))
    joined = joined.withColumn("notice", F.sum("opens").over(before.rowsBetween(Window.unboundedPreceding, 0)))
    joined = joined.groupBy("row", "doc_id", "family", "notice").agg(F.max_by(
        F.struct("paragraph", "until", "probability", "template", "overlap", "confirmed"),
        F.struct("overlap", -F.col("until"), "paragraph")).alias("x")).select("row", "doc_id", "family", "x.*")
    overlap = (F.col("l.row") == F.col("j.row")) & F.col("l.paragraph").between(F.col("j.paragraph"), F.col("j.until"))
    joined = cut(joined.alias("j").join(lines.where("confirmed").alias("l"), overlap & (F.col("l.family") == F.col("j.family")), "left_anti"))
    lines = lines.alias("l").join(joined.alias("j"), overlap & ~F.col("l.confirmed"), "left_anti")
    return lines.unionByName(joined).select("doc_id", "paragraph", "family", "probability", "template", "overlap", "confirmed")
