"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame functions only.

Every document has an exponential key, -ln(u) / w, with u from a digest of
its id and w its quality weight: the smallest keys are a weighted sample
without replacement. Within a source complete epochs are taken first; the
rest of the target is filled in key order. The prefix sum is taken in two
levels, over buckets of the key and then inside the one bucket a source's
target ends in, so no source is sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragloom.llm.common import WORD_CLASS, cut, id_key

#: Weights of the sources in code point order, repeating; null comes last.
WEIGHTS = (3, 1, 2)
#: Words of the mix, as a share of all words; no source is taken more than CAP times.
SHARE = 1.5
CAP = 2
#: Key buckets a source; a bucket's documents are sorted together.
BUCKETS = 4096
#: Sources whose decisions are broadcast (one short row each); more are joined by shuffle.
BROADCAST_SOURCES = 100_000
JUNK_CLASS = r"[#$%&*@|<>{}\[\]=+~^_0-9]+"


def quality(text: Column) -> Column:
    """0.1 to 1: falls with the square of the share of digits and signs that prose does not use."""
    n = F.length(text)
    clean = F.length(F.regexp_replace(text, JUNK_CLASS, "")) / n
    return F.when(n > 0, 0.1 + 0.9 * clean * clean).otherwise(F.lit(1.0))


def exponential_key(name: Column, weight: Column) -> Column:
    u = (F.conv(F.substring(F.md5(name.cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    return -F.log(u) / weight


#: The order in which a source's rows are taken; equal rows follow each other.
_ORDER = ("key", "doc_id", "size", "row")


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_CLASS)), F.lit(0)).cast("long")


def _bucket(key: Column) -> Column:
    return F.floor(key / (key + 1) * BUCKETS).cast("int")


def _null_safe(a: DataFrame, b: DataFrame, how: str = "inner") -> DataFrame:
    """Join on ``source`` with null equal to null; b's column goes."""
    b = b.withColumnRenamed("source", "__source")
    return a.join(b, a["source"].eqNullSafe(b["__source"]), how).drop("__source")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """source, source_size, target of a (source, source_size) table with one row a source.

    Shares by weight; a source that would pass ``cap`` times its size stops
    there and the excess is shared again. Capped sources are those with the
    smallest cap per weight, so one ordered prefix finds them.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = (sizes.withColumn("r", F.row_number().over(by_name))
              .withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("r") - 1) % len(weights) + 1))
              .withColumn("most", (F.col("source_size") * cap).cast("double")))
    everything = Window.partitionBy()
    fill = Window.orderBy(F.col("most") / F.col("w"), "r")
    before = F.coalesce(F.sum("most").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    weight_left = F.sum("w").over(fill.rowsBetween(0, Window.unboundedFollowing))
    level = ranked.withColumn("level", (F.sum("source_size").over(everything) * share - before) / weight_left)
    level = level.withColumn("full", F.col("most") <= F.col("level") * F.col("w"))
    first_open = F.min_by("level", F.when(~F.col("full"), F.struct((F.col("most") / F.col("w")).alias("x"), F.col("r")))).over(everything)
    return level.withColumn("target", F.when(F.col("full"), F.col("most")).otherwise(first_open * F.col("w"))).select(
        "source", "source_size", "target")


def _cuts(rows: DataFrame, weights, share: float, cap: int) -> DataFrame:
    """One row a source: source_size, target, epochs, and where the fraction ends in key order."""
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = targets(sizes, weights, share, cap)
    plan = plan.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size")))
                           .otherwise(F.lit(0)).cast("long"))
    plan = cut(plan.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")))
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    ends = _null_safe(sums.withColumn("base", F.sum("n").over(upto) - F.col("n")), plan.select("source", "rest"))
    ends = ends.where("rest > 0 and base < rest and base + n >= rest").select("source", "rest", "base", F.col("bucket").alias("last"))
    inside = _null_safe(rows.select("source", "bucket", *_ORDER), ends).where("bucket = last")
    run = Window.partitionBy("source").orderBy(*_ORDER).rowsBetween(Window.unboundedPreceding, 0)
    taken = inside.withColumn("before", F.col("base") + F.sum("size").over(run) - F.col("size"))
    taken = taken.where("2 * before + size <= 2 * rest").groupBy("source").agg(F.max(F.struct(*_ORDER)).alias("end"))
    return _null_safe(_null_safe(plan, ends.select("source", "last"), "left"), taken, "left").select(
        "source", "source_size", "target", "epochs", "last", "end")


def _decide(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """``rows`` with their source's decisions and ``copies``, the times a row is taken."""
    bounded = cuts.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    joined = _null_safe(rows, F.broadcast(cuts) if bounded else cuts)
    inside = (F.col("bucket") < F.col("last")) | ((F.col("bucket") == F.col("last"))
                                                  & (F.struct(*_ORDER) <= F.col("end")))
    return joined.withColumn("copies", F.col("epochs") + F.coalesce(inside, F.lit(False)).cast("long"))


def _rows(docs: DataFrame, doc_id: str, text: str, source: str, *more: Column) -> DataFrame:
    t = F.col(text)
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), size_of(t).alias("size"),
                       exponential_key(id_key(F.col(doc_id), t), quality(t)).alias("key"),
                       F.monotonically_increasing_id().alias("row"), *more).withColumn("bucket", _bucket(F.col("key")))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
        weights=WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """doc_id, size, source_size, target, copies, taken of every row.

    The document at which a target ends is taken if that brings the source
    nearer to its target. Null texts have size 0; a null source is a source
    of its own, last in order; a row without an id is keyed by its text.
    Rows equal in id and text share a key and are taken one by one, in the
    order they are read. Rows of an empty table: none. Other columns are
    ignored, whatever their names. Reruns agree, as the keys are digests.
    """
    rows = cut(_rows(docs, doc_id, text, source))
    out = _decide(rows, cut(_cuts(rows, weights, share, cap)))
    return out.select("doc_id", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mixed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
          weights=WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken, all columns kept.

    The texts are not shuffled: keys and sizes are computed where the rows
    lie and compared with the decisions of their source. ``docs`` is read
    twice and must give its rows in one order, as a table does, or else how
    many of some equal rows are taken may differ. Nulls, ties, repeated rows
    and empty tables as in ``mix``.
    """
    cuts = cut(_cuts(cut(_rows(docs, doc_id, text, source)), weights, share, cap))
    wide = _rows(docs, doc_id, text, source, F.struct("*").alias("__row"))
    return _decide(wide, cuts).where("copies > 0").withColumn(
        "__copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("__row.*")


ORACLE = rf"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
         CASE WHEN length(text) > 0 THEN length(regexp_replace(text, '{JUNK_CLASS}', '', 'g'))::DOUBLE / length(text) END AS clean,
         md5(coalesce(doc_id::VARCHAR, md5(text), '')) AS h
  FROM documents),
k AS (
  SELECT *, -ln((('0x' || substr(h, 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)
            / coalesce(0.1 + 0.9 * clean * clean, 1.0) AS key FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM k GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS r, sum(source_size) OVER ()::DOUBLE AS total FROM s),
w AS (SELECT *, CASE (r - 1) % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 ELSE 2.0 END::DOUBLE AS w, (2 * source_size)::DOUBLE AS most FROM r),
l AS (
  SELECT *, (total * {SHARE}::DOUBLE - coalesce(sum(most) OVER (ORDER BY most / w, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (ORDER BY most / w, r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
o AS (SELECT level FROM l WHERE most > level * w ORDER BY most / w, r LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN most <= level * w THEN most ELSE (SELECT level FROM o) * w END AS target FROM l),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM t),
b AS (
  SELECT k.doc_id, k.size, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS rest,
         sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.size ROWS UNBOUNDED PRECEDING) - k.size AS before
  FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       (size * (epochs + CASE WHEN rest > 0 AND 2 * before + size <= 2 * rest THEN 1 ELSE 0 END))::BIGINT AS taken
FROM b
"""
