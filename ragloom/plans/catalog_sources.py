"""Registered queries over sources and sinks: the drop-folder ingest and the segmented index."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions.mathx import rnd
from ..operators import chunk as chunk_ops
from ..operators import embed as embed_ops
from ..operators import intent_model as im
from ..operators import keywords as kw_ops
from ..session import scratch_path
from ..sources import corpus, index_store, labelled
from ..sources import ingest as ingest_ops
from . import catalog
from .catalog import CLEAN_SQL, COMPRESS_SQL, EVAL_SQL, FIXED_CHUNKS_SQL, HITS_SQL, _benchmark_hits, _eval_per_case, register, table

#: Files that the documents are written to, by id, and drops that the files come in.
FILES = 64
DROPS = 3


class Stopped(Exception):
    """The failure that a query injects between two steps of a run."""


def _stop_at(step: str):
    def at_step(done: str) -> None:
        if done == step:
            raise Stopped(step)
    return at_step


@register("ingest_drops", oracle=f"""
WITH files AS (SELECT doc_id % {FILES} AS doc_id, NULL AS source, string_agg(text || chr(10), '' ORDER BY doc_id) AS text
               FROM documents WHERE text IS NOT NULL GROUP BY doc_id % {FILES}),
chunks AS ({FIXED_CHUNKS_SQL.replace("FROM documents", "FROM files")})
SELECT doc_id AS file, chunk_no, length(text)::BIGINT AS n_chars, md5(text) AS digest FROM chunks
UNION ALL SELECT -1, count(*), 1, 'loaded, rejected' FROM files
""")
def q_ingest_drops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T1 + S1 + S3 + S4 + S6 + S7: files of documents come in three drops, one file is not UTF-8, the first run dies after its
    index and the second after its ledger; the chunks of the index, and a row with the numbers of files loaded and rejected."""
    base = scratch_path(spark, f"ingest-{uuid.uuid4().hex}")
    docs = table(spark, sf_dir, "documents").where("text is not null").select((F.col("doc_id") % FILES).alias("file"), "doc_id", "text")
    docs = docs.repartition("file").sortWithinPartitions("file", "doc_id").checkpoint(eager=True)
    bad = spark.createDataFrame([(b"\xff\xfe not text",)], "value binary").select(F.col("value").cast("string").alias("value"))
    for drop in range(DROPS):
        docs.where(F.col("file") % DROPS == drop).select("file", "text").write.mode("append").partitionBy("file").text(f"{base}/inbox")
        if drop == 0:
            bad.write.mode("append").text(f"{base}/inbox")
        for step in [s for s in ("index", "ledger")[drop:drop + 1]]:
            try:
                ingest_ops.ingest(spark, f"{base}/inbox", f"{base}/index", at_step=_stop_at(step), fixed=True)
            except Stopped:
                pass
        ingest_ops.ingest(spark, f"{base}/inbox", f"{base}/index", fixed=True)
    rows = ingest_ops.load(spark, f"{base}/index")
    chunks = rows.select(F.regexp_extract("source", r"file=(\d+)", 1).cast("long").alias("file"), "chunk_no",
                         F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("digest"))
    files = ingest_ops.ledger(spark, f"{base}/index").agg(F.count_if(F.col("status") == "loaded").alias("a"), F.count_if(F.col("status") == "rejected").alias("b"))
    return chunks.unionByName(files.select(F.lit(-1).cast("long").alias("file"), F.col("a").alias("chunk_no"), F.col("b").alias("n_chars"),
                                           F.lit("loaded, rejected").alias("digest")))


#: Sources of the replacement query: shelves of documents by id.
SHELVES = 50


@register("index_replacements", oracle=f"""
WITH shelved AS (SELECT doc_id, 'shelf-' || (doc_id % {SHELVES}) AS source, CASE WHEN doc_id % 2 = 0 THEN 'second ' || text ELSE text END AS text
                 FROM documents WHERE doc_id % {SHELVES} <> 7),
chunks AS ({FIXED_CHUNKS_SQL.replace("FROM documents", "FROM shelved")})
SELECT chunk_id, source, chunk_no, md5(text) AS digest FROM chunks
""")
def q_index_replacements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O3 with replacement: all sources loaded, half of them loaded again, one deleted, then a compaction; the chunks that count."""
    root = scratch_path(spark, f"segments-{uuid.uuid4().hex}")
    shelf = F.concat(F.lit("shelf-"), F.col("doc_id") % SHELVES)
    docs = table(spark, sf_dir, "documents").select("doc_id", shelf.alias("source"), "text")
    second = docs.where(F.col("doc_id") % 2 == 0).withColumn("text", F.concat(F.lit("second "), "text"))
    ingest_ops.replace_sources(spark, chunk_ops.chunk_documents_fixed(docs), root)
    ingest_ops.replace_sources(spark, chunk_ops.chunk_documents_fixed(second), root)
    ingest_ops.delete_sources(spark, spark.createDataFrame([("shelf-7",)], "source string"), root)
    ingest_ops.compact(spark, root)
    return ingest_ops.load(spark, root).select("chunk_id", "source", "chunk_no", F.md5("text").alias("digest"))


# ------------------------------------------------------ files written, read back and used
_FILES_SQL = f"""files AS (SELECT doc_id % {FILES} AS doc_id, string_agg(text || chr(10), '' ORDER BY doc_id) AS text
          FROM documents WHERE text IS NOT NULL GROUP BY doc_id % {FILES})"""


@register("cleaning_job", oracle=f"""
WITH {_FILES_SQL}
SELECT doc_id AS file, total_lines, removed_lines, md5(clean_text) AS digest FROM ({CLEAN_SQL.replace("FROM documents", "FROM files")}) c
""")
def q_cleaning_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C5 + S1 + S8: files of documents scanned, cleaned and written; the written corpus read back."""
    base = scratch_path(spark, f"cleaning-{uuid.uuid4().hex}")
    docs = table(spark, sf_dir, "documents").where("text is not null").select((F.col("doc_id") % FILES).alias("file"), "doc_id", "text")
    docs.repartition("file").sortWithinPartitions("file", "doc_id").select("file", "text").write.partitionBy("file").text(f"{base}/in")
    corpus.clean_corpus_job(spark, f"{base}/in", f"{base}/out", min_length=L.MIN_USEFUL_LENGTH)
    out = spark.read.parquet(f"{base}/out")
    return out.select(F.regexp_extract("relative_path", r"^file=(\d+)/", 1).cast("long").alias("file"), F.col("total_lines").cast("long").alias("total_lines"),
                      F.col("removed_lines").cast("long").alias("removed_lines"), F.md5("clean_text").alias("digest"))


@register("evaluation_report", oracle=f"""
WITH h AS ({HITS_SQL}), e AS ({EVAL_SQL}),
p AS (SELECT qid, count(*) AS shown, string_agg(replace(substr(text, 1, 150), chr(10), ' '), '|' ORDER BY rank) AS previews FROM h WHERE rank <= 5 GROUP BY qid)
SELECT e.qid, round(e.score, 6) AS score, p.shown, md5(p.previews) AS previews, (SELECT count(*) FROM e) AS cases, round((SELECT avg(score) FROM e), 6) AS avg_score
FROM e JOIN p USING (qid)
""")
def q_evaluation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evaluation report of every benchmark question written as JSON and read back, with its summary."""
    path = f"{scratch_path(spark, f'report-{uuid.uuid4().hex}')}/report"
    labelled.write_eval_report(_eval_per_case(spark, sf_dir), _benchmark_hits(spark, sf_dir), path)
    summary = spark.read.json(f"{path}_summary").first()
    shown = F.array_join(F.transform("top_hits", lambda h: h["preview"]), "|")
    return spark.read.json(path).select("qid", rnd("score").alias("score"), F.size("top_hits").cast("long").alias("shown"), F.md5(shown).alias("previews"),
                                        F.lit(summary["cases"]).alias("cases"), rnd(F.lit(summary["avg_score"])).alias("avg_score"))


_INTENT = "CASE turn % 4 WHEN 0 THEN 'greeting' WHEN 1 THEN 'knowledge' WHEN 2 THEN 'system' ELSE 'not an intent' END"


@register("labelled_utterances", oracle=f"""
SELECT intent, text, label::INT AS label, count(*) AS n FROM (SELECT {_INTENT} AS intent, text FROM conversations WHERE text IS NOT NULL) x
JOIN (SELECT unnest({L.INTENT_CLASSES}) AS intent, unnest(range(0, {len(L.INTENT_CLASSES)})) AS label) c USING (intent) GROUP BY ALL
""")
def q_labelled_utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S9 + F7 + M3: turns written as JSON files {intent: [text, ...]}, read back; unknown intents go, the others get their code."""
    base = scratch_path(spark, f"labelled-{uuid.uuid4().hex}")
    turns = table(spark, sf_dir, "conversations").where("text is not null").select(
        (F.col("conv_id") % FILES).alias("file"), F.expr(_INTENT).alias("intent"), "text")
    lists = turns.groupBy("file", "intent").agg(F.collect_list("text").alias("texts"))
    lists.groupBy("file").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("intent", "texts")))).alias("value")) \
        .repartition("file").write.partitionBy("file").text(base)
    paths = [f"{base}/{n}" for n in index_store._names(spark, base) if n.startswith("file=")]
    rows = labelled.read_labelled_utterances(spark, [*paths, f"{base}/missing.json"])
    coded = rows.join(F.broadcast(im.label_index(spark)), "intent")  # as many rows as classes
    return coded.groupBy("intent", "text", "label").agg(F.count(F.lit(1)).alias("n"))


@register("intent_cases", oracle="""
SELECT CASE WHEN item_id % 2 = 0 THEN 'test_cases' ELSE 'edge_cases' END AS "group", text, 'intent ' || (item_id % 5) AS expected_intent,
       'case ' || item_id AS description FROM benchmark WHERE text IS NOT NULL
""")
def q_intent_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S10 + O4: benchmark items written as case files with two of the three groups, read back."""
    base = scratch_path(spark, f"cases-{uuid.uuid4().hex}")
    case = F.struct("text", F.concat(F.lit("intent "), F.col("item_id") % 5).alias("expected_intent"),
                    F.concat(F.lit("case "), F.col("item_id")).alias("description"))
    even = F.col("item_id") % 2 == 0
    groups = table(spark, sf_dir, "benchmark").where("text is not null").groupBy((F.col("item_id") % 16).alias("file")).agg(
        F.collect_list(F.when(even, case)).alias("test_cases"), F.collect_list(F.when(~even, case)).alias("edge_cases"))
    groups.write.partitionBy("file").json(base)
    return labelled.read_intent_cases(spark, base)


@register("page_index", oracle=f"""
WITH p AS (SELECT page_id AS doc_id, url AS source, html AS text FROM pages),
chunks AS ({FIXED_CHUNKS_SQL.replace("FROM documents", "FROM p")})
SELECT source, doc_id::INT AS page, chunk_no, md5(text) AS digest, {embed_ops.DIM} AS dim FROM chunks
""")
def q_page_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S2 + S4 + S5 + S6 + O3: a table of pages scanned, the index built of one half, the other half appended, loaded again."""
    root = scratch_path(spark, f"pages-{uuid.uuid4().hex}")
    pages = corpus.scan_pages(table(spark, sf_dir, "pages"), "url", "page_id", "html")
    index_store.load_or_build_index(spark, root, corpus=pages.where("page % 2 = 0"), fixed=True)
    index = index_store.load_or_build_index(spark, root, new_docs=pages.where("page % 2 = 1"), fixed=True)
    return index.select("source", "page", "chunk_no", F.md5("text").alias("digest"), F.size("embedding").alias("dim"))


# ------------------------------------------------------------------- P14 by its recursion
def textrank_sql(src: str, key: str, k: int, iterations: int = 10) -> str:
    """Top k tokens of every text of ``src``: the damped updates written out one after another."""
    steps = ",\n".join(f"""r{n} AS MATERIALIZED (SELECT f.{key}, f.d AS token, (1.0::DOUBLE - 0.85::DOUBLE) + 0.85::DOUBLE * sum(f.f * r.r) AS r
      FROM f JOIN r{n - 1} r ON r.{key} = f.{key} AND r.token = f.s GROUP BY f.{key}, f.d)""" for n in range(1, iterations + 1))
    return f"""
WITH t AS (SELECT {key}, regexp_extract_all(lower(text), '\\p{{L}}+') AS w FROM {src}),
p AS (SELECT {key}, least(a, b) AS u, greatest(a, b) AS v, count(*)::DOUBLE AS w
      FROM (SELECT {key}, w[i] AS a, w[i + o] AS b FROM (SELECT {key}, w, unnest(range(1, 5)) AS o FROM t) x, range(1, len(w) - o + 1) g(i)) y
      WHERE a <> b GROUP BY ALL),
e AS MATERIALIZED (SELECT {key}, u AS s, v AS d, w FROM p UNION ALL SELECT {key}, v, u, w FROM p),
o AS MATERIALIZED (SELECT {key}, s, sum(w) AS w FROM e GROUP BY {key}, s),
f AS MATERIALIZED (SELECT e.{key}, e.s, e.d, e.w / o.w AS f FROM e JOIN o USING ({key}, s)),
r0 AS (SELECT {key}, s AS token, 1.0::DOUBLE AS r FROM o),
{steps}
SELECT {key}, rank, token, round(r, 6) AS weight
FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY round(r, 9) DESC, token) AS rank FROM r{iterations}) z WHERE rank <= {k}
"""


@register("textrank_keywords", oracle=textrank_sql("documents", "doc_id", 10))
def q_textrank_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P14 + J6: ten TextRank keywords of every document, after ten damped updates of its word graph."""
    found = kw_ops.textrank_keywords(table(spark, sf_dir, "documents"), 10)
    return found.select("doc_id", F.col("rank").cast("long").alias("rank"), "token", rnd("weight").alias("weight"))


def _prefiltered_sql() -> str:
    """The compression with the keyword prefilter of W3 put before its rerank: sentences of long texts are cut to those
    with most TextRank keywords, and stand in that order."""
    hybrid = COMPRESS_SQL.replace("sent AS (", "sent0 AS (", 1)
    keywords = textrank_sql(f"(SELECT qid * 100 + rank AS hid, array_to_string(ss, '。') AS text FROM ss WHERE len(ss) > {L.PREFILTER_SENTENCES})", "hid", 20)
    sent = f"""kt AS ({keywords}),
kk AS (SELECT hid, list(token) AS kws FROM kt GROUP BY hid),
ranked AS (
  SELECT qid, rank, sid, pos, sentence, count(*) OVER (PARTITION BY qid, rank) AS n, row_number() OVER (PARTITION BY qid, rank ORDER BY score DESC, pos) AS kr
  FROM (SELECT sent0.*, coalesce(len(list_filter(kws, lambda w: contains(lower(sentence), lower(w)))), 0) AS score
        FROM sent0 LEFT JOIN kk ON kk.hid = sent0.qid * 100 + sent0.rank) scored),
sent AS (SELECT qid, rank, sid, CASE WHEN n > {L.PREFILTER_SENTENCES} THEN kr - 1 ELSE pos END AS pos, sentence
         FROM ranked WHERE n <= {L.PREFILTER_SENTENCES} OR kr <= {L.PREFILTER_SENTENCES}),
sv AS ("""
    return hybrid.replace("sv AS (", sent, 1)


catalog.ORACLES["compress_textrank"] = f"""
SELECT qid, rank, chunk_id, n_sentences, compressed, before_chars, CAST(length(compressed) AS BIGINT) AS after_chars,
       round(CASE WHEN before_chars > 0 THEN (1.0 - length(compressed) / before_chars) * 100.0 ELSE 0.0 END, 6) AS ratio
FROM ({_prefiltered_sql()}) c
"""


# ------------------------------------------------------------------- M1, M2, S12 replayed
@register("intent_model_replay", oracle="SELECT vec_id, true AS as_saved, true AS as_replayed, true AS ranked FROM embeddings")
def q_intent_model_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1 + M2 + M4 + S12 + W13: the model saved and loaded again, and its exported weights applied by column functions, give every
    vector the intent and confidence of the model; are its three best probabilities in order."""
    emb = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), "label")
    split = im.stratified_split(emb, "label", "vec_id", 0.2, 42).checkpoint(eager=True)
    names = [f"class {r[0]}" for r in emb.select("label").distinct().orderBy("label").collect()]  # one row a class
    model = im.train_intent_model(split.where("not is_test"), max_iter=100)
    path = scratch_path(spark, f"model-{uuid.uuid4().hex}")
    im.save_model(model, path, spark, names)
    again, classes = im.load_model(path, spark)
    first = im.classify(model, emb, class_names=names).select("vec_id", "embedding", "intent", "confidence")
    second = im.classify(again, emb, class_names=classes).select("vec_id", F.col("intent").alias("intent2"), F.col("confidence").alias("confidence2"), "probabilities")
    weights = [(m.coefficients.toArray().tolist(), float(m.intercept)) for m in model.stages[-1].models]  # classes x dimensions numbers
    margins = [F.aggregate(F.zip_with("embedding", F.array(*[F.lit(x) for x in w]), lambda a, b: a * b), F.lit(b), lambda s, x: s + x) for w, b in weights]
    replayed = first.withColumn("m", F.array(*margins)).withColumn("p", F.transform("m", lambda x: F.lit(1.0) / (F.lit(1.0) + F.exp(-x))))
    total = F.aggregate("p", F.lit(0.0), lambda s, x: s + x)
    best = F.array_position("m", F.array_max("m")).cast("int")
    replayed = replayed.withColumn("as_replayed", (F.element_at(F.array(*[F.lit(n) for n in names]), best) == F.col("intent"))
                                   & (F.abs(F.array_max("p") / total - F.col("confidence")) < 1e-9))
    top = im.top_probabilities(F.col("probabilities"), 3)
    ranked = (F.size(top) == min(3, len(names))) & (top[0]["value"] == F.array_max(F.map_values("probabilities"))) & F.forall(
        F.sequence(F.lit(1), F.size(top) - 1), lambda i: F.get(top, i - 1)["value"] >= F.get(top, i)["value"])
    both = replayed.join(second, "vec_id")
    as_saved = (F.col("intent") == F.col("intent2")) & (F.col("confidence") == F.col("confidence2"))
    return both.select("vec_id", as_saved.alias("as_saved"), "as_replayed", ranked.alias("ranked"))
