"""Registered queries over the driver tables and their DuckDB oracles.

Every query reads whole tables from ``sf_dir`` (or data Spark derives from
them) and returns a DataFrame; ``ORACLES`` holds, for the SQL-expressible
ones, an independent DuckDB statement with the same column names.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions.mathx import pct2, rnd
from ..operators import chunk as chunk_ops
from ..operators import clean as clean_ops
from ..operators import compress as comp_ops
from ..operators import keywords as kw_ops
from ..operators import embed as embed_ops
from ..operators import evaluate as eval_ops
from ..operators import knn as knn_ops
from ..operators import route as route_ops
from ..operators import traffic as traffic_ops
from ..operators import validate as val_ops
from ..functions.text import split_sentences
from ..session import spread
from ..session import table as _table
from . import sqlgen as S


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Driver table; the document corpus is spread over the task slots when under-partitioned."""
    df = _table(spark, sf_dir, name)
    return spread(df) if name == "documents" else df

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


# =========================================================== retrieval
KNN_K = 10


def _knn_self(spark: SparkSession, sf_dir: str, k: int = KNN_K) -> DataFrame:
    """Every stored vector asks for its k nearest other vectors (leave-one-out)."""
    emb = table(spark, sf_dir, "embeddings")
    return knn_ops.knn_join(emb, emb, k=k, q_id="vec_id", x_id="vec_id", exclude_self=True)


@register("knn_top10", oracle=f"""
WITH pairs AS (
  SELECT q.vec_id AS qid, x.vec_id AS neighbour_id,
         {S.sqdist('q.embedding', 'x.embedding')} AS d
  FROM embeddings q JOIN embeddings x ON q.vec_id <> x.vec_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, neighbour_id) AS rank FROM pairs
)
SELECT qid, rank, neighbour_id, round(d, 6) AS distance, round(1.0 / (1.0 + d), 6) AS similarity
FROM ranked WHERE rank <= {KNN_K}
""")
def q_knn_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J1 + W1 + P9 + P10: exact leave-one-out top-10 over the whole vector table."""
    hits = _knn_self(spark, sf_dir)
    return hits.select("qid", F.col("rank").cast("long").alias("rank"),
                       F.col("id").alias("neighbour_id"),
                       rnd("distance").alias("distance"),
                       rnd(knn_ops.distance_to_similarity("distance")).alias("similarity"))


# ======================================================== corpus cleaning
def _spam_sql(x: str) -> str:
    return S.first_contained(x, L.SPAM_KEYWORDS)


CLEAN_SQL = f"""
WITH t AS (
  SELECT doc_id,
         list_transform(string_split(text, chr(10)), lambda l: {S.normalise('l')}) AS ls
  FROM documents
), r AS (
  SELECT doc_id,
         list_transform(ls, lambda l: {{'line': l, 'reason':
            CASE WHEN l = '' THEN 'empty'
                 WHEN {_spam_sql('l')} IS NOT NULL THEN 'spam'
                 WHEN length(l) < {L.MIN_USEFUL_LENGTH} THEN 'short' END}}) AS arr
  FROM t
)
SELECT doc_id,
       array_to_string(list_transform(list_filter(arr, lambda s: s.reason IS NULL),
                                      lambda s: s.line), chr(10) || chr(10)) AS clean_text,
       len(arr) AS total_lines,
       len(list_filter(arr, lambda s: s.reason IS NOT NULL)) AS removed_lines,
       len(list_filter(arr, lambda s: s.reason = 'spam')) AS spam_lines,
       len(list_filter(arr, lambda s: s.reason = 'empty')) AS empty_lines,
       len(list_filter(arr, lambda s: s.reason = 'short')) AS short_lines
FROM r
"""


@register("clean_documents", oracle=CLEAN_SQL)
def q_clean_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P1 + P2 + P3 + A1 per document."""
    docs = table(spark, sf_dir, "documents")
    return clean_ops.clean_documents(docs).select(
        "doc_id", "clean_text", *[F.col(c).cast("long").alias(c) for c in
                                  ("total_lines", "removed_lines", "spam_lines",
                                   "empty_lines", "short_lines")])


@register("cleaning_totals", oracle=f"""
WITH c AS ({CLEAN_SQL})
SELECT d.lang AS lang, count(*) AS files_processed,
       CAST(sum(total_lines) AS BIGINT) AS total_lines, CAST(sum(removed_lines) AS BIGINT) AS removed_lines,
       CAST(sum(spam_lines) AS BIGINT) AS spam_lines, CAST(sum(empty_lines) AS BIGINT) AS empty_lines,
       CAST(sum(short_lines) AS BIGINT) AS short_lines,
       CASE WHEN sum(total_lines) > 0
            THEN floor((2000 * sum(removed_lines) + sum(total_lines)) / (2.0 * sum(total_lines))) / 10.0
            ELSE 0.0 END AS removed_pct
FROM c JOIN documents d USING (doc_id)
GROUP BY d.lang
""")
def q_cleaning_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1 overall, per language of the corpus."""
    docs = table(spark, sf_dir, "documents")
    cleaned = clean_ops.clean_documents(docs, keep_columns=("doc_id", "lang"))
    return clean_ops.cleaning_totals(cleaned, ("lang",))


# ============================================== question validation
def _user_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = table(spark, sf_dir, "conversations")
    return conv.filter(F.col("role") == "user").select("conv_id", "turn", "text")


def _validate_sql(src: str = "conversations WHERE role = 'user'", ids: str = "conv_id, turn") -> str:
    st = S.strip("text")
    cut = f"(CASE WHEN length({st}) > {L.MAX_INPUT_LENGTH} THEN substr({st}, 1, {L.MAX_INPUT_LENGTH}) ELSE {st} END)"
    low = f"lower({cut})"
    probe = " OR ".join(f"regexp_matches({low}, {S.q(p)})" for p in L.SYSTEM_PROBE_PATTERNS)
    return f"""
SELECT {ids},
  CASE WHEN text IS NULL OR {st} = '' THEN false
       WHEN {S.any_contains(low, L.BLOCKED_KEYWORDS, lower=False)} THEN false
       WHEN ({probe}) THEN false
       WHEN {S.count_contained(low, L.TECH_TERMS)} >= {L.TECH_TERMS_LIMIT} THEN false
       ELSE true END AS ok,
  CASE WHEN text IS NULL OR {st} = '' THEN ''
       WHEN {S.any_contains(low, L.BLOCKED_KEYWORDS, lower=False)} THEN ''
       WHEN ({probe}) THEN ''
       WHEN {S.count_contained(low, L.TECH_TERMS)} >= {L.TECH_TERMS_LIMIT} THEN ''
       ELSE {cut} END AS text,
  CASE WHEN text IS NULL OR {st} = '' THEN {S.q(L.MSG_EMPTY)}
       WHEN {S.any_contains(low, L.BLOCKED_KEYWORDS, lower=False)} THEN {S.q(L.MSG_SECURITY)}
       WHEN ({probe}) THEN {S.q(L.MSG_SECURITY)}
       WHEN {S.count_contained(low, L.TECH_TERMS)} >= {L.TECH_TERMS_LIMIT} THEN {S.q(L.MSG_SECURITY)}
       ELSE NULL END AS error,
  CASE WHEN text IS NULL OR {st} = '' THEN 'empty'
       WHEN {S.any_contains(low, L.BLOCKED_KEYWORDS, lower=False)} THEN 'blocked_keyword'
       WHEN ({probe}) THEN 'system_probe'
       WHEN {S.count_contained(low, L.TECH_TERMS)} >= {L.TECH_TERMS_LIMIT} THEN 'tech_terms'
       WHEN length({st}) > {L.MAX_INPUT_LENGTH} THEN 'truncated'
       ELSE 'ok' END AS reason
FROM {src}
"""


VALIDATE_SQL = _validate_sql()


@register("validate_questions", oracle=VALIDATE_SQL)
def q_validate_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1-F4 + P24 over every user turn."""
    return val_ops.validate_questions(_user_turns(spark, sf_dir))


@register("filter_profile", oracle=f"""
SELECT reason, count(*) AS n, bool_or(ok) AS ok FROM ({VALIDATE_SQL}) v GROUP BY reason
""")
def q_filter_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10: validation outcomes by reason."""
    return val_ops.filter_profile(val_ops.validate_questions(_user_turns(spark, sf_dir)))


# ======================================================= routing
def _route_sql(src: str = "conversations WHERE role = 'user'", ids: str = "conv_id, turn") -> str:
    t = f"lower_strip"
    dids = ", ".join("d." + c.strip() for c in ids.split(","))
    pol = " UNION ALL ".join(
        f"SELECT {S.q(i)} AS intent, {str(s).lower()} AS skip_rag, "
        f"{S.q(r) if r is not None else 'NULL::VARCHAR'} AS response"
        for i, s, r in L.INTENT_POLICIES)
    return f"""
WITH base AS (
  SELECT {ids}, text, {S.strip('lower(text)')} AS lower_strip
  FROM {src}
), c AS (
  SELECT {ids}, text, {S.rule_intent(t)} AS r, {S.keyword_intent(t)} AS k FROM base
), d AS (
  SELECT {ids}, text, coalesce(r, k, 'knowledge') AS intent,
         CASE WHEN r IS NOT NULL THEN {L.RULE_CONFIDENCE}::DOUBLE WHEN k IS NOT NULL THEN {L.KEYWORD_CONFIDENCE}::DOUBLE
              ELSE {L.DEFAULT_CONFIDENCE}::DOUBLE END AS confidence,
         CASE WHEN r IS NOT NULL THEN 'rule' WHEN k IS NOT NULL THEN 'keyword' ELSE 'default' END AS method
  FROM c
), pol AS ({pol})
SELECT {dids}, d.text, d.intent, d.confidence, d.method,
       coalesce(pol.skip_rag, false) AS skip_rag, pol.response
FROM d LEFT JOIN pol ON d.intent = pol.intent
"""


ROUTE_SQL = _route_sql()


@register("route_questions", oracle=ROUTE_SQL)
def q_route_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C1 (rules -> keywords -> default) + J4 over every user turn."""
    routed = route_ops.route_questions(_user_turns(spark, sf_dir))
    return routed.select("conv_id", "turn", "text", "intent", "confidence", "method",
                         "skip_rag", "response")


def _kw_join_sql() -> str:
    t = "lower_strip"
    names = list(L.INTENT_KEYWORDS)
    scores = {i: S.keyword_score(t, L.INTENT_KEYWORDS[i]) for i in names}
    best = "greatest(" + ", ".join(scores[i] for i in names) + ")"
    return f"""
SELECT conv_id, turn, intent, score FROM (
  SELECT conv_id, turn, {S.keyword_intent(t)} AS intent, {best} AS score
  FROM (SELECT conv_id, turn, {S.strip('lower(text)')} AS lower_strip
        FROM conversations WHERE role = 'user') b
) x WHERE score > 0
"""


@register("keyword_join", oracle=_kw_join_sql())
def q_keyword_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J2 + W7 as a join: lexicon keywords matched as substring equi-joins, best intent per turn."""
    from ..sources.labelled import lexicon_tables
    turns = _user_turns(spark, sf_dir).withColumn(
        "qid", F.struct("conv_id", "turn"))
    best = route_ops.keyword_join(turns, lexicon_tables(spark)["keywords"], "qid", "text")
    return best.select("qid.conv_id", "qid.turn", "intent", F.col("score").cast("long").alias("score"))


@register("routing_profile", oracle=f"""
WITH r AS ({ROUTE_SQL}), g AS (
  SELECT intent, method, skip_rag, count(*) AS n FROM r GROUP BY intent, method, skip_rag
)
SELECT intent, method, skip_rag, n, {S.pct2('n', 'sum(n) OVER ()')} AS share_pct FROM g
""")
def q_routing_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions per intent x method and their share."""
    return route_ops.routing_profile(route_ops.route_questions(_user_turns(spark, sf_dir)))


# ================================================ request traffic
# events stand in for the request log: client = user_id, route = event_type,
# duration = value seconds. One-day windows make a limit of 1 bite at this
# data density (the operator is the same for one minute).
RL_LIMIT = 1
RL_WINDOW_S = 86400
DAY_US = RL_WINDOW_S * 1_000_000


def _fixed_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    return traffic_ops.fixed_window_limit(ev, RL_LIMIT, RL_WINDOW_S)


FIXED_SQL = f"""
SELECT event_id, user_id, event_type,
       make_timestamp(epoch_us(ts) - (epoch_us(ts) % {DAY_US})) AS window_start,
       row_number() OVER (PARTITION BY user_id, event_type, epoch_us(ts) - (epoch_us(ts) % {DAY_US})
                          ORDER BY ts, event_id) <= {RL_LIMIT} AS allowed
FROM events
"""


@register("rate_limit_fixed", oracle=FIXED_SQL)
def q_rate_limit_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per client x route and clock-aligned window, first n requests pass."""
    return _fixed_verdicts(spark, sf_dir).select("event_id", "user_id", "event_type",
                                                  "window_start", "allowed")


@register("rate_limit_moving", oracle=f"""
SELECT event_id, user_id, event_type,
       count(*) OVER (PARTITION BY user_id, event_type ORDER BY epoch_us(ts)
                      RANGE BETWEEN {DAY_US - 1} PRECEDING AND CURRENT ROW) AS attempts,
       count(*) OVER (PARTITION BY user_id, event_type ORDER BY epoch_us(ts)
                      RANGE BETWEEN {DAY_US - 1} PRECEDING AND CURRENT ROW) <= {RL_LIMIT} AS allowed
FROM events
""")
def q_rate_limit_moving(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W10 (attempt counting): requests of the key in the trailing window."""
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    out = traffic_ops.moving_window_attempts(ev, RL_WINDOW_S, RL_LIMIT)
    return out.select("event_id", "user_id", "event_type",
                      F.col("attempts").cast("long").alias("attempts"), "allowed")


@register("admission_rates", oracle=f"""
WITH v AS ({FIXED_SQL}), j AS (
  SELECT v.window_start AS day, v.allowed, e.event_type = 'error' AS failed
  FROM v JOIN events e USING (event_id)
), g AS (
  SELECT day, count(*) AS requests,
         sum(CASE WHEN NOT allowed THEN 1 ELSE 0 END) AS rejected,
         sum(CASE WHEN allowed AND NOT failed THEN 1 ELSE 0 END) AS completed
  FROM j GROUP BY day
)
SELECT day, requests, CAST(rejected AS BIGINT) AS rejected, CAST(completed AS BIGINT) AS completed,
       {S.pct2('rejected', 'requests')} AS reject_rate,
       {S.pct2('completed', 'requests')} AS completion_rate
FROM g
""")
def q_admission_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A9 per day: rejected by the limiter, completed = admitted and not failed."""
    v = (_fixed_verdicts(spark, sf_dir)
         .withColumn("failed", F.col("event_type") == "error")
         .withColumnRenamed("window_start", "day"))
    out = traffic_ops.admission_rates(v, ("day",))
    return out.select("day", "requests", F.col("rejected").cast("long").alias("rejected"),
                      F.col("completed").cast("long").alias("completed"),
                      "reject_rate", "completion_rate")


HOUR_US = 3600 * 1_000_000


@register("concurrency_profile", oracle=f"""
WITH iv AS (
  SELECT event_id, epoch_us(ts) AS s, epoch_us(ts) + CAST(round(value * 1000000) AS BIGINT) AS e
  FROM events
), ev AS (
  SELECT event_id, s AS t_at, 1 AS d FROM iv UNION ALL SELECT event_id, e AS t_at, -1 AS d FROM iv
), run AS (
  SELECT t_at, sum(d) OVER (ORDER BY t_at, d, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS active
  FROM ev
)
SELECT make_timestamp(t_at - (t_at % {HOUR_US})) AS bucket_start, count(*) AS events,
       CAST(max(active) AS BIGINT) AS peak, max(active) > {L.MAX_CONCURRENT_REQUESTS} AS over_limit,
       CAST(greatest(max(active) - {L.MAX_CONCURRENT_REQUESTS}, 0) AS BIGINT) AS peak_waiting
FROM run GROUP BY t_at - (t_at % {HOUR_US})
""")
def q_concurrency_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peak active requests per hour (interval = ts + duration)."""
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "value")
    return traffic_ops.concurrency_profile(ev, 3600)


@register("latency_profile", oracle="""
WITH g AS (
  SELECT event_type, count(*) AS n, avg(value) AS avg_s, min(value) AS min_s,
         max(value) AS max_s, sum(value) AS total_s
  FROM events GROUP BY event_type
)
SELECT event_type, n, round(avg_s, 6) AS avg_s, min_s, max_s, round(total_s, 6) AS total_s,
       round(total_s / sum(total_s) OVER (), 6) AS share
FROM g
""")
def q_latency_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time per route (event_type) and its share of all time."""
    ev = table(spark, sf_dir, "events").select("event_type", "value")
    p = traffic_ops.latency_profile(ev)
    return p.select("event_type", "n", rnd("avg_s").alias("avg_s"), "min_s", "max_s",
                    rnd("total_s").alias("total_s"), rnd("share").alias("share"))


# ================================================== keywords and sentences
TOP_KW = 10


@register("ngram_keywords", oracle=f"""
WITH t AS (
  SELECT doc_id, regexp_replace(text, {S.q(L.NGRAM_STRIP_CLASS)}, '', 'g') AS s FROM documents
), g AS (
  SELECT doc_id, substr(s, i, 2) AS gram FROM t, range(1, length(s)) r(i)
  UNION ALL
  SELECT doc_id, substr(s, i, 3) AS gram FROM t, range(1, length(s) - 1) r(i)
), c AS (
  SELECT doc_id, gram, count(*) AS n FROM g GROUP BY doc_id, gram
), r AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, gram) AS rank FROM c
)
SELECT doc_id, rank, gram, n FROM r WHERE rank <= {TOP_KW}
""")
def q_ngram_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten most frequent character 2/3-grams per document (in-row, no shuffle)."""
    return kw_ops.ngram_keywords(table(spark, sf_dir, "documents"), TOP_KW)


@register("tfidf_keywords", oracle=f"""
WITH tok AS (
  SELECT doc_id, unnest(regexp_extract_all(lower(text), '\\p{{L}}+')) AS token FROM documents
), tf AS (
  SELECT doc_id, token, count(*) AS tf FROM tok GROUP BY doc_id, token
), df AS (
  SELECT token, count(*) AS df FROM tf GROUP BY token
), n AS (SELECT count(*) AS n FROM documents),
s AS (
  SELECT tf.doc_id, tf.token, tf.tf, df.df, tf.tf * ln(n.n / df.df) AS score
  FROM tf JOIN df USING (token) CROSS JOIN n
), r AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, token) AS rank FROM s
)
SELECT doc_id, rank, token, tf, df, round(score, 6) AS score FROM r WHERE rank <= {TOP_KW}
""")
def q_tfidf_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top-10 TF-IDF words per document over the whole corpus."""
    out = kw_ops.tfidf_keywords(table(spark, sf_dir, "documents"), TOP_KW)
    return out.select("doc_id", "rank", "token", "tf", "df", rnd("score").alias("score"))


WESTERN_TERMINATORS = "[.!?。！？\n]+"


@register("sentence_stats", oracle=f"""
WITH s AS (
  SELECT doc_id,
         list_filter(list_transform(string_split_regex(text, {S.q(WESTERN_TERMINATORS)}),
                                    lambda x: {S.strip('x')}),
                     lambda x: length(x) >= {L.MIN_SENTENCE_LENGTH}) AS ss
  FROM documents
)
SELECT doc_id, CAST(len(ss) AS BIGINT) AS n_sentences,
       CAST(coalesce(list_sum(list_transform(ss, lambda x: length(x))), 0) AS BIGINT) AS sentence_chars,
       CAST(coalesce(list_max(list_transform(ss, lambda x: length(x))), 0) AS BIGINT) AS longest
FROM s
""")
def q_sentence_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P4 with Western terminators: sentences of 5+ characters per document."""
    docs = table(spark, sf_dir, "documents")
    ss = docs.select("doc_id", split_sentences(F.col("text"), WESTERN_TERMINATORS).alias("ss"))
    lens = F.transform("ss", lambda x: F.length(x))
    return ss.select("doc_id", F.size("ss").cast("long").alias("n_sentences"),
                     F.aggregate(lens, F.lit(0).cast("long"), lambda a, b: a + b).alias("sentence_chars"),
                     F.coalesce(F.array_max(lens), F.lit(0)).cast("long").alias("longest"))


@register("chunks_fixed", oracle=f"""
WITH d AS (
  SELECT doc_id, source, text, length(text) AS n FROM documents
  WHERE text IS NOT NULL AND length(text) > 0
), c AS (
  SELECT doc_id, source, text,
         1 + CAST(ceil(greatest(n - {L.CHUNK_SIZE}, 0) / {float(L.CHUNK_SIZE - L.CHUNK_OVERLAP)}) AS BIGINT) AS cnt
  FROM d
)
SELECT {chunk_ops.chunk_id_sql("doc_id", "i")} AS chunk_id, doc_id, i AS chunk_no,
       substr(text, CAST(i * {L.CHUNK_SIZE - L.CHUNK_OVERLAP} + 1 AS BIGINT), {L.CHUNK_SIZE}) AS text, source
FROM c, range(0, cnt) r(i)
""")
def q_chunks_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P5 fixed-stride chunks (size 800, overlap 150) with metadata copied."""
    return chunk_ops.chunk_documents_fixed(table(spark, sf_dir, "documents"))


@register("chunks_recursive")
def q_chunks_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P5 boundary-aware chunks (size 800, overlap 150); property-tested, no SQL oracle."""
    return chunk_ops.chunk_documents(table(spark, sf_dir, "documents"))


# ====================================================== conversations
@register("conversation_history", oracle="""
SELECT conv_id, turn, role,
       row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS position,
       CAST(coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS chars_before,
       lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS prev_role
FROM conversations
""")
def q_conversation_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered messages per conversation with position, context size, previous role."""
    from ..operators import context as ctx_ops
    return ctx_ops.conversation_history(table(spark, sf_dir, "conversations"))


# ================================================ text retrieval + C4 eval
# questions = benchmark items; index = fixed-stride chunks of the documents;
# embedder = hashed character trigram counts; ranking = exact cosine.
EVAL_K = 10
_STEP = L.CHUNK_SIZE - L.CHUNK_OVERLAP
FIXED_CHUNKS_SQL = f"""
SELECT {chunk_ops.chunk_id_sql("doc_id", "i")} AS chunk_id, doc_id, i AS chunk_no,
       substr(text, CAST(i * {_STEP} + 1 AS BIGINT), {L.CHUNK_SIZE}) AS text, source
FROM (SELECT doc_id, source, text,
             1 + CAST(ceil(greatest(length(text) - {L.CHUNK_SIZE}, 0) / {float(_STEP)}) AS BIGINT) AS cnt
      FROM documents WHERE text IS NOT NULL AND length(text) > 0) c, range(0, cnt) r(i)
"""


def _cp(i: str) -> str:
    return f"CAST(greatest(unicode(substr(l, {i}, 1)), 0) AS BIGINT)"


def _trigram_counts_sql(src: str, id_col: str) -> str:
    """Sparse trigram bucket counts (id, b, c) of ``src(id_col, text)``, same rule as the embedder."""
    b = (f"(({_cp('i')} * {embed_ops.MULT} + {_cp('i + 1')}) * {embed_ops.MULT} + {_cp('i + 2')})"
         f" % {embed_ops.MOD} % {embed_ops.DIM}")
    return f"""
SELECT id, b, count(*) AS c FROM (
  SELECT id, {b} AS b
  FROM (SELECT {id_col} AS id, lower(text) AS l, length(lower(text)) AS n FROM {src}) t,
       range(1, CASE WHEN n = 0 THEN 1 WHEN n < 3 THEN 2 ELSE n - 1 END) r(i)
) g GROUP BY id, b
"""


def _cosine_topk_sql(q_src: str, q_id: str, x_src: str, x_id: str, k: int) -> str:
    return f"""
WITH qv AS ({_trigram_counts_sql(q_src, q_id)}),
xv AS ({_trigram_counts_sql(x_src, x_id)}),
qn AS (SELECT id AS qid, sum(c * c) AS nn FROM qv GROUP BY id),
xn AS (SELECT id, sum(c * c) AS nn FROM xv GROUP BY id),
dots AS (SELECT qv.id AS qid, xv.id AS id, sum(qv.c * xv.c) AS dot FROM qv JOIN xv USING (b) GROUP BY qv.id, xv.id),
pairs AS (SELECT qn.qid, xn.id, coalesce(d.dot, 0) AS dot, qn.nn * xn.nn AS np
          FROM qn CROSS JOIN xn LEFT JOIN dots d ON d.qid = qn.qid AND d.id = xn.id),
cosd AS (SELECT qid, id, CASE WHEN np > 0 THEN dot / sqrt(np) ELSE 0.0 END AS cosine FROM pairs),
ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY cosine DESC, id) AS rank FROM cosd)
SELECT qid, rank, id, cosine FROM ranked WHERE rank <= {k}
"""


HITS_SQL = f"""
WITH chunks AS ({FIXED_CHUNKS_SQL}),
top AS ({_cosine_topk_sql("benchmark", "item_id", "chunks", "chunk_id", EVAL_K)})
SELECT top.qid, top.rank, top.id AS chunk_id, top.cosine, 2 - 2 * top.cosine AS distance,
       1.0 / (1.0 + (2 - 2 * top.cosine)) AS similarity, chunks.text, chunks.source
FROM top JOIN chunks ON chunks.chunk_id = top.id
"""


_INDEXES: dict[tuple, str] = {}


def _corpus_root(spark: SparkSession, sf_dir: str) -> str:
    """Folder of the persisted index of the corpus (S4-S6) and of its document frequencies.

    Built by the first query of a session that needs it, again if the files
    of ``documents`` have changed (names, sizes, times).
    """
    from ..session import scratch_path
    from ..sources import corpus, index_store
    files = corpus.file_identity(spark, f"{sf_dir.rstrip('/')}/documents.parquet")
    key = (spark.sparkContext.applicationId, sf_dir, files)
    if key not in _INDEXES:
        root = scratch_path(spark, f"index-{uuid.uuid4().hex}")
        chunks = chunk_ops.chunk_documents_fixed(table(spark, sf_dir, "documents"))
        index_store.save_index(spark, embed_ops.count_vectors(chunks, "text", "vec"), f"{root}/chunks")
        kw_ops.document_frequencies(index_store.load_index(spark, f"{root}/chunks")).write.parquet(f"{root}/frequencies")
        _INDEXES[key] = root
    return _INDEXES[key]


def _corpus_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks of the corpus with their vectors: (chunk_id, doc_id, chunk_no, text, source, vec)."""
    from ..sources import index_store
    return index_store.load_index(spark, f"{_corpus_root(spark, sf_dir)}/chunks")


def _chunk_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(token, df) over the chunks of the corpus."""
    return spark.read.parquet(f"{_corpus_root(spark, sf_dir)}/frequencies")


def _benchmark_hits(spark: SparkSession, sf_dir: str, k: int = EVAL_K) -> DataFrame:
    chunks = _corpus_index(spark, sf_dir)
    index = chunks.select("chunk_id", "vec")
    qs = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text")
    qv = embed_ops.count_vectors(qs, "text", "vec")
    top = knn_ops.knn_join(qv, index, k=k, q_id="qid", q_vec="vec", x_id="chunk_id",
                           x_vec="vec", metric="cosine")
    return (knn_ops.join_hits(top, chunks.select("chunk_id", "text", "source"))
            .select("qid", "rank", F.col("id").alias("chunk_id"), "cosine", "distance",
                    knn_ops.distance_to_similarity("distance").alias("similarity"),
                    "text", "source"))


@register("retrieval_hits", oracle=f"""
SELECT qid, rank, chunk_id, round(cosine, 6) AS cosine, round(distance, 6) AS distance,
       round(similarity, 6) AS similarity
FROM ({HITS_SQL}) h
""")
def q_retrieval_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P8 + J1 (cosine) + W1 + P10: top-10 chunks for every benchmark question."""
    h = _benchmark_hits(spark, sf_dir)
    return h.select("qid", F.col("rank").cast("long").alias("rank"), "chunk_id",
                    rnd("cosine").alias("cosine"), rnd("distance").alias("distance"),
                    rnd("similarity").alias("similarity"))


@register("retrieval_threshold", oracle=f"""
SELECT qid, rank, chunk_id, round(1.0 - distance / sqrt(2.0), 6) AS relevance
FROM ({HITS_SQL}) h WHERE 1.0 - distance / sqrt(2.0) >= 0.5
""")
def q_retrieval_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the top-10 hits whose relevance 1 - distance / sqrt(2) reaches 0.5 (threshold retrieval mode)."""
    h = knn_ops.score_threshold(knn_ops.with_relevance(_benchmark_hits(spark, sf_dir)))
    return h.select("qid", F.col("rank").cast("long").alias("rank"), "chunk_id",
                    rnd("relevance").alias("relevance"))


def _mmr_sql() -> str:
    """Two picks: the best hit, then the best of half relevance minus half similarity to the first."""
    fetch = 20
    return f"""
WITH chunks AS ({FIXED_CHUNKS_SQL}),
top AS ({_cosine_topk_sql("benchmark", "item_id", "chunks", "chunk_id", fetch)}),
c AS (SELECT DISTINCT t.id AS chunk_id, c.text FROM top t JOIN chunks c ON c.chunk_id = t.id),
v AS ({_trigram_counts_sql("c", "chunk_id")}),
n AS (SELECT id, sum(c * c) AS nn FROM v GROUP BY id),
one AS (SELECT qid, id FROM top WHERE rank = 1),
pair AS (SELECT t.qid, t.id, t.rank, t.cosine, o.id AS first FROM top t JOIN one o USING (qid) WHERE t.rank > 1),
dots AS (SELECT p.qid, p.id, sum(a.c * b.c) AS dot FROM pair p JOIN v a ON a.id = p.id JOIN v b ON b.id = p.first AND b.b = a.b GROUP BY p.qid, p.id),
s AS (SELECT p.qid, p.id, p.rank, 0.5 * p.cosine - 0.5 * coalesce(d.dot, 0) / sqrt(a.nn * b.nn) AS score
      FROM pair p JOIN n a ON a.id = p.id JOIN n b ON b.id = p.first LEFT JOIN dots d ON d.qid = p.qid AND d.id = p.id),
two AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, rank) AS r FROM s)
SELECT qid, 1::BIGINT AS mmr_rank, id, 1::BIGINT AS rank FROM one
UNION ALL SELECT qid, 2, id, rank FROM two WHERE r = 1
"""


@register("retrieval_mmr", oracle=_mmr_sql())
def q_retrieval_mmr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maximal marginal relevance (lambda 0.5) picks 2 of the 20 best chunks per question."""
    index = _corpus_index(spark, sf_dir).select("chunk_id", "vec")
    qs = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text")
    qv = embed_ops.count_vectors(qs, "text", "vec")
    top = knn_ops.knn_join(qv, index, k=L.RETRIEVER_FETCH_K, q_id="qid", q_vec="vec",
                           x_id="chunk_id", x_vec="vec", metric="cosine")
    cands = (knn_ops.join_hits(top, index.select("chunk_id", F.col("vec").alias("x_vec")))
             .join(qv.select("qid", F.col("vec").alias("q_vec")), "qid"))
    picks = knn_ops.mmr(cands, k=L.RETRIEVER_K, lambda_mult=L.MMR_LAMBDA)
    return picks.select("qid", F.col("mmr_rank").cast("long").alias("mmr_rank"), "id", F.col("rank").cast("long").alias("rank"))


CASES_SQL = """
SELECT b.item_id AS qid, coalesce(k.keywords, []::VARCHAR[]) AS keywords
FROM benchmark b LEFT JOIN (
  SELECT qid, list(w ORDER BY length(w) DESC, w) AS keywords
  FROM (SELECT DISTINCT item_id AS qid, unnest(regexp_extract_all(text, '\\p{L}+')) AS w
        FROM benchmark) d
  GROUP BY qid
) k ON k.qid = b.item_id
"""

EVAL_SQL = f"""
WITH h AS ({HITS_SQL}), cases AS ({CASES_SQL}),
kw AS (SELECT qid, unnest(keywords) AS keyword, generate_subscripts(keywords, 1) AS kw_pos FROM cases),
found AS (
  SELECT kw.qid, kw.keyword, min(h.rank) AS best_rank, count(*) AS n_hits
  FROM kw JOIN h ON h.qid = kw.qid AND contains(h.text, kw.keyword) GROUP BY kw.qid, kw.keyword
),
ks AS (SELECT kw.qid, kw.keyword, kw.kw_pos, f.best_rank FROM kw LEFT JOIN found f USING (qid, keyword)),
kagg AS (
  SELECT qid, count(best_rank) AS keywords_found, avg(best_rank) AS avg_best_rank,
         coalesce(string_agg(keyword, ', ' ORDER BY kw_pos) FILTER (WHERE best_rank IS NULL), '') AS missed,
         coalesce(string_agg(keyword, ', ' ORDER BY kw_pos) FILTER (WHERE best_rank > 10), '') AS low
  FROM ks GROUP BY qid
),
sims AS (
  SELECT qid, count(*) AS n_hits, max(similarity) AS max_similarity, avg(similarity) AS avg_similarity,
         sum(CASE WHEN rank <= 3 THEN similarity ELSE 0.0 END) / 3.0 AS top3_mean,
         sum(CASE WHEN rank <= 5 THEN similarity ELSE 0.0 END) / 5.0 AS top5_mean
  FROM h GROUP BY qid
),
c AS (
  SELECT cases.qid, cases.keywords, len(cases.keywords) AS n_kw,
         coalesce(sims.n_hits, 0) AS n_hits, coalesce(sims.max_similarity, 0.0) AS mx,
         coalesce(sims.avg_similarity, 0.0) AS av, coalesce(sims.top3_mean, 0.0) AS top3_mean,
         coalesce(sims.top5_mean, 0.0) AS top5_mean, coalesce(kagg.keywords_found, 0) AS keywords_found,
         kagg.avg_best_rank, kagg.missed, kagg.low
  FROM cases LEFT JOIN sims USING (qid) LEFT JOIN kagg USING (qid)
),
s AS (
  SELECT *,
    CAST((CASE WHEN mx >= 0.7 THEN 40 WHEN mx >= 0.6 THEN 30 WHEN mx >= 0.5 THEN 20 WHEN mx >= 0.4 THEN 10 ELSE 0 END)
       + (CASE WHEN av >= 0.6 THEN 30 WHEN av >= 0.5 THEN 20 WHEN av >= 0.4 THEN 10 ELSE 0 END) AS DOUBLE)
    + (CASE WHEN n_kw > 0 THEN keywords_found / n_kw * 15.0 ELSE 0.0 END)
    + CAST((CASE WHEN n_kw > 0 AND keywords_found > 0 THEN
              (CASE WHEN avg_best_rank <= 3 THEN 15 WHEN avg_best_rank <= 5 THEN 10
                    WHEN avg_best_rank <= 10 THEN 5 ELSE 0 END) ELSE 0 END) AS DOUBLE) AS score
  FROM c
),
a AS (
  SELECT *, list_filter([
      CASE WHEN mx < 0.5 THEN {S.q(L.SUGGEST_LOW_MAX)} END,
      CASE WHEN av < 0.4 THEN {S.q(L.SUGGEST_LOW_AVG)} END,
      CASE WHEN n_kw > 0 AND coalesce(missed, '') <> '' THEN replace({S.q(L.SUGGEST_MISSED)}, '{{kws}}', missed) END,
      CASE WHEN n_kw > 0 AND coalesce(low, '') <> '' THEN replace({S.q(L.SUGGEST_LOW_RANK)}, '{{kws}}', low) END,
      CASE WHEN mx >= 0.6 AND av >= 0.5 THEN {S.q(L.SUGGEST_GOOD)} END], lambda x: x IS NOT NULL) AS adv
  FROM s
)
SELECT qid, n_hits, mx AS max_similarity, av AS avg_similarity, top3_mean, top5_mean,
       array_to_string(keywords, ',') AS keywords, keywords_found, score,
       CASE {" ".join(f"WHEN score >= {b} THEN {S.q(g)}" for b, g in L.QUALITY_GRADES)} END AS grade,
       CASE WHEN n_hits > 0 THEN greatest(0.3, top3_mean - 0.05) END AS strict,
       CASE WHEN n_hits > 0 THEN greatest(0.25, top5_mean - 0.08) END AS balanced,
       CASE WHEN n_hits > 0 THEN greatest(0.2, top5_mean - 0.15) END AS loose,
       array_to_string(CASE WHEN len(adv) = 0 THEN [{S.q(L.SUGGEST_FINE)}] ELSE adv END, chr(10)) AS suggestions
FROM a
"""

_EVAL_FLOATS = ("max_similarity", "avg_similarity", "top3_mean", "top5_mean", "score",
                "strict", "balanced", "loose")


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark")
    return b.select(F.col("item_id").alias("qid"), eval_ops.case_keywords(F.col("text")).alias("keywords"))


def _eval_per_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eval_ops.evaluate_cases(_benchmark_hits(spark, sf_dir), _cases(spark, sf_dir))


@register("retrieval_eval", oracle=f"""
SELECT qid, CAST(n_hits AS BIGINT) AS n_hits, {", ".join(f"round({c}, 6) AS {c}" for c in _EVAL_FLOATS)},
       keywords, CAST(keywords_found AS BIGINT) AS keywords_found, grade, suggestions
FROM ({EVAL_SQL}) e
""")
def q_retrieval_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C4 per question: A3, A4/J7, P12, P20 score and grade, P21 thresholds, P22 advice."""
    e = _eval_per_case(spark, sf_dir)
    return e.select("qid", F.col("n_hits").cast("long").alias("n_hits"),
                    *[rnd(c).alias(c) for c in _EVAL_FLOATS],
                    "keywords", "keywords_found", "grade", "suggestions")


@register("retrieval_eval_summary", oracle=f"""
SELECT count(*) AS cases, round(avg(score), 6) AS avg_score,
       round(avg(max_similarity), 6) AS avg_max_similarity,
       round(avg(avg_similarity), 6) AS avg_avg_similarity,
       round(greatest(0.3, avg(top3_mean) - 0.05), 6) AS strict,
       round(greatest(0.25, avg(top5_mean) - 0.08), 6) AS balanced,
       round(greatest(0.2, avg(top5_mean) - 0.15), 6) AS loose
FROM ({EVAL_SQL}) e
""")
def q_retrieval_eval_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5: means over all cases and global threshold suggestions."""
    s = eval_ops.evaluation_summary(_eval_per_case(spark, sf_dir))
    return s.select("cases", *[rnd(c).alias(c) for c in s.columns if c != "cases"])


@register("grade_distribution", oracle=f"""
SELECT split_part(grade, ' ', 1) AS grade, count(*) AS cases FROM ({EVAL_SQL}) e GROUP BY 1
""")
def q_grade_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases per grade word."""
    return eval_ops.grade_distribution(_eval_per_case(spark, sf_dir))


# ============================================= context compression
# the top-2 hits (RETRIEVER_K) of every benchmark question, Western terminators
COMP_K = L.RETRIEVER_K

def _compress_sql(hits_src: str, q_src: str, q_id: str) -> str:
    """Compressed text per (qid, rank): hits_src(qid, rank, chunk_id, text), q_src(q_id, text)."""
    return f"""
WITH h AS (SELECT qid, rank, chunk_id, text FROM {hits_src}),
ss AS (
  SELECT qid, rank, chunk_id, text,
         list_filter(list_transform(string_split_regex(text, {S.q(WESTERN_TERMINATORS)}),
                                    lambda x: {S.strip('x')}),
                     lambda x: length(x) >= {L.MIN_SENTENCE_LENGTH}) AS ss
  FROM h
),
sent AS (
  SELECT qid, rank, qid * 1000000 + rank * 10000 + pos AS sid, pos, sentence FROM (
    SELECT qid, rank, unnest(ss) AS sentence, generate_subscripts(ss, 1) - 1 AS pos
    FROM ss WHERE len(ss) > {L.MAX_SENTENCES_PER_DOC}) u
),
sv AS ({_trigram_counts_sql("(SELECT sid, sentence AS text FROM sent)", "sid")}),
qv AS ({_trigram_counts_sql(q_src, q_id)}),
sn AS (SELECT id, sum(c * c) AS nn FROM sv GROUP BY id),
qn AS (SELECT id, sum(c * c) AS nn FROM qv GROUP BY id),
dots AS (
  SELECT sent.sid, sum(sv.c * qv.c) AS dot
  FROM sent JOIN sv ON sv.id = sent.sid JOIN qv ON qv.id = sent.qid AND qv.b = sv.b
  GROUP BY sent.sid
),
sc AS (
  SELECT sent.*, CASE WHEN coalesce(sn.nn, 0) * coalesce(qn.nn, 0) > 0
                      THEN coalesce(d.dot, 0) / sqrt(sn.nn * qn.nn) ELSE 0.0 END AS cosine
  FROM sent LEFT JOIN sn ON sn.id = sent.sid LEFT JOIN qn ON qn.id = sent.qid
       LEFT JOIN dots d ON d.sid = sent.sid
),
best AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, rank ORDER BY cosine DESC, pos) AS r FROM sc) t
  WHERE r <= {L.MAX_SENTENCES_PER_DOC}
),
folded AS (SELECT qid, rank, string_agg(sentence, '。' ORDER BY pos) AS joined FROM best GROUP BY qid, rank)
SELECT ss.qid, ss.rank, ss.chunk_id, CAST(len(ss.ss) AS BIGINT) AS n_sentences,
       CASE WHEN len(ss.ss) <= {L.MAX_SENTENCES_PER_DOC} THEN ss.text
            WHEN f.joined <> '' AND NOT ends_with(f.joined, '。') THEN f.joined || '。'
            ELSE f.joined END AS compressed,
       CAST(length(ss.text) AS BIGINT) AS before_chars
FROM ss LEFT JOIN folded f ON f.qid = ss.qid AND f.rank = ss.rank
"""


COMPRESS_SQL = _compress_sql(f"({HITS_SQL}) x WHERE rank <= {COMP_K}", "benchmark", "item_id")


def _compressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _benchmark_hits(spark, sf_dir).filter(F.col("rank") <= COMP_K)
    qs = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"),
                                                  F.col("text").alias("question"))
    return comp_ops.compress_hits(hits.select("qid", "rank", "chunk_id", "text"), qs,
                                  terminators=WESTERN_TERMINATORS)


@register("compress_context", oracle=f"""
SELECT qid, rank, chunk_id, n_sentences, compressed, before_chars,
       CAST(length(compressed) AS BIGINT) AS after_chars,
       round(CASE WHEN before_chars > 0 THEN (1.0 - length(compressed) / before_chars) * 100.0 ELSE 0.0 END, 6) AS ratio
FROM ({COMPRESS_SQL}) c
""")
def q_compress_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P4 + W4 + W5 + P17: the top-2 hits of each question cut to their 3 most relevant sentences."""
    c = _compressed(spark, sf_dir)
    return c.select("qid", F.col("rank").cast("long").alias("rank"), "chunk_id", "n_sentences",
                    "compressed", "before_chars", "after_chars", rnd("ratio").alias("ratio"))


@register("compress_textrank")
def q_compress_textrank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P14 + W3 + W4 + W5 (hybrid method): TextRank keywords of each hit prefilter
    texts of more than 10 sentences before the semantic rerank."""
    hits = _benchmark_hits(spark, sf_dir).filter(F.col("rank") <= COMP_K) \
        .select("qid", "rank", "chunk_id", "text")
    # only texts of more than PREFILTER_SENTENCES sentences are ever prefiltered; their kept sentences are ranked
    keyed = (hits.withColumn("ss", split_sentences(F.col("text"), WESTERN_TERMINATORS)).where(F.size("ss") > L.PREFILTER_SENTENCES)
             .select(F.struct("qid", "rank").alias("doc_id"), F.array_join("ss", "。").alias("text")))
    kw = kw_ops.textrank_keywords(keyed, k=20)
    kws = (kw.groupBy("doc_id")  # at most 20 rows per hit
           .agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "token"))),
                            lambda s: s["token"]).alias("kws")))
    h2 = (hits.withColumn("doc_id", F.struct("qid", "rank"))
          .join(kws, "doc_id", "left")
          .withColumn("kws", F.coalesce("kws", F.array().cast("array<string>"))).drop("doc_id"))
    qs = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"),
                                                  F.col("text").alias("question"))
    c = comp_ops.compress_hits(h2, qs, terminators=WESTERN_TERMINATORS, keywords_col="kws")
    return c.select("qid", F.col("rank").cast("long").alias("rank"), "chunk_id", "n_sentences",
                    "compressed", "before_chars", "after_chars", rnd("ratio").alias("ratio"))


@register("compression_totals", oracle=f"""
SELECT qid, count(*) AS documents, CAST(sum(before_chars) AS BIGINT) AS before_chars,
       CAST(sum(length(compressed)) AS BIGINT) AS after_chars,
       round(CASE WHEN sum(before_chars) > 0
                  THEN (1.0 - sum(length(compressed)) / sum(before_chars)) * 100.0 ELSE 0.0 END, 6) AS ratio
FROM ({COMPRESS_SQL}) c GROUP BY qid
""")
def q_compression_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2: per question, summed lengths before and after compression and the ratio."""
    t = comp_ops.compression_totals(_compressed(spark, sf_dir))
    return t.select("qid", "documents", F.col("before_chars").cast("long").alias("before_chars"),
                    F.col("after_chars").cast("long").alias("after_chars"), rnd("ratio").alias("ratio"))


# ===================================================== question -> context
ANSWER_K = L.RETRIEVER_K


def _clean_query_sql(x: str) -> str:
    from ..functions.text import WS_CLASS
    y = S.strip(x)
    y = f"regexp_replace({y}, {S.q('(?m)^' + chr(92) + 'p{Nd}+[.)]' + WS_CLASS + '*')}, '', 'g')"
    y = f"regexp_replace({y}, {S.q(chr(92) + 'n+')}, ' ', 'g')"
    y = S.strip(S.collapse(y))
    return f"substr({y}, 1, {L.QUERY_MAX_LENGTH})"


def _template_sql(context: str, question: str) -> str:
    """The user template filled in one pass (literal pieces concatenated with the values)."""
    import re
    vals = {"context": context, "question": question}
    out, pos = [], 0
    for m in re.finditer(r"\{(\w+)\}", L.USER_QUESTION_TEMPLATE):
        out.append(S.q(L.USER_QUESTION_TEMPLATE[pos:m.start()]))
        out.append(vals[m.group(1)])
        pos = m.end()
    out.append(S.q(L.USER_QUESTION_TEMPLATE[pos:]))
    return "(" + " || ".join(out) + ")"


def _answer_sql(route: bool, compress: bool, context_from_question: bool = False) -> str:
    v = _validate_sql("benchmark", "item_id")
    routed = (_route_sql("(SELECT item_id, text FROM v WHERE ok) vv", "item_id") if route else
              "SELECT item_id, text, NULL::VARCHAR AS intent, NULL::DOUBLE AS confidence, "
              "NULL::VARCHAR AS method, false AS skip_rag, NULL::VARCHAR AS response FROM v WHERE ok")
    hits = f"(SELECT qid, rank, id AS chunk_id, c.text FROM top JOIN chunks c ON c.chunk_id = top.id) hh"
    comp = (f"(SELECT qid, rank, compressed AS text FROM ({_compress_sql(hits, '(SELECT item_id, text FROM go)', 'item_id')}) cc) hx"
            if compress else f"(SELECT qid, rank, text FROM {hits}) hx")
    return f"""
WITH v AS ({v}),
r AS ({routed}),
go0 AS (SELECT * FROM r WHERE NOT skip_rag),
chunks AS ({FIXED_CHUNKS_SQL}),
dfq AS (SELECT token, count(*) AS df FROM (SELECT DISTINCT chunk_id, unnest(regexp_extract_all(lower(text), '\\p{{L}}+')) AS token FROM chunks) d GROUP BY token),
tfq AS (SELECT item_id, token, count(*) AS tf FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '\\p{{L}}+')) AS token FROM go0) d GROUP BY ALL),
rkq AS (SELECT item_id, token, row_number() OVER (PARTITION BY item_id ORDER BY
          round(tf * ln((SELECT count(*) FROM chunks) / greatest(coalesce(df, 0), 1)), 9) DESC, token) AS r FROM tfq LEFT JOIN dfq USING (token)),
kwq AS (SELECT item_id, string_agg(token, ' ' ORDER BY r) AS kw FROM rkq WHERE r <= 10 GROUP BY item_id),
go AS (SELECT go0.*, coalesce(nullif({_clean_query_sql('kw')}, ''), go0.text) AS query FROM go0 LEFT JOIN kwq USING (item_id)),
qtop AS ({_cosine_topk_sql("(SELECT item_id, query AS text FROM go)", "item_id", "chunks", "chunk_id", ANSWER_K)}),
top AS ({_cosine_topk_sql("(SELECT item_id, text FROM go)", "item_id", "chunks", "chunk_id", ANSWER_K)
         if context_from_question else "SELECT * FROM qtop"}),
hx AS (SELECT * FROM {comp}),
rep AS (SELECT qid, count(*) AS n FROM qtop GROUP BY qid),
ctx AS (SELECT hx.qid, string_agg(hx.text, chr(10) || chr(10) ORDER BY hx.rank) AS context,
               {"max(rep.n)" if context_from_question else "count(*)"} AS n_docs
        FROM hx LEFT JOIN rep ON rep.qid = hx.qid GROUP BY hx.qid)
SELECT item_id AS qid, ok, reason, NULL::VARCHAR AS intent, NULL::VARCHAR AS method, NULL::BOOLEAN AS skip_rag,
       NULL::VARCHAR AS query, 0::BIGINT AS n_docs, error AS reply, NULL::VARCHAR AS prompt
FROM v WHERE NOT ok
UNION ALL
SELECT r.item_id, true, v.reason, r.intent, r.method, r.skip_rag, NULL, 0, r.response, NULL
FROM r JOIN v USING (item_id) WHERE r.skip_rag
UNION ALL
SELECT go.item_id, true, v.reason, go.intent, go.method, go.skip_rag, go.query, coalesce(ctx.n_docs, 0), NULL,
       {S.q(L.SYSTEM_PROMPT + chr(10) + chr(10))} || {_template_sql("coalesce(ctx.context, '')", "go.text")}
FROM go JOIN v USING (item_id) LEFT JOIN ctx ON ctx.qid = go.item_id
"""


def _answer(spark: SparkSession, sf_dir: str, route: bool, compress: bool,
            context_from_question: bool = False) -> DataFrame:
    from ..operators import answer as ans_ops
    index = _corpus_index(spark, sf_dir)
    qs = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text")
    return ans_ops.answer_context(qs, index.select("chunk_id", "text"), index.select("chunk_id", "vec"), k=ANSWER_K, route=route, compress=compress,
                                  terminators=WESTERN_TERMINATORS, frequencies=_chunk_frequencies(spark, sf_dir),
                                  context_from_question=context_from_question)


@register("answer_context", oracle=_answer_sql(True, True))
def q_answer_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validate -> route -> short-circuit -> expand (P7/P6) -> retrieve -> compress -> prompt."""
    return _answer(spark, sf_dir, True, True)


@register("plain_context", oracle=_answer_sql(False, False, True))
def q_plain_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validate -> expand -> retrieve -> prompt; no routing, no compression; the context
    comes from the question itself, the expanded-query hits are only counted (n_docs)."""
    return _answer(spark, sf_dir, False, False, True)


# ============================================ classifier metrics
_REPORT_FLOATS = ("precision", "recall", "f1")


def _report_sql(pairs_sql: str) -> str:
    """A8 report over pairs_sql(e, p) of label strings."""
    return f"""
WITH pr AS ({pairs_sql}),
conf AS (SELECT e, p, count(*) AS n FROM pr GROUP BY e, p),
sup AS (SELECT e AS label, sum(n) AS support FROM conf GROUP BY e),
prd AS (SELECT p AS label, sum(n) AS pred FROM conf GROUP BY p),
tp AS (SELECT e AS label, n AS tp FROM conf WHERE e = p),
per AS (
  SELECT coalesce(s.label, q.label) AS label, coalesce(s.support, 0) AS support,
         coalesce(q.pred, 0) AS pred, coalesce(tp.tp, 0) AS tp
  FROM sup s FULL JOIN prd q ON s.label = q.label LEFT JOIN tp ON tp.label = coalesce(s.label, q.label)
),
m AS (SELECT label, CASE WHEN pred > 0 THEN tp / pred ELSE 0.0 END AS precision,
             CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall, support, tp FROM per),
f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall)
                     ELSE 0.0 END AS f1 FROM m)
SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
       CAST(support AS BIGINT) AS support FROM f
UNION ALL
SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), CAST(sum(support) AS BIGINT) FROM f
UNION ALL
SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6),
       round(sum(f1 * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM f
UNION ALL
SELECT 'accuracy', round(sum(tp) / sum(support), 6), round(sum(tp) / sum(support), 6),
       round(sum(tp) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM f
"""


@register("knn_label_report", oracle=_report_sql(f"""
SELECT CAST(e.label AS VARCHAR) AS e, CAST(x.label AS VARCHAR) AS p
FROM (SELECT qid, neighbour_id FROM ({ORACLES['knn_top10']}) k WHERE rank = 1) t
JOIN embeddings e ON e.vec_id = t.qid JOIN embeddings x ON x.vec_id = t.neighbour_id
"""))
def q_knn_label_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A7 + A8: leave-one-out 1-nearest-neighbour labels against the true labels."""
    from ..operators import intent_model as im
    emb = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    top1 = _knn_self(spark, sf_dir, k=1)
    pairs = (top1.join(emb.withColumnRenamed("vec_id", "qid").withColumnRenamed("label", "expected"), "qid")
             .join(emb.withColumnRenamed("vec_id", "id").withColumnRenamed("label", "predicted"), "id"))
    rep = im.classification_report(pairs, "expected", "predicted")
    return rep.select("label", *[rnd(c).alias(c) for c in _REPORT_FLOATS], "support")


def _model_eval(spark: SparkSession, sf_dir: str):
    from ..operators import intent_model as im
    emb = table(spark, sf_dir, "embeddings")
    split = im.stratified_split(emb, "label", "vec_id", 0.2, 42).checkpoint(eager=True)
    model = im.train_intent_model(split.filter(~F.col("is_test")), "embedding", "label")
    test = split.filter(F.col("is_test"))
    return im, im.classify(model, test, "embedding")


@register("intent_model_report")
def q_intent_model_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1 + M2 + M4 (W8 split, A7, A8): one-vs-rest logistic regression on the vectors."""
    im, pred = _model_eval(spark, sf_dir)
    rep = im.classification_report(pred.withColumn("p", F.col("predicted").cast("string")), "label", "p")
    return rep.select("label", *[rnd(c).alias(c) for c in _REPORT_FLOATS], "support")


@register("intent_top_probabilities")
def q_intent_top_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M2 + W13: label, confidence and the three most likely classes of every held-out vector."""
    im, pred = _model_eval(spark, sf_dir)
    return pred.select("vec_id", "label", "predicted", rnd("confidence").alias("confidence"),
                       im.top_probabilities(F.col("probabilities"), 3).alias("top3"))


# ================================================================ streaming
# The driver tables are replayed as file streams (directory + file glob) with
# trigger(availableNow); sinks and checkpoints live below spark.checkpoint.dir.
def _stream_dirs(spark: SparkSession, name: str) -> tuple[str, str]:
    from ..session import scratch_path
    base = scratch_path(spark, f"streams/{name}-{uuid.uuid4().hex[:8]}")
    return f"{base}/out", f"{base}/checkpoint"


def _events_stream(spark: SparkSession, sf_dir: str):
    from ..streaming import jobs
    schema = table(spark, sf_dir, "events").schema
    return jobs.one_table_stream(spark, f"{sf_dir.rstrip('/')}/events.parquet", schema, max_files_per_trigger=1)


@register("stream_window_counts", oracle=f"""
SELECT make_timestamp(epoch_us(ts) - (epoch_us(ts) % {DAY_US})) AS window_start, user_id, event_type,
       count(*) AS requests, count(*) > {RL_LIMIT} AS over_limit
FROM events GROUP BY 1, user_id, event_type
""")
def q_stream_window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T2 counts: watermark + one-day tumbling windows per client x route, over-limit flag."""
    from pyspark.sql import Window
    from ..streaming import jobs
    out, ck = _stream_dirs(spark, "window-counts")
    counts = jobs.stream_window_counts(_events_stream(spark, sf_dir), RL_WINDOW_S, RL_LIMIT)

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id).cast("long")) \
             .write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    jobs.run_available(counts.writeStream.outputMode("update").foreachBatch(sink), ck)
    rows = spark.read.parquet(out)
    w = Window.partitionBy("window_start", "user_id", "event_type").orderBy(F.col("batch_id").desc())
    return (rows.withColumn("_r", F.row_number().over(w)).filter("_r = 1")
            .select("window_start", "user_id", "event_type", "requests", "over_limit"))


def _screen_sql() -> str:
    v = _validate_sql()
    r = _route_sql("(SELECT conv_id, turn, text FROM v WHERE ok) vv", "conv_id, turn")
    return f"""
WITH v AS ({v}), r AS ({r})
SELECT v.conv_id, v.turn, v.ok, v.text, v.error, v.reason, r.intent, r.confidence, r.method,
       r.skip_rag, r.response
FROM v LEFT JOIN r ON r.conv_id = v.conv_id AND r.turn = v.turn
"""


@register("stream_screen_questions", oracle=_screen_sql())
def q_stream_screen_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T4: validation + routing of user turns arriving as a stream."""
    from ..streaming import jobs
    out, ck = _stream_dirs(spark, "screen")
    schema = table(spark, sf_dir, "conversations").schema
    conv = jobs.one_table_stream(spark, f"{sf_dir.rstrip('/')}/conversations.parquet", schema)
    s = jobs.stream_screen(conv.filter(F.col("role") == "user").select("conv_id", "turn", "text"))
    jobs.run_available(s.writeStream.format("parquet").option("path", out), ck)
    return spark.read.schema(s.schema).parquet(out)


@register("stream_incremental_index", oracle=f"""
SELECT chunk_id, doc_id, chunk_no, text, {embed_ops.DIM} AS dim FROM ({FIXED_CHUNKS_SQL}) c
""")
def q_stream_incremental_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents dropped as files in several batches are chunked, embedded, appended."""
    from ..streaming import jobs
    out, ck = _stream_dirs(spark, "incremental-index")
    inbox = out.rsplit("/", 1)[0] + "/inbox"
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    docs.write.mode("overwrite").parquet(inbox)  # drop folder derived from the table
    stream = jobs.table_stream(spark, inbox, "*.parquet", docs.schema, max_files_per_trigger=2)
    jobs.incremental_index(stream, out, ck, fixed=True)
    idx = spark.read.parquet(f"{out}/index")
    return idx.select("chunk_id", "doc_id", "chunk_no", "text", F.size("embedding").alias("dim"))


# ====================================== operators on rows derived from the driver tables
#: Request attributes that ``events`` lacks, derived by the same rule in Spark and in DuckDB.
_REQUEST = """
SELECT event_id, user_id,
       CASE event_id % 7 WHEN 0 THEN '' WHEN 1 THEN 'Mozilla/5.0 (X11; Linux)' WHEN 2 THEN 'curl/8.1'
            WHEN 3 THEN 'Mozilla/5.0 (compatible; Googlebot/2.1)' WHEN 4 THEN 'python-requests/2.31' WHEN 5 THEN NULL
            ELSE 'Mozilla/5.0 Safari/605' END AS user_agent,
       CASE WHEN user_id % 3 = 0 THEN '/' ELSE '/chat' END AS path,
       CASE WHEN event_id % 2 = 0 THEN 'POST' ELSE 'GET' END AS method,
       CASE WHEN event_id % 5 = 0 THEN '' ELSE 'http://example.org/' END AS referer,
       CASE event_id % 4 WHEN 0 THEN '10.0.0.1, 10.0.0.2' WHEN 1 THEN ' 10.0.0.9 ' WHEN 2 THEN '' ELSE NULL END AS xff,
       CASE WHEN event_id % 3 = 0 THEN '172.16.0.1' ELSE NULL END AS real_ip,
       concat('192.168.0.', CAST(user_id % 250 AS {text})) AS peer
FROM events
"""


@register("bot_screen", oracle=f"""
SELECT event_id, CASE WHEN coalesce(xff, '') <> '' THEN trim(split_part(xff, ',', 1)) WHEN real_ip IS NOT NULL THEN real_ip ELSE peer END AS client_ip,
       reason IS NOT NULL AS suspicious, reason AS bot_reason
FROM (SELECT *, CASE
        WHEN coalesce(user_agent, '') = '' THEN '缺少User-Agent'
        WHEN regexp_matches(lower(user_agent), 'googlebot|bingbot|baiduspider') THEN NULL
        WHEN regexp_matches(lower(user_agent), 'bot|crawler|spider|scraper|curl|wget|python-requests|python-urllib|java|go-http-client|postman|insomnia|httpie')
          THEN '可疑的User-Agent'
        WHEN path <> '/' AND method = 'POST' AND referer = '' THEN '缺少Referer' END AS reason
      FROM ({_REQUEST.format(text="VARCHAR")}) q) r
""")
def q_bot_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F5 + P23: client address and bot verdict of every request."""
    from ..functions.text import real_client_ip
    req = spark.sql(_REQUEST.format(text="STRING").replace("FROM events", "FROM {events}"), events=table(spark, sf_dir, "events"))
    v = traffic_ops.detect_bots(req, check_referer=True)
    return v.select("event_id", real_client_ip("xff", "real_ip", "peer").alias("client_ip"), "suspicious", "bot_reason")


_LOG_SECONDS = "CAST(round(value * 1000) AS BIGINT)"


@register("app_log_profile", oracle=f"""
WITH e AS (SELECT event_type, event_id, {_LOG_SECONDS} / 1000.0 AS s FROM events)
SELECT event_type AS op, count(*) AS n, round(avg(s), 6) AS avg_s, max(s) AS max_s,
       count(*) FILTER (WHERE event_type = 'error') AS error_lines, max(event_id) AS last_event
FROM e GROUP BY 1
""")
def q_app_log_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S15 + F9 + A11: the event table written as an application log, parsed and profiled per operation."""
    from ..session import scratch_path
    from ..sources import app_log
    ms = F.round(F.col("value") * 1000).cast("long")
    seconds = F.concat_ws(".", F.floor(ms / 1000).cast("string"), F.lpad((ms % 1000).cast("string"), 3, "0"))
    level = F.when(F.col("event_type") == "error", "ERROR   ").otherwise("INFO    ")
    line = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" | "), level, F.lit(" | Thread-"), F.col("user_id").cast("string"),
                    F.lit(" | app.perf:record:42 - Performance: "), F.col("event_type"), F.lit(" took "), seconds,
                    F.lit("s | event="), F.col("event_id").cast("string"), F.lit(", user="), F.col("user_id").cast("string"))
    path = scratch_path(spark, f"app-log-{uuid.uuid4().hex}")
    table(spark, sf_dir, "events").select(line).write.text(path)
    log = app_log.parse_app_log(spark, path)
    errors = app_log.error_log_lines(log).groupBy("op").agg(F.count(F.lit(1)).alias("error_lines"))
    last = log.groupBy("op").agg(F.max(F.col("fields")["event"].cast("long")).alias("last_event"))
    return (app_log.performance_profile(log).join(errors, "op", "left").join(last, "op")
            .select("op", "n", rnd("avg_s").alias("avg_s"), "max_s", F.coalesce("error_lines", F.lit(0)).alias("error_lines"), "last_event"))


@register("stratified_split_sizes", oracle="""
SELECT label, count(*) AS n, CAST(round(count(*) * 0.2) AS BIGINT) AS n_test FROM embeddings GROUP BY label
""")
def q_stratified_split_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and held-out rows per class of the exact stratified split."""
    from ..operators import intent_model as im
    split = im.stratified_split(table(spark, sf_dir, "embeddings"), "label", "vec_id", 0.2, 42)
    return split.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("is_test").cast("long")).alias("n_test"))


@register("hit_previews", oracle=f"""
SELECT h.qid AS item_id, h.rank, h.chunk_id, CAST(len(list_filter(c.keywords, lambda w: contains(h.text, w))) AS INTEGER) AS score,
       replace(substr(h.text, 1, 150), chr(10), ' ') AS preview
FROM ({HITS_SQL}) h JOIN ({CASES_SQL}) c ON c.qid = h.qid
""")
def q_hit_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P12 + P13 + P19: keywords of every benchmark question in each of its retrieved chunks, with the chunk's preview."""
    from ..functions.text import keyword_score, preview
    hits = _benchmark_hits(spark, sf_dir).join(_cases(spark, sf_dir), "qid")
    return hits.select(F.col("qid").alias("item_id"), F.col("rank").cast("long").alias("rank"), "chunk_id",
                       keyword_score("text", "keywords").alias("score"), preview("text", 150).alias("preview"))


@register("file_corpus_hits", oracle=f"""
WITH files AS (SELECT doc_id, source, text || chr(10) AS text FROM documents WHERE text IS NOT NULL),
chunks AS ({FIXED_CHUNKS_SQL.replace("FROM documents", "FROM files")}),
top AS ({_cosine_topk_sql("benchmark", "item_id", "chunks", "chunk_id", L.RETRIEVER_K)})
SELECT qid, rank, round(cosine, 6) AS cosine FROM top
""")
def q_file_corpus_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S1 -> P5 -> P8 -> S4-S6 -> J1: every document written as a text file, scanned, chunked, embedded, saved as an
    index, loaded again and searched with every benchmark question."""
    from ..session import scratch_path
    from ..sources import corpus, index_store
    base = scratch_path(spark, f"file-corpus-{uuid.uuid4().hex}")
    texts = table(spark, sf_dir, "documents").where("text is not null").select("text")
    for at, folders in enumerate(corpus.write_text_files(texts, f"{base}/inbox")):
        docs, _ = corpus.scan_text_corpus(spark, folders)
        save = index_store.append_index if at else index_store.save_index
        save(spark, embed_ops.count_vectors(chunk_ops.chunk_documents_fixed(docs), "text", "vec"), f"{base}/index")
    index = index_store.load_index(spark, f"{base}/index")
    qs = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text")
    top = knn_ops.knn_join(embed_ops.count_vectors(qs, "text", "vec"), index, k=L.RETRIEVER_K, q_id="qid", q_vec="vec",
                           x_id="chunk_id", x_vec="vec", metric="cosine")
    return top.select("qid", F.col("rank").cast("long").alias("rank"), rnd("cosine").alias("cosine"))


@register("stream_bot_screen", oracle=ORACLES["bot_screen"].replace("SELECT event_id, CASE", "SELECT event_id, suspicious, bot_reason FROM (SELECT event_id, CASE", 1) + ") v")
def q_stream_bot_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T4 + F5: bot verdicts of requests arriving as a stream."""
    from ..streaming import jobs
    out, ck = _stream_dirs(spark, "bots")
    req = spark.sql(_REQUEST.format(text="STRING").replace("FROM events", "FROM {events}"), events=_events_stream(spark, sf_dir))
    v = jobs.stream_bots(req, check_referer=True).select("event_id", "suspicious", "bot_reason")
    jobs.run_available(v.writeStream.format("parquet").option("path", out), ck)
    return spark.read.parquet(out)


@register("route_with_model")
def q_route_with_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C1 with the model stage (P8, M1, M2, M3, F8): user turns that rules or keywords decide train the classifier,
    which answers the turns they leave open."""
    from ..operators import cascade
    turns = _user_turns(spark, sf_dir)
    decided = route_ops.route_questions(turns).where("method <> 'default'")
    model = cascade.train_on_texts(decided, max_iter=50)
    return cascade.route_with_model(turns, model).select("conv_id", "turn", "intent", "method", "skip_rag", rnd("confidence").alias("confidence"))


@register("category_eval", oracle=f"""
WITH h AS ({HITS_SQL}), cases AS (SELECT *, 'group ' || CAST(qid % 4 AS VARCHAR) AS category FROM ({CASES_SQL}) c),
rel AS (SELECT c.category, len(list_filter(c.keywords, lambda k: contains(h.text, k))) > 0 AS relevant FROM h JOIN cases c USING (qid)),
prec AS (SELECT category, count(*) FILTER (WHERE relevant) AS relevant, count(*) AS hits FROM rel GROUP BY 1),
kw AS (SELECT category, qid, unnest(keywords) AS keyword FROM cases),
rec AS (SELECT category, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM h WHERE h.qid = kw.qid AND contains(h.text, kw.keyword))) AS found,
               count(*) AS expected FROM kw GROUP BY 1)
SELECT category, relevant, hits, found, expected, round(relevant / hits, 6) AS precision, round(found / expected, 6) AS recall
FROM prec JOIN rec USING (category)
""")
def q_category_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A13 + J7: keyword precision and recall of the retrieval per group of benchmark questions."""
    cases = _cases(spark, sf_dir).withColumn("category", F.concat(F.lit("group "), (F.col("qid") % 4).cast("string")))
    m = eval_ops.category_metrics(_benchmark_hits(spark, sf_dir), cases)
    return m.select("category", F.col("relevant").cast("long").alias("relevant"), "hits", "found", "expected",
                    rnd("precision").alias("precision"), rnd("recall").alias("recall"))


@register("first_spam_keyword", oracle="""
SELECT doc_id, CASE WHEN contains(t, 'pinmuch') THEN 'pinmuch' WHEN contains(t, '品品品') THEN '品品品'
  WHEN contains(t, '网购返利') THEN '网购返利' WHEN contains(t, '获取本书pdf全文') THEN '获取本书PDF全文' WHEN contains(t, '请前往') THEN '请前往'
  WHEN contains(t, '搜索该书名') THEN '搜索该书名' WHEN contains(t, '欢速药夯患pdf') THEN '欢速药夯患PDF' WHEN contains(t, '全文，请前往') THEN '全文，请前往'
  WHEN contains(t, 'http://') THEN 'http://' WHEN contains(t, 'https://') THEN 'https://' WHEN contains(t, 'www.') THEN 'www.'
  WHEN contains(t, '精品资源') THEN '精品资源' WHEN contains(t, '扫码关注') THEN '扫码关注' WHEN contains(t, '微信公众号') THEN '微信公众号'
  WHEN contains(t, '公众号') THEN '公众号' WHEN contains(t, '尽在""') THEN '尽在""' WHEN contains(t, '献给') THEN '献给'
  WHEN contains(t, '专业关爱') THEN '专业关爱' WHEN contains(t, '版权所有') THEN '版权所有' WHEN contains(t, '保留所有权利') THEN '保留所有权利'
  WHEN contains(t, '流产康复') THEN '流产康复' WHEN contains(t, '做个爱她的男人') THEN '做个爱她的男人' WHEN contains(t, '做个体己的女子') THEN '做个体己的女子' END AS keyword
FROM (SELECT page_id AS doc_id, lower(html) AS t FROM pages)
""")
def q_first_spam_keyword(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first keyword of the spam list (list order) found in every raw page, if any."""
    from ..functions.text import first_spam_keyword
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), first_spam_keyword("html").alias("keyword"))


@register("cooccurrence_totals", oracle="""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '\\p{L}+') AS w FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, w[i] AS a, unnest(w[i + 1:i + 4]) AS b FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w)),
e AS (SELECT doc_id, least(a, b) AS u, greatest(a, b) AS v, count(*) AS n FROM p WHERE a <> b GROUP BY 1, 2, 3)
SELECT doc_id, 2 * count(*) AS edges, CAST(2 * sum(n) AS DOUBLE) AS weight, max(n)::DOUBLE AS heaviest FROM e GROUP BY doc_id
""")
def q_cooccurrence_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size, weight and heaviest edge of every document's word graph (both directions of an edge count)."""
    e = kw_ops.cooccurrence_edges(table(spark, sf_dir, "documents"))
    return e.groupBy("doc_id").agg(F.count(F.lit(1)).alias("edges"), F.sum("w").alias("weight"), F.max("w").alias("heaviest"))


@register("chunk_contract", oracle=f"""
SELECT doc_id, true AS short_enough, true AS all_contained, 0 AS lost_words, true AS no_blank_edges
FROM documents WHERE len(regexp_extract_all(text, '[^\\s]+')) > 0 AND list_max(list_transform(regexp_extract_all(text, '[^\\s]+'), lambda x: length(x))) <= {L.CHUNK_SIZE}
""")
def q_chunk_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P5: what the boundary-aware chunks of every document must satisfy: at most 800 characters, taken from the text,
    stripped, and between them holding every word (documents whose words all fit a chunk)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    all_words = F.regexp_extract_all("text", F.lit(r"(\S+)"), 1)
    c = chunk_ops.chunk_documents(docs).join(docs.select("doc_id", F.col("text").alias("whole")), "doc_id")
    per = c.groupBy("doc_id").agg(
        F.bool_and(F.length("text") <= L.CHUNK_SIZE).alias("short_enough"),
        F.bool_and(F.col("whole").contains(F.col("text"))).alias("all_contained"),
        F.bool_and(~F.col("text").rlike(r"^\s|\s$")).alias("no_blank_edges"),
        F.array_distinct(F.flatten(F.collect_list(all_words))).alias("seen"))  # one document's words
    longest = F.array_max(F.transform("w", lambda x: F.length(x)))
    return (docs.select("doc_id", all_words.alias("w")).where((F.size("w") > 0) & (longest <= L.CHUNK_SIZE)).join(per, "doc_id")
            .select("doc_id", "short_enough", "all_contained", F.size(F.array_except("w", "seen")).alias("lost_words"), "no_blank_edges"))


from . import catalog_requests, catalog_retrieval, catalog_sources  # noqa: E402,F401  (register their queries)
