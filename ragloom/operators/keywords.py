"""Keyword extraction: n-gram (P15), TF-IDF (P16) and TextRank.

* P15 needs only the document itself, so it runs inside the document row
  (an Arrow UDF counts the grams of one text at a time): no shuffle.
* P16 needs corpus document frequencies: term counts are taken inside the
  document row, document frequencies are an aggregate of counts per batch
  joined back on the token.
* P14 is an iterative, damped rank propagation over co-occurrence edges; the
  state is one row per (doc, token) and lineage is cut with ``checkpoint()``.
"""

from __future__ import annotations

import re

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import lexicon as L
from ..functions.text import words

BROADCAST_TOKENS = 1_000_000  # vocabulary rows (token, df) that may be broadcast

GRAM_ARRAY = T.ArrayType(T.StructType([T.StructField("gram", T.StringType()),
                                       T.StructField("n", T.LongType())]))
#: Edges that leave a Python worker at a time (a few megabytes).
EDGE_ROWS = 1 << 16
#: Texts whose tokens are counted at a time.
COUNT_ROWS = 1000


def _lists(texts: pa.Array, found, names: list[str], types: list[pa.DataType]) -> pa.Array:
    """A list of structs for every text: ``found(text)`` gives a list of dicts; one text is a Python string at a time."""
    columns, ends = {n: [] for n in names}, [0]
    for t in texts:
        rows = found(t.as_py())
        for n in names:
            columns[n] += [r[n] for r in rows]
        ends.append(ends[-1] + len(rows))
    fields = [pa.field(n, t) for n, t in zip(names, types)]
    struct = pa.StructArray.from_arrays([pa.array(columns[f.name], f.type) for f in fields], fields=fields)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), struct)


def _top_grams(text: str | None, k: int, strip_re: re.Pattern) -> list[dict]:
    """k most frequent 2/3-grams (count desc, then gram in code point order).

    Grams are packed into one int64 each: ``c0<<42 | c1<<21 | tail`` with
    tail 0 for a 2-gram and ``c2+1`` for a 3-gram, so integer order equals
    string order (a 2-gram sorts before the 3-grams it prefixes).
    """
    if text is None:
        return []
    t = strip_re.sub("", text)
    if len(t) < 2:
        return []
    cp = np.frombuffer(t.encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
    two = (cp[:-1] << 42) | (cp[1:] << 21)
    three = (cp[:-2] << 42) | (cp[1:-1] << 21) | (cp[2:] + 1)
    keys, counts = np.unique(np.concatenate([two, three]), return_counts=True)
    order = np.lexsort((keys, -counts))[:k]
    out = []
    mask = (1 << 21) - 1
    for key, n in zip(keys[order].tolist(), counts[order].tolist()):
        tail = key & mask
        g = chr(key >> 42) + chr((key >> 21) & mask) + (chr(tail - 1) if tail else "")
        out.append({"gram": g, "n": int(n)})
    return out


def ngram_keywords_col(text_col: str = "text", k: int = 10,
                       strip_class: str = L.NGRAM_STRIP_CLASS):
    """P15 as a column: array<struct<gram, n>> of the k most frequent 2/3-grams.

    Punctuation and whitespace runs are removed first; order is frequency
    desc, then gram (code point order).
    """
    strip_re = re.compile(strip_class)

    @F.arrow_udf(GRAM_ARRAY)
    def top_grams(s: pa.Array) -> pa.Array:
        return _lists(s, lambda t: _top_grams(t, k, strip_re), ["gram", "n"], [pa.string(), pa.int64()])

    return top_grams(F.col(text_col))


def ngram_keywords(docs: DataFrame, k: int = 10, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """P15 rows: (doc_id, rank, gram, n)."""
    return (docs.select(id_col, ngram_keywords_col(text_col, k).alias("_g"))
            .select(id_col, F.posexplode("_g").alias("_pos", "_s"))
            .select(id_col, (F.col("_pos") + 1).cast("long").alias("rank"),
                    F.col("_s.gram").alias("gram"), F.col("_s.n").alias("n")))


def _counted(docs: DataFrame, id_col: str, text_col: str, by_text: bool) -> DataFrame:
    """Tokens counted inside the rows: (id, token, n) of every text, or (token, n) with the texts of a batch that hold the token."""
    rows = docs.select(id_col, words(F.col(text_col)).alias("_words"))
    fields = [T.StructField("token", T.StringType()), T.StructField("n", T.LongType())]
    schema = T.StructType([rows.schema[0], *fields] if by_text else fields)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(at, COUNT_ROWS) for whole in batches for at in range(0, whole.num_rows, COUNT_ROWS)):
            lists = b.column(1)
            coded = lists.flatten().dictionary_encode()
            row = np.repeat(np.arange(b.num_rows), pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
            size = max(1, len(coded.dictionary))
            pair, n = np.unique(row * size + coded.indices.to_numpy(), return_counts=True)
            if not by_text:
                yield pa.RecordBatch.from_arrays([coded.dictionary, pa.array(np.bincount(pair % size, minlength=len(coded.dictionary)), pa.int64())], names=["token", "n"])
                continue
            for s in range(0, len(pair), EDGE_ROWS):
                own = pair[s:s + EDGE_ROWS]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(own // size)), coded.dictionary.take(pa.array(own % size)),
                                                  pa.array(n[s:s + EDGE_ROWS], pa.int64())], names=schema.names)

    return rows.mapInArrow(count, schema)


def _summed(counted: DataFrame, docs: DataFrame, id_col: str) -> DataFrame:
    """(id, token, tf) from the counts of every text: only those of an id that several rows share are shuffled and added up."""
    counted = counted.withColumnRenamed("n", "tf")
    shared = docs.groupBy(id_col).count().where("count > 1").select(F.col(id_col).alias("_shared")).checkpoint(eager=True)
    if shared.isEmpty():
        return counted
    here = F.col(id_col).eqNullSafe(F.col("_shared"))
    once, several = (counted.join(shared, here, how) for how in ("left_anti", "left_semi"))
    return once.unionByName(several.groupBy(id_col, "token").agg(F.sum("tf").alias("tf")))


def term_frequencies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, token, tf) over lower-cased letter runs; a text is counted in its row."""
    return _summed(_counted(docs, id_col, text_col, True), docs, id_col)


def document_frequencies(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(token, df): in how many texts a token occurs; a batch of texts sends each of its tokens once."""
    return _counted(docs, text_col, text_col, False).groupBy("token").agg(F.sum("n").alias("df"))


def tfidf_keywords(docs: DataFrame, k: int = 10, id_col: str = "doc_id",
                   text_col: str = "text", n_docs: int | None = None) -> DataFrame:
    """P16 rows: (doc_id, rank, token, tf, df, score) with score = tf * ln(N / df).

    Ranking uses the score rounded to 9 decimals so mathematically equal
    scores tie exactly, then the token.
    """
    if n_docs is None:
        n_docs = docs.count()
    tf = term_frequencies(docs, id_col, text_col)
    # words of nearly every document would be hot join keys: document frequencies are
    # broadcast while the vocabulary is within the bound
    df_ = document_frequencies(docs, text_col).checkpoint(eager=True)
    side = F.broadcast(df_) if df_.count() <= BROADCAST_TOKENS else df_
    scored = (tf.join(side, "token")
              .withColumn("score", F.col("tf") * F.log(F.lit(float(n_docs)) / F.col("df"))))
    w = Window.partitionBy(id_col).orderBy(F.round("score", 9).desc(), F.col("token"))
    return (scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
            .select(id_col, F.col("rank").cast("long").alias("rank"), "token", "tf", "df", "score"))


def corpus_keywords(texts: DataFrame, frequencies: DataFrame, n_docs: int, k: int = 10, id_col: str = "qid",
                    text_col: str = "text") -> DataFrame:
    """P16 of texts outside the corpus: (id, keywords), the k tokens of most tf * ln(n_docs / df), best first.

    ``frequencies``: (token, df) of the corpus, as ``document_frequencies``
    gives them; a token that the corpus lacks weighs as if one document had
    it. Ties go by token. Texts without a token give no row. Ids must differ.
    """
    tf = texts.select(id_col, F.explode(words(F.col(text_col))).alias("token")).groupBy(id_col, "token").agg(F.count(F.lit(1)).alias("tf"))
    side = F.broadcast(frequencies) if frequencies.limit(BROADCAST_TOKENS + 1).count() <= BROADCAST_TOKENS else frequencies
    weight = F.col("tf") * F.log(F.lit(float(max(1, n_docs))) / F.greatest(F.coalesce("df", F.lit(0)), F.lit(1)))
    scored = tf.join(side, "token", "left").withColumn("_s", F.round(weight, 9))
    w = Window.partitionBy(id_col).orderBy(F.col("_s").desc(), F.col("token"))
    top = scored.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k)
    ordered = F.array_sort(F.collect_list(F.struct("_r", "token")))  # k entries
    return top.groupBy(id_col).agg(F.transform(ordered, lambda x: x["token"]).alias("keywords"))


# ------------------------------------------------------------------ TextRank
WORD_RE = re.compile(r"[^\W\d_]+")
_HAN = regex.compile(r"(\p{Han}+)")


def tokens(text: str) -> list[str]:
    """Lower-cased letter runs of one text; runs of Chinese characters as bigrams (``functions.text.words``)."""
    out: list[str] = []
    for run in WORD_RE.findall(text.lower()):
        for part in filter(None, _HAN.split(run)):
            out += [part[i:i + 2] for i in range(len(part) - 1)] if _HAN.match(part) and len(part) > 1 else [part]
    return out

TR_ARRAY = T.ArrayType(T.StructType([T.StructField("token", T.StringType()),
                                     T.StructField("weight", T.DoubleType())]))


def _graph(text: str | None, window: int) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of one text in order of name, and its word graph: ends (u < v, positions of tokens) and weights of the edges."""
    toks = tokens(text or "")
    names = sorted(set(toks))
    vocab = {t: i for i, t in enumerate(names)}
    ids = np.fromiter((vocab[t] for t in toks), dtype=np.int64, count=len(toks))
    packed = []
    for off in range(1, window):
        a, b = ids[:-off], ids[off:]
        apart = a != b
        packed.append((np.minimum(a, b) * len(names) + np.maximum(a, b))[apart])
    pair, w = np.unique(np.concatenate([np.zeros(0, np.int64), *packed]), return_counts=True)
    return names, pair // max(1, len(names)), pair % max(1, len(names)), w.astype(np.float64)


def cooccurrence_edges(docs: DataFrame, window: int = 5, id_col: str = "doc_id",
                       text_col: str = "text") -> DataFrame:
    """Weighted edges (u, v, w), in both directions, between tokens at most ``window - 1`` apart.

    A text's graph is counted inside its row: no self-join, and no token or
    edge is shuffled. Edges leave in batches of ``EDGE_ROWS``, however many a
    text or a batch of texts has.
    """
    rows = docs.select(id_col, F.col(text_col).cast("string").alias("_text"))
    schema = T.StructType([rows.schema[0], T.StructField("u", T.StringType()), T.StructField("v", T.StringType()), T.StructField("w", T.DoubleType())])

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column(0), b.column(1)
            names, held, parts = [], 0, []

            def emptied() -> Iterator[pa.RecordBatch]:
                at, u, v, w = (np.concatenate(x) for x in zip(*parts))
                words_, strings = pa.array(names, pa.string()), texts.type
                for s in range(0, len(at), EDGE_ROWS):
                    cut = slice(s, s + EDGE_ROWS)
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array(at[cut])), words_.take(pa.array(u[cut])).cast(strings),
                         words_.take(pa.array(v[cut])).cast(strings), pa.array(w[cut])], names=[b.schema.names[0], "u", "v", "w"])

            for i in range(b.num_rows):
                toks, u, v, w = _graph(texts[i].as_py(), window)
                if not len(u):
                    continue
                u, v = u + len(names), v + len(names)
                names += toks
                parts.append((np.full(2 * len(u), i), np.concatenate([u, v]), np.concatenate([v, u]), np.concatenate([w, w])))
                held += 2 * len(u)
                if held >= EDGE_ROWS:
                    yield from emptied()
                    names, held, parts = [], 0, []
            if parts:
                yield from emptied()

    return rows.mapInArrow(edges, schema)


def _textrank_one(text: str | None, k: int, window: int, damping: float, iterations: int):
    """Power iteration over one document's co-occurrence graph (edge lists, linear in edges)."""
    names, u, v, w = _graph(text, window)
    if len(u) == 0:
        return []
    n = len(names)
    src = np.concatenate([u, v])
    dst = np.concatenate([v, u])
    wt = np.concatenate([w, w])
    out = np.bincount(src, weights=wt, minlength=n)
    frac = wt / out[src]
    r = np.ones(n)
    for _ in range(iterations):
        r = (1.0 - damping) + damping * np.bincount(dst, weights=frac * r[src], minlength=n)
    nodes = np.unique(src)
    order = sorted(nodes.tolist(), key=lambda i: (-round(float(r[i]), 9), names[i]))[:k]  # equal up to rounding is a tie
    return [{"token": names[i], "weight": float(r[i])} for i in order]


def textrank_keywords(docs: DataFrame, k: int = 20, window: int = 5, damping: float = 0.85,
                      iterations: int = 10, id_col: str = "doc_id", text_col: str = "text",
                      checkpoint_every: int = 3, method: str = "in_row") -> DataFrame:
    """P14 rows: (doc_id, rank, token, weight) after ``iterations`` damped updates.

    Each document's graph belongs to its own row, so the default
    ``method="in_row"`` runs the iteration inside an Arrow UDF (edge
    lists, no shuffle). ``method="iterative"`` is the DataFrame formulation:
    state is one row per (doc, token), every iteration a join with the edge
    table and an aggregate, lineage cut with a reliable ``checkpoint()``.
    Both give the same weights.
    """
    if method == "in_row":
        @F.arrow_udf(TR_ARRAY)
        def tr(s: pa.Array) -> pa.Array:
            return _lists(s, lambda t: _textrank_one(t, k, window, damping, iterations), ["token", "weight"], [pa.string(), pa.float64()])
        return (docs.select(id_col, F.posexplode(tr(F.col(text_col))).alias("_p", "_s"))
                .select(id_col, (F.col("_p") + 1).cast("long").alias("rank"),
                        F.col("_s.token").alias("token"), F.col("_s.weight").alias("weight")))
    edges = cooccurrence_edges(docs, window, id_col, text_col)
    out_w = edges.groupBy(id_col, "u").agg(F.sum("w").alias("_out"))
    e = (edges.join(out_w, [id_col, "u"]).select(id_col, "u", "v", (F.col("w") / F.col("_out")).alias("_f"))
         .repartition(id_col).checkpoint(eager=True))
    rank = e.select(id_col, F.col("u").alias("token")).distinct().withColumn("r", F.lit(1.0))
    for it in range(iterations):
        contrib = (e.join(rank.withColumnRenamed("token", "u"), [id_col, "u"])
                   .groupBy(id_col, F.col("v").alias("token"))
                   .agg(F.sum(F.col("_f") * F.col("r")).alias("_s")))
        rank = contrib.select(id_col, "token",
                              (F.lit(1.0 - damping) + F.lit(damping) * F.col("_s")).alias("r"))
        if (it + 1) % checkpoint_every == 0:
            rank = rank.checkpoint(eager=True)
    w = Window.partitionBy(id_col).orderBy(F.round("r", 9).desc(), F.col("token"))
    out = (rank.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
           .select(id_col, F.col("rank").cast("long").alias("rank"), "token",
                   F.col("r").alias("weight")))
    return out
