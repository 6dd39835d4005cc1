"""DuckDB statements for the rows of the registered queries that SQL can express."""

from __future__ import annotations

from ragloom.llm import mixing, sharding

_DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_FIVE = "('0x' || substr(h, {at}, 5))::BIGINT"
_BASE32 = " || ".join(
    f"substr('{_DIGITS}', ((({_FIVE.format(at=1 + 5 * k)}) >> {s}) & 31)::INT + 1, 1)" for k in range(8) for s in (15, 10, 5, 0))

WARC = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
h AS (SELECT page_id, strlen(t)::BIGINT AS payload_bytes, sha1(t) AS h FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY h, payload_bytes) AS first FROM h)
SELECT page_id, payload_bytes, {_BASE32} AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM m
"""

#: The pages of the given tables mark their article; its blocks start at paragraphs and headings.
HTML = r"""
WITH a AS (SELECT page_id, url, regexp_extract(html, '(?s)<article[^>]*>(.*)</article>', 1) AS body FROM pages),
b AS (SELECT page_id, url, list_transform(
        string_split(regexp_replace(regexp_replace(body, '</?(p|h[1-6]|div|ul|ol|li|blockquote)(\s[^>]*)?>', chr(1), 'g'), '<[^>]*>', ' ', 'g'), chr(1)),
        lambda x: trim(regexp_replace(regexp_replace(replace(replace(regexp_replace(x, '&quot;?', '"', 'g'), '&lt;', '<'), '&gt;', '>'),
                                                '&amp;?', '&', 'g'), '\s+', ' ', 'g'))) AS blocks FROM a),
t AS (SELECT page_id, url, array_to_string(list_filter(blocks, lambda x: x <> ''), chr(10)) AS text FROM b)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM t
"""

EMBEDDINGS = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings),
link AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id
         WHERE list_inner_product(a.e, b.e) / (a.n * b.n) >= 0.9),
reach AS (SELECT vec_id AS x, vec_id AS y FROM v UNION SELECT r.x, l.y FROM reach r JOIN link l ON r.y = l.x),
c AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x),
n AS (SELECT x, count(*) AS n FROM link GROUP BY x)
SELECT v.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN c ON c.x = v.vec_id LEFT JOIN n ON n.x = v.vec_id
"""

_WORDS = (r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
          r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")

DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id::VARCHAR AS item_id, {_WORDS} AS w FROM benchmark),
windows AS (SELECT DISTINCT item_id, l, array_to_string(w[k:k + l - 1], ' ') AS g
            FROM (SELECT *, least(len(w), 13) AS l, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS k FROM i WHERE len(w) > 0)),
grams AS (SELECT doc_id, l, k, array_to_string(w[k:k + l - 1], ' ') AS g
          FROM (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS k FROM d, (SELECT DISTINCT l FROM windows))),
found AS (SELECT doc_id, k, l, item_id FROM grams JOIN windows USING (l, g)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + l)) AS p FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def _turns(names: list[str], size: int) -> list[int]:
    """The lookup table by its definition: whole preference lists, turns until every slot has an owner."""
    order = []
    for s in names:
        start, stride = sharding.preference(s, size)
        order.append(iter([(start + j * stride) % size for j in range(size)]))
    owner: dict[int, int] = {}
    while len(owner) < size:
        for k, slots in enumerate(order):
            if len(owner) < size:
                owner[next(s for s in slots if s not in owner)] = k
    return [owner[s] for s in range(size)]


def _sharding() -> str:
    table = _turns([f"shard-{k:05d}" for k in range(sharding.SHARDS)], sharding.TABLE_SIZE)
    return f"""
WITH s AS (SELECT doc_id, (('0x' || substr(md5(coalesce(doc_id::VARCHAR, md5(text), '')), 1, 15))::BIGINT % {sharding.TABLE_SIZE})::INT AS slot FROM documents),
t AS (SELECT unnest(range(0, {sharding.TABLE_SIZE}))::INT AS slot, unnest({table})::INT AS shard)
SELECT doc_id, slot, shard FROM s JOIN t USING (slot)
"""


def _clustering(k: int = 8, rounds: int = 10) -> str:
    """Rounds written out one after another; all arithmetic in 64-bit integers."""
    parts = ["v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings "
             "WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0)",
             f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), v) - 1 AS c, v AS m FROM v "
             f"QUALIFY row_number() OVER (ORDER BY sha256('3:' || vec_id), v) <= {k})"]
    for r in range(rounds + 1):
        parts.append(f"a{r} AS MATERIALIZED (SELECT vec_id, any_value(v) AS v, min(struct_pack(d := d, c := c)) AS x FROM (SELECT vec_id, n, v, c, "
                     f"list_sum(list_transform(list_zip(v, m), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d "
                     f"FROM (SELECT *, row_number() OVER () AS n FROM v), c{r}) GROUP BY vec_id, n)")
        if r < rounds:
            parts.append(f"s{r} AS (SELECT c, i, sum(e)::BIGINT AS s, count(*) AS n FROM (SELECT x.c AS c, unnest(v) AS e, unnest(range(1, 65)) AS i FROM a{r}) GROUP BY c, i)")
            parts.append(f"c{r + 1} AS MATERIALIZED (SELECT c, coalesce(f, m) AS m FROM c{r} LEFT JOIN "
                         f"(SELECT c, list(((s - ((s % n) + n) % n) / n)::BIGINT ORDER BY i) AS f FROM s{r} GROUP BY c) USING (c))")
    return ("WITH " + ",\n".join(parts) + f"""
SELECT vec_id, x.c::INT AS cluster, x.d AS distance, sum(x.d) OVER (PARTITION BY x.c)::BIGINT AS cluster_inertia,
       sum(x.d) OVER ()::BIGINT AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} ON c = x.c
""")


#: Every order and step over counts by set of failed filters; shapley by its definition, summed over the orders.
FILTER_AUDIT = r"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS first FROM t),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT
             + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t))::INT
             + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(w.doc_id > first, false)::INT AS m,
             coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM w LEFT JOIN l USING (doc_id)),
g AS (SELECT part, m, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY part, m),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS o FROM x a, x b, x c, x d, x e
      WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT o, step, 1 << (ascii(substr(o, step, 1)) - 65) AS own,
             list_sum(list_transform(range(1, step), lambda k: 1 << (ascii(substr(o, k, 1)) - 65))) AS before
      FROM (SELECT o, unnest(range(1, 6)) AS step FROM o)),
r AS (SELECT part, o AS filter_order, step::INT AS step, own,
             coalesce(sum(n) FILTER (m & (own | before) = 0), 0) AS kept,
             coalesce(sum(n) FILTER (m & own <> 0 AND m & before = 0), 0) AS removed,
             coalesce(sum(n) FILTER (m & own <> 0 AND m & before <> 0), 0) AS redundant,
             coalesce(sum(n) FILTER (m = own), 0) AS unique_fails,
             coalesce(sum(good) FILTER (m & own <> 0 AND m & before = 0), 0) AS good_lost,
             coalesce(sum(toxic) FILTER (m & own <> 0 AND m & before = 0), 0) AS toxic_lost
      FROM g, (SELECT o, step, own, coalesce(before, 0)::BIGINT AS before FROM s) GROUP BY part, o, step, own)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
       unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM r
"""


def statements() -> dict[str, str]:
    return {"op1_warc": WARC, "op3_source_mixing": mixing.ORACLE, "op4_html_text": HTML,
            "op6_embedding_near_dedup": EMBEDDINGS, "op7_decontamination": DECONTAMINATION, "op10_sharding": _sharding(),
            "op11_centroid_clustering": _clustering(), "op12_filter_audit": FILTER_AUDIT}
