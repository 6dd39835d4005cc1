"""Registered queries over the request log that came after ``catalog.py``: admitted-only moving windows,
verdicts on a stream of drops, latency sketches and stage shares."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timex import micros
from ..operators import admitted as admitted_ops
from ..operators import traffic as traffic_ops
from ..session import scratch_path
from . import sqlgen as S
from .catalog import DAY_US, HOUR_US, RL_LIMIT, RL_WINDOW_S, register, table


# ------------------------------------------------------- W10, admitted requests only
def admitted_walk_sql(src: str, keys: str, width_us: int, limit: int) -> str:
    """Walk each key's requests in order, remembering the last ``limit`` admitted instants."""
    on = " AND ".join(f"o.{k.strip()} = w.{k.strip()}" for k in keys.split(","))
    ok = f"(len(w.acc) < {limit} OR o.us - w.acc[1] >= {width_us})"
    outer = ", ".join(f"o.{k.strip()}" for k in keys.split(","))
    return f"""
WITH RECURSIVE o AS (
  SELECT event_id, {keys}, us, row_number() OVER (PARTITION BY {keys} ORDER BY us, event_id) AS rn FROM {src}
),
walk({keys}, rn, event_id, acc, allowed) AS (
  SELECT {keys}, rn, event_id, [us], true FROM o WHERE rn = 1
  UNION ALL
  SELECT {outer}, o.rn, o.event_id,
         CASE WHEN {ok} THEN list_append(w.acc, o.us)[-{limit}:] ELSE w.acc END, {ok}
  FROM walk w JOIN o ON {on} AND o.rn = w.rn + 1
)
SELECT event_id, {keys}, allowed FROM walk
"""


_EVENTS_US = "(SELECT *, epoch_us(ts) AS us FROM events)"


@register("rate_limit_admitted", oracle=admitted_walk_sql(_EVENTS_US, "user_id, event_type", DAY_US, RL_LIMIT))
def q_rate_limit_admitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W10 counting admitted requests only, per client and route, one a day, by a walk over sorted pieces."""
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    return admitted_ops.moving_window_admitted(ev, RL_WINDOW_S, RL_LIMIT).drop("ts")


@register("rate_limit_admitted_routes", oracle=admitted_walk_sql(_EVENTS_US, "event_type", HOUR_US, 3))
def q_rate_limit_admitted_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W10 counting admitted requests only, three an hour on a whole route: every key holds a fifth or more of all rows."""
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "event_type")
    return admitted_ops.moving_window_admitted(ev, 3600, 3, key_cols=("event_type",)).drop("ts")


# --------------------------------------------------------------- T2, T3 on drops of files
#: A drop holds what arrives in so many days.
DROP_DAYS = 4
#: Requests arrive up to so many days after their instant, in any order; the watermark waits as long ...
DISORDER_DAYS = 2
#: ... but every fiftieth request is this much later still.
STRAGGLE_DAYS = 10

_ARRIVAL = f"({{us}} + (event_id * 7919 % 1000) * {DISORDER_DAYS * DAY_US // 1000} + CASE WHEN event_id % 50 = 0 THEN {STRAGGLE_DAYS * DAY_US} ELSE 0 END)"


def _drops(spark: SparkSession, sf_dir: str, base: str) -> DataFrame:
    """``events`` written as files in the order of arrival (ten or more), then a heartbeat that ends the stream; as a stream."""
    ev = table(spark, sf_dir, "events")
    drop = F.floor(F.expr(_ARRIVAL.format(us="_us")) / (DROP_DAYS * DAY_US))
    rows = ev.withColumn("_us", micros("ts")).withColumn("drop", drop).drop("_us").checkpoint(eager=True)
    names = sorted(r[0] for r in rows.select("drop").distinct().collect())  # a number for every four days
    for at, n in enumerate(names):
        rows.where(F.col("drop") == n).select(ev.columns).repartition(1).write.parquet(f"{base}/drops/d={at}")
    beat = rows.agg((F.max("ts") + F.expr("INTERVAL 400 DAYS")).alias("ts"))
    beat.select(*[F.lit(None).cast(f.dataType).alias(f.name) if f.name != "ts" else F.col("ts") for f in ev.schema]) \
        .coalesce(1).write.parquet(f"{base}/drops/d={len(names)}")
    return spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/drops/d=*")


def _late_sql(span_us: int) -> str:
    """Requests with ``late``: their span of time was closed by the watermark of the drops before theirs."""
    return f"""
d AS (SELECT event_id, user_id, event_type, ts, epoch_us(ts) AS us, {_ARRIVAL.format(us='epoch_us(ts)')} // {DROP_DAYS * DAY_US} AS n FROM events),
m AS (SELECT n, max(max(us)) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM d GROUP BY n),
l AS (SELECT d.*, coalesce((us // {span_us} + 1) * {span_us} // 1000 < seen // 1000 - {DISORDER_DAYS * DAY_US // 1000}, false) AS late
      FROM d JOIN m USING (n))
"""


def _stream(spark: SparkSession, sf_dir: str, verdicts) -> DataFrame:
    from ..streaming import jobs
    base = scratch_path(spark, f"streams/drops-{uuid.uuid4().hex[:8]}")
    out = verdicts(_drops(spark, sf_dir, base))
    jobs.run_available(out.writeStream.format("parquet").option("path", f"{base}/out"), f"{base}/checkpoint")
    return spark.read.schema("event_id long, allowed boolean, late boolean").parquet(f"{base}/out")


@register("stream_fixed_window_verdicts", oracle=f"""
WITH {_late_sql(DAY_US)},
v AS (SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type, us // {DAY_US} ORDER BY us, event_id) <= {RL_LIMIT} AS allowed
      FROM l WHERE NOT late)
SELECT event_id, allowed, late FROM l LEFT JOIN v USING (event_id)
""")
def q_stream_fixed_window_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T2 per request with transformWithState: drops out of order, late requests counted; equals W9 over the others."""
    from ..streaming import limiter
    return _stream(spark, sf_dir, lambda s: limiter.fixed_window_verdicts(s, RL_WINDOW_S, RL_LIMIT, watermark=f"{DISORDER_DAYS} days"))


@register("stream_moving_window_verdicts", oracle=f"""
WITH {_late_sql(DAY_US // 4)}
SELECT event_id, allowed, late FROM l
LEFT JOIN ({admitted_walk_sql('(SELECT * FROM l WHERE NOT late)', 'user_id, event_type', DAY_US, RL_LIMIT)}) v USING (event_id)
""")
def q_stream_moving_window_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T3 with transformWithState: moving window of admitted requests over drops out of order; equals W10 over those not late."""
    from ..streaming import limiter
    return _stream(spark, sf_dir, lambda s: limiter.moving_window_verdicts(s, RL_WINDOW_S, RL_LIMIT, watermark=f"{DISORDER_DAYS} days"))


# ------------------------------------------------------------------ A11 percentiles, stages
QUANTILES = (0.5, 0.9, 0.99)


@register("latency_sketch_ranks", oracle=f"""
SELECT event_type, count(*) AS n, unnest({list(QUANTILES)})::DOUBLE AS quantile, true AS within_bound FROM events GROUP BY event_type
""")
def q_latency_sketch_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly KLL sketches merged per route; is the exact rank of every quantile within one percent of what it stands for."""
    ev = table(spark, sf_dir, "events").select("event_type", "ts", "value")
    found = traffic_ops.merged_quantiles(traffic_ops.latency_sketches(ev), QUANTILES)
    near = ev.join(F.broadcast(found), "event_type")  # three rows a route
    ranks = near.groupBy("event_type", "n", "quantile").agg(F.avg((F.col("value") < F.col("seconds")).cast("double")).alias("low"),
                                                             F.avg((F.col("value") <= F.col("seconds")).cast("double")).alias("high"))
    within = (F.col("low") - 0.01 <= F.col("quantile")) & (F.col("quantile") <= F.col("high") + 0.01)
    return ranks.select("event_type", F.col("n").cast("long").alias("n"), "quantile", within.alias("within_bound"))


_US = "CAST(round(value * 1000000) AS BIGINT)"


@register("latency_stage_shares", oracle=f"""
WITH e AS (SELECT event_type, {_US} AS us, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events),
s AS (SELECT event_type, us * (k % 30) // 100 AS retrieval, us * (k % 7) // 100 AS compression, us FROM e),
g AS (SELECT event_type, count(*) AS requests, sum(us)::BIGINT AS total, sum(retrieval)::BIGINT AS a, sum(compression)::BIGINT AS b FROM s GROUP BY event_type),
p AS (SELECT event_type, requests, total, unnest([{{'stage': 'retrieval', 'micros': a}}, {{'stage': 'compression', 'micros': b}},
      {{'stage': 'generation', 'micros': total - a - b}}]) AS p FROM g)
SELECT event_type, p.stage AS stage, requests, p.micros AS micros, {S.pct2('p.micros', 'total')} AS share_pct FROM p
""")
def q_latency_stage_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time of every stage and its share, per route; the stages of a request are parts of its duration set by ``props``."""
    ev = table(spark, sf_dir, "events").select("event_type", F.expr(_US).alias("us"), F.get_json_object("props", "$.k").cast("long").alias("k"))
    ev = ev.withColumn("retrieval", F.expr("us * (k % 30) div 100")).withColumn("compression", F.expr("us * (k % 7) div 100"))
    ev = ev.withColumn("generation", F.col("us") - F.col("retrieval") - F.col("compression"))
    return traffic_ops.stage_shares(ev, {s: s for s in ("retrieval", "compression", "generation")})
