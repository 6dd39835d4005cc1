"""Request-traffic analytics: rate limits (W9, W10), bots (F5), concurrency
(W11), admission (A9) and latency (A11).

Requests are rows ``(event_id, ts, client, route, duration)``. Hot clients are
the norm in traffic data, so no operator here lets one key own a task:

* fixed windows rank by ``row_number`` inside (key, window), so a hot client
  is spread over its windows; null keys and repeated ids need no special case;
* moving windows split each key's time line into buckets and copy the rows
  of the last window length of a bucket into the next one ("halo"), so a
  window frame never crosses a partition and a hot key spreads over buckets;
* running sums (concurrency) are segmented: bucket totals -> a prefix over
  the small bucket table -> local running sums inside each bucket.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions.mathx import pct2
from ..functions.timex import from_micros, micros

MICROS = 1_000_000
WORK_SECONDS = 60  # buckets of the running count, whatever the reporting bucket


def window_start(ts, width_seconds: int) -> Column:
    """Clock-aligned (epoch) start of the fixed window holding ``ts``."""
    t = micros(ts)
    return from_micros(t - F.pmod(t, F.lit(width_seconds * MICROS)))


def fixed_window_limit(req: DataFrame, limit: int, width_seconds: int,
                       key_cols=("user_id", "event_type"), ts: str = "ts",
                       id_col: str = "event_id") -> DataFrame:
    """Per key and clock-aligned window the first ``limit`` requests pass.

    Adds ``window_start`` and ``allowed``. Rejected requests count as attempts
    (they never enter the window's admitted set).
    """
    staged = req.withColumn("window_start", window_start(ts, width_seconds))
    w = Window.partitionBy(*key_cols, "window_start").orderBy(F.col(ts), F.col(id_col))
    return (staged.withColumn("_admit_no", F.row_number().over(w))
            .withColumn("allowed", F.col("_admit_no") <= limit).drop("_admit_no"))


def moving_window_attempts(req: DataFrame, width_seconds: int, limit: int,
                           key_cols=("user_id", "event_type"), ts: str = "ts",
                           bucket_factor: int = 1) -> DataFrame:
    """W10 (attempt counting): requests of the same key in ``(t - width, t]``.

    Requests at the same instant count together (RANGE frame). ``allowed`` is
    ``attempts <= limit``. A key's time line is cut into buckets of
    ``bucket_factor`` widths; rows within ``width`` of the next bucket start
    are copied into it ("halo"), so a frame never leaves its bucket and a hot
    key spreads over its buckets. Null keys are a key like any other, rows
    with equal ids stay rows of their own; a null instant counts the null
    instants of its key.
    """
    W = width_seconds * MICROS
    B = max(1, bucket_factor) * W
    t = micros(ts)
    # _b is the bucket start (integer micros); rows within W of the next start are copied there
    base = req.withColumn("_t", t).withColumn("_b", F.col("_t") - F.pmod(F.col("_t"), F.lit(B)))
    halo_cond = F.col("_t") > F.col("_b") + B - W
    copies = F.when(halo_cond, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    exploded = (base.withColumn("_halo", F.explode(copies))
                .withColumn("_b", F.col("_b") + F.col("_halo") * B))
    w = (Window.partitionBy(*key_cols, "_b").orderBy("_t").rangeBetween(-(W - 1), 0))
    counted = exploded.withColumn("attempts", F.count(F.lit(1)).over(w))
    return (counted.filter(F.col("_halo") == 0)
            .withColumn("allowed", F.col("attempts") <= limit)
            .drop("_t", "_b", "_halo"))


def running_sum(df: DataFrame, value: str, order_cols, bucket: str,
                part_cols=(), out: str = "running") -> DataFrame:
    """Exact running sum of ``value`` over ``part_cols`` ordered by ``order_cols``.

    ``bucket`` must be monotone in the order (e.g. the hour of the time). The
    only single-partition step is the prefix over bucket totals, a table with
    one row per (part, bucket).
    """
    part_cols = list(part_cols)
    totals = df.groupBy(*part_cols, bucket).agg(F.sum(value).alias("_bt"))
    wb = Window.partitionBy(*part_cols).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.withColumn("_base", F.coalesce(F.sum("_bt").over(wb), F.lit(0))).drop("_bt")
    wl = (Window.partitionBy(*part_cols, bucket).orderBy(*order_cols)
          .rowsBetween(Window.unboundedPreceding, 0))
    local = df.withColumn("_loc", F.sum(value).over(wl))
    keys = [*part_cols, bucket]
    bases = bases.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)], "_base")
    same = reduce(lambda a, b: a & b, [local[c].eqNullSafe(bases[f"_k{i}"]) for i, c in enumerate(keys)])
    return (local.join(bases, same).withColumn(out, F.col("_loc") + F.col("_base"))
            .drop("_loc", "_base", *[f"_k{i}" for i in range(len(keys))]))


def request_intervals(req: DataFrame, ts: str = "ts", duration: str = "value",
                      id_col: str = "event_id") -> DataFrame:
    """(id, start_us, end_us) with end = start + duration seconds (rounded to µs)."""
    start = micros(ts)
    return req.select(id_col, start.alias("start_us"),
                      (start + F.round(F.col(duration) * MICROS).cast("long")).alias("end_us"))


def concurrency_profile(req: DataFrame, bucket_seconds: int = 3600,
                        max_concurrent: int = L.MAX_CONCURRENT_REQUESTS,
                        ts: str = "ts", duration: str = "value",
                        id_col: str = "event_id") -> DataFrame:
    """Active requests after every start/end event, peak per time bucket.

    Intervals are half-open: at equal instants ends are applied before
    starts. Output per bucket with events: events, peak, over_limit and
    peak_waiting (requests that would queue behind the limit).
    """
    iv = request_intervals(req, ts, duration, id_col)
    ev = (iv.select(id_col, F.col("start_us").alias("_at"), F.lit(1).alias("_d"))
          .unionByName(iv.select(id_col, F.col("end_us").alias("_at"), F.lit(-1).alias("_d"))))
    bw = bucket_seconds * MICROS
    # the running count works in short buckets, so a busy reporting bucket is many tasks
    work = min(bucket_seconds, WORK_SECONDS) * MICROS
    ev = (ev.withColumn("_bucket", F.col("_at") - F.pmod(F.col("_at"), F.lit(bw)))
          .withColumn("_work", F.col("_at") - F.pmod(F.col("_at"), F.lit(work))))
    run = running_sum(ev, "_d", [F.col("_at"), F.col("_d"), F.col(id_col)], "_work", out="active")
    per = run.groupBy("_bucket").agg(F.count(F.lit(1)).alias("events"),
                                     F.max("active").alias("peak"))
    # as configured, requests above the limit wait in the queue (none is refused for load)
    return per.select(from_micros(F.col("_bucket")).alias("bucket_start"),
                      "events", F.col("peak").cast("long").alias("peak"),
                      (F.col("peak") > max_concurrent).alias("over_limit"),
                      F.greatest(F.col("peak") - max_concurrent, F.lit(0)).cast("long")
                      .alias("peak_waiting"))


def admission_rates(verdicts: DataFrame, group_cols=("day",), failed_col: str = "failed") -> DataFrame:
    """Requests, rejected, completed and the two rates (%, 2 decimals, 0 if none)."""
    agg = verdicts.groupBy(*group_cols).agg(
        F.count(F.lit(1)).alias("requests"),
        F.sum(F.when(~F.col("allowed"), 1).otherwise(0)).alias("rejected"),
        F.sum(F.when(F.col("allowed") & ~F.col(failed_col), 1).otherwise(0)).alias("completed"))
    return (agg.withColumn("reject_rate", pct2("rejected", "requests"))
               .withColumn("completion_rate", pct2("completed", "requests")))


def latency_profile(req: DataFrame, group_col: str = "event_type", duration: str = "value") -> DataFrame:
    """Per group count / mean / min / max / total seconds and share of all time."""
    g = req.groupBy(group_col).agg(
        F.count(F.lit(1)).alias("n"), F.avg(duration).alias("avg_s"),
        F.min(duration).alias("min_s"), F.max(duration).alias("max_s"),
        F.sum(duration).alias("total_s"))
    share = F.col("total_s") / F.sum("total_s").over(Window.partitionBy())  # one row per group
    return g.withColumn("share", share)


def latency_quantiles(req: DataFrame, group_col: str = "event_type", duration: str = "value",
                      accuracy: int = 10000) -> DataFrame:
    """A11 percentiles with bounded memory per group (``percentile_approx``)."""
    return req.groupBy(group_col).agg(
        F.percentile_approx(duration, [0.5, 0.9, 0.99], accuracy).alias("p50_p90_p99"))


#: Size of a quantile sketch; the rank of a quantile it gives is off by 0.35 % of the rows or less (99 % of the time).
SKETCH_K = 800


def latency_sketches(req: DataFrame, bucket_seconds: int = 3600, group_col: str = "event_type", duration: str = "value",
                     ts: str = "ts") -> DataFrame:
    """A11 percentiles, kept part: per group and time bucket the number of durations and their KLL sketch.

    A sketch has a few kilobytes whatever it saw, and sketches merge, so a
    stored table of them answers any range of buckets. Null durations are
    left out; a request without an instant is in the null bucket.
    """
    start = window_start(ts, bucket_seconds)
    return (req.where(F.col(duration).isNotNull()).groupBy(group_col, start.alias("bucket_start"))
            .agg(F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double(F.col(duration).cast("double"), SKETCH_K).alias("sketch")))


def merged_quantiles(sketches: DataFrame, quantiles=(0.5, 0.9, 0.99), group_col: str = "event_type") -> DataFrame:
    """A11 percentiles: (group, n, quantile, seconds) from the merged sketches of every group."""
    merged = sketches.groupBy(group_col).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("_s"))
    each = F.array(*[F.struct(F.lit(float(q)).alias("quantile"), F.kll_sketch_get_quantile_double("_s", F.lit(float(q))).alias("seconds"))
                     for q in quantiles])
    return merged.select(group_col, "n", F.inline(each))


def stage_shares(req: DataFrame, stages: dict[str, str], group_col: str = "event_type") -> DataFrame:
    """A11 by stage: (group, stage, requests, micros, share_pct) from columns of whole microseconds a request.

    ``stages`` maps stage names to columns. Shares are of the group's time,
    in percent with two decimals, from exact integers (0 if it spent none). A
    null duration counts as none.
    """
    per = req.groupBy(group_col).agg(F.count(F.lit(1)).alias("requests"),
                                     *[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(f"_us_{s}") for s, c in stages.items()])
    total = sum((F.col(f"_us_{s}") for s in stages), F.lit(0))
    pairs = F.explode(F.array(*[F.struct(F.lit(s).alias("stage"), F.col(f"_us_{s}").alias("micros")) for s in stages]))
    return (per.withColumn("_total", total).withColumn("_p", pairs)
            .select(group_col, "_p.stage", "requests", "_p.micros", pct2(F.col("_p.micros"), F.col("_total")).alias("share_pct")))


def detect_bots(req: DataFrame, ua: str = "user_agent", path: str = "path",
                method: str = "method", referer: str = "referer",
                block_empty: bool = True, check_referer: bool = False) -> DataFrame:
    """adds ``suspicious`` and ``bot_reason``.

    Order: empty UA -> whitelist (pass) -> suspicious substring -> optional
    POST to a non-root path without Referer.
    """
    u = F.lower(F.coalesce(F.col(ua), F.lit("")))
    white = None
    for w in L.WHITELISTED_USER_AGENTS:
        c = u.contains(w.lower())
        white = c if white is None else (white | c)
    sus = None
    for s in L.SUSPICIOUS_USER_AGENTS:
        c = u.contains(s.lower())
        sus = c if sus is None else (sus | c)
    chain = F.when(F.lit(block_empty) & (u == ""), F.lit(L.BOT_REASON_EMPTY_UA))
    chain = chain.when(white, F.lit(None).cast("string"))
    chain = chain.when(sus, F.lit(L.BOT_REASON_SUSPICIOUS_UA))
    if check_referer:
        chain = chain.when((F.col(path) != "/") & (F.col(method) == "POST")
                           & (F.coalesce(F.col(referer), F.lit("")) == ""),
                           F.lit(L.BOT_REASON_NO_REFERER))
    reason = chain.otherwise(F.lit(None).cast("string"))
    return req.withColumn("bot_reason", reason).withColumn("suspicious", F.col("bot_reason").isNotNull())
