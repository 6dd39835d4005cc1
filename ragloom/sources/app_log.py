"""Application log source (S15) and log filters.

Line format: ``YYYY-MM-DD HH:mm:ss | LEVEL    | Thread-<id> | name:function:line - message``;
performance messages read ``Performance: <op> took <d>s | k=v, k=v``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LINE_RE = (r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}) \| (\S+)\s*\| Thread-(\d+) \| "
           r"([^:]*):([^:]*):(\d+) - (.*)$")
PERF_RE = r"^Performance: (.+?) took ([0-9.]+)s(?: \| (.*))?$"
LEVELS = ["TRACE", "DEBUG", "INFO", "SUCCESS", "WARNING", "ERROR", "CRITICAL"]


def parse_app_log(spark: SparkSession, path: str) -> DataFrame:
    """(ts, level, thread, logger, function, line, message, op, seconds, fields)."""
    raw = spark.read.text(path)
    g = lambda i: F.regexp_extract("value", LINE_RE, i)
    parsed = raw.select(
        F.to_timestamp(g(1), "yyyy-MM-dd HH:mm:ss").alias("ts"), g(2).alias("level"),
        g(3).try_cast("long").alias("thread"), g(4).alias("logger"), g(5).alias("function"),
        g(6).try_cast("int").alias("line"), g(7).alias("message"),
        F.col("value").rlike(LINE_RE).alias("_ok"))
    perf = F.col("message").rlike(PERF_RE)
    return (parsed.filter("_ok").drop("_ok")
            .withColumn("op", F.when(perf, F.regexp_extract("message", PERF_RE, 1)))
            .withColumn("seconds", F.when(perf, F.regexp_extract("message", PERF_RE, 2).try_cast("double")))
            .withColumn("fields", F.when(perf & (F.regexp_extract("message", PERF_RE, 3) != ""),
                                         F.str_to_map(F.regexp_extract("message", PERF_RE, 3),
                                                      F.lit(", "), F.lit("=")))))


def error_log_lines(log: DataFrame) -> DataFrame:
    """records at ERROR level or above."""
    return log.filter(F.col("level").isin("ERROR", "CRITICAL"))


def access_log_lines(log: DataFrame) -> DataFrame:
    """access records (written through the access logger)."""
    return log.filter(F.col("logger").contains("access") | F.col("message").startswith("ACCESS"))


def performance_profile(log: DataFrame) -> DataFrame:
    """A11 over the log: per operation count, mean and max seconds."""
    return (log.filter(F.col("op").isNotNull()).groupBy("op")
            .agg(F.count(F.lit(1)).alias("n"), F.avg("seconds").alias("avg_s"), F.max("seconds").alias("max_s")))
