"""Metrics of a generation run: ``metrics(metric, ts, value, model, event_id)``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.order import rolling_mean

#: metric, operator, limit, level
RULES = (
    ("success_rate", "<", 0.8, "warning"),
    ("generation_time", ">", 30.0, "warning"),
    ("error_rate", ">", 0.2, "error"),
    ("prompt_tokens", ">", 4096.0, "info"),
    ("completion_tokens", ">", 4096.0, "info"),
    ("total_tokens", ">", 8192.0, "warning"),
    ("conversation_length", ">", 2.0, "info"),
)


def trailing(metrics: DataFrame, as_of: str, minutes: int = 5) -> DataFrame:
    """Mean, least, most and count of each metric in the minutes up to ``as_of``."""
    t = F.lit(as_of).cast("timestamp_ntz")
    m = metrics.where((F.col("ts") >= t - F.expr(f"INTERVAL {minutes} MINUTES")) & (F.col("ts") <= t))
    return m.groupBy("metric").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.min("value"), 6).alias("least"), F.round(F.max("value"), 6).alias("most"), F.count("*").alias("n"))


def windows(metrics: DataFrame, minutes: int = 5) -> DataFrame:
    """The same in fixed windows; the batch form of the stream."""
    w = F.window(F.col("ts").cast("timestamp"), f"{minutes} minutes")
    return metrics.groupBy(w.alias("w"), "metric").agg(F.avg("value").alias("mean"), F.min("value").alias("least"), F.max("value").alias("most"), F.count("*").alias("n")).select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "metric", F.round("mean", 6).alias("mean"), F.round("least", 6).alias("least"), F.round("most", 6).alias("most"), "n")


def alerts(stats: DataFrame, rules=RULES) -> DataFrame:
    """Rows of ``trailing`` or ``windows`` that break a rule; a metric without events breaks none."""
    hit = F.lit(False)
    level = F.lit(None).cast("string")
    for name, op, limit, what in rules:
        here = (F.col("metric") == name) & ((F.col("mean") < limit) if op == "<" else (F.col("mean") > limit))
        hit = hit | here
        level = F.when(here, F.lit(what)).otherwise(level)
    return stats.where(hit).withColumn("level", level)


def rolling(metrics: DataFrame, events: int = 10) -> DataFrame:
    """Mean of the last events of a metric, at each event; fewer at its start."""
    m = rolling_mean(metrics.select("event_id", "metric", "model", "ts", "value"), ["metric", "model"], ["ts", "event_id"], "value", events, "rolling")
    return m.select("event_id", "metric", "model", F.round("rolling", 6).alias("rolling"))


def token_usage(usage: DataFrame) -> DataFrame:
    """Token sums by model (null: ``unknown``) and in all (``model`` null), from one pass."""
    u = usage.withColumn("model", F.coalesce("model", F.lit("unknown")))
    s = [F.sum(F.col(c).cast("long")).alias(c) for c in ("prompt_tokens", "completion_tokens", "total_tokens")]
    return u.rollup("model").agg(*s, F.grouping("model").cast("long").alias("is_total"))


def fan_out(events: DataFrame) -> DataFrame:
    """A generation event as metric rows: time, success, error if any, model use and tokens."""
    pair = lambda m, v: F.struct(F.lit(m).alias("metric"), v.cast("double").alias("value"))
    rows = F.array_compact(
        F.array(
            pair("generation_time", F.col("duration")), pair("success_rate", F.col("success").cast("int")),
            F.when(F.col("error").isNotNull(), pair("error_rate", F.lit(1.0))), F.struct(F.concat(F.lit("model_usage:"), F.coalesce("model", F.lit("unknown"))).alias("metric"), F.lit(1.0).alias("value")),
            F.when(F.col("prompt_tokens").isNotNull(), pair("prompt_tokens", F.col("prompt_tokens"))), F.when(F.col("completion_tokens").isNotNull(), pair("completion_tokens", F.col("completion_tokens"))),
        )
    )
    return events.select("event_id", "ts", "model", F.explode(rows).alias("m")).select("event_id", "ts", "model", "m.*")
