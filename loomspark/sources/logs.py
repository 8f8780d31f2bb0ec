"""Logs of a run as JSON lines: metric events, appended rows, exports of metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .readers import BAD

#: fields of a metric line; others are not read
METRIC_LINE = "metric string, value double, timestamp string, model_name string, prompt_tokens long, completion_tokens long, total_tokens long"
METRICS = ("json", "csv", "parquet")


def _metrics(lines: DataFrame) -> DataFrame:
    """Lines to ``metric, ts, value, model`` and token counts; lines that are no JSON, or name no metric, are dropped."""
    read = F.from_json("value", f"{METRIC_LINE}, {BAD} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD})
    x = lines.select(read.alias("x")).where(f"x.{BAD} IS NULL AND x.metric IS NOT NULL").select("x.*")
    return x.select("metric", F.try_to_timestamp("timestamp").cast("timestamp_ntz").alias("ts"), "value", F.col("model_name").alias("model"), "prompt_tokens", "completion_tokens", "total_tokens")


def metric_lines(spark: SparkSession, path: str) -> DataFrame:
    """Metric events of JSON-line files."""
    return _metrics(spark.read.text(path).select("value"))


def metric_line_stream(spark: SparkSession, path: str, files_at_once: int | None = None) -> DataFrame:
    """The same as a stream: files that appear in the folder are read once each."""
    reader = spark.readStream.format("text")
    return _metrics((reader.option("maxFilesPerTrigger", files_at_once) if files_at_once else reader).load(path).select("value"))


def as_lines(metrics: DataFrame) -> DataFrame:
    """``value``: metric rows (``metric, ts, value, model``, token counts if any) as lines of a log."""
    names = {"ts": "timestamp", "model": "model_name"}
    fields = [F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp") if c == "ts" else F.col(c).alias(names.get(c, c)) for c in metrics.columns]
    return metrics.select(F.to_json(F.struct(*fields)).alias("value"))


def append_lines(rows: DataFrame, path: str) -> None:
    """Adds rows as JSON lines; Spark commits the files of a job together, so a failed write adds nothing."""
    rows.write.mode("append").option("ignoreNullFields", "false").json(path)


def export_metrics(metrics: DataFrame, path: str, kind: str = "json", since: str | None = None) -> None:
    """All metrics of one scan to a folder each (``metric=<name>``), as JSON lines, CSV with a header, or Parquet; with
    ``since`` only events from that time on, which the scan filters. Folders of metrics without such events stay."""
    if kind not in METRICS:
        raise ValueError(f"unknown kind {kind!r}; known: {', '.join(METRICS)}")
    rows = metrics.where(F.col("ts") >= F.lit(since).cast("timestamp_ntz")) if since else metrics
    out = rows.repartition("metric", F.pmod(F.xxhash64("ts", "value"), F.lit(8)))  # few files a folder, no task for a whole metric
    w = out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("metric")
    (w.option("header", True) if kind == "csv" else w).format(kind).save(path)


def append_counted(rows: DataFrame, path: str) -> int:
    """As ``append_lines``; gives the number of rows, counted in the job that writes them."""
    seen = Observation("appended")
    append_lines(rows.observe(seen, F.count(F.lit(1)).alias("n")), path)
    return seen.get["n"]


#: what a skill store keeps of each context
SKILL_LOGS = ("probes", "results", "versions")


def append_skill_log(rows: DataFrame, root: str, kind: str) -> None:
    """Adds ``rows(context_id, ord, ...)`` to a log of a skill store, in a folder for each context (``context_id=<id>``);
    rows without a context are an error of the job."""
    if kind not in SKILL_LOGS:
        raise ValueError(f"unknown log {kind!r}; known: {', '.join(SKILL_LOGS)}")
    checked = rows.withColumn("context_id", F.coalesce(F.col("context_id").cast("string"), F.raise_error(F.lit("a skill log row without context_id")).cast("string")))
    checked.write.mode("append").partitionBy("context_id").option("ignoreNullFields", "false").json(f"{root}/{kind}")


def skill_log(spark: SparkSession, root: str, kind: str, schema: str, key: str | None = None) -> DataFrame:
    """A log of a skill store; with ``key`` the last row by ``ord`` of each context and key."""
    df = spark.read.schema(f"{schema}, context_id string").json(f"{root}/{kind}")
    if not key:
        return df
    last = df.groupBy("context_id", key).agg(F.max_by(F.struct("*"), "ord").alias("x"))
    return last.select("x.*")
