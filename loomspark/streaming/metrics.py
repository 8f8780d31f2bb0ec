"""Structured Streaming over metric events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from ..operators.monitor import RULES, alerts, token_usage
from ..sources.shared import children, new_path, remove


def windowed(events: DataFrame, minutes: int = 5, late: str = "10 minutes") -> DataFrame:
    """Windowed statistics of a stream ``metric, ts, value``; rows later than the watermark are dropped.
    ``ts`` without a time zone is read in the session's."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    g = e.groupBy(F.window("ts", f"{minutes} minutes").alias("w"), "metric").agg(F.avg("value").alias("mean"), F.min("value").alias("least"), F.max("value").alias("most"), F.count("*").alias("n"))
    return g.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "metric", *(F.round(c, 6).alias(c) for c in ("mean", "least", "most")), "n")


def alert_stream(events: DataFrame, minutes: int = 5, rules=RULES) -> DataFrame:
    return alerts(windowed(events, minutes), rules)


STOPS = "stream string, stopped_at long, spent double"


def stop_stream(items: DataFrame, limit: float) -> DataFrame:
    """Online stop rule: ``items(stream, ord, cost)``; emits each stream once, at the item whose running cost
    reaches the limit. State is one number and a flag for each stream."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        spent, done = state.get if state.exists else (0.0, False)
        for f in frames:
            for o, c in f.sort_values("ord")[["ord", "cost"]].itertuples(index=False):
                if done:
                    break
                spent += float(c)
                if spent >= limit:
                    done = True
                    yield pd.DataFrame({"stream": [key[0]], "stopped_at": [int(o)], "spent": [spent]})
        state.update((spent, done))

    return items.groupBy("stream").applyInPandasWithState(step, STOPS, "spent double, done boolean", "append", GroupStateTimeout.NoTimeout)


def report(df: DataFrame, path: str, checkpoint: str, keep: int = 2, **trigger) -> StreamingQuery:
    """Starts a running report: all rows of ``df`` after each batch, under ``path/batch=<number>``.

    A batch that is run again replaces its own folder, so a restart counts nothing twice. The last ``keep`` reports
    stay. The trigger is ``availableNow=True`` unless given (``processingTime="60 seconds"`` and the like).
    """
    spark = df.sparkSession

    def put(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")
        remove(spark, f"{path}/batch={batch - keep}")

    return df.writeStream.outputMode("complete").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def latest(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """The last whole report; without any, an empty frame of ``schema``."""
    done = [n for n in children(spark, path) if n.startswith("batch=") and "_SUCCESS" in children(spark, f"{path}/{n}")]
    if not done:
        if schema is None:
            raise FileNotFoundError(f"no report in {path}")
        return spark.createDataFrame([], schema)
    return spark.read.parquet(f"{path}/{max(done, key=lambda n: int(n[6:]))}")


def reported(df: DataFrame) -> DataFrame:
    """The report of all that is there now, from the shared folder."""
    spark, path = df.sparkSession, new_path(df.sparkSession)
    report(df, path, f"{path}-state").awaitTermination()
    return latest(spark, path, df.schema)


def appended(df: DataFrame) -> DataFrame:
    """The rows that a stream in append mode gives for all that is there now, from files in the shared folder."""
    spark, path = df.sparkSession, new_path(df.sparkSession)
    df.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}-state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(path)


def token_report(usage: DataFrame, path: str, checkpoint: str, **how) -> StreamingQuery:
    """A running report of tokens by model and in all, over a stream of usage rows; see ``monitor.token_usage``."""
    return report(token_usage(usage), path, checkpoint, **how)


def run_once(df: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """Runs a streaming frame over what is there now into a memory table, and returns that."""
    w = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    (w.option("checkpointLocation", checkpoint) if checkpoint else w).start().awaitTermination()
    return df.sparkSession.table(name)
