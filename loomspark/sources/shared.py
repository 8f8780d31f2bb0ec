"""Tables written in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_paths: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder serves only where that is unset and the master is local."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="loomspark-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def new_path(spark: SparkSession) -> str:
    """A path in the shared folder that nothing uses yet."""
    _paths.append(path := f"{shared_dir(spark)}/loomspark-{uuid.uuid4().hex}")
    return path


def clear(spark: SparkSession) -> int:
    """Deletes all tables that this process has written in the shared folder, and gives their number. Frames that were
    made from them can no longer be read: call it once their results are stored."""
    n = len(_paths)
    while _paths:
        for end in ("", "-state", "-log"):
            remove(spark, _paths[-1] + end)
        _paths.pop()
    return n


def written(df: DataFrame) -> DataFrame:
    """The same rows, read back from a Parquet table in the shared folder."""
    path = new_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a file or folder if it is there, by Hadoop's own client."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder; none if it is not there."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []
