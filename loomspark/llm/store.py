"""Written tables that cut lineage, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a temporary folder only where it is unset and the master is local (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        path = spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="loomspark-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """The same rows, read back from a Parquet table in the shared folder."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loomspark-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def buckets(spark: SparkSession) -> int:
    """How many parts packed exchanges use at least: the session's shuffle partitions."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


ROW = "__row"


def held(df: DataFrame, *keys: Column) -> DataFrame:
    """All columns of ``df`` as one struct ROW beside ``keys``, so that no name of theirs can clash; see ``let_go``."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(ROW), *keys)


def let_go(df: DataFrame) -> DataFrame:
    """The columns that ``held`` put away."""
    return df.select(f"{ROW}.*")


def join_small(df: DataFrame, small: DataFrame, on, how: str, most: int = 50_000) -> DataFrame:
    """Broadcast ``small`` only if it has been counted to hold at most ``most`` rows; else a shuffled join,
    whose hot keys adaptive execution splits."""
    small = written(small)
    return df.join(F.broadcast(small) if small.limit(most + 1).count() <= most else small, on, how)
