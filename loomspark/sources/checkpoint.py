"""Checkpoints of a run: tables and small texts in one folder, with a digest of every file.

A save writes a version of its own (``version=<n>``): first the tables, then the manifest, one JSON row for each file
with its size and SHA-256, which is what makes the version count. So a save that breaks off leaves nothing that is
read, and what an earlier save held beside it cannot come back. Digests are worked out by the executors, file by file.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.taxonomy import invalid_nodes
from .shared import children, remove

PRODUCER, FORMAT, SUPPORTED = "loomspark", "checkpoint", ("1.0",)
MANIFEST = "kind string, producer string, format string, format_version string, created_at string, name string, path string, length long, sha256 string, body string"
#: Largest file: binary files are read whole by a task.
ROWS_A_FILE = 200_000


class CheckpointError(ValueError):
    """A checkpoint that is not what its manifest says, or that this code cannot read."""


@dataclass
class Checkpoint:
    version: int
    created_at: str
    tables: dict[str, DataFrame]
    texts: dict[str, str] = field(default_factory=dict)


def versions(spark: SparkSession, root: str) -> list[int]:
    """Numbers of all versions that were begun, whole or not."""
    return sorted(int(m[1]) for m in (re.fullmatch(r"version=(\d+)", c) for c in children(spark, root)) if m)


def _whole(spark: SparkSession, root: str, version: int) -> bool:
    return "_SUCCESS" in children(spark, f"{root}/version={version}/manifest")


def _digests(spark: SparkSession, folder: str) -> DataFrame:
    """``path, length, sha256`` of all data files below a folder, paths from there."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "part-*").load(folder)
    # whatever scheme and authority the store writes in front, a path goes on after the version's data folder
    short = F.regexp_extract("path", r"/version=\d+/data/(.*)$", 1)
    return files.select(short.alias("path"), "length", F.sha2("content", 256).alias("sha256"))


def _check_tree(nodes: DataFrame) -> None:
    bad = invalid_nodes(nodes).limit(5).collect()
    if bad:
        raise CheckpointError("the taxonomy is no tree: " + "; ".join(f"{r.factor_id}/{r.node_id}: {r.problem}" for r in bad))


def save(spark: SparkSession, root: str, tables: dict[str, DataFrame], texts: dict[str, str] | None = None, keep: int = 2, taxonomy: str | None = "taxonomy") -> int:
    """Writes ``tables`` and ``texts`` as a new version and gives its number; of older versions ``keep - 1`` whole ones
    stay. The table named ``taxonomy``, if there is one, has to be a tree."""
    if not tables or not all(re.fullmatch(r"\w+", n) for n in tables):
        raise ValueError("a checkpoint needs at least one table, named by letters and digits")
    if taxonomy in tables:
        _check_tree(tables[taxonomy])
    version = max([0, *versions(spark, root)]) + 1
    here = f"{root}/version={version}"
    for name, df in tables.items():
        df.write.mode("overwrite").option("maxRecordsPerFile", ROWS_A_FILE).parquet(f"{here}/data/{name}")
    same = {"kind": "file", **dict.fromkeys(("producer", "format", "format_version", "created_at", "body"))}
    files = _digests(spark, f"{here}/data").withColumn("name", F.substring_index("path", "/", 1)).withColumns({k: F.lit(v).cast("string") for k, v in same.items()})
    head = spark.range(1).select(F.lit("header").alias("kind"), F.lit(PRODUCER).alias("producer"), F.lit(FORMAT).alias("format"), F.lit(SUPPORTED[-1]).alias("format_version"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("created_at"))
    rows = head.unionByName(files, allowMissingColumns=True)
    if texts:
        said = spark.createDataFrame([("text", k, v) for k, v in texts.items()], "kind string, name string, body string")
        rows = rows.unionByName(said.withColumn("sha256", F.sha2("body", 256)), allowMissingColumns=True)
    rows.coalesce(1).write.mode("overwrite").json(f"{here}/manifest")  # a row for each file; its _SUCCESS comes last
    whole = [v for v in versions(spark, root) if _whole(spark, root, v)]
    for old in versions(spark, root):
        if old < version and old not in whole[-max(keep, 1) :]:
            remove(spark, f"{root}/version={old}")
    return version


def differences(spark: SparkSession, root: str, version: int) -> DataFrame:
    """``path, problem`` of files that are missing, changed, or not in the manifest; a join, nothing is collected."""
    here = f"{root}/version={version}"
    told = spark.read.schema(MANIFEST).json(f"{here}/manifest").where("kind = 'file'").select("path", "length", "sha256")
    both = told.alias("t").join(_digests(spark, f"{here}/data").alias("f"), "path", "full")
    problem = F.when(F.col("f.sha256").isNull(), "missing").when(F.col("t.sha256").isNull(), "not in the manifest").when((F.col("t.sha256") != F.col("f.sha256")) | (F.col("t.length") != F.col("f.length")), "digest mismatch")
    return both.select("path", problem.alias("problem")).where("problem IS NOT NULL")


def load(spark: SparkSession, root: str, version: int | None = None, verify: bool = True, taxonomy: str | None = "taxonomy") -> Checkpoint:
    """The last whole version, or the one asked for, after its digests and its taxonomy were checked."""
    known = [v for v in versions(spark, root) if _whole(spark, root, v)]
    if not known or version is not None and version not in known:
        raise FileNotFoundError(f"no checkpoint with a manifest in {root}" + (f" of version {version}" if version is not None else ""))
    version = known[-1] if version is None else version
    here = f"{root}/version={version}"
    manifest = spark.read.schema(MANIFEST).json(f"{here}/manifest")
    head = manifest.where("kind = 'header'").first()
    if head is None or (head.producer, head.format) != (PRODUCER, FORMAT):
        raise CheckpointError(f"unexpected producer or format: {head and (head.producer, head.format)}")
    if head.format_version not in SUPPORTED:
        raise CheckpointError(f"unsupported format_version {head.format_version!r}; supported: {', '.join(SUPPORTED)}")
    if verify:
        bad = differences(spark, root, version).limit(5).collect()
        if bad:
            raise CheckpointError("; ".join(f"{r.path}: {r.problem}" for r in bad))
        if changed := [r.name for r in manifest.where("kind = 'text' AND sha2(body, 256) <> sha256").select("name").limit(5).collect()]:
            raise CheckpointError(f"digest mismatch of the texts {', '.join(changed)}")
    names = [r.name for r in manifest.where("kind = 'file'").select("name").distinct().collect()]  # one for each table
    tables = {n: spark.read.parquet(f"{here}/data/{n}") for n in sorted(names)}
    if verify and taxonomy in tables:
        _check_tree(tables[taxonomy])
    return Checkpoint(version, head.created_at, tables, {r.name: r.body for r in manifest.where("kind = 'text'").collect()})
