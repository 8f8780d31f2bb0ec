"""Export of conversation files to training formats, with counters: one scan, whatever the number of formats.

Each line becomes one row that holds its output rows of every format. The counters are observed on these rows in the
job that writes them, so nothing is read twice and nothing is collected; the rows are then dealt to a folder for each
format (``format=<name>``).
"""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..sources.readers import BAD, CONVERSATION
from ..sources.shared import remove
from . import export

#: what the counters say if no pair could be made: fixed texts
NO_SCORES = "DPO export requires quality scores. Re-generate with quality.auto_improve: true"
NO_PAIRS = "No instruction pairs found for DPO. Need multiple responses per prompt."
ROWWISE = ("agent_dpo", "agent_sft", "alpaca", "alpaca_split", "llama_factory", "messages", "openai", "oumi", "raw", "sharegpt")


@dataclass(frozen=True)
class Counts:
    """Of one format: lines read, rows written, lines that gave no row, lines that are no JSON, warnings."""

    format: str
    input: int
    output: int
    skipped: int
    malformed: int
    warnings: int
    note: str = ""


def parsed(lines: DataFrame) -> DataFrame:
    """``lines(value)`` -> the fields of a conversation, ``__line`` and ``__bad`` (true for what is no JSON object).

    Blank lines do not count. A missing content is an empty text, missing conversations are none.
    """
    text = lines.where(F.trim("value") != "").select(F.trim("value").alias("__line"))
    read = F.from_json("__line", f"{CONVERSATION}, {BAD} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD})
    turns = F.transform("x.conversations", lambda t: F.struct(F.coalesce(t["role"], F.lit("")).alias("role"), F.coalesce(t["content"], F.lit("")).alias("content")))
    out = text.select("__line", read.alias("x")).withColumn("__bad", F.col("x").isNull() | F.col(f"x.{BAD}").isNotNull())
    return out.select("__line", "__bad", F.coalesce(turns, F.array().cast("array<struct<role:string,content:string>>")).alias("conversations"), "x.instruction_context", "x.response_context", "x.final_score", F.col("x.metadata")["trajectory_id"].alias("trajectory_id"))


def _written_rows(rows: DataFrame, name: str, system: str | None) -> Column:
    """Output rows of one line as JSON; nulls are written."""
    if name == "raw":
        made = F.array("__line")
    else:
        made = F.transform(export.output_rows(rows, name, system), lambda x: F.to_json(x, {"ignoreNullFields": "false"}))
    return F.when(~F.col("__bad"), made).otherwise(F.array().cast("array<string>"))


def export_lines(lines: DataFrame, path: str, formats: tuple[str, ...] = ROWWISE, system: str | None = None) -> list[Counts]:
    """Writes ``lines(value)`` (JSON conversations) under ``path`` in every one of ``formats``; see ``Counts``.

    Only the folders of these formats are replaced, also by nothing. All formats that work line by line share one scan;
    ``dpo`` compares conversations and takes a scan and a shuffle of its own.
    """
    known = {*ROWWISE, "dpo"}
    if unknown := sorted({*formats} - known) or not formats:
        raise ValueError(f"unknown formats {unknown}; known: {', '.join(sorted(known))}")
    formats = tuple(dict.fromkeys(formats))
    single = [f for f in formats if f != "dpo"]
    found: dict[str, Counts] = {}
    if single:
        rows = parsed(lines)
        made = rows.select("__bad", *(_written_rows(rows, f, system).alias(f) for f in single))
        seen = Observation("export")
        counters = [F.count(F.lit(1)).alias("input"), F.count_if("__bad").alias("malformed")]
        for f in single:
            counters += [F.coalesce(F.sum(F.size(f)), F.lit(0)).alias(f"output_{f}"), F.count_if(F.size(f) == 0).alias(f"skipped_{f}")]
        tagged = made.observe(seen, *counters).select(F.explode(F.array(*(F.struct(F.lit(f).alias("format"), F.col(f).alias("rows")) for f in single))).alias("x"))
        _write(tagged.select("x.format", F.explode("x.rows").alias("value")), path)
        n = seen.get
        found = {f: Counts(f, n["input"], n[f"output_{f}"], n[f"skipped_{f}"], n["malformed"], n["malformed"]) for f in single}
    if "dpo" in formats:
        found["dpo"] = _export_pairs(lines, path, system)
    for f, c in found.items():
        if not c.output:  # a dynamic overwrite leaves the folder of what has no row
            remove(lines.sparkSession, f"{path}/format={f}")
    return [found[f] for f in formats]


def _export_pairs(lines: DataFrame, path: str, system: str | None) -> Counts:
    before, after = Observation("pairs read"), Observation("pairs written")
    unusable = F.col("__bad") | F.col("final_score").isNull() | (F.size("conversations") < 2)
    counters = [F.count(F.lit(1)).alias("input"), F.count_if("__bad").alias("malformed"), F.count_if(unusable).alias("skipped"), F.count("final_score").alias("scored")]
    rows = parsed(lines).observe(before, *counters).where(~F.col("__bad")).withColumn("conv_id", F.monotonically_increasing_id())
    pairs = export.dpo(rows, system=system).select(F.lit("dpo").alias("format"), F.to_json(F.struct("prompt", "chosen", "rejected")).alias("value"))
    _write(pairs.observe(after, F.count(F.lit(1)).alias("output")), path)
    n, output = before.get, after.get["output"]
    note = NO_SCORES if not n["scored"] else NO_PAIRS if not output else ""
    return Counts("dpo", n["input"], output, n["skipped"], n["malformed"], int(bool(note)), note)


def _write(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("format").text(path)


def export_files(spark: SparkSession, source: str, path: str, formats: tuple[str, ...] = ROWWISE, system: str | None = None) -> list[Counts]:
    """``export_lines`` of JSON-line files."""
    return export_lines(spark.read.text(source).select("value"), path, formats, system)


def as_table(spark: SparkSession, counts: list[Counts]) -> DataFrame:
    """A row for each format."""
    return spark.createDataFrame([asdict(c) for c in counts], "format string, input long, output long, skipped long, malformed long, warnings long, note string")
