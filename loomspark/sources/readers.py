"""Readers of conversations, documents and tables; sinks are Spark's own writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import json as J
from ..functions.text import chunks, strip

BAD = "__malformed"
CONVERSATION = (
    "conversations array<struct<role:string,content:string,reasoning_content:string>>, metadata map<string,string>, instruction_context string, "
    "response_context string, persona string, evaluation string, final_score double"
)


def conversation_jsonl(spark: SparkSession, path: str, limit: int = 0, offset: int = 0) -> DataFrame:
    """Conversations of JSON lines in file order (``row_ord``); a malformed line fails; limit 0 is no limit."""
    df = spark.read.schema(CONVERSATION).json(path, mode="FAILFAST")
    if limit or offset:  # splits of a file are numbered in the order of their starts only within the file
        at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("id"))
        df = df.withColumn("row_ord", at).orderBy("row_ord")
        df = df.offset(offset) if offset else df
        df = df.limit(limit) if limit else df
    return df


def lenient_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines without blank and malformed ones; ``conversation_jsonl`` fails on these instead."""
    t = spark.read.text(path).where(F.trim("value") != "")
    read = F.from_json("value", f"{schema}, {BAD} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD})
    return t.select(read.alias("x")).where(f"x.{BAD} IS NULL").select("x.*").drop(BAD)


def numbered_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """``file, line, value`` of all lines of text files, lines numbered from 1 in each file.

    Large files are read in splits, each by one task in order. Lines are counted by split, and a line's number is its
    place in the split and the counts of the splits before: nothing is sorted, and only the counts are shuffled.
    """
    t = spark.read.text(list(paths)).select("value", F.regexp_replace("_metadata.file_path", "^file:(//)?(?=/)", "").alias("file"), F.col("_metadata.file_block_start").alias("__start"), F.monotonically_increasing_id().alias("__at"))
    splits = t.groupBy("file", "__start").agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    before = Window.partitionBy("file").orderBy("__start").rowsBetween(Window.unboundedPreceding, -1)  # a row for each split
    splits = splits.select("file", "__start", (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")).alias("__shift"))
    return t.join(splits, ["file", "__start"]).select("file", (F.col("__at") + F.col("__shift") + 1).alias("line"), "value")


def malformed_lines(lines: DataFrame) -> DataFrame:
    """Of ``numbered_lines`` those that are neither blank nor a JSON object."""
    kind = F.schema_of_variant(J.parsed(F.col("value")))
    return lines.where((F.trim("value") != "") & ~F.coalesce(kind.startswith("OBJECT"), F.lit(False)))


def documents_of_lines(lines: DataFrame, content_key: str = "text", preserve_ids: bool = False, include_metadata: bool = False) -> DataFrame:
    """``file, line, doc_id, text`` (and ``metadata map<string,string>``) of ``numbered_lines`` of JSON: texts are stripped; lines
    that are no object, or whose content is no text or a blank one, give nothing. The id is ``file:line``, or with
    ``preserve_ids`` the line's ``id``, else its ``metadata.context_id``, if there is one. Metadata are the fields of
    ``metadata``, then all other fields but these; nested ones stay JSON."""
    v = lines.withColumn("__v", J.parsed(F.col("value"))).where(J.is_string(F.try_variant_get("__v", J.path_of(f'"{content_key}"'), "variant")))
    own = F.concat_ws(":", "file", "line")
    named = [F.nullif(F.try_variant_get("__v", p, "string"), F.lit("")) for p in ("$.id", "$.metadata.context_id")] if preserve_ids else []
    columns = ["file", "line", F.coalesce(*named, own).alias("doc_id"), strip(F.try_variant_get("__v", J.path_of(f'"{content_key}"'), "string")).alias("text")]
    if include_metadata:
        every = F.from_json("value", "map<string,string>")
        told = F.coalesce(F.from_json(F.to_json(F.try_variant_get("__v", "$.metadata", "variant")), "map<string,string>"), F.create_map().cast("map<string,string>"))
        rest = F.map_filter(every, lambda k, _: ~k.isin(content_key, "id", "metadata") & ~F.map_contains_key(told, k))
        columns.append(F.map_concat(told, rest).alias("metadata"))
    return v.select(*columns).where("text <> ''")


def document_jsonl(spark: SparkSession, *paths: str, content_key: str = "text", preserve_ids: bool = True, include_metadata: bool = False, most: int = 0) -> DataFrame:
    """Documents of JSON-line files (see ``documents_of_lines``); with ``most`` the first ones by file and line."""
    out = documents_of_lines(numbered_lines(spark, *paths), content_key, preserve_ids, include_metadata)
    return (out.orderBy("file", "line").limit(most) if most else out).drop("file", "line")


def merge_lines(spark: SparkSession, paths: list[str], path: str) -> DataFrame:
    """Writes the lines of several files as one dataset, file after file in the given order, blank lines left out, and
    gives it back with the schemas of all merged."""
    rows = None
    for i, p in enumerate(paths):
        part = numbered_lines(spark, p).where(F.trim("value") != "").withColumn("__source", F.lit(i))
        rows = part if rows is None else rows.union(part)
    rows.orderBy("__source", "file", "line").select("value").write.mode("overwrite").text(path)
    return spark.read.json(path)


def text_files(spark: SparkSession, path: str, patterns: tuple[str, ...] = ("*.txt", "*.md"), min_length: int = 1) -> DataFrame:
    """Whole files as documents; a file that two patterns match appears twice; nothing left is an error."""
    out = None
    for p in patterns:
        t = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", p).text(path, wholetext=True)
        t = t.select(F.col("_metadata.file_path").alias("doc_id"), strip(F.col("value")).alias("text")).where(F.length("text") >= min_length)
        out = t if out is None else out.unionByName(t)
    return out


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """A document a line that is not blank."""
    return spark.read.text(path).select(strip(F.col("value")).alias("text")).where("text <> ''")


def delimited(spark: SparkSession, path: str, column: str, sep: str = ",") -> DataFrame:
    df = spark.read.option("header", True).option("multiLine", True).csv(path, sep=sep)
    if column not in df.columns:
        raise ValueError(f"no column {column!r}; there are {', '.join(df.columns)}")
    return df.select(F.col(column).alias("text")).where(F.col("text").isNotNull())


def chunked(docs: DataFrame, size: int = 5000, overlap: int = 0) -> DataFrame:
    """``doc_id, chunk, text``: pieces of fixed size; blank ones are dropped, the rest stripped if they overlap."""
    c = docs.select("doc_id", F.posexplode(chunks(F.col("text"), size, overlap)).alias("chunk", "text"))
    if overlap:
        c = c.withColumn("text", strip(F.col("text"))).where("text <> ''")
    return c.select("doc_id", F.col("chunk").cast("long").alias("chunk"), "text")


def page(df: DataFrame, equal: dict | None = None, order: list[tuple[str, int]] | None = None, limit: int = 0, offset: int = 0) -> DataFrame:
    """Equality filters, a multi-key order (+1 or -1), and a page; ``metadata.key`` is a path into the JSON in ``metadata`` (see
    ``functions.json.path_of``), whose value counts as a text."""
    for k, v in (equal or {}).items():
        c = J.at_path(F.col("metadata"), k[9:]) if k.startswith("metadata.") else F.col(k)
        df = df.where(c == (str(v).lower() if isinstance(v, bool) and k.startswith("metadata.") else str(v) if k.startswith("metadata.") else v))
    if order:
        df = df.orderBy(*[F.desc(c) if s < 0 else F.asc(c) for c, s in order])
    df = df.offset(offset) if offset else df
    return df.limit(limit) if limit else df


def page_with_total(df: DataFrame, equal: dict | None = None, order: list[tuple[str, int]] | None = None, limit: int = 0, offset: int = 0) -> DataFrame:
    """As ``page``, with ``total``: how many rows the page is cut from."""
    total = page(df, equal).agg(F.count("*").alias("total"))
    return page(df, equal, order, limit, offset).join(F.broadcast(total))  # one row


def documents_of(spark: SparkSession, texts: list[str] | dict[str, str]) -> DataFrame:
    """``doc_id, text`` of texts in memory, numbered unless they are named; a stated small set."""
    named = texts.items() if isinstance(texts, dict) else ((str(i), t) for i, t in enumerate(texts))
    return spark.createDataFrame(list(named), "doc_id string, text string")


def messages_as_document(turns: DataFrame) -> DataFrame:
    """A conversation as one text; blank messages are skipped but still counted in the numbering."""
    m = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    parts = F.filter(F.transform("t", lambda x, i: F.when(F.trim(x["text"]) != "", F.concat(F.lit("## Message "), (i + 1).cast("string"), F.lit(": "), x["role"], F.lit("\n\n"), x["text"]))), lambda x: x.isNotNull())
    return m.select("conv_id", F.array_join(parts, "\n\n---\n\n").alias("text"))


def indexed(vectors: DataFrame, dim: int, most_chars: int = 120_000) -> DataFrame:
    """Rows for a vector store: blank texts and wrong sizes dropped, long texts cut as the store demands."""
    return vectors.where((F.trim("text") != "") & (F.size("vector") == dim)).withColumn("text", F.substring("text", 1, most_chars))
