"""The corpus pipeline: quality rules, near-duplicate removal, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``documents``. A stage works on all that its predecessor kept. Columns of any name, and in any case, stay as they
are; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm.decontaminate import drop_leaks
from loomspark.llm.jaccard import jaccard_join
from loomspark.llm.mixing import sample
from loomspark.llm.quality import keep_good
from loomspark.llm.sharding import place
from loomspark.llm.store import held, join_small, let_go, written
from loomspark.plans.session import ship


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go: those that fail the base rules, and those of rejected hosts.

    A null or empty text has no word and fails; a null source is one host; repeated rows are judged each.
    """
    ship(spark)
    return keep_good(docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays.

    Texts without a word, and rows without an id, stay; rows that share an id are one document and stay or go
    together.
    """
    ship(spark)
    more = jaccard_join(docs).where("doc_id != component_id").select(F.col("doc_id").alias("copy_id")).distinct()
    rows = held(docs, F.col("doc_id").cast("long").alias("copy_id"))
    return let_go(join_small(rows, more, "copy_id", "left_anti", most=500_000))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak a benchmark item go; each row is judged by its own text, a null text leaks nothing."""
    return drop_leaks(docs, ship(spark).read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are sampled by calibrated probabilities.

    A null source or language is a category of its own; a text without a word in a cell without one has probability
    0; rows that share an id (or have none) are drawn alike.
    """
    ship(spark)
    return sample(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document gets its shard; a null id has the place of an empty key; columns named as the three new ones, in
    any case, are replaced."""
    ship(spark)
    return place(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("decontaminate", decontaminate),
    ("mix_sources", mix_sources),
    ("sharding", sharding),
]

#: Retrieval in a fitted latent space has no form in SQL; a test holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is written and read again."""
    docs = ship(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs)
    return docs
