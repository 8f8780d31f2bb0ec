"""Conversation rows with the attributes of a generated dataset.

The test tables have turns only. Personas, contexts, scores and the like are derived from the ids by integer
arithmetic; they are scaffolding for the operators and say nothing about the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

METRICS = ("coherence", "factuality", "grounding", "helpfulness", "relevance")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/conversations.parquet")


def conversations(turns_df: DataFrame) -> DataFrame:
    """``conv_id, conversations array<struct<role, content>>`` in the order of turns."""
    entry = F.struct("turn", "role", F.col("text").alias("content"))
    return turns_df.groupBy("conv_id").agg(F.array_sort(F.collect_list(entry)).alias("t")).select("conv_id", F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("conversations"))


def with_context(df: DataFrame) -> DataFrame:
    """Adds ``instruction_context``, null for every third conversation."""
    return df.withColumn("instruction_context", F.when(F.col("conv_id") % 3 != 0, F.concat(F.lit("about doc_"), (F.col("conv_id") * 13 % 200).cast("string"))))


def grade(score: Column) -> Column:
    return F.when(score >= 0.88, "perfect").when(score >= 0.72, "good").when(score >= 0.52, "needs_improvement").when(score >= 0.32, "bad").when(score.isNotNull(), "not_acceptable")


def attributes(df: DataFrame) -> DataFrame:
    """Adds persona, depth, contexts, metric scores, final score and grade by ``conv_id``."""
    i = F.col("conv_id")
    scored = i % 5 != 0
    df = df.withColumns(
        {
            "persona": F.when(i % 11 != 0, F.concat(F.lit("persona_"), (i % 7).cast("string"))),
            "depth": i % 3,
            "context_id": F.concat(F.lit("doc_"), (i * 13 % 200).cast("string")),
            "context_ids": F.array(F.concat(F.lit("doc_"), (i * 13 % 200).cast("string")), F.concat(F.lit("doc_"), (i * 29 % 200).cast("string"))),
            "prompt": F.concat(F.lit("prompt_"), (i % 20).cast("string")),
            **{m: F.when(scored, ((i * 37 + k * 11) % 101) / F.lit(100.0)) for k, m in enumerate(METRICS)},
        }
    )
    total = sum((F.col(m) for m in METRICS[1:]), F.col(METRICS[0]))
    return df.withColumn("final_score", F.round(total / F.lit(5.0), 9)).withColumn("grade", grade(F.col("final_score")))


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attributes(with_context(conversations(turns(spark, sf_dir))))


CONTEXT_SQL = "CASE WHEN conv_id % 3 <> 0 THEN 'about doc_' || (conv_id * 13 % 200) END"
_CTX = "'doc_' || (conv_id * 13 % 200), 'doc_' || (conv_id * 29 % 200)"
#: The same rows in SQL, as CTEs
SQL = (
    "r0 AS (SELECT conv_id, list(struct_pack(role := role, content := text) ORDER BY turn) AS c FROM conversations GROUP BY conv_id), "
    "r1 AS (SELECT *, CASE WHEN conv_id % 11 <> 0 THEN 'persona_' || (conv_id % 7) END AS persona, conv_id % 3 AS depth, "
    f"{CONTEXT_SQL} AS instruction_context, "
    f"'doc_' || (conv_id * 13 % 200) AS context_id, [{_CTX}] AS context_ids, 'prompt_' || (conv_id % 20) AS prompt, "
    + ", ".join(f"CASE WHEN conv_id % 5 <> 0 THEN ((conv_id * 37 + {k * 11}) % 101) / 100.0 END AS {m}" for k, m in enumerate(METRICS))
    + " FROM r0), r2 AS (SELECT *, round((coherence + factuality + grounding + helpfulness + relevance) / 5.0, 9) AS final_score FROM r1), "
    "r AS (SELECT *, CASE WHEN final_score >= 0.88 THEN 'perfect' WHEN final_score >= 0.72 THEN 'good' WHEN final_score >= 0.52 THEN 'needs_improvement' "
    "WHEN final_score >= 0.32 THEN 'bad' WHEN final_score IS NOT NULL THEN 'not_acceptable' END AS grade FROM r2)"
)
