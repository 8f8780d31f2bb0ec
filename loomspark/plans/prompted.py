"""Queries of prompts and their settings, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import prompts
from .catalogue import Tables, query

_D = "doc_id"
_FOUND = f"CASE doc_id % 4 WHEN 0 THEN '{prompts.NO_CONTEXT}' WHEN 1 THEN '' ELSE coalesce(text, '') END"

query("f12_without_context", f"SELECT doc_id, {_FOUND} IN ('', '{prompts.NO_CONTEXT}') AS without_context FROM documents")(
    lambda t: t.documents.select("doc_id", prompts.without_context(F.expr(_FOUND)).alias("without_context"))
)
query(
    "p28_rag_prompts",
    f"""
WITH c AS (SELECT doc_id, lang, CASE WHEN doc_id % 3 = 0 THEN '' ELSE source END AS context, coalesce(text, '') AS text FROM documents)
SELECT doc_id, 'Speak ' || lang || '.' || chr(10) || 'Context: ' || CASE WHEN context = '' THEN text ELSE context || chr(10) || chr(10) || '{prompts.RAG_HEADING}' || chr(10) || text END AS prompt FROM c
""",
)(
    lambda t: t.documents.select(
        "doc_id",
        prompts.filled("{prompt}\nContext: {context}", prompt=F.concat(F.lit("Speak "), "lang", F.lit(".")), context=prompts.with_retrieved(F.when(F.col(_D) % 3 != 0, F.col("source")), F.coalesce("text", F.lit("")))).alias("prompt"),
    )
)


def _skilled(t: Tables):
    skills = t.benchmark.select(F.col("item_id").alias("context_id"), F.concat(F.lit("skill "), F.col("item_id").cast("string")).alias("name"), F.lit("always").alias("description"), F.col("text").alias("content"))
    asked = t.documents.select("doc_id", (F.col(_D) % 97).alias("context_id"), F.concat(F.col("source"), F.lit(" \n")).alias("prompt"))
    return prompts.with_skills(asked, skills)


query(
    "p29_skill_prompts",
    f"""
WITH d AS (SELECT doc_id, doc_id % 97 AS context_id, source FROM documents)
SELECT doc_id, context_id, CASE WHEN item_id IS NULL THEN source || ' ' || chr(10) ELSE rtrim(source) || chr(10) || chr(10) || '{prompts.SKILL_HEADING}' || chr(10) || chr(10) || '{prompts.SKILL_ADVICE}'
|| chr(10) || chr(10) || '### skill ' || item_id || chr(10) || 'When to use: always' || chr(10) || chr(10) || trim(text) END AS prompt, 'skill ' || item_id AS skill
FROM d LEFT JOIN benchmark ON item_id = context_id
""",
)(_skilled)
query(
    "x6_synthesized",
    """
SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN source ELSE 'write ' || source END AS task,
CASE WHEN doc_id % 4 IN (0, 1) THEN '{"id":' || doc_id || '}' ELSE '{}' END AS context FROM documents
""",
)(
    lambda t: t.documents.select(
        "doc_id",
        prompts.synthesized(
            F.when(F.col(_D) % 4 == 0, F.format_string('Here: PROMPT: "write %s" INITIAL_CONTEXT: ```json\n{"id": %d}\n``` end', "source", "doc_id"))
            .when(F.col(_D) % 4 == 1, F.format_string('PROMPT: write %s INITIAL_CONTEXT: {"id": %d}', "source", "doc_id"))
            .when(F.col(_D) % 4 == 2, F.format_string("PROMPT: write %s INITIAL_CONTEXT: ```\nnone\n```", "source"))
            .otherwise(F.col("source"))
        ).alias("x"),
    ).select("doc_id", "x.*")
)
query(
    "x18_regenerated",
    "WITH c AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE doc_id % 10 / 10.0 END AS t FROM documents) SELECT doc_id, round(CASE doc_id % 5 "
    + " ".join(f"WHEN {i} THEN least(coalesce(t, {d}) * {f}, {c})" for i, (d, f, c, _) in enumerate(prompts.STRATEGIES.values()))
    + " ELSE t END, 6)::DOUBLE AS temperature, 'Be kind.' || CASE doc_id % 5 "
    + " ".join(f"WHEN {i} THEN '{s.replace(chr(10), '')}'" for i, (_, _, _, s) in enumerate(prompts.STRATEGIES.values()))
    + " ELSE '' END AS system_prompt FROM c",
)(
    lambda t: t.documents.select(
        "doc_id", prompts.regenerated(F.get(F.array(*map(F.lit, prompts.STRATEGIES)), (F.col(_D) % 5).cast("int")), F.when(F.col(_D) % 3 != 0, (F.col(_D) % 10) / 10.0), F.lit("Be kind.")).alias("x")
    ).select("doc_id", F.round("x.temperature", 6).alias("temperature"), F.replace("x.system_prompt", F.lit("\n"), F.lit("")).alias("system_prompt"))
)
query("x24_substituted", "SELECT o_orderkey, 'Write ' || greatest(o_orderkey % 7, 1) || ' questions' AS prompt FROM orders")(
    lambda t: t.orders.select("o_orderkey", prompts.with_count(F.lit("Write {n_instructions} questions"), F.col("o_orderkey") % 7).alias("prompt"))
)
query(
    "p26_display_rows",
    """
WITH c AS (SELECT conv_id, list(coalesce(text, '') ORDER BY turn) AS l FROM conversations GROUP BY 1)
SELECT conv_id, l[1] AS instruction, coalesce(l[2], '') AS response, CASE WHEN conv_id % 3 = 0 OR l[-1] = '' THEN '' ELSE left(l[-1], 200) || '...' END AS context,
CASE WHEN conv_id % 2 = 0 THEN 'N/A' ELSE 'persona ' || conv_id END AS persona FROM c
""",
)(
    lambda t: prompts.display_rows(
        t.base().withColumn("context", F.when(F.col("conv_id") % 3 != 0, F.element_at("conversations", -1)["content"])).withColumn("persona", F.when(F.col("conv_id") % 2 != 0, F.concat(F.lit("persona "), F.col("conv_id").cast("string"))))
    )
)
