"""Preference pairs: building, statistics and output formats."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def build_pairs(responses: DataFrame, min_gap: float = 0.1) -> DataFrame:
    """``responses(prompt, content, score, variation_label, ord)`` -> the best and worst of each prompt, and
    whether their gap is large enough. Ties: the first best, the last worst."""
    one = F.struct("content", "score", "variation_label")
    g = responses.where("score IS NOT NULL").groupBy("prompt").agg(
        F.max_by(one, F.struct("score", -F.col("ord"))).alias("chosen"), F.min_by(one, F.struct("score", -F.col("ord"))).alias("rejected"), F.count("*").alias("n")
    )
    gap = F.round(F.col("chosen.score") - F.col("rejected.score"), 9)
    return g.where("n >= 2").withColumn("gap", gap).withColumn("valid", gap >= min_gap)


def statistics(pairs: DataFrame) -> DataFrame:
    """One row: attempted, valid, discarded, rates, mean scores and gap, and the share of the commonest label."""
    n, ok = F.count("*"), F.count_if("valid")
    mean = lambda c: F.round(F.coalesce(F.avg(F.when(F.col("valid"), F.col(c))), F.lit(0.0)), 6)
    one = pairs.agg(n.alias("attempted"), ok.alias("valid"), (n - ok).alias("discarded"), F.round(F.coalesce((n - ok) / F.nullif(n, F.lit(0)), F.lit(0.0)), 6).alias("discard_rate"), mean("chosen.score").alias("mean_chosen"), mean("rejected.score").alias("mean_rejected"), mean("gap").alias("mean_gap"))
    top = label_distribution(pairs).agg(F.max("n").alias("top"))
    share = F.round(F.coalesce(F.col("top") / F.nullif(F.col("valid"), F.lit(0)), F.lit(0.0)), 6)
    return one.join(F.broadcast(top)).select(*one.columns, (share >= 0.75).alias("dominated"), (F.col("discard_rate") > 0.4).alias("many_discarded"))


def label_distribution(pairs: DataFrame) -> DataFrame:
    return pairs.where("valid").groupBy(F.col("chosen.variation_label").alias("label")).agg(F.count("*").alias("n"))


def as_dpo(pairs: DataFrame) -> DataFrame:
    return pairs.where("valid").select("prompt", F.col("chosen.content").alias("chosen"), F.col("rejected.content").alias("rejected"))


def as_orpo(pairs: DataFrame) -> DataFrame:
    return pairs.where("valid").select("prompt", F.col("chosen.content").alias("chosen"), F.col("rejected.content").alias("rejected"), F.col("chosen.score").alias("chosen_score"), F.col("rejected.score").alias("rejected_score"))


def _prefix(pairs: DataFrame):
    """The turns before the prompt: ``shared_prefix array<struct<role, content>>`` if there is such a column."""
    kind = "array<struct<role:string,content:string>>"
    return F.coalesce(F.col("shared_prefix").cast(kind), F.array().cast(kind)) if "shared_prefix" in pairs.columns else F.array().cast(kind)


def as_chat(pairs: DataFrame, system: str | None = None) -> DataFrame:
    """Messages before the answer (system, shared turns, prompt), and both answers as messages."""
    say = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    before = F.concat(F.array(say("system", F.lit(system))), _prefix(pairs)) if system else _prefix(pairs)
    return pairs.where("valid").select(F.concat(before, F.array(say("user", F.col("prompt")))).alias("prompt"), F.array(say("assistant", F.col("chosen.content"))).alias("chosen"), F.array(say("assistant", F.col("rejected.content"))).alias("rejected"))


def as_ultrafeedback(pairs: DataFrame) -> DataFrame:
    """All scored answers where ``all_scores array<struct<response, overall_score, model>>`` holds any, else the two."""
    one = lambda c: F.struct(F.col(f"{c}.content").alias("response"), F.col(f"{c}.score").alias("overall_score"), F.col(f"{c}.variation_label").alias("model"))
    both = F.array(one("chosen"), one("rejected"))
    scored = F.when(F.size("all_scores") > 0, F.col("all_scores")).otherwise(both) if "all_scores" in pairs.columns else both
    return pairs.where("valid").select(F.col("prompt").alias("instruction"), scored.alias("completions"))


def as_anthropic_hh(pairs: DataFrame) -> DataFrame:
    """Shared turns, prompt and answer as one text; turns of other roles than user and assistant are left out."""
    turn = lambda x: F.concat(F.when(x["role"] == "user", "Human: ").otherwise("Assistant: "), F.coalesce(x["content"], F.lit("")))
    before = F.transform(F.filter(_prefix(pairs), lambda x: x["role"].isin("user", "assistant")), turn)
    text = lambda c: F.array_join(F.concat(before, F.array(F.concat(F.lit("Human: "), F.col("prompt")), F.concat(F.lit("Assistant: "), F.col(f"{c}.content")))), "\n\n")
    return pairs.where("valid").select(text("chosen").alias("chosen"), text("rejected").alias("rejected"))


def save(pairs: DataFrame, rows: DataFrame, path: str, log_path: str | None = None) -> None:
    """Writes formatted ``rows`` (of one of the formats above) as JSON lines and, with ``log_path``, a log of all pairs,
    good or not, that ends with one row of their statistics (``_analytics``)."""
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
    if log_path:
        told = pairs.select(F.lit(0).alias("__last"), F.to_json(F.struct("*")).alias("value"))
        last = statistics(pairs).select(F.lit(1).alias("__last"), F.to_json(F.struct(F.struct("*").alias("_analytics"))).alias("value"))
        told.union(last).orderBy("__last").select("value").write.mode("overwrite").text(log_path)
