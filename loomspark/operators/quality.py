"""Scores and gates of conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import cosine

REJECTED = ("not_acceptable", "bad", "needs_improvement")
STRATEGY = {"coherence": "improve_coherence", "factuality": "improve_factuality", "grounding": "improve_grounding", "helpfulness": "improve_helpfulness", "relevance": "improve_relevance"}


def composite(rows: DataFrame, weights: dict[str, float], how: str = "mean", limit: float = 0.6) -> DataFrame:
    """Overall score of the metric columns (mean, weighted_mean or min; 0 without a score), whether to write the
    row anew, and the worst metric (the first of equals) with its strategy."""
    have = F.filter(F.array(*[F.struct(F.lit(m).alias("m"), F.col(m).alias("s"), F.lit(float(w)).alias("w")) for m, w in weights.items()]), lambda x: x["s"].isNotNull())
    zero = F.lit(0.0)
    total = lambda f: F.aggregate("__h", zero, lambda a, x: a + f(x))
    if how == "min":
        score = F.array_min(F.transform("__h", lambda x: x["s"]))
    elif how == "weighted_mean":
        score = F.try_divide(total(lambda x: x["s"] * x["w"]), total(lambda x: x["w"]))
    elif how == "mean":
        score = F.try_divide(total(lambda x: x["s"]), F.size("__h").cast("double"))
    else:
        raise ValueError(f"unknown way to combine scores: {how!r}")
    worst = F.get(F.filter("__h", lambda x: x["s"] == F.array_min(F.transform("__h", lambda y: y["s"]))), F.lit(0))["m"]
    out = rows.withColumn("__h", have).select("conv_id", F.round(F.coalesce(score, zero), 6).alias("overall"), worst.alias("worst"))
    strategy = F.coalesce(F.create_map(*[F.lit(x) for kv in STRATEGY.items() for x in kv])[F.col("worst")], F.lit("general_improvement"))
    return out.select("conv_id", "overall", (F.col("overall") < limit).alias("regenerate"), "worst", strategy.alias("strategy"))


def accepted(rows: DataFrame) -> DataFrame:
    """Rows whose grade passes; rows that were never judged pass."""
    return rows.where(F.col("grade").isNull() | ~F.col("grade").isin(*REJECTED))


def first_accepted(attempts: DataFrame, most: int | None = None) -> DataFrame:
    """``attempts(item, attempt, grade)``: the first attempt of each item that passes, among the first ``most`` if given."""
    return accepted(attempts if most is None else attempts.where(F.col("attempt") < most)).groupBy("item").agg(F.min("attempt").alias("attempt"))


def question_answer_pairs(turns: DataFrame) -> DataFrame:
    """Positions 0-1, 2-3, ... of each conversation as pairs; an odd last turn has none."""
    at = turns.withColumn("pos", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1).withColumn("k", F.floor(F.col("pos") / 2))
    return at.groupBy("conv_id", "k").agg(F.max(F.when(F.col("pos") % 2 == 0, F.struct("turn", "vec"))).alias("q"), F.max(F.when(F.col("pos") % 2 == 1, F.struct("turn", "vec"))).alias("a")).where("q IS NOT NULL AND a IS NOT NULL")


def coherence(turns: DataFrame, limit: float = 0.65) -> DataFrame:
    """Mean cosine of each conversation's question-answer pairs; without a pair 0. ``turns`` has ``vec``."""
    sim = question_answer_pairs(turns).select("conv_id", cosine(F.col("q.vec"), F.col("a.vec")).alias("s")).groupBy("conv_id").agg(F.avg("s").alias("s"), F.count("*").alias("pairs"))
    s = F.round(F.coalesce("s", F.lit(0.0)), 6)
    return turns.select("conv_id").distinct().join(sim, "conv_id", "left").select("conv_id", s.alias("score"), F.coalesce("pairs", F.lit(0)).alias("pairs"), (s < limit).alias("regenerate"))


def similarity_to_context(turns: DataFrame, contexts: DataFrame, role: str, limit: float = 0.55) -> DataFrame:
    """Mean cosine of a conversation's turns of ``role`` with its context: 1 without a context, 0 without such a
    turn. ``contexts(conv_id, context_vec)`` has at most a row a conversation."""
    t = turns.where(F.col("role") == role).select("conv_id", "vec")
    sim = t.join(contexts, "conv_id").groupBy("conv_id").agg(F.avg(cosine(F.col("vec"), F.col("context_vec"))).alias("s"))
    every = turns.select("conv_id").distinct().join(contexts.select("conv_id", F.lit(True).alias("has")), "conv_id", "left").join(sim, "conv_id", "left")
    s = F.round(F.when(F.col("has").isNull(), 1.0).otherwise(F.coalesce("s", F.lit(0.0))), 6)
    return every.select("conv_id", s.alias("score"), (s < limit).alias("regenerate"))


def scores_valid(scores: Column) -> Column:
    return (F.size(scores) > 0) & F.forall(scores, lambda x: (x >= 0) & (x <= 1))


def rubric(status: Column) -> Column:
    """1 if there are rubrics and all hold, else 0."""
    return F.when((F.size(status) > 0) & F.forall(status, lambda x: x), 1.0).otherwise(0.0)


def multiple_choice(choices: Column, index: Column, n: int = 4) -> Column:
    """Choices cut or filled to n; an index out of range becomes 0."""
    filled = F.slice(F.concat(choices, F.array_repeat(F.lit("(placeholder)"), n)), 1, n)
    return F.struct(filled.alias("choices"), F.when((index >= 0) & (index < n), index).otherwise(0).alias("correct_index"))


def language_mismatch(rows: DataFrame, expected: str, examples: int = 5) -> DataFrame:
    """One row of ``rows(id, detected)``: how many texts were detected as another language, and the first of these ids.
    Texts without a detected language do not count."""
    other = F.col("detected") != expected
    first = rows.where(other).orderBy("id").limit(examples).agg(F.array_join(F.transform(F.array_sort(F.collect_list("id")), lambda x: x.cast("string")), ",").alias("examples"))
    return rows.agg(F.count("*").alias("n"), F.count_if(other).alias("n_mismatched")).join(F.broadcast(first))  # one row each
