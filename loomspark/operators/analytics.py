"""Dataset analytics over conversation rows and over turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.order import next_value
from ..functions.text import bigrams, tokens, word_count


def summary(rows: DataFrame) -> DataFrame:
    """One row: conversations, turns, words, their means, distinct personas and contexts."""
    words = F.aggregate("conversations", F.lit(0).cast("long"), lambda s, x: s + word_count(x["content"]))
    t = rows.select(F.size("conversations").cast("long").alias("t"), words.alias("w"), F.nullif("persona", F.lit("")).alias("p"), F.nullif("context_id", F.lit("")).alias("c"))
    n, turns, said = F.count("*"), F.coalesce(F.sum("t"), F.lit(0)), F.coalesce(F.sum("w"), F.lit(0))
    return t.agg(
        n.alias("n_conversations"), turns.alias("n_turns"), F.round(F.coalesce(turns / F.nullif(n, F.lit(0)), F.lit(0.0)), 6).alias("avg_turns"), said.alias("n_words"),
        F.round(F.coalesce(said / F.nullif(turns, F.lit(0)), F.lit(0.0)), 6).alias("avg_words_per_turn"), F.countDistinct("p").alias("n_personas"), F.countDistinct("c").alias("n_contexts"),
    )


def persona_counts(rows: DataFrame) -> DataFrame:
    """Rows a persona, the first seen before others of equal count (``rank``)."""
    c = rows.where("persona <> ''").groupBy("persona").agg(F.count("*").alias("n"), F.min("conv_id").alias("first"))
    return c.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "first")).cast("long")).select("persona", "n", "rank")


def depth_histogram(rows: DataFrame) -> DataFrame:
    return rows.where("depth IS NOT NULL").groupBy("depth").agg(F.count("*").alias("n"))


def context_counts(rows: DataFrame, dedup: bool = False) -> DataFrame:
    """Uses of each context; ``dedup`` counts a context once a row, else its id counts besides the list."""
    ids = F.concat(F.array("context_id"), F.coalesce("context_ids", F.array().cast("array<string>")))
    return rows.select(F.explode(F.array_distinct(ids) if dedup else ids).alias("context")).where("context <> ''").groupBy("context").agg(F.count("*").alias("n"))


def coverage(rows: DataFrame, dedup: bool = False) -> DataFrame:
    return context_counts(rows, dedup).agg(F.count("*").alias("n_contexts"), F.count_if(F.col("n") == 1).alias("used_once"), F.count_if(F.col("n") > 1).alias("used_multiple"))


def grade_counts(rows: DataFrame) -> DataFrame:
    return rows.where("grade IS NOT NULL").groupBy("grade").agg(F.count("*").alias("n"))


def metric_means(rows: DataFrame, metrics) -> DataFrame:
    """Mean of each metric over the scored rows, one row a metric."""
    stack = F.stack(F.lit(len(metrics)), *[x for m in metrics for x in (F.lit(m), F.col(m))]).alias("metric", "score")
    return rows.where("grade IS NOT NULL").select(stack).groupBy("metric").agg(F.round(F.avg("score"), 6).alias("mean"), F.count("score").alias("n"))


def histogram(values: DataFrame, value: str, bins: int = 10, by: list[str] | None = None) -> DataFrame:
    """Equal-width bins over the common range; empty bins count 0; one bin if all values are equal.

    The range is one row and is broadcast; counts are pre-aggregated before the shuffle.
    """
    by = by or []
    v = values.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("v"))
    lim = v.agg(F.min("v").alias("lo"), F.max("v").alias("hi")).where("lo IS NOT NULL")
    place = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("v") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / bins)).cast("long"), F.lit(bins - 1))).otherwise(F.lit(0))
    counts = v.join(F.broadcast(lim)).select(*by, place.cast("long").alias("bin")).groupBy(*by, "bin").agg(F.count("*").alias("n"))
    frame = lim.select(F.explode(F.when(F.col("hi") > F.col("lo"), F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))).alias("bin"), F.round(F.col("lo"), 6).alias("lo"), F.round((F.col("hi") - F.col("lo")) / bins, 6).alias("width"))
    keys = v.select(*by).distinct().join(F.broadcast(frame)) if by else frame
    return keys.join(counts, [*by, "bin"], "left").select(*by, "bin", F.round(F.col("lo") + F.col("bin") * F.col("width"), 6).alias("edge"), F.coalesce("n", F.lit(0)).alias("n"))


def token_counts(turns: DataFrame, by: list[str] | None = None) -> DataFrame:
    return turns.select(*(by or []), F.explode(tokens(F.col("text"))).alias("token")).groupBy(*(by or []), "token").agg(F.count("*").alias("n"))


def vocabulary(turns: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Tokens, distinct tokens, their ratio and the entropy in bits, from one count by token."""
    by = by or []
    c = token_counts(turns, by)
    total = c.groupBy(*by).agg(F.sum("n").alias("n_tokens"), F.count("*").alias("n_distinct"), F.sum(F.col("n") * F.log2("n")).alias("s"))
    n = F.col("n_tokens")
    return total.select(*by, "n_tokens", "n_distinct", F.round(F.col("n_distinct") / n, 6).alias("ttr"), F.round(F.log2(n) - F.col("s") / n, 6).alias("entropy"))


def bigram_repetition(turns: DataFrame, order: list[str]) -> DataFrame:
    """Share of bigrams that occur more than once, over the stream of all messages in order.

    Bigrams inside a message come from its own array. Those across messages need the next message that has a
    token: inside a group by a window of its own, between groups by ranges of their ids, so that no task sees
    the whole stream. ``order`` is an integer group id, then the order inside the group.
    """
    t = turns.select(*order, tokens(F.col("text")).alias("w")).where(F.size("w") > 0)
    inside = t.select(F.explode(bigrams(F.col("w"))).alias("b"))
    ends = t.select(F.struct(*order).alias("o"), F.get("w", F.lit(0)).alias("first"), F.element_at("w", -1).alias("last"), order[0])
    own = Window.partitionBy(order[0]).orderBy("o")
    inner = ends.select("last", F.lead("first").over(own).alias("next")).where("next IS NOT NULL")
    # from one group to the next: a row a group
    edge = ends.groupBy(order[0]).agg(F.min_by("first", "o").alias("first"), F.max_by("last", "o").alias("last"))
    outer = next_value(edge, order[0], "first", "next").select("last", "next").where("next IS NOT NULL")
    across = inner.union(outer).select(F.concat("last", F.lit(" "), "next").alias("b"))
    c = inside.union(across).groupBy("b").agg(F.count("*").alias("n"))
    return c.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_bigrams"), F.round(F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))) / F.sum("n"), F.lit(0.0)), 6).alias("repetition"))


def word_lengths(turns: DataFrame) -> DataFrame:
    """Words of a message by role: count, mean, least, most."""
    return turns.select("role", word_count(F.col("text")).alias("w")).groupBy("role").agg(F.count("*").alias("n"), F.round(F.avg("w"), 6).alias("mean"), F.min("w").alias("least"), F.max("w").alias("most"))


def char_lengths(turns: DataFrame, low: int = 50, high: int = 2000) -> DataFrame:
    """Characters of a message by role, population deviation, and how many are out of bounds."""
    n = F.length("text").cast("long")
    return turns.groupBy("role").agg(F.round(F.avg(n), 6).alias("mean"), F.round(F.stddev_pop(n), 6).alias("std"), F.min(n).alias("least"), F.max(n).alias("most"), F.count_if((n < low) | (n > high)).alias("outliers"))


def length_outliers(turns: DataFrame, low: int = 50, high: int = 2000) -> DataFrame:
    return turns.select("conv_id", "turn", "role", F.length("text").cast("long").alias("n")).where((F.col("n") < low) | (F.col("n") > high))


def turn_balance(turns: DataFrame) -> DataFrame:
    c = turns.groupBy("role").agg(F.count("*").alias("n"))
    return c.join(F.broadcast(c.agg(F.sum("n").alias("all")))).select("role", "n", F.round(F.col("n") / F.col("all"), 6).alias("share"))


def exact_duplicates(docs: DataFrame, text: Column | None = None) -> DataFrame:
    """Groups of equal texts: size and smallest id; grouped by a hash, so texts are not shuffled."""
    text = F.col("text") if text is None else text
    return docs.select("doc_id", F.sha2(text, 256).alias("digest")).groupBy("digest").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")
