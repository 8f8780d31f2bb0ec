"""Sampling, splits and stop rules; every random choice is a hash of a seed and an id."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.order import running_sums
from ..functions.text import hash_unit
from ..sources.shared import written


def usage_weight(used: Column, target: Column | None = None, covered: Column | None = None) -> Column:
    """Weight of a document: 0 if covered; what is left to its target, if it has one; else 1/(used+1)."""
    free = F.lit(1.0) / (used + 1)
    w = free if target is None else F.when(target.isNull(), free).otherwise(F.when(target <= 0, 0.0).otherwise(F.greatest(target - used, F.lit(0)).cast("double")))
    return w if covered is None else F.when(covered, 0.0).otherwise(w)


def weighted_sample(items: DataFrame, k: int, seed: str = "42") -> DataFrame:
    """``items(id, weight)``: k of them without replacement, in proportion to weight (exponential keys); all with
    weight if there are no more. Each partition keeps k before the last step."""
    u = F.greatest(hash_unit(seed, F.col("id")), F.lit(2.0**-33))
    return items.where("weight > 0").withColumn("key", -F.ln(u) / F.col("weight")).orderBy("key", "id").limit(k).drop("key")


def weighted_choice(draws: DataFrame, options: DataFrame, seed: str = "42", few: int = 100_000) -> DataFrame:
    """One option for each draw, in proportion to weight: ``draws(draw_id)``, ``options(ord, option, weight)``.

    Options own ranges of the summed weight. Up to ``few`` of them are sent to all tasks. Of more, only those that own a
    thousandth or more of all weight are (a thousand at most); the others are laid on a grid of as many cells of equal
    width as there are options: a draw looks in its own cell only, at the options that reach into it, and cells meet
    draws by an ordinary shuffled join.
    """
    o = running_sums(options.where("weight > 0").withColumn("__all", F.lit(1)), ["__all"], ["ord"], {"hi": F.col("weight").cast("double")})
    o = written(o.select("option", "hi", (F.col("hi") - F.col("weight")).alias("lo")))
    n, total = o.agg(F.count("*"), F.max("hi")).first()
    x = draws.withColumn("__x", hash_unit(seed, F.col("draw_id")) * F.lit(total))
    hit = (F.col("__x") >= F.col("lo")) & (F.col("__x") < F.col("hi"))
    if n <= few:
        return x.join(F.broadcast(o), hit).select(*draws.columns, "option")
    large = o.where((F.col("hi") - F.col("lo")) * 1000 >= F.lit(total))
    rest = x.join(F.broadcast(large.select("lo", "hi")), hit, "left_anti")
    cell = lambda v: F.least(F.floor(v / F.lit(total) * n), F.lit(n - 1)).cast("long")
    grid = o.where((F.col("hi") - F.col("lo")) * 1000 < F.lit(total)).withColumn("__cell", F.explode(F.sequence(cell(F.col("lo")), cell(F.col("hi")))))
    found = rest.withColumn("__cell", cell(F.col("__x"))).join(grid, "__cell").where(hit)
    return x.join(F.broadcast(large), hit).select(*draws.columns, "option").union(found.select(*draws.columns, "option"))


def split(df: DataFrame, key: Column, val_ratio: float, seed: str = "42") -> DataFrame:
    """Adds ``split``: exactly max(1, int(n * ratio)) rows are val, those of the smallest hashes.

    The border is found without sorting the rows in one task: counts by hash prefix give the bucket it lies in,
    and only that bucket is ranked.
    """
    h = F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")).cast("binary"))
    d = df.withColumn("__h", h).withColumn("__b", F.substring("__h", 1, 3))
    counts = d.groupBy("__b").agg(F.count("*").alias("n"))
    up = Window.orderBy("__b")
    counts = counts.withColumn("before", F.sum("n").over(up) - F.col("n")).join(counts.agg(F.greatest(F.floor(F.sum("n") * val_ratio), F.lit(1)).alias("want")))
    counts = counts.select("__b", (F.col("want") - F.col("before")).alias("__left"), "n")
    d = d.join(F.broadcast(counts), "__b")  # at most 4096 rows
    edge = (F.col("__left") > 0) & (F.col("__left") < F.col("n"))
    rank = F.row_number().over(Window.partitionBy("__b", edge).orderBy("__h"))
    return d.withColumn("split", F.when(F.when(edge, rank <= F.col("__left")).otherwise(F.col("__left") > 0), "val").otherwise("train")).select(*df.columns, "split")


def budget_stop(items: DataFrame, cost: str, limit: float) -> DataFrame:
    """``items(stream, ord, cost)``: the first item of each stream at which the running cost reaches the limit."""
    run = running_sums(items, ["stream"], ["ord"], {"spent": F.col(cost)})
    return run.where(F.col("spent") >= limit).groupBy("stream").agg(F.min("ord").alias("ord"), F.round(F.min("spent"), 6).alias("spent"))


def running_state(items: DataFrame) -> DataFrame:
    """``items(stream, ord, cost, failed, value)`` with what stop rules look at, after each item: ``generated`` (items
    that did not fail), ``spent`` (cost), ``events`` and ``failures``, ``distinct`` (values that have occurred)."""
    first = items.where("value IS NOT NULL").groupBy("stream", "value").agg(F.min("ord").alias("ord")).groupBy("stream", "ord").agg(F.count("*").alias("__new"))
    d = items.join(first, ["stream", "ord"], "left")
    failed = F.coalesce(F.col("failed"), F.lit(False))
    sums = {"generated": (~failed).cast("long"), "spent": F.col("cost"), "events": F.lit(1), "failures": failed.cast("long"), "distinct": F.col("__new")}
    return running_sums(d, ["stream"], ["ord"], sums).drop("__new")


def spent_at_least(limit: float) -> Column:
    return F.col("spent") >= limit


def generated_at_least(n: int) -> Column:
    return F.col("generated") >= n


def distinct_at_least(n: int) -> Column:
    return F.col("distinct") >= n


def error_rate_at_least(most: float = 0.5, min_samples: int = 10) -> Column:
    """Not before ``min_samples`` items were generated."""
    return (F.col("generated") >= min_samples) & (F.col("failures") >= most * F.col("events"))


def first_stop(state: DataFrame, *rules: Column, every: bool = False) -> DataFrame:
    """``stream, ord``: the first item of each stream after which any of the rules holds, or ``every`` one at once."""
    if not rules:
        raise ValueError("no rule to stop by")
    held = reduce((lambda a, b: a & b) if every else (lambda a, b: a | b), (F.coalesce(r, F.lit(False)) for r in rules))
    return state.where(held).groupBy("stream").agg(F.min("ord").alias("ord"))


def distinct_stop(items: DataFrame, value: str, n: int) -> DataFrame:
    """The first item of each stream at which n distinct values have occurred."""
    first = items.where(F.col(value).isNotNull()).groupBy("stream", value).agg(F.min("ord").alias("ord"))
    rank = F.row_number().over(Window.partitionBy("stream").orderBy("ord", value))
    return first.withColumn("seen", rank).where(F.col("seen") == n).select("stream", "ord")


def coverage_stop(items: DataFrame, value: str, total: int, threshold: float) -> DataFrame:
    """The first item of each stream at which the share of distinct values reaches the threshold."""
    return distinct_stop(items, value, max(1, -int(-total * threshold // 1)))


def char_budget(docs: DataFrame, most_docs: int = 8, per_doc: int = 4000, total: int = 24000) -> DataFrame:
    """``docs(grp, ord, text)``: excerpts of the first documents of a group within a budget; blank ones are
    skipped after the cap on documents; the last excerpt is cut to what is left."""
    w = Window.partitionBy("grp").orderBy("ord")
    d = docs.withColumn("k", F.row_number().over(w)).where(F.col("k") <= most_docs).where("trim(text) <> ''")
    d = d.withColumn("n", F.least(F.length("text"), F.lit(per_doc))).withColumn("before", F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return d.where(F.col("before") < total).select("grp", "ord", F.least(F.col("n").cast("long"), total - F.col("before")).alias("n")).withColumn("n", F.col("n").cast("long"))


def round_robin(items: DataFrame, pool: int) -> DataFrame:
    """``items(stream, ord)`` -> the pool member that each takes in turn."""
    run = running_sums(items, ["stream"], ["ord"], {"__k": F.lit(1)})
    return run.withColumn("pick", ((F.col("__k") - 1) % pool).cast("long")).drop("__k")


def persona_weight(personas: DataFrame, most_depth: int) -> DataFrame:
    """(most_depth - depth + 1) / how many of the depth; a row a depth is joined, no depth is gathered."""
    n = personas.groupBy("depth").agg(F.count("*").alias("__n"))
    return personas.join(n, "depth", "left").select(*personas.columns, F.round((most_depth - F.col("depth") + 1) / F.col("__n"), 6).alias("weight"))
