"""Taxonomies (node tables), difficulty ratings and skills."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written

NODES = "factor_id string, node_id string, parent_id string, depth int, label string"


def level_coverage(nodes: DataFrame, assigned: DataFrame) -> DataFrame:
    """By factor and depth: nodes, assigned nodes, their share. Unknown assigned ids are dropped."""
    a = assigned.select("factor_id", "node_id").distinct().withColumn("hit", F.lit(1))
    g = nodes.join(a, ["factor_id", "node_id"], "left").groupBy("factor_id", "depth").agg(F.count("*").alias("nodes"), F.count("hit").alias("covered"))
    return g.withColumn("coverage", F.round(F.col("covered") / F.col("nodes"), 6))


def paths(nodes: DataFrame) -> DataFrame:
    """Labels from the root to each node, joined by ``/``, at any depth. A level is a join of the last one, which is
    written first, so that no plan repeats the levels before it; it stops at the first empty level. Nodes that no root
    reaches (cycles too) have no path."""
    found = nodes.where("parent_id IS NULL").select("factor_id", "node_id", F.col("label").alias("path"))
    out, level = found, found
    while True:
        child = nodes.alias("c").join(level.alias("p"), (F.col("c.factor_id") == F.col("p.factor_id")) & (F.col("c.parent_id") == F.col("p.node_id")))
        level = written(child.select("c.factor_id", "c.node_id", F.concat("p.path", F.lit("/"), "c.label").alias("path")))
        if level.isEmpty():
            break
        out = out.union(level)
    return out


def invalid_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes without their parent, at a wrong depth, or that are a second root of their factor. A cycle shows as a wrong
    depth, as depths cannot rise by one all along it; so a node without a problem is reached by a root."""
    p = nodes.select("factor_id", F.col("node_id").alias("parent_id"), F.col("depth").alias("parent_depth"))
    roots = nodes.where("parent_id IS NULL").withColumn("k", F.row_number().over(Window.partitionBy("factor_id").orderBy("node_id"))).where("k > 1").select("factor_id", "node_id", F.lit("second root").alias("problem"))
    j = nodes.where("parent_id IS NOT NULL").join(p, ["factor_id", "parent_id"], "left")
    what = F.when(F.col("parent_depth").isNull(), "no parent").when(F.col("depth") != F.col("parent_depth") + 1, "wrong depth")
    return j.select("factor_id", "node_id", what.alias("problem")).where("problem IS NOT NULL").union(roots)


def leaves(nodes: DataFrame) -> DataFrame:
    p = nodes.where("parent_id IS NOT NULL").select("factor_id", F.col("parent_id").alias("node_id")).distinct()
    return nodes.join(p, ["factor_id", "node_id"], "left_anti")


def elo(comparisons: DataFrame, start: float = 1500.0, k: float = 32.0) -> DataFrame:
    """``comparisons(batch, ord, winner, loser)`` folded in order within a batch -> ``batch, item, rating``.

    The fold is sequential by definition, so a batch (a bounded set of items compared with each other) is one
    row's array; batches run side by side.
    """
    state = "map<long,double>"

    def step(acc, x):
        a, b = F.coalesce(F.try_element_at(acc, x["winner"]), F.lit(start)), F.coalesce(F.try_element_at(acc, x["loser"]), F.lit(start))
        gain = F.lit(k) * (F.lit(1.0) - F.lit(1.0) / (F.lit(1.0) + F.pow(F.lit(10.0), (b - a) / F.lit(400.0))))
        rest = F.map_filter(acc, lambda i, _: (i != x["winner"]) & (i != x["loser"]))
        return F.map_concat(rest, F.create_map(x["winner"], a + gain, x["loser"], b - gain)).cast(state)

    games = F.transform(F.array_sort(F.collect_list(F.struct("ord", F.col("winner").cast("long").alias("winner"), F.col("loser").cast("long").alias("loser")))), lambda x: F.struct(x["winner"].alias("winner"), x["loser"].alias("loser")))
    g = comparisons.where("winner <> loser").groupBy("batch").agg(games.alias("g"))
    return g.select("batch", F.explode(F.aggregate("g", F.create_map().cast(state), step)).alias("item", "rating")).withColumn("rating", F.round("rating", 6))


def pass_rates(results: DataFrame) -> DataFrame:
    """``results(source, variant, score, satisfied, total)`` by variant (``source`` null) and by source and variant.
    Rows without rubrics count 0 in the mean share, and stay in it."""
    share = F.coalesce(F.try_divide(F.col("satisfied"), F.col("total")), F.lit(0.0))
    r = results.withColumn("share", share).groupingSets([["variant"], ["source", "variant"]], "variant", "source")
    return r.agg(F.count("*").alias("tasks"), F.round(F.avg("score"), 6).alias("pass_rate"), F.round(F.avg("share"), 6).alias("rubric_rate")).select("source", "variant", "tasks", "pass_rate", "rubric_rate")


def select_versions(results: DataFrame) -> DataFrame:
    """``results(context_id, version, kind, passed)``, kind hard or easy -> the version with the highest product of
    smoothed pass rates, (p+1)/(n+1); the first of equals. A kind without a probe counts 1."""
    rate = lambda kind: (F.count_if((F.col("kind") == kind) & F.col("passed")) + 1) / (F.count_if(F.col("kind") == kind) + 1)
    v = results.groupBy("context_id", "version").agg(F.round(rate("hard") * rate("easy"), 9).alias("score"))
    return v.groupBy("context_id").agg(F.max_by("version", F.struct("score", -F.col("version"))).alias("version"), F.round(F.max("score"), 6).alias("score"))


def latest_per_key(log: DataFrame, key: str, order: str) -> DataFrame:
    """Last row written for each key."""
    return log.withColumn("__k", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("__k = 1").drop("__k")


def compare_sides(left: DataFrame, right: DataFrame, key: str, text: str) -> DataFrame:
    """Both sides of a key, and the similarity of their word sets where both are there."""
    from ..functions.text import jaccard, tokens

    a, b = left.select(key, F.col(text).alias("l")), right.select(key, F.col(text).alias("r"))
    j = F.when(F.col("l").isNotNull() & F.col("r").isNotNull(), F.round(jaccard(tokens(F.col("l")), tokens(F.col("r")), 1.0), 6))
    side = F.when(F.col("r").isNull(), "left").when(F.col("l").isNull(), "right").otherwise("both")
    return a.join(b, key, "full_outer").select(key, side.alias("side"), j.alias("jaccard"))
