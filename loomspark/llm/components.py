"""Connected components by alternating large-star and small-star steps (public map-reduce method)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import written


def components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` long ids, any order, repeats and loops allowed -> ``(node, component)``.

    ``component`` is the smallest id reachable; ids without an edge to another id are absent. No neighbour
    list is gathered: each step is a minimum per node (pre-aggregated) and a join that adaptive execution
    may split. Null ids are ignored; empty edges give an empty table.
    """
    e = edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = written(e)
    mark = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: larger neighbours hang on the smallest of the neighbourhood
        e1 = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = e1.groupBy("u").agg(F.min("v").alias("m"))
        # small star: a node and its smaller neighbours hang on the smallest of them
        e2 = e1.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*").where("u != v").distinct()
        e = written(e2)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    return e.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node").union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()).groupBy("node").agg(F.min("component").alias("component"))
