"""Joins and set operations of the document, skill and task tables, and the summaries made from them.

Small sides are left to the optimiser's size check; nothing is broadcast by force.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.order import rolling_mean
from ..functions.text import strip


def usage_counts(docs: DataFrame, uses: DataFrame) -> DataFrame:
    """``docs(doc_id)``, ``uses(doc_id)`` -> every document with how often it was used, 0 if never."""
    n = uses.groupBy("doc_id").agg(F.count("*").alias("n"))
    return docs.select("doc_id").join(n, "doc_id", "left").select("doc_id", F.coalesce("n", F.lit(0)).alias("n_used"))


def coverage(usage: DataFrame, least: int = 1) -> DataFrame:
    """One row of ``usage(doc_id, n_used)``: documents, those used ``least`` times or more, and their share."""
    hit = F.count_if(F.col("n_used") >= least)
    return usage.agg(F.count("*").alias("n_docs"), hit.alias("n_covered"), F.round(F.coalesce(hit / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0)), 6).alias("share"))


def selected_skills(texts: DataFrame, contexts: DataFrame, selected: DataFrame, versions: DataFrame) -> DataFrame:
    """``texts(text_id, text)`` -> ``text_id, context_id, version``: by the digest of the stripped text
    (``contexts(digest, context_id)``; a null text counts as empty) the version ``selected(context_id, version)``, else
    the last appended of ``versions(context_id, version, ord)``; null if there is neither."""
    latest = versions.groupBy("context_id").agg(F.max_by("version", "ord").alias("latest"))
    t = texts.select("text_id", F.sha2(strip(F.coalesce("text", F.lit(""))), 256).alias("digest")).join(contexts, "digest", "left")
    return t.join(selected, "context_id", "left").join(latest, "context_id", "left").select("text_id", "context_id", F.coalesce("version", "latest").alias("version"))


def undeclared(references: DataFrame, declared: DataFrame) -> DataFrame:
    """``references(ref)`` that ``declared(name)`` has neither whole nor by what stands after their last dot."""
    tail = F.substring_index("ref", ".", -1)
    names = declared.select("name").union(declared.select(F.substring_index("name", ".", -1))).distinct()
    return references.select("ref").distinct().join(declared.select(F.col("name").alias("ref")), "ref", "left_anti").withColumn("name", tail).join(names, "name", "left_anti").select("ref")


def replays(versions: DataFrame, probes: DataFrame) -> DataFrame:
    """Every version of a context against each of its probes: ``versions(context_id, version)``, ``probes(context_id,
    probe_id)``; the product is per context, never of the tables."""
    return versions.join(probes, "context_id").select("context_id", "version", "probe_id")


def distinct_tasks(first: DataFrame, second: DataFrame) -> DataFrame:
    """``(task, rubrics, ord)`` of two sources, the first source's before the second's; of equal (task, rubrics) the
    first stays: ``task, rubrics, src, ord``."""
    both = first.withColumn("src", F.lit(0)).unionByName(second.withColumn("src", F.lit(1)))
    at = both.groupBy("task", "rubrics").agg(F.min(F.struct("src", "ord")).alias("at"))  # pre-aggregated, no window
    return at.select("task", "rubrics", "at.src", "at.ord")


def union_ids(*tables: DataFrame) -> DataFrame:
    """Distinct ``context_id`` of all tables."""
    out = tables[0].select("context_id")
    for t in tables[1:]:
        out = out.union(t.select("context_id"))
    return out.distinct()


def in_all(key: str, most: int, *tables: DataFrame) -> DataFrame:
    """The first ``most`` keys, in order, that every table has."""
    out = tables[0].select(key)
    for t in tables[1:]:
        out = out.intersect(t.select(key))
    return out.orderBy(key).limit(most)


def hardest_and_easiest(results: DataFrame) -> DataFrame:
    """By ``iteration`` of ``results(iteration, probe_id, passed, rate, n_rubrics)``: the failed probe of the least rubric
    rate, then the fewest rubrics, then the first; the passed probe of the fewest rubrics, then the first."""
    failed, passed = ~F.col("passed"), F.col("passed")
    return results.groupBy("iteration").agg(
        F.min_by(F.when(failed, F.col("probe_id")), F.when(failed, F.struct("rate", "n_rubrics", "probe_id"))).alias("hardest"),
        F.min_by(F.when(passed, F.col("probe_id")), F.when(passed, F.struct("n_rubrics", "probe_id"))).alias("easiest"),
    )


def shallowest(personas: DataFrame, target: int) -> DataFrame:
    """``personas(doc_id, persona, depth, ord)``: the first ``target`` of each document by depth, then in their order."""
    w = Window.partitionBy("doc_id").orderBy("depth", "ord")
    return personas.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= target).withColumn("rank", F.col("rank").cast("long"))


def capped_children(nodes: DataFrame, most: int) -> DataFrame:
    """``nodes(parent_id, node_id, ord)``: at most ``most`` children of a parent, in their order."""
    w = Window.partitionBy("parent_id").orderBy("ord", "node_id")
    return nodes.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).drop("rank")


def by_category(tools: DataFrame) -> DataFrame:
    """``tools(name, category)`` -> ``category, place, tools``: names in order, categories in order, those without last."""
    c = F.coalesce(F.nullif(F.trim("category"), F.lit("")), F.lit("Uncategorized"))
    g = tools.select(c.alias("category"), "name").groupBy("category").agg(F.array_sort(F.collect_set("name")).alias("tools"))
    place = F.row_number().over(Window.orderBy(F.col("category") == "Uncategorized", "category"))  # a row a category
    return g.select("category", place.cast("long").alias("place"), "tools")


def similarity_summary(scores: DataFrame, low: float, examples: int = 5) -> DataFrame:
    """One row of ``scores(id, score)``: count, mean, population deviation, how many lie below ``low``, and the ids of the
    lowest of these."""
    under = F.col("score") < low
    one = scores.agg(F.count("*").alias("n"), F.round(F.coalesce(F.avg("score"), F.lit(0.0)), 6).alias("mean"), F.round(F.coalesce(F.stddev_pop("score"), F.lit(0.0)), 6).alias("std"), F.count_if(under).alias("n_low"))
    worst = scores.where(under).orderBy("score", "id").limit(examples)  # a row an example
    ids = worst.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("score", "id"))), lambda x: x["id"].cast("string")), ",").alias("examples"))
    return one.crossJoin(F.broadcast(ids))  # one row each


def compare_summary(sides: DataFrame) -> DataFrame:
    """Of ``sides(side, jaccard)``: both, left and right only, and the mean over both."""
    return sides.agg(*[F.count_if(F.col("side") == s).alias(s) for s in ("both", "left", "right")], F.round(F.coalesce(F.avg(F.when(F.col("side") == "both", F.col("jaccard"))), F.lit(0.0)), 6).alias("mean_jaccard"))


def judged_mean(scores: Column, flagged: Column, fallback: float, limit: float = 0.55) -> Column:
    """Mean of an array of scores in [0, 1], ``fallback`` if one is out of range or there is none; and whether to write
    the text anew: flagged, or a mean below the limit."""
    good = F.coalesce((F.size(scores) > 0) & F.forall(scores, lambda x: (x >= 0) & (x <= 1)), F.lit(False))
    mean = F.round(F.when(good, F.aggregate(scores, F.lit(0.0), lambda s, x: s + x) / F.size(scores)).otherwise(F.lit(fallback)), 6)
    return F.struct(mean.alias("score"), (F.coalesce(flagged, F.lit(False)) | (mean < limit)).alias("regenerate"))


def target_per_document(requested: Column, active: Column) -> Column:
    """Requested rows shared out over the active documents, rounded up, one at least."""
    return F.greatest(F.ceil(F.try_divide(requested, active)), F.lit(1)).cast("long")


def evaluation_scores(rows: DataFrame, metrics: list[str]) -> DataFrame:
    """One row for each score of an evaluation: ``conv_id, metric, value``."""
    pair = [F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics]
    return rows.select("conv_id", F.explode(F.filter(F.array(*pair), lambda x: x["value"].isNotNull())).alias("x")).select("conv_id", "x.*")


def rolling_within(metrics: DataFrame, metric: str, as_of: str, hours: int = 1, events: int = 10) -> DataFrame:
    """Mean of the last events of one metric, at each of its events in the hours up to ``as_of``."""
    t = F.lit(as_of).cast("timestamp_ntz")
    m = metrics.where((F.col("metric") == metric) & (F.col("ts") > t - F.expr(f"INTERVAL {hours} HOURS")) & (F.col("ts") <= t))
    m = rolling_mean(m.select("event_id", "metric", "ts", "value"), ["metric"], ["ts", "event_id"], "value", events, "rolling")  # the events of the lookback only
    return m.select("event_id", F.round("rolling", 6).alias("rolling"))
