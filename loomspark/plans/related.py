"""Queries of joins, set operations and summaries, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import export, relations, taxonomy
from ..sources import enrich
from .catalogue import COS, TOK, Tables, flat, query

_USES = "u AS (SELECT ps.user_id AS doc_id FROM events ps)"
_USED = f"{_USES}, n AS (SELECT d.doc_id, count(u.doc_id) AS n_used FROM (SELECT doc_id FROM documents) d LEFT JOIN u USING (doc_id) GROUP BY 1)"


def _usage(t: Tables):
    return relations.usage_counts(t.documents, t.events.select(F.col("user_id").alias("doc_id")))


query("j1_usage_counts", f"WITH {_USED} SELECT * FROM n")(_usage)
query("j2_document_coverage", f"WITH {_USED} SELECT count(*) AS n_docs, count_if(n_used >= 2) AS n_covered, round(count_if(n_used >= 2) / count(*), 6) AS share FROM n")(lambda t: relations.coverage(_usage(t), 2))


def _skills(t: Tables):
    b = t.benchmark.where("item_id % 4 <> 0")
    contexts = b.groupBy(F.sha2("text", 256).alias("digest")).agg(F.min("item_id").alias("context_id"))
    labels = t.labels.select((F.col("doc_id") % 50).alias("context_id"), (F.col("doc_id") % 7).alias("version"), "quality", F.col("doc_id").alias("ord"))
    chosen = labels.where("quality = 1 AND context_id % 3 = 0").groupBy("context_id").agg(F.min("version").alias("version"))
    return relations.selected_skills(t.benchmark.select(F.col("item_id").alias("text_id"), F.concat(F.lit(" "), "text", F.lit(" \n")).alias("text")), contexts, chosen, labels)


query(
    "j3_selected_skill",
    """
WITH l AS (SELECT doc_id % 50 AS context_id, doc_id % 7 AS version, quality, doc_id FROM labels),
c AS (SELECT sha256(text) AS digest, min(item_id) AS context_id FROM benchmark WHERE item_id % 4 <> 0 GROUP BY 1),
s AS (SELECT context_id, min(version) AS version FROM l WHERE quality = 1 AND context_id % 3 = 0 GROUP BY 1),
m AS (SELECT context_id, arg_max(version, doc_id) AS latest FROM l GROUP BY 1)
SELECT item_id AS text_id, c.context_id, coalesce(version, latest) AS version
FROM benchmark b LEFT JOIN c ON c.digest = sha256(b.text) LEFT JOIN s USING (context_id) LEFT JOIN m USING (context_id)
""",
)(_skills)
query(
    "j7_undeclared",
    """
WITH d AS (SELECT 'app' || n_regionkey || '.' || n_name AS name FROM nation WHERE n_nationkey % 2 = 0),
r AS (SELECT 'app' || n_regionkey || '.' || n_name AS ref FROM nation UNION SELECT 'other.' || n_name FROM nation UNION SELECT r_name FROM region)
SELECT ref FROM r WHERE ref NOT IN (SELECT name FROM d) AND split_part(ref, '.', -1) NOT IN (SELECT name FROM d UNION SELECT split_part(name, '.', -1) FROM d)
""",
)(
    lambda t: (
        lambda name: relations.undeclared(
            t.nation.select(name.alias("ref")).union(t.nation.select(F.concat(F.lit("other."), "n_name"))).union(t.region.select("r_name")),
            t.nation.where("n_nationkey % 2 = 0").select(name.alias("name")),
        )
    )(F.concat(F.lit("app"), F.col("n_regionkey").cast("string"), F.lit("."), "n_name"))
)
query("j12_replays", "SELECT DISTINCT a.doc_id % 40 AS context_id, a.doc_id % 3 AS version, b.item_id AS probe_id FROM labels a JOIN benchmark b ON a.doc_id % 40 = b.item_id % 40")(
    lambda t: relations.replays(t.labels.select((F.col("doc_id") % 40).alias("context_id"), (F.col("doc_id") % 3).alias("version")).distinct(), t.benchmark.select((F.col("item_id") % 40).alias("context_id"), F.col("item_id").alias("probe_id")))
)
_TASKS = "t AS (SELECT text AS task, turn % 3 AS rubrics, conv_id * 100 + turn AS ord, CASE WHEN role = 'user' THEN 0 ELSE 1 END AS src FROM conversations)"
query("j14_distinct_tasks", f"WITH {_TASKS} SELECT task, rubrics, src, ord FROM (SELECT *, row_number() OVER (PARTITION BY task, rubrics ORDER BY src, ord) AS k FROM t) WHERE k = 1")(
    lambda t: (lambda c: relations.distinct_tasks(c.where("role = 'user'").drop("role"), c.where("role <> 'user'").drop("role")))(t.conversations.select(F.col("text").alias("task"), (F.col("turn") % 3).cast("long").alias("rubrics"), (F.col("conv_id") * 100 + F.col("turn")).alias("ord"), "role"))
)
query("u1_union_contexts", "SELECT doc_id % 90 AS context_id FROM labels UNION SELECT item_id FROM benchmark")(
    lambda t: relations.union_ids(t.labels.select((F.col("doc_id") % 90).alias("context_id")), t.benchmark.select(F.col("item_id").alias("context_id")))
)
query("u8_in_all_three", "SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels INTERSECT SELECT user_id FROM events ORDER BY 1 LIMIT 20")(
    lambda t: relations.in_all("doc_id", 20, t.documents, t.labels, t.events.select(F.col("user_id").alias("doc_id")))
)
query(
    "o9_hardest_and_easiest",
    """
WITH r AS (SELECT doc_id % 12 AS iteration, doc_id AS probe_id, quality = 1 AS passed, doc_id % 4 / 4.0 AS rate, doc_id % 5 AS n FROM labels)
SELECT iteration, arg_min(probe_id, (rate, n, probe_id)) FILTER (WHERE NOT passed) AS hardest, arg_min(probe_id, (n, probe_id)) FILTER (WHERE passed) AS easiest
FROM r GROUP BY 1
""",
)(lambda t: relations.hardest_and_easiest(t.labels.select((F.col("doc_id") % 12).alias("iteration"), F.col("doc_id").alias("probe_id"), (F.col("quality") == 1).alias("passed"), (F.col("doc_id") % 4 / 4.0).alias("rate"), (F.col("doc_id") % 5).alias("n_rubrics"))))
query("o11_shallowest_personas", "SELECT * FROM (SELECT doc_id, persona, depth, ord, row_number() OVER (PARTITION BY doc_id ORDER BY depth, ord) AS rank FROM (SELECT user_id AS doc_id, event_type AS persona, event_id % 3 AS depth, event_id AS ord FROM events)) WHERE rank <= 4")(
    lambda t: relations.shallowest(t.events.select(F.col("user_id").alias("doc_id"), F.col("event_type").alias("persona"), (F.col("event_id") % 3).alias("depth"), F.col("event_id").alias("ord")), 4)
)
query("o12_capped_children", "SELECT parent_id, node_id, ord FROM (SELECT *, row_number() OVER (PARTITION BY parent_id ORDER BY ord, node_id) AS k FROM (SELECT c_nationkey AS parent_id, c_custkey AS node_id, c_custkey % 10 AS ord FROM customer)) WHERE k <= 8")(
    lambda t: relations.capped_children(t.customer.select(F.col("c_nationkey").alias("parent_id"), F.col("c_custkey").alias("node_id"), (F.col("c_custkey") % 10).alias("ord")), 8)
)
query(
    "o13_tools_by_category",
    """
WITH c AS (SELECT CASE WHEN p_partkey % 5 = 0 THEN 'Uncategorized' ELSE p_brand END AS category, p_name FROM part),
g AS (SELECT category, string_agg(DISTINCT p_name, '|' ORDER BY p_name) AS tools FROM c GROUP BY 1)
SELECT category, row_number() OVER (ORDER BY category = 'Uncategorized', category) AS place, tools FROM g
""",
)(lambda t: relations.by_category(t.part.select(F.col("p_name").alias("name"), F.when(F.col("p_partkey") % 5 != 0, F.col("p_brand")).alias("category"))).withColumn("tools", F.array_join("tools", "|")))
_SUM = "SELECT count(*) AS n, round(avg(s), 6) AS mean, round(stddev_pop(s), 6) AS std, count_if(s < {0}) AS n_low, coalesce((SELECT string_agg(id, ',' ORDER BY s, id) FROM (SELECT * FROM x WHERE s < {0} ORDER BY s, id LIMIT 5)), '') AS examples FROM x"
query(
    "a12_similarity_summary",
    f"WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), x AS (SELECT a.vec_id AS id, round({COS.format('a.v', 'b.v')}, 6) AS s FROM e a JOIN e b ON b.vec_id = a.vec_id + 1 WHERE a.vec_id % 2 = 0) " + _SUM.format("0.3"),
)(lambda t: relations.similarity_summary(_neighbours(t), 0.3))
_A27 = f"x AS (SELECT conv_id, {TOK} AS w FROM conversations WHERE turn = 1), y AS (SELECT conv_id, {TOK} AS w FROM conversations WHERE turn = 3), j AS (SELECT x.conv_id AS l, y.conv_id AS r, round(len(list_intersect(x.w, y.w)) / len(list_distinct(x.w || y.w)), 6) AS s FROM x FULL JOIN y USING (conv_id))"
query("a27_compare_summary", f"WITH {_A27} SELECT count_if(l IS NOT NULL AND r IS NOT NULL) AS both, count_if(r IS NULL) AS left, count_if(l IS NULL) AS right, round(coalesce(avg(s) FILTER (WHERE l IS NOT NULL AND r IS NOT NULL), 0.0), 6) AS mean_jaccard FROM j")(
    lambda t: relations.compare_summary(taxonomy.compare_sides(t.conversations.where("turn = 1"), t.conversations.where("turn = 3"), "conv_id", "text"))
)
query(
    "a16_judged_means",
    "SELECT conv_id, score, flag OR score < 0.55 AS regenerate FROM (SELECT conv_id, conv_id % 6 = 0 AS flag, round(CASE WHEN conv_id % 5 = 0 OR conv_id % 7 = 0 THEN 0.5 ELSE (conv_id % 10 / 10.0 + conv_id % 3 / 3.0) / 2 END, 6) AS score FROM (SELECT DISTINCT conv_id FROM conversations))",
)(
    lambda t: (lambda i: t.conversations.select("conv_id").distinct().select("conv_id", relations.judged_mean(F.when(i % 5 == 0, F.array().cast("array<double>")).otherwise(F.array(F.when(i % 7 == 0, 1.5).otherwise(i % 10 / 10.0), i % 3 / 3.0)), i % 6 == 0, 0.5).alias("x")).select("conv_id", "x.*"))(F.col("conv_id"))
)
query("x15_target_per_document", "SELECT o_orderkey, greatest(ceil(o_custkey / (1 + o_orderkey % 40)), 1)::BIGINT AS target FROM orders")(lambda t: t.orders.select("o_orderkey", relations.target_per_document(F.col("o_custkey"), 1 + F.col("o_orderkey") % 40).alias("target")))
query("t4_evaluation_scores", f"WITH {enrich.SQL} " + " UNION ALL ".join(f"SELECT conv_id, '{m}' AS metric, {m}::DOUBLE AS value FROM r WHERE {m} IS NOT NULL" for m in enrich.METRICS))(lambda t: relations.evaluation_scores(t.rows(), list(enrich.METRICS)))
query("w3_rolling_lookback", "SELECT event_id, round(avg(value) OVER (ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 6) AS rolling FROM events WHERE event_type = 'click' AND ts > TIMESTAMP '2024-01-15 12:00:00' - INTERVAL 48 HOURS AND ts <= TIMESTAMP '2024-01-15 12:00:00'")(
    lambda t: relations.rolling_within(t.metrics(), "click", "2024-01-15 12:00:00", 48)
)
query("p14_agent_sft", "SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS messages, 'traj_' || conv_id AS trajectory_id FROM conversations GROUP BY 1")(lambda t: export.agent_sft(t.base().withColumn("trajectory_id", F.concat(F.lit("traj_"), F.col("conv_id").cast("string")))).withColumn("messages", flat("messages")))


def _neighbours(t: Tables):
    from ..functions.vectors import cosine

    e = t.embeddings
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    return e.where("vec_id % 2 = 0").join(b, "vec_id").select(F.col("vec_id").alias("id"), F.round(cosine(F.col("embedding"), F.col("next")), 6).alias("score"))
