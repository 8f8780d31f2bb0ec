"""Queries over stored data: exports, points, checkpoints, logs and metrics, each with the same result in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import drawing, exports, monitor, sampling
from ..operators.taxonomy import NODES
from ..sources import checkpoint, enrich, logs, points
from ..sources.shared import new_path
from ..streaming import metrics, weights
from .catalogue import _PAIR, SQL, Tables, _nodes, query, usage_of

# ---- exports


def conversation_lines(t: Tables) -> DataFrame:
    """Conversations as JSON lines; every 17th is cut off and is no JSON any more."""
    rows = enrich.rows(t.spark, t.dir).select("conv_id", F.to_json(F.struct("conversations", "instruction_context", "final_score")).alias("value"))
    return rows.select(F.when(F.col("conv_id") % 17 == 0, F.expr("left(value, length(value) - 5)")).otherwise(F.col("value")).alias("value"))


@query(
    "k3_export_counts",
    f"""
WITH {enrich.SQL}, {_PAIR}, g AS (SELECT * FROM r WHERE conv_id % 17 <> 0), n AS (SELECT count(*) AS input, count_if(conv_id % 17 = 0) AS malformed FROM r),
has AS (
  SELECT conv_id, bool_or(role = 'assistant') AS said, bool_or(role = 'user' AND text <> '') AND bool_or(role = 'assistant' AND text <> '') AS answered
  FROM conversations WHERE conv_id % 17 <> 0 GROUP BY 1
), k AS (SELECT conv_id, count(*) AS k FROM q WHERE conv_id % 17 <> 0 GROUP BY 1),
a AS (
  SELECT arg_min(text, turn) FILTER (WHERE role = 'user' AND text <> '') AS prompt, arg_max(text, turn) FILTER (WHERE role = 'assistant') AS response, final_score AS s
  FROM conversations JOIN g USING (conv_id) WHERE final_score IS NOT NULL AND len(c) >= 2 GROUP BY conv_id, final_score
), d AS (SELECT prompt FROM a WHERE prompt <> '' AND response <> '' GROUP BY 1 HAVING count(*) >= 2 AND round(max(s) - min(s), 6) >= 0.2),
o AS (
  SELECT 'sharegpt' AS format, count(*) AS output, count(*) AS kept FROM g
  UNION ALL SELECT 'oumi', count(*), count(*) FROM g
  UNION ALL SELECT 'raw', count(*), count(*) FROM g
  UNION ALL SELECT 'messages', count(*), count(*) FROM has WHERE said
  UNION ALL SELECT 'openai', count(*), count(*) FROM has WHERE said
  UNION ALL SELECT 'alpaca', count(*), count(*) FROM has WHERE answered
  UNION ALL SELECT 'alpaca_split', coalesce(sum(k), 0), count(*) FROM k
  UNION ALL SELECT 'llama_factory', count(*), count(*) FROM k
  UNION ALL SELECT 'dpo', (SELECT count(*) FROM d), count_if(final_score IS NOT NULL AND len(c) >= 2) FROM g
)
SELECT format, input, output::BIGINT AS output, input - kept AS skipped, malformed,
  CASE WHEN format <> 'dpo' THEN malformed WHEN output = 0 THEN 1 ELSE 0 END AS warnings,
  CASE WHEN format = 'dpo' AND output = 0 THEN '{exports.NO_PAIRS}' ELSE '' END AS note
FROM o, n
""",
)
def k3_export_counts(t: Tables) -> DataFrame:
    formats = ("sharegpt", "oumi", "raw", "messages", "openai", "alpaca", "alpaca_split", "llama_factory", "dpo")
    path = new_path(t.spark)
    out = exports.as_table(t.spark, exports.export_lines(conversation_lines(t), path, formats))
    exports.remove(t.spark, path)
    return out


# ---- points of a vector store


@query("s10_points", "SELECT vec_id AS id, label, len(embedding)::INTEGER AS size FROM embeddings WHERE label = 3 AND vec_id >= 10")
def s10_points(t: Tables) -> DataFrame:
    path = new_path(t.spark)
    points.index_points(t.embeddings.select(F.col("vec_id").alias("id"), "label", F.size("embedding").alias("size")), path)
    return points.scan_points(t.spark, path, "id long, label int, size int", {"label": 3}, low=10, page=64)


# ---- checkpoints

_TREE = """
SELECT 'geo' AS factor_id, 'root' AS node_id, NULL::VARCHAR AS parent_id, 0 AS depth, 'all' AS label
UNION ALL SELECT 'geo', 'r' || r_regionkey, 'root', 1, r_name FROM region
UNION ALL SELECT 'geo', 'n' || n_nationkey, 'r' || n_regionkey, 2, n_name FROM nation
UNION ALL SELECT 'geo', 'c' || c_custkey, 'n' || c_nationkey, 3, c_name FROM customer
"""


def tree(t: Tables) -> DataFrame:
    """Regions, nations and customers as one taxonomy."""
    key = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    leaves = t.customer.select(F.lit("geo"), key("c", "c_custkey"), key("n", "c_nationkey"), F.lit(3), "c_name")
    return _nodes(t).union(leaves)


@query("s13_checkpoint", _TREE)
def s13_checkpoint(t: Tables) -> DataFrame:
    root = new_path(t.spark)
    checkpoint.save(t.spark, root, {"taxonomy": tree(t), "strategy": t.region}, {"instruction": "all places"})
    return checkpoint.load(t.spark, root).tables["taxonomy"]


# ---- metrics


@query("s11_metric_lines", "SELECT event_type AS metric, ts, round(value, 6) AS value, 'model_' || (user_id % 5) AS model FROM events")
def s11_metric_lines(t: Tables) -> DataFrame:
    path = new_path(t.spark)
    logs.append_lines(t.metrics().select("metric", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"), "value", F.col("model").alias("model_name")), path)
    return logs.metric_lines(t.spark, path).select("metric", "ts", F.round("value", 6).alias("value"), "model")


@query("k6_metric_export", "SELECT event_type AS metric, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE ts >= TIMESTAMP '2024-01-15 12:00:00' GROUP BY 1")
def k6_metric_export(t: Tables) -> DataFrame:
    path = new_path(t.spark)
    logs.export_metrics(t.metrics(), path, "csv", since="2024-01-15 12:00:00")
    got = t.spark.read.schema("event_id long, ts string, value double, model string, metric string").csv(path, header=True)
    return got.groupBy("metric").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("t5_token_report", SQL["a23_token_usage"])
def t5_token_report(t: Tables) -> DataFrame:
    events = t.spark.readStream.schema(t.events.schema).parquet(f"{t.dir}/events.parquet*")
    return metrics.reported(monitor.token_usage(usage_of(events)))


@query(
    "t7_adaptive_weights",
    """
SELECT user_id::VARCHAR AS doc_id, count_if(event_id % 13 <> 0) AS used, bool_or(event_id % 13 = 0 AND user_id % 11 = 0) AS covered,
  CASE WHEN bool_or(event_id % 13 = 0 AND user_id % 11 = 0) THEN 0.0 WHEN user_id % 3 = 0 THEN 1.0 / (count_if(event_id % 13 <> 0) + 1)
    ELSE greatest(user_id % 9 * 5 - count_if(event_id % 13 <> 0), 0) END::DOUBLE AS weight
FROM events WHERE event_id % 13 <> 0 OR user_id % 11 = 0 GROUP BY user_id
""",
)
def t7_adaptive_weights(t: Tables) -> DataFrame:
    """The last weight of each document after all its uses."""
    events = t.spark.readStream.schema(t.events.schema).parquet(f"{t.dir}/events.parquet*")
    kind = F.when(F.col("event_id") % 13 != 0, "use").otherwise("cover")
    said = events.where("event_id % 13 <> 0 OR user_id % 11 = 0").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("ord"), kind.alias("event"), F.when(F.col("user_id") % 3 != 0, F.col("user_id") % 9 * 5).alias("target"))
    last = F.max_by(F.struct("used", "covered", "weight"), "ord").alias("x")
    return metrics.appended(weights.adaptive_weights(said)).groupBy("doc_id").agg(last).select("doc_id", "x.*")


# ---- stop rules and mixes

_STATE = """
i AS (SELECT user_id AS stream, event_id AS ord, value AS cost, event_id % 5 < 2 AS failed, event_type AS value FROM events),
f AS (SELECT *, row_number() OVER (PARTITION BY stream, value ORDER BY ord) = 1 AS new FROM i),
s AS (
  SELECT stream, ord, count_if(NOT failed) OVER w AS generated, count_if(failed) OVER w AS failures, count(*) OVER w AS events, sum(cost) OVER w AS spent, count_if(new) OVER w AS n_distinct
  FROM f WINDOW w AS (PARTITION BY stream ORDER BY ord)
)
"""


def _state(t: Tables) -> DataFrame:
    e = t.events
    items = e.select(F.col("user_id").alias("stream"), F.col("event_id").alias("ord"), F.col("value").alias("cost"), (F.col("event_id") % 5 < 2).alias("failed"), F.col("event_type").alias("value"))
    return sampling.running_state(items)


@query("t6_error_rate_stop", f"WITH {_STATE} SELECT stream, min(ord) AS ord FROM s WHERE generated >= 10 AND failures >= 0.45 * events GROUP BY 1")
def t6_error_rate_stop(t: Tables) -> DataFrame:
    return sampling.first_stop(_state(t), sampling.error_rate_at_least(0.45, 10))


@query("t6_all_of_stop", f"WITH {_STATE} SELECT stream, min(ord) AS ord FROM s WHERE spent >= 300 AND n_distinct >= 4 AND generated >= 12 GROUP BY 1")
def t6_all_of_stop(t: Tables) -> DataFrame:
    return sampling.first_stop(_state(t), sampling.spent_at_least(300.0), sampling.distinct_at_least(4), sampling.generated_at_least(12), every=True)


STRATEGIES = [drawing.Strategy("place", 1.0, ("geo",)), drawing.Strategy("both", 3.0, ("geo", "brand"), (("nation_1", "#1"), ("_2", "#2")))]


@query(
    "c3_mixes",
    """
WITH geo AS (SELECT 'n' || n_nationkey AS node_id, n_name AS label, row_number() OVER (ORDER BY 'n' || n_nationkey) - 1 AS place FROM nation),
brand AS (SELECT 'b' || p_brand AS node_id, p_brand AS label, row_number() OVER (ORDER BY 'b' || p_brand) - 1 AS place FROM (SELECT DISTINCT p_brand FROM part)),
i AS (SELECT doc_id AS mix_id, CASE WHEN ('0x' || substr(md5('42|strategy|' || doc_id), 1, 8))::BIGINT / 4294967296.0 * 4 < 1 THEN 'place' ELSE 'both' END AS strategy FROM documents),
a AS (
  SELECT mix_id, strategy, k AS attempt,
    floor(('0x' || substr(md5('42|' || k || '|' || mix_id || '|geo'), 1, 8))::BIGINT / 4294967296.0 * (SELECT count(*) FROM geo))::BIGINT AS g,
    floor(('0x' || substr(md5('42|' || k || '|' || mix_id || '|brand'), 1, 8))::BIGINT / 4294967296.0 * (SELECT count(*) FROM brand))::BIGINT AS b
  FROM i, range(50) t(k)
), d AS (
  SELECT mix_id, strategy, attempt, geo.node_id || CASE WHEN strategy = 'both' THEN '|' || brand.node_id ELSE '' END AS nodes, lower(geo.label || ' ' || brand.label) AS labels
  FROM a JOIN geo ON geo.place = g JOIN brand ON brand.place = b
)
SELECT mix_id, strategy, min(attempt)::INTEGER AS attempt, arg_min(nodes, attempt) AS nodes FROM d
WHERE strategy = 'place' OR NOT (contains(labels, 'nation_1') AND contains(labels, '#1') OR contains(labels, '_2') AND contains(labels, '#2')) GROUP BY 1, 2
""",
)
def c3_mixes(t: Tables) -> DataFrame:
    brands = t.part.select("p_brand").distinct().select(F.lit("brand").alias("factor_id"), F.concat(F.lit("b"), "p_brand").alias("node_id"), F.lit("brands").alias("parent_id"), F.lit(1).alias("depth"), F.col("p_brand").alias("label"))
    top = t.spark.createDataFrame([("brand", "brands", None, 0, "all")], NODES)
    got = drawing.mixes(t.documents.select(F.col("doc_id").alias("mix_id")), _nodes(t).union(top).union(brands), STRATEGIES)
    return got.withColumn("nodes", F.array_join(F.transform("entries", lambda e: e["node_id"]), "|")).drop("entries")


@query("c4_one_scenario", "SELECT conv_id AS mix_id, arg_min(turn, (('0x' || substr(md5('42|' || conv_id || '|' || turn), 1, 8))::BIGINT, turn)) AS meta_id, arg_min(text, (('0x' || substr(md5('42|' || conv_id || '|' || turn), 1, 8))::BIGINT, turn)) AS text FROM conversations GROUP BY 1")
def c4_one_scenario(t: Tables) -> DataFrame:
    return drawing.one_scenario(t.conversations.select(F.col("conv_id").alias("mix_id"), F.col("turn").alias("meta_id"), "text"))
