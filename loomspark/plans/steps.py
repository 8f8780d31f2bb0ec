"""Queries over steps of a generation run: documents, trajectories, gates, numbers, logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import json as J
from ..functions import text as T
from ..operators import preference, prompts, quality, relations, rules, vectors
from ..sources import logs, readers
from ..sources.shared import new_path
from .catalogue import _PP, COS, Tables, _pairs, query
from .related import _neighbours

# ---- documents and metadata


@query(
    "s9_documents",
    r"""
WITH l AS (SELECT doc_id, text, row_number() OVER (ORDER BY doc_id) AS line FROM documents)
SELECT line, sha256(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS digest FROM l WHERE doc_id % 13 <> 0 AND regexp_replace(text, '^\s+|\s+$', '', 'g') <> ''
""",
)
def s9_documents(t: Tables) -> DataFrame:
    """Documents of a file of JSON lines, by line; every 13th line is cut off."""
    path = new_path(t.spark)
    line = F.to_json(F.struct("text", "lang"))
    rows = t.documents.select("doc_id", F.when(F.col("doc_id") % 13 == 0, F.left(line, F.length(line) - 3)).otherwise(line).alias("value"))
    rows.orderBy("doc_id").coalesce(1).select("value").write.text(path)  # one file, as the query is about its lines
    got = readers.document_jsonl(t.spark, path, preserve_ids=False)
    return got.select(F.regexp_extract("doc_id", r":(\d+)$", 1).cast("long").alias("line"), F.sha2("text", 256).alias("digest"))


@query("x27_metadata_page", "SELECT event_id, props FROM events WHERE json_extract_string(props, '$.k') = '42'")
def x27_metadata_page(t: Tables) -> DataFrame:
    rows = t.events.select("event_id", F.col("props").alias("metadata"))
    return readers.page(rows, {"metadata.k": 42}).withColumnRenamed("metadata", "props")


@query("x9_object_digests", """SELECT event_id, sha256('{"event":"' || event_type || '","k":' || json_extract_string(props, '$.k') || ',"user":' || user_id || '}') AS digest FROM events""")
def x9_object_digests(t: Tables) -> DataFrame:
    """The keys stand in two orders; the digest is the same."""
    k = F.get_json_object("props", "$.k")
    one = F.format_string('{"user": %d, "k": %s, "event": "%s"}', "user_id", k, "event_type")
    other = F.format_string('{ "event":"%s",\n"user":%d,"k":%s}', "event_type", "user_id", k)
    return t.events.select("event_id", J.object_digest(F.when(F.col("event_id") % 2 == 0, one).otherwise(other)).alias("digest"))


@query("o10_page_with_total", "SELECT o_orderkey, o_orderdate, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS total FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 40")
def o10_page_with_total(t: Tables) -> DataFrame:
    return readers.page_with_total(t.orders.select("o_orderkey", "o_orderdate", "o_orderstatus"), {"o_orderstatus": "F"}, [("o_orderdate", -1), ("o_orderkey", 1)], 20, 40).drop("o_orderstatus")


# ---- trajectories and tools

_CALLS = "user_id % 3 AS app, event_type AS action"


@query(
    "p25_trajectories",
    """
WITH s AS (
  SELECT event_id // 4 AS tid, event_id,
    'assistant: Thought: ' || event_type || CASE WHEN event_id % 4 < 2 THEN chr(10) || 'Action: app' || (user_id % 3) || '.' || event_type || chr(10) || 'Action Input: ' || props ELSE '' END
      || CASE WHEN event_id % 4 < 2 THEN chr(10) || 'user: Observation: ' || (event_id % 10) ELSE '' END AS said
  FROM events
)
SELECT tid::VARCHAR AS trajectory_id,
  'user: task ' || tid || chr(10) || string_agg(said, chr(10) ORDER BY event_id) || CASE WHEN tid % 3 = 0 THEN '' ELSE chr(10) || 'assistant: Final Answer: done ' || count(*) END AS said,
  CASE WHEN tid % 5 = 0 THEN '{"passed":true}' END AS verdict
FROM s GROUP BY tid
""",
)
def p25_trajectories(t: Tables) -> DataFrame:
    i = F.col("event_id")
    used = i % 4 < 2
    step = F.struct(F.col("event_type").alias("thought"), F.when(used, F.concat(F.lit("app"), (F.col("user_id") % 3).cast("string"), F.lit("."), "event_type")).alias("tool"), F.when(used, F.col("props")).alias("arguments"), F.when(used, (i % 10).cast("string")).alias("observation"))
    g = t.events.groupBy(F.floor(i / 4).alias("tid")).agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", step.alias("step")))), lambda x: x["step"]).alias("turns"))
    tid = F.col("tid")
    answer = F.when(tid % 3 != 0, F.concat(F.lit("done "), F.size("turns").cast("string")))
    rows = g.select(tid.cast("string").alias("trajectory_id"), F.concat(F.lit("task "), tid.cast("string")).alias("task"), F.col("turns").cast(f"array<{prompts.STEP}>").alias("turns"), answer.alias("final_answer"), F.when(tid % 5 == 0, '{"passed":true}').alias("verdict"))
    said = F.array_join(F.transform("conversations", lambda x: F.concat(x["role"], F.lit(": "), x["content"])), "\n")
    return prompts.trajectory_conversations(rows).select("trajectory_id", said.alias("said"), F.col("metadata")["judge_verdict"].alias("verdict"))


@query(
    "p30_tool_documentation",
    """
SELECT r_name AS app, r_regionkey AS app_ord, '### App: ' || r_name || chr(10) || 'Description: region ' || r_regionkey || chr(10) || 'Actions:' || chr(10)
  || string_agg('- `' || r_name || '.' || n_name || '(id: integer' || CASE WHEN n_nationkey % 2 = 0 THEN ', note: string (optional)' ELSE '' END || ')`: about ' || n_name, chr(10) ORDER BY n_nationkey) || chr(10) AS documentation
FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1, 2
""",
)
def p30_tool_documentation(t: Tables) -> DataFrame:
    field = lambda name, kind, required: F.struct(F.lit(name).alias("name"), F.lit(kind).alias("type"), F.lit(required).alias("required"))
    parameters = F.when(F.col("n_nationkey") % 2 == 0, F.array(field("id", "integer", True), field("note", "string", False))).otherwise(F.array(field("id", "integer", True)))
    met = t.region.join(t.nation, F.col("n_regionkey") == F.col("r_regionkey"))
    return prompts.tool_documentation(met.select(F.col("r_name").alias("app"), F.col("r_regionkey").alias("app_ord"), F.concat(F.lit("region "), F.col("r_regionkey").cast("string")).alias("app_description"), F.col("n_name").alias("action"), F.col("n_nationkey").alias("action_ord"), F.concat(F.lit("about "), "n_name").alias("description"), parameters.alias("parameters")))


# ---- gates


@query("f5_language_mismatch", "SELECT count(*) AS n, count_if(lang <> 'en') AS n_mismatched, (SELECT string_agg(doc_id, ',' ORDER BY doc_id) FROM (SELECT doc_id FROM documents WHERE lang <> 'en' ORDER BY doc_id LIMIT 5)) AS examples FROM documents")
def f5_language_mismatch(t: Tables) -> DataFrame:
    """The table's language stands for what a detector gives."""
    return quality.language_mismatch(t.documents.select(F.col("doc_id").alias("id"), F.col("lang").alias("detected")), "en")


_LOW = "SELECT count(*) AS n, round(avg(s), 6) AS mean, round(stddev_pop(s), 6) AS std, count_if(s < 0.5) AS n_low, coalesce((SELECT string_agg(id, ',' ORDER BY s, id) FROM (SELECT * FROM x WHERE s < 0.5 ORDER BY s, id LIMIT 5)), '') AS examples FROM x"


@query("f6_low_coherence", f"WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), x AS (SELECT a.vec_id AS id, round({COS.format('a.v', 'b.v')}, 6) AS s FROM e a JOIN e b ON b.vec_id = a.vec_id + 1 WHERE a.vec_id % 2 = 0) {_LOW}")
def f6_low_coherence(t: Tables) -> DataFrame:
    return relations.similarity_summary(_neighbours(t), 0.5)


@query("f7_double_critic", "SELECT doc_id, quality = 1 AND toxic <> 1 AS accepted FROM labels")
def f7_double_critic(t: Tables) -> DataFrame:
    return t.labels.select("doc_id", rules.doubly_accepted(F.col("quality") == 1, F.col("toxic") == 1).alias("accepted"))


@query("f8_last_verdict", "SELECT conv_id, arg_max(length(text) % 3 > 0, turn) AS satisfied FROM conversations GROUP BY 1")
def f8_last_verdict(t: Tables) -> DataFrame:
    g = t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", (F.length("text") % 3 > 0).alias("ok")))).alias("x"))
    return g.select("conv_id", rules.last_verdict(F.transform("x", lambda v: v["ok"])).alias("satisfied"))


@query(
    "f17_five_descriptions",
    r"""
WITH w AS (SELECT doc_id, list_transform(regexp_split_to_array(text, '\n'), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))) AS l FROM documents),
d AS (SELECT doc_id, list_filter(l, lambda x, i: x <> '' AND list_position(l, x) = i) AS l FROM w)
SELECT doc_id, CASE WHEN len(l) >= 5 THEN array_to_string(l[1:5], '|') END AS five FROM d
""",
)
def f17_five_descriptions(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.array_join(rules.five_descriptions(F.split("text", "\n")), "|").alias("five"))


# ---- texts and numbers


@query("x4_personas", "SELECT event_id, 'a ' || event_type || '|user ' || user_id AS personas FROM events")
def x4_personas(t: Tables) -> DataFrame:
    said = F.concat(F.lit("Here:\nPersona 1: a "), "event_type", F.lit("\nno persona\nPersona 12:  user "), F.col("user_id").cast("string"))
    return t.events.select("event_id", F.array_join(T.numbered_personas(said), "|").alias("personas"))


@query("x8_front_matter", "SELECT doc_id, text FROM documents")
def x8_front_matter(t: Tables) -> DataFrame:
    whole = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("---\nname: x\ntags: [a]\n---\n"), "text")).otherwise(F.col("text"))
    return t.documents.select("doc_id", T.front_matter_removed(whole).alias("text"))


@query("x16_temperatures", "SELECT n_nationkey, string_agg('temperature_' || printf('%.2f', 0.1 + i * 0.8 / greatest(n_regionkey + 1, 1)), '|' ORDER BY i) AS labels FROM nation, range(6) t(i) WHERE i <= n_regionkey + 1 GROUP BY 1")
def x16_temperatures(t: Tables) -> DataFrame:
    n = t.nation
    labels = F.when(F.lit(False), F.lit(None).cast("string"))
    for r in range(5):  # as many strategies as the region's number and two
        labels = labels.when(F.col("n_regionkey") == r, F.array_join(F.transform(rules.temperatures(r + 2), lambda x: x["label"]), "|"))
    return n.select("n_nationkey", labels.alias("labels"))


@query(
    "x19_numbers",
    """
SELECT o_orderkey, printf('%.0f', o_totalprice / 8.0) AS label, printf('%.2f', o_totalprice / 64.0) AS price,
  CASE WHEN o_custkey * 50 >= 10000 THEN printf('%.1f', o_custkey * 50 / 1000.0::DOUBLE) || 'k' ELSE (o_custkey * 50)::VARCHAR END AS customers
FROM orders
""",
)
def x19_numbers(t: Tables) -> DataFrame:
    price = F.col("o_totalprice")
    return t.orders.select("o_orderkey", T.fixed(price / 8.0, 0).alias("label"), T.chart_number(price / 64.0, False).alias("price"), T.chart_number(F.col("o_custkey") * 50, True).alias("customers"))


@query("c8_random_turns", "SELECT conv_id, floor(('0x' || substr(md5('42|turns|' || conv_id), 1, 8))::BIGINT / 4294967296.0 * 6)::BIGINT + 1 AS turns FROM conversations WHERE turn = 0")
def c8_random_turns(t: Tables) -> DataFrame:
    return t.conversations.where("turn = 0").select("conv_id", rules.random_turns(F.col("conv_id"), 6).alias("turns"))


@query(
    "x18_regenerated_settings",
    """
WITH c AS (SELECT doc_id, doc_id % 5 AS s, CASE WHEN doc_id % 3 > 0 THEN doc_id % 10 / 10.0 END AS p, CASE WHEN doc_id % 4 > 0 THEN doc_id % 40 * 100 END AS w, CASE WHEN doc_id % 7 > 0 THEN doc_id % 12 END AS k FROM documents)
SELECT doc_id, round(CASE WHEN s = 0 THEN least(coalesce(p, 0.9) * 0.9, 0.7) ELSE p END, 6)::DOUBLE AS top_p,
  round(CASE s WHEN 1 THEN least(coalesce(w, 1000) * 1.5, 4000) WHEN 2 THEN least(coalesce(w, 1000) * 1.2, 3000) ELSE w END, 6)::DOUBLE AS context_window,
  CASE WHEN s = 1 THEN least(coalesce(k, 3) + 2, 10) ELSE k END::DOUBLE AS retrieval_k, CASE WHEN s = 4 THEN 2 ELSE 0 END::INTEGER AS n_blocked
FROM c
""",
)
def x18_regenerated_settings(t: Tables) -> DataFrame:
    i = F.col("doc_id")
    strategy = F.get(F.array(*map(F.lit, ("coherence", "grounding", "relevance", "factuality", "safety"))), (i % 5).cast("int"))
    x = prompts.regenerated_settings(strategy, F.when(i % 3 > 0, i % 10 / 10.0), F.when(i % 4 > 0, i % 40 * 100), F.when(i % 7 > 0, i % 12))
    rows = t.documents.select("doc_id", x.alias("x"))
    return rows.select("doc_id", F.round("x.top_p", 6).alias("top_p"), F.round("x.context_window", 6).alias("context_window"), "x.retrieval_k", F.size(F.coalesce("x.safety_settings", F.array().cast("array<struct<category:string,threshold:string>>"))).alias("n_blocked"))


# ---- retrieval and logs


@query(
    "o5_retrieved_texts",
    f"""
WITH s AS (SELECT a.vec_id AS query_id, b.vec_id AS item_id, round({COS.format('a.embedding::DOUBLE[]', 'b.embedding::DOUBLE[]')}, 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM s WHERE score >= 0.2)
SELECT query_id, string_agg(text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context FROM k JOIN documents ON doc_id = item_id WHERE rank <= 3 AND text IS NOT NULL GROUP BY 1
""",
)
def o5_retrieved_texts(t: Tables) -> DataFrame:
    e = t.embeddings
    hits = vectors.top_k(e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), e.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("v")), 3, 0.2)
    return vectors.with_texts(hits, t.documents.select(F.col("doc_id").alias("item_id"), "text"))


@query("k1_appended", "SELECT conv_id, turn, role, text FROM conversations")
def k1_appended(t: Tables) -> DataFrame:
    """Two appends to one log, read back."""
    path, c = new_path(t.spark), t.conversations
    for rest in (0, 1):
        logs.append_lines(c.where(F.col("conv_id") % 2 == rest), path)
    return t.spark.read.schema(c.schema).json(path)


@query("k11_skill_versions", "SELECT doc_id % 30 AS context_id, doc_id % 4 AS version, max(doc_id) AS ord, arg_max(quality, doc_id) AS quality FROM labels GROUP BY 1, 2")
def k11_skill_versions(t: Tables) -> DataFrame:
    """A log of skill versions by context: appended twice, the last row of each version counts."""
    root = new_path(t.spark)
    rows = t.labels.select((F.col("doc_id") % 30).alias("context_id"), (F.col("doc_id") % 4).alias("version"), F.col("doc_id").alias("ord"), "quality")
    for rest in (0, 1):
        logs.append_skill_log(rows.where(F.col("ord") % 2 == rest), root, "versions")
    got = logs.skill_log(t.spark, root, "versions", "version long, ord long, quality int", "version")
    return got.withColumn("context_id", F.col("context_id").cast("long"))


@query("k13_preference_log", f"WITH {_PP} SELECT count(*) AS n_pairs, 1::BIGINT AS n_analytics, (SELECT count(*) FROM pp WHERE valid) AS n_written, (SELECT count(*) FROM pp WHERE valid) AS n_valid FROM pp")
def k13_preference_log(t: Tables) -> DataFrame:
    pairs, path = _pairs(t), new_path(t.spark)
    preference.save(pairs, preference.as_dpo(pairs), path, f"{path}-log")
    log = t.spark.read.text(f"{path}-log").select(F.get_json_object("value", "$._analytics.valid").cast("long").alias("valid"))
    counts = log.agg(F.count_if(F.col("valid").isNull()).alias("n_pairs"), F.count("valid").alias("n_analytics"), F.max("valid").alias("n_valid"))
    return counts.join(F.broadcast(t.spark.read.json(path).agg(F.count("*").alias("n_written"))))
