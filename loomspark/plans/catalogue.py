"""Queries over the test tables, each with the same result in SQL where SQL has a form for it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import analytics, export, generation, monitor, preference, quality, rules, sampling, taxonomy, traces, vectors
from ..sources import enrich, readers
from ..streaming import metrics as streaming
from .session import ship

QUERIES: dict = {}
SQL: dict[str, str] = {}
TOK = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+')"


def query(name: str, sql: str | None = None):
    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(Tables(spark, sf_dir))

        run.__name__, run.module = name, f.__module__
        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return f

    return add


class Tables:
    """The tables of one folder, and frames derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = ship(spark), sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def rows(self) -> DataFrame:
        return enrich.rows(self.spark, self.dir)

    def base(self) -> DataFrame:
        return enrich.with_context(enrich.conversations(self.conversations))

    def metrics(self) -> DataFrame:
        e = self.events
        return e.select("event_id", F.col("event_type").alias("metric"), "ts", "value", F.concat(F.lit("model_"), (F.col("user_id") % 5).cast("string")).alias("model"))

    def turn_vectors(self) -> DataFrame:
        t = self.conversations.withColumn("vec_id", (F.col("conv_id") * 8 + F.col("turn")) % 500)
        return t.join(self.embeddings.select("vec_id", F.col("embedding").alias("vec")), "vec_id")


METRIC = "m AS (SELECT event_id, event_type AS metric, ts, value, 'model_' || (user_id % 5) AS model FROM events)"
VEC = "tv AS (SELECT conv_id, turn, role, text, embedding::DOUBLE[] AS vec FROM conversations JOIN embeddings ON vec_id = (conv_id * 8 + turn) % 500)"
COS = "coalesce(list_dot_product({0}, {1}) / nullif(sqrt(list_dot_product({0}, {0})) * sqrt(list_dot_product({1}, {1})), 0), 0.0)"
FLAT = "array_to_string(list_transform({0}, lambda x: x.role || ': ' || x.content), chr(10))"


def flat(c, role="role", content="content"):
    return F.array_join(F.transform(c, lambda x: F.concat(x[role], F.lit(": "), x[content])), "\n")


# ---- analytics

query("a1_summary", f"WITH {enrich.SQL}, t AS (SELECT conv_id, count(*) AS t, sum(len({TOK})) AS w FROM conversations GROUP BY 1) SELECT count(*) AS n_conversations, sum(t)::BIGINT AS n_turns, round(sum(t) / count(*), 6) AS avg_turns, sum(w)::BIGINT AS n_words, round(sum(w) / sum(t), 6) AS avg_words_per_turn, count(DISTINCT persona) AS n_personas, count(DISTINCT context_id) AS n_contexts FROM r JOIN t USING (conv_id)")(lambda t: analytics.summary(t.rows()))
query("a2_personas", f"WITH {enrich.SQL}, c AS (SELECT persona, count(*) AS n, min(conv_id) AS f FROM r WHERE persona IS NOT NULL GROUP BY 1) SELECT persona, n, row_number() OVER (ORDER BY n DESC, f) AS rank FROM c")(lambda t: analytics.persona_counts(t.rows()))
query("a2_depth", f"WITH {enrich.SQL} SELECT depth, count(*) AS n FROM r GROUP BY 1")(lambda t: analytics.depth_histogram(t.rows()))
_COV = "SELECT count(*) AS n_contexts, count_if(n = 1) AS used_once, count_if(n > 1) AS used_multiple FROM (SELECT x, count(*) AS n FROM (SELECT unnest({0}) AS x FROM r) GROUP BY 1)"
query("a3_coverage_compat", f"WITH {enrich.SQL} " + _COV.format("[context_id] || context_ids"))(lambda t: analytics.coverage(t.rows()))
query("a3_coverage_dedup", f"WITH {enrich.SQL} " + _COV.format("list_distinct([context_id] || context_ids)"))(lambda t: analytics.coverage(t.rows(), dedup=True))
query("a4_grades", f"WITH {enrich.SQL} SELECT grade, count(*) AS n FROM r WHERE grade IS NOT NULL GROUP BY 1")(lambda t: analytics.grade_counts(t.rows()))
query("a4_metric_means", f"WITH {enrich.SQL}, l AS (" + " UNION ALL ".join(f"SELECT '{m}' AS metric, {m} AS s FROM r WHERE grade IS NOT NULL" for m in enrich.METRICS) + ") SELECT metric, round(avg(s), 6) AS mean, count(s) AS n FROM l GROUP BY 1")(lambda t: analytics.metric_means(t.rows(), enrich.METRICS))
_HIST = "l AS (SELECT min(v) AS lo, max(v) AS hi FROM v), b AS (SELECT {0} least(floor((v - lo) / ((hi - lo) / 10))::BIGINT, 9) AS bin, count(*) AS n FROM v, l GROUP BY ALL), g AS (SELECT {0} i::BIGINT AS bin, round(round(lo, 6) + i * round((hi - lo) / 10, 6), 6) AS edge FROM {1} range(10) t(i), l) SELECT {0} g.bin, edge, coalesce(n, 0)::BIGINT AS n FROM g LEFT JOIN b USING ({0} bin)"
query("a9_score_hist", f"WITH {enrich.SQL}, v AS (SELECT final_score AS v FROM r WHERE final_score IS NOT NULL), " + _HIST.format("", ""))(lambda t: analytics.histogram(t.rows(), "final_score"))
query("a8_length_hist", f"WITH v AS (SELECT role, len({TOK})::DOUBLE AS v FROM conversations), " + _HIST.format("role,", "(SELECT DISTINCT role FROM v),"))(lambda t: analytics.histogram(t.conversations.select("role", T.word_count(F.col("text")).alias("w")), "w", by=["role"]))
_VOC = "SELECT {0} sum(n)::BIGINT AS n_tokens, count(*) AS n_distinct, round(count(*) / sum(n), 6) AS ttr, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) AS entropy FROM (SELECT {0} w, count(*) AS n FROM (SELECT {0} unnest({1}) AS w FROM {2}) GROUP BY ALL) GROUP BY ALL"
query("a5_a6_vocabulary", _VOC.format("", TOK, "conversations"))(lambda t: analytics.vocabulary(t.conversations))
query("a5_a6_vocabulary_by_lang", _VOC.format("lang,", TOK, "documents"))(lambda t: analytics.vocabulary(t.documents, ["lang"]))
query("a7_bigram_repetition", f"WITH w AS (SELECT conv_id, turn, unnest({TOK}) AS w, unnest(range(len({TOK}))) AS i FROM conversations), b AS (SELECT w || ' ' || lead(w) OVER (ORDER BY conv_id, turn, i) AS b FROM w), c AS (SELECT b, count(*) AS n FROM b WHERE b IS NOT NULL GROUP BY 1) SELECT sum(n)::BIGINT AS n_bigrams, round(sum(CASE WHEN n > 1 THEN n ELSE 0 END) / sum(n), 6) AS repetition FROM c")(lambda t: analytics.bigram_repetition(t.conversations, ["conv_id", "turn"]))
query("a8_lengths", f"SELECT role, count(*) AS n, round(avg(w), 6) AS mean, min(w)::BIGINT AS least, max(w)::BIGINT AS most FROM (SELECT role, len({TOK}) AS w FROM conversations) GROUP BY 1")(lambda t: analytics.word_lengths(t.conversations))
query("a10_char_lengths", "SELECT role, round(avg(n), 6) AS mean, round(stddev_pop(n), 6) AS std, min(n)::BIGINT AS least, max(n)::BIGINT AS most, count_if(n < 50 OR n > 2000) AS outliers FROM (SELECT role, length(text) AS n FROM conversations) GROUP BY 1")(lambda t: analytics.char_lengths(t.conversations))
query("f4_outliers", "SELECT conv_id, turn, role, length(text)::BIGINT AS n FROM conversations WHERE length(text) < 50 OR length(text) > 2000")(lambda t: analytics.length_outliers(t.conversations))
query("a11_turn_balance", "SELECT role, count(*) AS n, round(count(*) / (SELECT count(*) FROM conversations), 6) AS share FROM conversations GROUP BY 1")(lambda t: analytics.turn_balance(t.conversations))
query("u7_exact_duplicates", "SELECT sha256(text) AS digest, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")(lambda t: analytics.exact_duplicates(t.documents))
query("o3_most_common_tokens", f"SELECT w AS token, count(*) AS n FROM (SELECT unnest({TOK}) AS w FROM conversations) GROUP BY 1 ORDER BY n DESC, token LIMIT 15")(lambda t: analytics.token_counts(t.conversations).orderBy(F.desc("n"), "token").limit(15))

# ---- formats

_BASE = "r0 AS (SELECT conv_id, list(struct_pack(role := role, content := text) ORDER BY turn) AS c FROM conversations GROUP BY 1)"
_PAIR = "p AS (SELECT conv_id, turn, text AS u, lead(text) OVER w AS a, role, lead(role) OVER w AS nr FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), q AS (SELECT conv_id, turn, u, a, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k FROM p WHERE role = 'user' AND nr = 'assistant')"
_GPT = "CASE role WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'gpt' ELSE role END"
query("p1_sharegpt", f"WITH a AS (SELECT *, {_GPT} AS f FROM conversations), b AS (SELECT *, CASE WHEN f = lag(f) OVER (PARTITION BY conv_id ORDER BY turn) THEN 0 ELSE 1 END AS new FROM a), c AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY turn) AS g FROM b), d AS (SELECT conv_id, g, any_value(f) AS f, string_agg(text, chr(10) ORDER BY turn) AS v FROM c GROUP BY 1, 2) SELECT conv_id, string_agg(f || ': ' || v, chr(10) ORDER BY g) AS said, count(*) AS n FROM d GROUP BY 1")(lambda t: export.sharegpt(t.base()).select("conv_id", flat("conversations", "from", "value").alias("said"), F.size("conversations").cast("long").alias("n")))
query("p11_sharegpt_plain", f"SELECT conv_id, string_agg({_GPT} || ': ' || text, chr(10) ORDER BY turn) AS said FROM conversations GROUP BY 1")(lambda t: export.sharegpt_plain(t.base()).select("conv_id", flat("conversations", "from", "value").alias("said")))
_FIRST = "arg_min(text, turn) FILTER (WHERE role = '{0}' AND text <> '')"
query("p2_alpaca", f"WITH f AS (SELECT conv_id, {_FIRST.format('user')} AS instruction, {_FIRST.format('assistant')} AS output FROM conversations GROUP BY 1) SELECT conv_id, instruction, coalesce({enrich.CONTEXT_SQL}, '') AS input, output FROM f WHERE instruction IS NOT NULL AND output IS NOT NULL")(lambda t: export.alpaca(t.base()))
query("p12_alpaca_all", f"SELECT conv_id, coalesce({_FIRST.format('user')}, '') AS instruction, '' AS input, coalesce({_FIRST.format('assistant')}, '') AS output FROM conversations GROUP BY 1")(lambda t: export.alpaca_all(t.base()))
query(
    "p3_alpaca_split",
    f"""
WITH {_PAIR}, h AS (
  SELECT q.conv_id, q.k, q.u, q.a, (SELECT string_agg('User: ' || x.u || chr(10) || 'Assistant: ' || x.a, chr(10) ORDER BY x.k) FROM q x WHERE x.conv_id = q.conv_id AND x.k < q.k) AS told FROM q
)
SELECT conv_id, k AS pair, u AS instruction, a AS output,
  concat_ws(chr(10) || chr(10), 'Previous conversation:' || chr(10) || told, 'Context: ' || {enrich.CONTEXT_SQL}) AS input
FROM h
""",
)(lambda t: export.alpaca_split(t.base()))
query("p4_messages", f"WITH {_BASE} SELECT conv_id, {FLAT.format('c')} AS said FROM r0 WHERE len(list_filter(c, lambda x: x.role = 'assistant')) > 0")(lambda t: export.messages(t.base()).select("conv_id", flat("messages").alias("said")))
query("p6_messages_all", f"WITH {_BASE} SELECT conv_id, 'system: Be brief.' || chr(10) || {FLAT.format('c')} AS said FROM r0")(lambda t: export.messages_all(t.base(), system="Be brief.").select("conv_id", flat("messages").alias("said")))
query("p7_llama_factory", f"WITH {_PAIR}, m AS (SELECT conv_id, max(k) AS k FROM q GROUP BY 1) SELECT q.conv_id, q.u AS instruction, coalesce({enrich.CONTEXT_SQL.replace('conv_id', 'q.conv_id')}, '') AS input, q.a AS output, coalesce((SELECT string_agg(x.u || '|' || x.a, chr(10) ORDER BY x.k) FROM q x WHERE x.conv_id = q.conv_id AND x.k < q.k), '') AS history FROM q JOIN m USING (conv_id, k)")(lambda t: export.llama_factory(t.base()).withColumn("history", F.array_join(F.transform("history", lambda h: F.array_join(h, "|")), "\n")))
query("p10_warnings", f"WITH {_BASE} SELECT * FROM (SELECT conv_id, concat_ws('; ', CASE WHEN len(list_filter(c, lambda x: x.role = 'assistant')) = 0 THEN 'no assistant turn' END, CASE WHEN len(list_filter(c, lambda x: x.content = '')) > 0 THEN 'empty content' END, CASE WHEN c[1].role = 'assistant' THEN 'starts with assistant' END) AS warnings FROM r0) WHERE warnings <> ''")(lambda t: export.warnings(t.base()).withColumn("warnings", F.array_join("warnings", "; ")))
query("p18_agent_dpo", f"WITH {_BASE}, s AS (SELECT conv_id, c[1].content AS prompt, list_transform(c[2:], lambda x: x.content) AS rest FROM r0) SELECT conv_id, prompt, array_to_string(rest, chr(10)) AS chosen, CASE WHEN len(rest) > 1 THEN array_to_string(rest[:len(rest) // 2], chr(10)) ELSE 'Unable to fulfill request.' END AS rejected, 'traj_' || conv_id AS trajectory_id FROM s")(lambda t: export.agent_dpo(t.base().withColumn("trajectory_id", F.concat(F.lit("traj_"), F.col("conv_id").cast("string")))))
query("a20_dpo_pairs", f"WITH {enrich.SQL}, a AS (SELECT prompt, final_score AS s, conv_id, list_filter(c, lambda x: x.role = 'assistant')[-1].content AS response FROM r WHERE final_score IS NOT NULL AND len(c) >= 2), g AS (SELECT prompt, arg_max(struct_pack(r := response, s := s, i := conv_id), (s, -conv_id)) AS b, arg_min(struct_pack(r := response, s := s, i := conv_id), (s, -conv_id)) AS w, count(*) AS n FROM a WHERE response <> '' GROUP BY 1) SELECT prompt, b.r AS chosen, w.r AS rejected, b.i AS chosen_id, w.i AS rejected_id, round(b.s - w.s, 6) AS gap FROM g WHERE n >= 2 AND round(b.s - w.s, 6) >= 0.2")(lambda t: export.dpo(t.rows()))


# ---- preference

def _pairs(t: Tables) -> DataFrame:
    r = t.rows().select("prompt", export.last_content("assistant").alias("content"), F.col("final_score").alias("score"), F.concat(F.lit("temperature_0."), ((F.col("conv_id") % 3) + 1).cast("string")).alias("variation_label"), F.col("conv_id").alias("ord")).where("content IS NOT NULL")
    return preference.build_pairs(r)


_PP = f"{enrich.SQL}, a AS (SELECT prompt, final_score AS score, conv_id, 'temperature_0.' || (conv_id % 3 + 1) AS l, list_filter(c, lambda x: x.role = 'assistant')[-1].content AS content FROM r WHERE final_score IS NOT NULL), pp0 AS (SELECT prompt, arg_max(struct_pack(c := content, s := score, l := l), (score, -conv_id)) AS b, arg_min(struct_pack(c := content, s := score, l := l), (score, -conv_id)) AS w, count(*) AS n FROM a WHERE content IS NOT NULL GROUP BY 1), pp AS (SELECT *, round(b.s - w.s, 9) AS gap, round(b.s - w.s, 9) >= 0.1 AS valid FROM pp0 WHERE n >= 2)"
query("a21_preference_statistics", f"WITH {_PP}, o AS (SELECT count(*) AS attempted, count(*) FILTER (WHERE valid) AS valid, round(avg(b.s) FILTER (WHERE valid), 6) AS mean_chosen, round(avg(w.s) FILTER (WHERE valid), 6) AS mean_rejected, round(avg(gap) FILTER (WHERE valid), 6) AS mean_gap FROM pp), l AS (SELECT max(n) AS top FROM (SELECT b.l, count(*) AS n FROM pp WHERE valid GROUP BY 1)) SELECT attempted, valid, attempted - valid AS discarded, coalesce(round((attempted - valid) / nullif(attempted, 0), 6), 0.0) AS discard_rate, coalesce(mean_chosen, 0.0) AS mean_chosen, coalesce(mean_rejected, 0.0) AS mean_rejected, coalesce(mean_gap, 0.0) AS mean_gap, coalesce(round(top / nullif(valid, 0), 6), 0.0) >= 0.75 AS dominated, coalesce(round((attempted - valid) / nullif(attempted, 0), 6), 0.0) > 0.4 AS many_discarded FROM o, l")(lambda t: preference.statistics(_pairs(t)))
query("a21_label_distribution", f"WITH {_PP} SELECT b.l AS label, count(*) AS n FROM pp WHERE valid GROUP BY 1")(lambda t: preference.label_distribution(_pairs(t)))
query("p19_preference_dpo", f"WITH {_PP} SELECT prompt, b.c AS chosen, w.c AS rejected FROM pp WHERE valid")(lambda t: preference.as_dpo(_pairs(t)))
query("p20_preference_chat", f"WITH {_PP} SELECT 'user: ' || prompt AS prompt, 'assistant: ' || b.c AS chosen, 'assistant: ' || w.c AS rejected FROM pp WHERE valid")(lambda t: preference.as_chat(_pairs(t)).select(*(flat(c).alias(c) for c in ("prompt", "chosen", "rejected"))))
query("p21_ultrafeedback", f"WITH {_PP} SELECT prompt AS instruction, b.l || '=' || b.c || chr(10) || w.l || '=' || w.c AS completions FROM pp WHERE valid")(lambda t: preference.as_ultrafeedback(_pairs(t)).withColumn("completions", F.array_join(F.transform("completions", lambda x: F.concat(x["model"], F.lit("="), x["response"])), "\n")))
query("p22_anthropic_hh", f"WITH {_PP} SELECT 'Human: ' || prompt || chr(10) || chr(10) || 'Assistant: ' || b.c AS chosen, 'Human: ' || prompt || chr(10) || chr(10) || 'Assistant: ' || w.c AS rejected FROM pp WHERE valid")(lambda t: preference.as_anthropic_hh(_pairs(t)))
query("p23_orpo", f"WITH {_PP} SELECT prompt, b.c AS chosen, w.c AS rejected, b.s AS chosen_score, w.s AS rejected_score FROM pp WHERE valid")(lambda t: preference.as_orpo(_pairs(t)))

# ---- quality and retrieval

_WEIGHTS = dict(zip(enrich.METRICS, (1.0, 2.0, 1.0, 2.0, 1.0)))
_L = "[{m: 'coherence', s: coherence, w: 1.0}, {m: 'factuality', s: factuality, w: 2.0}, {m: 'grounding', s: grounding, w: 1.0}, {m: 'helpfulness', s: helpfulness, w: 2.0}, {m: 'relevance', s: relevance, w: 1.0}]"
for _how, _expr in (("mean", "list_avg(list_transform(h, lambda x: x.s))"), ("weighted_mean", "list_sum(list_transform(h, lambda x: x.s * x.w)) / list_sum(list_transform(h, lambda x: x.w))"), ("min", "list_min(list_transform(h, lambda x: x.s))")):
    query(f"a17_composite_{_how}", f"WITH {enrich.SQL}, h AS (SELECT conv_id, list_filter({_L}, lambda x: x.s IS NOT NULL) AS h FROM r), o AS (SELECT conv_id, round(coalesce({_expr}, 0.0), 6) AS overall, list_filter(h, lambda x: x.s = list_min(list_transform(h, lambda y: y.s)))[1].m AS worst FROM h) SELECT conv_id, overall, overall < 0.6 AS regenerate, worst, coalesce('improve_' || worst, 'general_improvement') AS strategy FROM o")(lambda t, how=_how: quality.composite(t.rows(), _WEIGHTS, how))
query("f2_quality_gate", f"WITH {enrich.SQL} SELECT conv_id, grade FROM r WHERE grade IS NULL OR grade NOT IN ('not_acceptable', 'bad', 'needs_improvement')")(lambda t: quality.accepted(t.rows()).select("conv_id", "grade"))
query("f3_first_accepted", f"WITH {enrich.SQL} SELECT conv_id // 10 AS item, min(conv_id % 10) AS attempt FROM r WHERE grade IS NULL OR grade NOT IN ('not_acceptable', 'bad', 'needs_improvement') GROUP BY 1")(lambda t: quality.first_accepted(t.rows().select(F.floor(F.col("conv_id") / 10).alias("item"), (F.col("conv_id") % 10).alias("attempt"), "grade")))
query("a13_coherence", f"WITH {VEC}, o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS p FROM tv), s AS (SELECT a.conv_id, avg({COS.format('a.vec', 'b.vec')}) AS s, count(*) AS n FROM o a JOIN o b ON a.conv_id = b.conv_id AND a.p % 2 = 0 AND b.p = a.p + 1 GROUP BY 1) SELECT conv_id, round(coalesce(s, 0.0), 6) AS score, coalesce(n, 0)::BIGINT AS pairs, round(coalesce(s, 0.0), 6) < 0.65 AS regenerate FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN s USING (conv_id)")(lambda t: quality.coherence(t.turn_vectors()))
_CTX = f"WITH {VEC}, x AS (SELECT conv_id, embedding::DOUBLE[] AS cv FROM (SELECT DISTINCT conv_id FROM conversations) JOIN embeddings ON vec_id = conv_id * 13 % 500 WHERE conv_id % 4 <> 0), s AS (SELECT conv_id, avg({COS.format('vec', 'cv')}) AS s FROM tv JOIN x USING (conv_id) WHERE role = '{{0}}' GROUP BY 1), f AS (SELECT conv_id, round(CASE WHEN cv IS NULL THEN 1.0 ELSE coalesce(s, 0.0) END, 6) AS score FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN x USING (conv_id) LEFT JOIN s USING (conv_id)) SELECT conv_id, score, score < 0.55 AS regenerate FROM f"


def _context(t: Tables, role: str) -> DataFrame:
    ids = t.conversations.select("conv_id").distinct().where("conv_id % 4 <> 0").withColumn("vec_id", F.col("conv_id") * 13 % 500)
    return quality.similarity_to_context(t.turn_vectors(), ids.join(t.embeddings, "vec_id").select("conv_id", F.col("embedding").alias("context_vec")), role)


query("a14_grounding", _CTX.format("assistant"))(lambda t: _context(t, "assistant"))
query("a15_relevance", _CTX.format("user"))(lambda t: _context(t, "user"))
query("j6_near_duplicates", f"SELECT a.label AS \"group\", a.vec_id AS a, b.vec_id AS b, round({COS.format('a.embedding::DOUBLE[]', 'b.embedding::DOUBLE[]')}, 6) AS score FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id WHERE round({COS.format('a.embedding::DOUBLE[]', 'b.embedding::DOUBLE[]')}, 6) > 0.3")(lambda t: vectors.near_duplicates(t.embeddings.select(F.col("label").alias("group"), F.col("vec_id").alias("id"), F.col("embedding").alias("v")), 0.3))
query("o5_top_k", f"WITH s AS (SELECT a.vec_id AS query_id, b.vec_id AS item_id, round({COS.format('a.embedding::DOUBLE[]', 'b.embedding::DOUBLE[]')}, 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM s WHERE score >= 0.2) SELECT query_id, item_id, score, rank FROM k WHERE rank <= 3")(lambda t: vectors.top_k(t.embeddings.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), t.embeddings.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("v")), 3, 0.2))


def _hits(t: Tables) -> DataFrame:
    return t.conversations.select(F.col("conv_id").alias("query_id"), F.col("role").alias("retriever"), (F.col("turn") % 4).alias("weight"), F.col("turn").alias("ord"), "text")


_H = "h AS (SELECT conv_id AS query_id, role AS retriever, turn % 4 AS weight, turn AS ord, text FROM conversations)"
query("o6_ensemble", f"WITH {_H}, k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY weight DESC, ord) AS rank FROM h WHERE weight > 0 AND text <> '') SELECT * FROM k WHERE rank <= 3")(lambda t: vectors.best_by_weight(_hits(t)))
query("o7_chained", f"WITH {_H}, k AS (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY query_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM h WHERE text <> '') SELECT * FROM k WHERE before < 50")(lambda t: vectors.chained(_hits(t)))

# ---- monitoring

_AT = "2024-01-15 12:00:00"
_STAT = "round(avg(value), 6) AS mean, round(min(value), 6) AS least, round(max(value), 6) AS most, count(*) AS n"
query("a22_trailing_window", f"WITH {METRIC} SELECT metric, {_STAT} FROM m WHERE ts >= TIMESTAMP '{_AT}' - INTERVAL 720 MINUTES AND ts <= TIMESTAMP '{_AT}' GROUP BY 1")(lambda t: monitor.trailing(t.metrics(), _AT, 720))
_WIN = f"SELECT strftime(time_bucket(INTERVAL 60 MINUTES, ts, TIMESTAMP '2000-01-01'), '%Y-%m-%d %H:%M:%S') AS start, metric, {_STAT} FROM m GROUP BY 1, 2"
query("t1_windows", f"WITH {METRIC} {_WIN}")(lambda t: monitor.windows(t.metrics(), 60))
_RULES = (("purchase", ">", 60.0, "warning"), ("click", "<", 40.0, "error"), ("view", ">", 90.0, "info"))
query("t2_alerts", f"WITH {METRIC}, s AS ({_WIN}) SELECT *, CASE metric WHEN 'purchase' THEN 'warning' WHEN 'click' THEN 'error' ELSE 'info' END AS level FROM s WHERE metric = 'purchase' AND mean > 60 OR metric = 'click' AND mean < 40 OR metric = 'view' AND mean > 90")(lambda t: monitor.alerts(monitor.windows(t.metrics(), 60), _RULES))
for _n in (10, 5):
    query(f"w1_rolling_{_n}", f"WITH {METRIC} SELECT event_id, metric, model, round(avg(value) OVER (PARTITION BY metric, model ORDER BY ts, event_id ROWS BETWEEN {_n - 1} PRECEDING AND CURRENT ROW), 6) AS rolling FROM m")(lambda t, n=_n: monitor.rolling(t.metrics(), n))


def _usage(t: Tables) -> DataFrame:
    return usage_of(t.events)


def usage_of(e: DataFrame) -> DataFrame:
    return e.select(F.when(F.col("user_id") % 7 != 0, F.concat(F.lit("model_"), (F.col("user_id") % 5).cast("string"))).alias("model"), (F.col("event_id") % 100).alias("prompt_tokens"), (F.col("event_id") % 37).alias("completion_tokens"), (F.col("event_id") % 100 + F.col("event_id") % 37).alias("total_tokens"))


query("a23_token_usage", "SELECT model, sum(p)::BIGINT AS prompt_tokens, sum(c)::BIGINT AS completion_tokens, sum(p + c)::BIGINT AS total_tokens, grouping(model)::BIGINT AS is_total FROM (SELECT CASE WHEN user_id % 7 <> 0 THEN 'model_' || (user_id % 5) ELSE 'unknown' END AS model, event_id % 100 AS p, event_id % 37 AS c FROM events) GROUP BY ROLLUP (model)")(lambda t: monitor.token_usage(_usage(t)))


def _generated(t: Tables) -> DataFrame:
    e = t.events
    return e.select("event_id", "ts", F.concat(F.lit("model_"), (F.col("user_id") % 5).cast("string")).alias("model"), F.col("value").alias("duration"), (F.col("event_id") % 4 != 0).alias("success"), F.when(F.col("event_id") % 9 == 0, "timeout").alias("error"), F.when(F.col("event_id") % 2 == 0, F.col("event_id") % 100).alias("prompt_tokens"), F.lit(None).cast("long").alias("completion_tokens"))


query("t3_fan_out", "WITH g AS (SELECT event_id, 'model_' || (user_id % 5) AS model, value FROM events), a AS (SELECT event_id, 'generation_time' AS metric, value FROM g UNION ALL SELECT event_id, 'success_rate', CASE WHEN event_id % 4 <> 0 THEN 1.0 ELSE 0.0 END FROM g UNION ALL SELECT event_id, 'error_rate', 1.0 FROM g WHERE event_id % 9 = 0 UNION ALL SELECT event_id, 'model_usage:' || model, 1.0 FROM g UNION ALL SELECT event_id, 'prompt_tokens', (event_id % 100)::DOUBLE FROM g WHERE event_id % 2 = 0) SELECT metric, count(*) AS n, round(sum(value), 4) AS total FROM a GROUP BY 1")(lambda t: monitor.fan_out(_generated(t)).groupBy("metric").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")))

# ---- sampling and stop rules

_U = "('0x' || substr(md5('{0}|' || {1}), 1, 8))::BIGINT / 4294967296.0"
query("c1_weighted_sample", f"SELECT doc_id AS id, 1.0 / (doc_id % 5 + 1) AS weight FROM documents WHERE doc_id % 10 <> 0 ORDER BY -ln(greatest({_U.format('42', 'doc_id')}, pow(2.0, -33))) / (1.0 / (doc_id % 5 + 1)), doc_id LIMIT 50")(lambda t: sampling.weighted_sample(t.documents.select(F.col("doc_id").alias("id"), sampling.usage_weight(F.col("doc_id") % 5, covered=F.col("doc_id") % 10 == 0).alias("weight")), 50))
query("c2_weighted_choice", f"WITH d AS (SELECT DISTINCT conv_id AS draw_id FROM conversations), u AS (SELECT draw_id, {_U.format('42', 'draw_id')} * 6.0 AS x FROM d) SELECT draw_id, CASE WHEN x < 1 THEN 'a' WHEN x < 3 THEN 'b' ELSE 'c' END AS option FROM u")(lambda t: sampling.weighted_choice(t.conversations.select(F.col("conv_id").alias("draw_id")).distinct(), t.spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0), (3, "c", 3.0)], "ord int, option string, weight double")))
query("c7_split", "SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY md5('42|' || doc_id)) <= greatest((SELECT floor(count(*) * 0.1) FROM documents), 1) THEN 'val' ELSE 'train' END AS split FROM documents")(lambda t: sampling.split(t.documents.select("doc_id"), F.col("doc_id"), 0.1))
query("w7_budget_stop", "WITH s AS (SELECT user_id AS stream, event_id AS ord, sum(value) OVER (PARTITION BY user_id ORDER BY event_id) AS spent FROM events) SELECT stream, min(ord) AS ord, round(min(spent), 6) AS spent FROM s WHERE spent >= 500 GROUP BY 1")(lambda t: sampling.budget_stop(t.events.select(F.col("user_id").alias("stream"), F.col("event_id").alias("ord"), F.col("value").alias("cost")), "cost", 500.0))
_STOP = "WITH f AS (SELECT user_id AS stream, event_type, min(event_id) AS ord FROM events GROUP BY 1, 2), k AS (SELECT stream, ord, row_number() OVER (PARTITION BY stream ORDER BY ord, event_type) AS k FROM f) SELECT stream, ord FROM k WHERE k = {0}"
query("w11_distinct_stop", _STOP.format(3))(lambda t: sampling.distinct_stop(t.events.select(F.col("user_id").alias("stream"), F.col("event_id").alias("ord"), "event_type"), "event_type", 3))
query("t6_coverage_stop", _STOP.format(4))(lambda t: sampling.coverage_stop(t.events.select(F.col("user_id").alias("stream"), F.col("event_id").alias("ord"), "event_type"), "event_type", 5, 0.8))
query("w8_char_budget", "WITH k AS (SELECT source AS grp, doc_id AS ord, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents), d AS (SELECT grp, ord, least(length(text), 4000) AS n FROM k WHERE k <= 8 AND trim(text) <> ''), b AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY grp ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM d) SELECT grp, ord, least(n, 24000 - b)::BIGINT AS n FROM b WHERE b < 24000")(lambda t: sampling.char_budget(t.documents.select(F.col("source").alias("grp"), F.col("doc_id").alias("ord"), "text")))
query("w9_round_robin", "SELECT conv_id AS stream, turn AS ord, ((row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) % 3)::BIGINT AS pick FROM conversations")(lambda t: sampling.round_robin(t.conversations.select(F.col("conv_id").alias("stream"), F.col("turn").alias("ord")), 3))
query("x13_persona_weight", f"WITH {enrich.SQL} SELECT conv_id, depth, round((2 - depth + 1) / count(*) OVER (PARTITION BY depth), 6) AS weight FROM r")(lambda t: sampling.persona_weight(t.rows().select("conv_id", "depth"), 2))

# ---- taxonomy, ratings, skills


def _nodes(t: Tables) -> DataFrame:
    """A region - nation - customer tree in the form of a taxonomy."""
    r = t.region.select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("node_id"), F.lit("root").alias("parent_id"), F.lit(1).alias("depth"), F.col("r_name").alias("label"))
    n = t.nation.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")), F.lit(2), F.col("n_name"))
    root = t.spark.createDataFrame([("root", None, 0, "all")], "node_id string, parent_id string, depth int, label string")
    return root.union(r).union(n).select(F.lit("geo").alias("factor_id"), "*")


_N = "nodes AS (SELECT 'geo' AS factor_id, 'root' AS node_id, NULL::VARCHAR AS parent_id, 0 AS depth, 'all' AS label UNION ALL SELECT 'geo', 'r' || r_regionkey, 'root', 1, r_name FROM region UNION ALL SELECT 'geo', 'n' || n_nationkey, 'r' || n_regionkey, 2, n_name FROM nation)"
query("a24_level_coverage", f"WITH {_N}, a AS (SELECT DISTINCT 'n' || (c_nationkey // 2 * 2) AS node_id FROM customer) SELECT factor_id, depth, count(*) AS nodes, count(a.node_id) AS covered, round(count(a.node_id) / count(*), 6) AS coverage FROM nodes LEFT JOIN a USING (node_id) GROUP BY 1, 2")(lambda t: taxonomy.level_coverage(_nodes(t), t.customer.select(F.lit("geo").alias("factor_id"), F.concat(F.lit("n"), (F.floor(F.col("c_nationkey") / 2) * 2).cast("string")).alias("node_id"))))
query("j5_paths", f"WITH RECURSIVE {_N}, p AS (SELECT factor_id, node_id, label AS path FROM nodes WHERE parent_id IS NULL UNION ALL SELECT n.factor_id, n.node_id, p.path || '/' || n.label FROM nodes n JOIN p ON n.parent_id = p.node_id) SELECT * FROM p")(lambda t: taxonomy.paths(_nodes(t)))
query("c3_leaves", f"WITH {_N} SELECT * FROM nodes WHERE node_id NOT IN (SELECT parent_id FROM nodes WHERE parent_id IS NOT NULL)")(lambda t: taxonomy.leaves(_nodes(t)))
query("f20_invalid_nodes", f"WITH {_N} SELECT n.factor_id, n.node_id, 'no parent' AS problem FROM (SELECT * FROM nodes WHERE node_id <> 'r1') n LEFT JOIN (SELECT * FROM nodes WHERE node_id <> 'r1') p ON n.parent_id = p.node_id WHERE n.parent_id IS NOT NULL AND p.node_id IS NULL")(lambda t: taxonomy.invalid_nodes(_nodes(t).where("node_id <> 'r1'")))


def _games(t: Tables) -> DataFrame:
    return t.events.select(F.floor(F.col("event_id") / 30).alias("batch"), F.col("event_id").alias("ord"), (F.col("user_id") % 6).alias("winner"), (F.col("event_id") * 7 % 6).alias("loser"))


query("a25_elo", "WITH RECURSIVE g AS (SELECT event_id // 30 AS batch, row_number() OVER (PARTITION BY event_id // 30 ORDER BY event_id) AS k, user_id % 6 AS w, event_id * 7 % 6 AS l FROM events WHERE user_id % 6 <> event_id * 7 % 6), f(batch, k, s) AS (SELECT DISTINCT batch, 0::BIGINT, [1500.0::DOUBLE, 1500.0, 1500.0, 1500.0, 1500.0, 1500.0] FROM g UNION ALL SELECT f.batch, g.k, list_transform(range(6), lambda i: CASE WHEN i = w THEN s[w + 1] + 32 * (1 - 1 / (1 + pow(10, (s[l + 1] - s[w + 1]) / 400))) WHEN i = l THEN s[l + 1] - 32 * (1 - 1 / (1 + pow(10, (s[l + 1] - s[w + 1]) / 400))) ELSE s[i + 1] END) FROM f JOIN g ON g.batch = f.batch AND g.k = f.k + 1), e AS (SELECT batch, arg_max(s, k) AS s FROM f GROUP BY 1), u AS (SELECT DISTINCT batch, w AS item FROM g UNION SELECT DISTINCT batch, l FROM g) SELECT batch, item, round(s[item + 1], 6) AS rating FROM u JOIN e USING (batch)")(lambda t: taxonomy.elo(_games(t)))


def _results(t: Tables) -> DataFrame:
    d = t.labels
    return d.select(F.concat(F.lit("s"), (F.col("doc_id") % 3).cast("string")).alias("source"), F.concat(F.lit("v"), (F.col("doc_id") % 2).cast("string")).alias("variant"), F.col("quality").cast("double").alias("score"), (F.col("doc_id") % 4).alias("satisfied"), F.when(F.col("doc_id") % 7 != 0, 4).otherwise(0).alias("total"))


query("a26_pass_rates", "SELECT source, variant, count(*) AS tasks, round(avg(score), 6) AS pass_rate, round(avg(share), 6) AS rubric_rate FROM (SELECT 's' || (doc_id % 3) AS source, 'v' || (doc_id % 2) AS variant, quality::DOUBLE AS score, CASE WHEN doc_id % 7 <> 0 THEN (doc_id % 4) / 4 ELSE 0.0 END AS share FROM labels) GROUP BY GROUPING SETS ((variant), (source, variant))")(lambda t: taxonomy.pass_rates(_results(t)))
query("a28_select_versions", "WITH v AS (SELECT doc_id % 10 AS context_id, doc_id % 4 AS version, round((count_if(toxic = 1 AND quality = 1) + 1) / (count_if(toxic = 1) + 1) * ((count_if(toxic = 0 AND quality = 1) + 1) / (count_if(toxic = 0) + 1)), 9) AS score FROM labels GROUP BY 1, 2) SELECT context_id, arg_max(version, (score, -version)) AS version, round(max(score), 6) AS score FROM v GROUP BY 1")(lambda t: taxonomy.select_versions(t.labels.select((F.col("doc_id") % 10).alias("context_id"), (F.col("doc_id") % 4).alias("version"), F.when(F.col("toxic") == 1, "hard").otherwise("easy").alias("kind"), (F.col("quality") == 1).alias("passed"))))
query("w10_latest_per_key", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) WHERE k = 1")(lambda t: taxonomy.latest_per_key(t.events.select("user_id", "event_id", "event_type"), "user_id", "event_id"))
_SETS = "len(list_intersect({0}, {1})) / len(list_distinct({0} || {1}))"
query("j8_compare_sides", f"WITH x AS (SELECT conv_id, {TOK} AS w FROM conversations WHERE turn = 1), y AS (SELECT conv_id, {TOK} AS w FROM conversations WHERE turn = 3) SELECT conv_id, CASE WHEN y.w IS NULL THEN 'left' WHEN x.w IS NULL THEN 'right' ELSE 'both' END AS side, CASE WHEN x.w IS NOT NULL AND y.w IS NOT NULL THEN round({_SETS.format('x.w', 'y.w')}, 6) END AS jaccard FROM x FULL JOIN y USING (conv_id)")(lambda t: taxonomy.compare_sides(t.conversations.where("turn = 1"), t.conversations.where("turn = 3"), "conv_id", "text"))

# ---- traces


def _traces(t: Tables) -> DataFrame:
    """Trajectories in thought-action-observation text, made from events."""
    e = t.events.withColumn("conv_id", F.floor(F.col("event_id") / 4))
    call = F.concat(F.lit("Thought: look up "), F.col("event_type"), F.lit("\nAction: app."), F.col("event_type"), F.lit('\nAction Input: {"user": "'), F.col("user_id").cast("string"), F.lit('"}'))
    seen = F.concat(F.lit("Observation: "), F.col("user_id").cast("string"))
    done = F.concat(F.lit("Thought: done\nFinal Answer: "), F.col("event_type"))
    last = F.col("event_id") % 4 == 3
    m = e.select("conv_id", (F.col("event_id") * 2).alias("turn"), F.when(last, F.lit("assistant")).otherwise("assistant").alias("role"), F.when(last, done).otherwise(call).alias("text")).union(e.where(~last).select("conv_id", F.col("event_id") * 2 + 1, F.lit("user"), seen))
    return enrich.conversations(m)


_TR = "e AS (SELECT *, event_id // 4 AS conv_id FROM events), c AS (SELECT *, row_number() OVER (ORDER BY event_id) AS id FROM e WHERE event_id % 4 <> 3)"
query("p15_openai_tools", f"WITH {_TR}, p AS (SELECT conv_id, event_id * 2 AS o, '{{\"role\":\"assistant\",\"content\":\"look up ' || event_type || '\",\"tool_calls\":[{{\"id\":\"call_' || id || '\",\"type\":\"function\",\"function\":{{\"name\":\"app__' || event_type || '\",\"arguments\":\"{{\\\"user\\\": \\\"' || user_id || '\\\"}}\"}}}}]}}' AS m FROM c UNION ALL SELECT conv_id, event_id * 2 + 1, '{{\"role\":\"tool\",\"tool_call_id\":\"call_' || id || '\",\"content\":\"' || user_id || '\"}}' FROM c UNION ALL SELECT conv_id, event_id * 2, '{{\"role\":\"assistant\",\"content\":\"done' || '\\n' || ' ' || event_type || '\"}}' FROM e WHERE event_id % 4 = 3) SELECT conv_id, string_agg(m, chr(10) ORDER BY o) AS messages FROM p GROUP BY 1")(lambda t: traces.openai_tools(_traces(t)).withColumn("messages", F.array_join("messages", "\n")))
query("p17_hermes_tools", f"WITH {_TR}, p AS (SELECT conv_id, event_id * 2 AS o, 'assistant: look up ' || event_type || chr(10) || '<tool_call>' || chr(10) || '{{\"name\": \"app__' || event_type || '\", \"arguments\": {{\"user\": \"' || user_id || '\"}}}}' || chr(10) || '</tool_call>' AS m FROM c UNION ALL SELECT conv_id, event_id * 2 + 1, 'tool: <tool_response>' || chr(10) || user_id || chr(10) || '</tool_response>' FROM c UNION ALL SELECT conv_id, event_id * 2, 'assistant: done' || chr(10) || ' ' || event_type FROM e WHERE event_id % 4 = 3) SELECT conv_id, string_agg(m, chr(10) ORDER BY o) AS messages FROM p GROUP BY 1")(lambda t: traces.hermes_tools(_traces(t)).withColumn("messages", flat("messages")))
query("p16_anthropic_tools", f"WITH {_TR}, p AS (SELECT conv_id, event_id * 2 AS o, 'assistant {{\"type\":\"text\",\"text\":\"look up ' || event_type || '\"}}{{\"type\":\"tool_use\",\"id\":\"toolu_' || id || '\",\"name\":\"app__' || event_type || '\",\"input\":{{\"user\":\"' || user_id || '\"}}}}' AS m FROM c UNION ALL SELECT conv_id, event_id * 2 + 1, 'user {{\"type\":\"tool_result\",\"tool_use_id\":\"toolu_' || id || '\",\"content\":\"' || user_id || '\"}}' FROM c UNION ALL SELECT conv_id, event_id * 2, 'assistant {{\"type\":\"text\",\"text\":\"done' || '\\n' || ' ' || event_type || '\"}}' FROM e WHERE event_id % 4 = 3) SELECT conv_id, string_agg(m, chr(10) ORDER BY o) AS messages FROM p GROUP BY 1")(lambda t: traces.anthropic_tools(_traces(t)).withColumn("messages", F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(" "), F.array_join(m["content"], ""))), "\n")))
query("a29_tool_statistics", f"WITH {_TR} SELECT 'app__' || event_type AS tool, count(*) AS n, count(DISTINCT conv_id) AS conversations FROM c GROUP BY 1")(lambda t: traces.tool_statistics(traces.parsed(_traces(t)).where("kind = 'call'")))
query("a32_least_used", "WITH t AS (SELECT 'tool_' || i AS tool, i AS reg_ord FROM range(20) t(i)), c AS (SELECT 'tool_' || (user_id % 17) AS tool, count(*) AS n FROM events GROUP BY 1) SELECT tool, reg_ord, coalesce(n, 0)::BIGINT AS n FROM t LEFT JOIN c USING (tool) ORDER BY coalesce(n, 0), reg_ord LIMIT 10")(lambda t: traces.least_used(t.spark.range(20).select(F.concat(F.lit("tool_"), F.col("id").cast("string")).alias("tool"), F.col("id").alias("reg_ord")), t.events.select(F.concat(F.lit("tool_"), (F.col("user_id") % 17).cast("string")).alias("tool"))))
query("a33_ledger", "WITH s AS (SELECT event_id AS ord, user_id % 10 AS account, -round(value, 2) AS delta FROM events UNION ALL SELECT event_id, event_id % 10, round(value, 2) FROM events), r AS (SELECT *, sum(round(delta * 100)::BIGINT) OVER (PARTITION BY account ORDER BY ord, delta ROWS UNBOUNDED PRECEDING) AS b FROM s) SELECT account, ord, round(delta, 2) AS delta, round(b / 100.0, 2) AS balance FROM r")(lambda t: traces.ledger(t.events.select(F.col("event_id").alias("ord"), (F.col("user_id") % 10).alias("src"), (F.col("event_id") % 10).alias("dst"), F.round("value", 2).alias("amount"))))
query("f13_hard_gate", "SELECT user_id AS traj_id, bool_or(event_type = 'error') OR bool_or(coalesce(json_extract_string(props, '$.error') IS NOT NULL, false)) AS rejected FROM events GROUP BY 1")(lambda t: traces.hard_gate(t.events.select(F.col("user_id").alias("traj_id"), F.col("event_type").alias("status"), F.col("props").alias("observation"))))
query("f14_judged", f"WITH {enrich.SQL} SELECT conv_id AS traj_id, round((coherence + factuality + grounding + helpfulness) / 4, 6) AS score, conv_id % 3 <> 0 AND (coherence + factuality + grounding + helpfulness) / 4 >= 0.75 AS accepted FROM r WHERE coherence IS NOT NULL")(lambda t: traces.judged(t.rows().where("coherence IS NOT NULL").select(F.col("conv_id").alias("traj_id"), (F.col("conv_id") % 3 != 0).alias("is_valid"), *enrich.METRICS), list(enrich.METRICS[:4])))

# ---- sources and texts

query("s17_chunks", "SELECT doc_id, i::BIGINT AS chunk, substring(text, i * 500 + 1, 500) AS text FROM (SELECT doc_id, text, unnest(range(((length(text) + 499) // 500)::BIGINT)) AS i FROM documents)")(lambda t: readers.chunked(t.documents, 500))
query("s18_overlapping_chunks", r"SELECT doc_id, i::BIGINT AS chunk, regexp_replace(substring(text, i * 900 + 1, 1000), '^\s+|\s+$', '', 'g') AS text FROM (SELECT doc_id, text, unnest(range(((length(text) + 899) // 900)::BIGINT)) AS i FROM documents) WHERE regexp_replace(substring(text, i * 900 + 1, 1000), '^\s+|\s+$', '', 'g') <> ''")(lambda t: readers.chunked(t.documents, 1000, 100))
query("s19_messages_as_document", "SELECT conv_id, string_agg('## Message ' || k || ': ' || role || chr(10) || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY k) AS text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations) WHERE trim(text) <> '' GROUP BY 1")(lambda t: readers.messages_as_document(t.conversations))
query("s4_page", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 40")(lambda t: readers.page(t.orders, {"o_orderstatus": "F"}, [("o_orderdate", -1), ("o_orderkey", 1)], 20, 40).select("o_orderkey", "o_orderstatus"))
query("s20_indexed", "SELECT vec_id, substring(text, 1, 120000) AS text FROM embeddings JOIN documents ON vec_id = doc_id WHERE trim(text) <> '' AND len(embedding) = 64")(lambda t: readers.indexed(t.embeddings.join(t.documents, F.col("vec_id") == F.col("doc_id")).select("vec_id", "text", F.col("embedding").alias("vector")), 64).select("vec_id", "text"))
query("u6_not_in_train", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")(lambda t: t.documents.select("doc_id").join(t.labels, "doc_id", "left_anti"))
query("u4_trigram_overlap", f"WITH d AS (SELECT item_id, {TOK} AS w FROM benchmark), g AS (SELECT item_id, list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) AS g FROM d) SELECT a.item_id AS a, b.item_id AS b, round({_SETS.format('a.g', 'b.g')}, 6) AS jaccard FROM g a JOIN g b ON b.item_id = a.item_id + 1")(lambda t: (lambda d: d.select(F.col("item_id").alias("a"), F.col("g").alias("ga")).join(d.select(F.col("item_id").alias("b"), F.col("g").alias("gb")), F.col("b") == F.col("a") + 1).select("a", "b", F.round(T.jaccard(F.col("ga"), F.col("gb"), 0.0), 6).alias("jaccard")))(t.benchmark.select("item_id", T.ngrams(T.tokens(F.col("text")), 3).alias("g"))))
query("x9_digests", r"SELECT doc_id, sha256(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS digest FROM documents")(lambda t: t.documents.select("doc_id", F.sha2(T.strip(F.col("text")), 256).alias("digest")))
query("x20_labels", "SELECT doc_id, CASE WHEN length(text) > 20 THEN substring(text, 1, 20) || '...' ELSE text END AS label FROM documents")(lambda t: t.documents.select("doc_id", T.short_label(F.col("text"), 20).alias("label")))
query("x21_escaped", "SELECT page_id, replace(replace(replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;') AS url FROM pages")(lambda t: t.pages.select("page_id", T.html_escaped(F.col("url")).alias("url")))
query("a31_context_state", f"WITH {enrich.SQL} SELECT x AS context, count(*) AS n FROM (SELECT unnest(list_distinct([context_id] || context_ids)) AS x FROM r) GROUP BY 1")(lambda t: analytics.context_counts(t.rows(), dedup=True))


# ---- small rules

query("f9_multiple_choice", "SELECT doc_id, array_to_string((w || ['(placeholder)', '(placeholder)', '(placeholder)', '(placeholder)'])[1:4], '|') AS choices, CASE WHEN i >= 0 AND i < 4 THEN i ELSE 0 END::BIGINT AS correct_index FROM (SELECT doc_id, string_split(source, 'r') AS w, doc_id % 7 - 1 AS i FROM documents)")(lambda t: t.documents.select("doc_id", quality.multiple_choice(F.split("source", "r"), F.col("doc_id") % 7 - 1).alias("x")).select("doc_id", F.array_join("x.choices", "|").alias("choices"), "x.correct_index"))
query("f15_rubric", "SELECT doc_id, CASE WHEN doc_id % 5 > 0 AND NOT list_contains(list_transform(range(doc_id % 5), lambda i: (doc_id + i) % 3 > 0), false) THEN 1.0 ELSE 0.0 END::DOUBLE AS score FROM documents")(lambda t: t.documents.select("doc_id", quality.rubric(F.filter(F.transform(F.sequence(F.lit(0).cast("long"), F.col("doc_id") % 5), lambda i: F.when(i < F.col("doc_id") % 5, (F.col("doc_id") + i) % 3 > 0)), lambda x: x.isNotNull())).alias("score")))
query("f11_forbidden", "SELECT p_partkey, contains(lower(p_name || ' ' || p_brand), 'part') AND contains(lower(p_name || ' ' || p_brand), '#1') AS hit FROM part")(lambda t: t.part.select("p_partkey", rules.forbidden(F.array("p_name", "p_brand"), [("Part", "#1")]).alias("hit")))
query("f18_retryable", "SELECT event_id, coalesce(event_id % 600 IN (429, 500, 502, 503, 504), false) OR regexp_matches(lower(event_type), 'resource_exhausted|rate limit|too many requests|temporarily unavailable|service unavailable') AS retry FROM events")(lambda t: t.events.select("event_id", rules.retryable(F.col("event_id") % 600, F.col("event_type")).alias("retry")))
query("x12_usage_weight", "SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 0.0 WHEN doc_id % 3 = 0 THEN 1.0 / (doc_id % 5 + 1) WHEN doc_id % 4 <= 0 THEN 0.0 ELSE greatest(doc_id % 4 - doc_id % 5, 0)::DOUBLE END::DOUBLE AS weight FROM documents")(lambda t: t.documents.select("doc_id", sampling.usage_weight(F.col("doc_id") % 5, F.when(F.col("doc_id") % 3 != 0, F.col("doc_id") % 4), F.col("doc_id") % 11 == 0).alias("weight")))
query("x14_auto_depth", "WITH d AS (SELECT i AS depth, (SELECT sum(pow(5, k + 1))::BIGINT FROM range(i + 1) r(k)) AS n FROM range(7) t(i)) SELECT DISTINCT o_custkey, arg_min(depth, (abs(n - o_custkey), depth))::BIGINT AS depth FROM (SELECT DISTINCT o_custkey FROM orders), d GROUP BY 1")(lambda t: t.orders.select("o_custkey").distinct().select("o_custkey", rules.auto_depth(F.col("o_custkey")).cast("long").alias("depth")))
query("x17_backoff", "SELECT event_id, least(60.0, pow(2.0, event_id % 9))::DOUBLE AS seconds FROM events")(lambda t: t.events.select("event_id", rules.backoff(F.col("event_id") % 9).alias("seconds")))
query("x23_coerced", r"SELECT event_id, CASE WHEN lower(trim(v)) IN ('true', 'false') THEN 'boolean' WHEN regexp_matches(trim(v), '^[+-]?[0-9]+$') THEN 'integer' WHEN regexp_matches(trim(v), '^[+-]?[0-9]*\.[0-9]+$') THEN 'number' ELSE 'string' END AS kind FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'True' WHEN 1 THEN event_id::VARCHAR WHEN 2 THEN (event_id % 50) || '.5' ELSE event_type END AS v FROM events)")(lambda t: t.events.select("event_id", rules.coerced(F.when(F.col("event_id") % 4 == 0, "True").when(F.col("event_id") % 4 == 1, F.col("event_id").cast("string")).when(F.col("event_id") % 4 == 2, F.concat((F.col("event_id") % 50).cast("string"), F.lit(".5"))).otherwise(F.col("event_type")))["kind"].alias("kind")))
query("a34_key_usage", "WITH c AS (SELECT 'key_' || (user_id % 6) AS api_key, ts, event_id % 13 = 0 AS failed FROM events), l AS (SELECT api_key, max(ts) AS last FROM c GROUP BY 1) SELECT api_key, count_if(ts > last - INTERVAL 1 HOUR) AS hourly, count_if(ts > last - INTERVAL 1 DAY) AS daily, count_if(failed) AS errors FROM c JOIN l USING (api_key) GROUP BY 1")(lambda t: rules.key_usage(t.events.select(F.concat(F.lit("key_"), (F.col("user_id") % 6).cast("string")).alias("api_key"), "ts", (F.col("event_id") % 13 == 0).alias("failed"))).drop("last_used"))
query("a35_job_progress", "SELECT o_orderkey AS job_id, round(coalesce(done * 100.0 / nullif(total, 0), 0.0), 1) AS percent, round(done / nullif(seconds, 0), 1) AS rate, round((total - done) / nullif(done / nullif(seconds, 0), 0), 1) AS eta FROM (SELECT o_orderkey, o_orderkey % 50 AS done, 50 + o_orderkey % 7 AS total, (o_orderkey % 9)::DOUBLE AS seconds FROM orders)")(lambda t: rules.job_progress(t.orders.select(F.col("o_orderkey").alias("job_id"), (F.col("o_orderkey") % 50).alias("done"), (50 + F.col("o_orderkey") % 7).alias("total"), (F.col("o_orderkey") % 9).cast("double").alias("seconds"))))
query("c5_grid_pick", f"SELECT doc_id AS task_id, floor({_U.format('grid', 'doc_id')} * 108)::BIGINT AS bucket FROM documents")(lambda t: rules.pick_bucket(t.documents.select(F.col("doc_id").alias("task_id")), rules.task_grid(t.spark)).select("task_id", F.col("bucket").cast("long").alias("bucket")))
query("u9_upsert", "WITH n AS (SELECT event_id AS k, event_id + 1 AS ord, 'new' AS v FROM events WHERE event_id % 3 = 0), o AS (SELECT event_id AS k, event_id AS ord, event_type AS v FROM events WHERE event_id % 2 = 0) SELECT * FROM n UNION ALL SELECT * FROM o WHERE k NOT IN (SELECT k FROM n)")(lambda t: rules.upserted(t.events.where("event_id % 2 = 0").select(F.col("event_id").alias("k"), F.col("event_id").alias("ord"), F.col("event_type").alias("v")), t.events.where("event_id % 3 = 0").select(F.col("event_id").alias("k"), (F.col("event_id") + 1).alias("ord"), F.lit("new").alias("v")), "k"))
query("a30_tool_outcomes", "SELECT CASE WHEN w = g THEN 'exact_match' WHEN event_id % 4 = 0 THEN 'missing_call' ELSE 'wrong_tool' END AS outcome, count(*) AS n FROM (SELECT event_id, event_type AS w, CASE WHEN event_id % 4 = 0 THEN NULL WHEN event_id % 5 = 0 THEN 'other' ELSE event_type END AS g FROM events) GROUP BY 1")(lambda t: t.events.select(traces.call_outcome(F.array(F.struct(F.col("event_type").alias("name"), F.lit("{}").alias("args"))), F.when(F.col("event_id") % 4 == 0, F.array().cast("array<struct<name:string,args:string>>")).otherwise(F.array(F.struct(F.when(F.col("event_id") % 5 == 0, "other").otherwise(F.col("event_type")).alias("name"), F.lit("{}").alias("args"))))).alias("outcome")).groupBy("outcome").agg(F.count("*").alias("n")))
query("j13_resolve_tool", "WITH t AS (SELECT 'app' || (n_regionkey) || '.' || lower(n_name) AS tool, n_nationkey AS o FROM nation), q AS (SELECT tool AS name FROM t WHERE o % 3 = 0 UNION SELECT split_part(tool, '.', 2) FROM t UNION SELECT 'none') SELECT q.name, coalesce(t.tool, (SELECT arg_min(x.tool, x.o) FROM t x WHERE split_part(x.tool, '.', 2) = q.name)) AS tool FROM q LEFT JOIN t ON t.tool = q.name")(lambda t: (lambda k: traces.resolve_tool(k.where("reg_ord % 3 = 0").select(F.col("tool").alias("name")).union(k.select(F.element_at(F.split("tool", r"\."), 2))).union(t.spark.createDataFrame([("none",)], "name string")).distinct(), k))(t.nation.select(F.concat(F.lit("app"), F.col("n_regionkey").cast("string"), F.lit("."), F.lower("n_name")).alias("tool"), F.col("n_nationkey").alias("reg_ord"))))
query("l1_generation_stub", "SELECT conv_id, turn, 'answer ' || substr(md5(text), 1, 12) AS answer FROM conversations WHERE role = 'user'")(lambda t: generation.generate(t.conversations.where("role = 'user'").select("conv_id", "turn", "text"), "text").drop("text"))


@query("t1_stream_windows", SQL["t1_windows"])
def _stream(t: Tables) -> DataFrame:
    import uuid

    e = t.spark.readStream.schema(t.events.schema).parquet(f"{t.dir}/events.parquet*")
    return streaming.reported(streaming.windowed(e.select(F.col("event_type").alias("metric"), "ts", "value"), 60))


from . import prompted, related, stored, steps  # noqa: E402, F401  (add their queries)
