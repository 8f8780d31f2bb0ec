"""Operators on literal rows with answers worked out by hand."""

import json
import math

import pytest
from pyspark.sql import functions as F

from loomspark.functions import text as T
from loomspark.operators import analytics, export, generation, monitor, preference, quality, sampling, taxonomy, traces, vectors
from loomspark.sources import readers

ROWS = "conv_id long, conversations array<struct<role:string,content:string>>, persona string, context_id string, context_ids array<string>, depth int"


@pytest.fixture(scope="module")
def five(spark):
    said = [
        ("What is Python?", "A programming language.", "Student", "doc1", 0),
        ("Explain OOP", "Object-oriented programming...", "Student", "doc1", 0),
        ("How does async work?", "Async allows concurrent...", "Developer", "doc2", 1),
        ("What is REST?", "Representational state transfer.", "Beginner", "doc3", 0),
        ("What about GraphQL?", "A query language for APIs.", "Developer", "doc2", 1),
    ]
    return spark.createDataFrame([(i, [("user", u), ("assistant", a)], p, c, [], d) for i, (u, a, p, c, d) in enumerate(said)], ROWS)


def turns_of(rows):
    return rows.select("conv_id", F.posexplode("conversations").alias("turn", "x")).select("conv_id", "turn", "x.role", F.col("x.content").alias("text"))


def test_summary(five):
    r = analytics.summary(five).first().asDict()
    assert r == {"n_conversations": 5, "n_turns": 10, "avg_turns": 2.0, "n_words": 32, "avg_words_per_turn": 3.2, "n_personas": 3, "n_contexts": 3}


def test_summary_of_nothing(five):
    r = analytics.summary(five.limit(0)).first()
    assert r.n_conversations == 0 and r.avg_turns == 0.0 and r.avg_words_per_turn == 0.0


def test_personas_and_depth(five):
    assert [(r.persona, r.n) for r in analytics.persona_counts(five).orderBy("rank").collect()] == [("Student", 2), ("Developer", 2), ("Beginner", 1)]
    assert {r.depth: r.n for r in analytics.depth_histogram(five).collect()} == {0: 3, 1: 2}


def test_coverage(five):
    assert analytics.coverage(five).first()[1:] == (1, 2)


def test_vocabulary_and_bigrams(five):
    t = turns_of(five)
    r = analytics.vocabulary(t).first()
    assert (r.n_tokens, r.n_distinct, r.ttr) == (32, 25, 0.78125) and abs(r.entropy - 4.538910) < 1e-6
    assert analytics.bigram_repetition(t, ["conv_id", "turn"]).first().repetition == 0.064516


def test_histogram(spark, five):
    w = turns_of(five).select("role", T.word_count(F.col("text")).alias("w"))
    h = {(r.role, r.bin): r.n for r in analytics.histogram(w, "w", by=["role"]).collect()}
    assert [h["user", i] for i in range(10)] == [1, 0, 0, 3, 0, 0, 1, 0, 0, 0]
    assert [h["assistant", i] for i in range(10)] == [0, 0, 0, 4, 0, 0, 0, 0, 0, 1]
    same = spark.createDataFrame([(5.0,)] * 3, "v double")
    assert [(r.bin, r.n) for r in analytics.histogram(same, "v").collect()] == [(0, 3)]
    assert analytics.histogram(same.limit(0), "v").count() == 0


def test_tokens(spark):
    r = spark.createDataFrame([("Hello, world!",), ("café résumé",), (None,)], "t string").select(T.tokens(F.col("t")).alias("w")).collect()
    assert [x.w for x in r] == [["hello", "world"], ["café", "résumé"], []]


def eight(spark):
    c = [
        [("user", "q1"), ("assistant", "a1")], [("user", "q2"), ("assistant", "a2")], [("user", "x"), ("assistant", "y")] * 3,
        [("user", "same"), ("assistant", "good")], [("user", "same"), ("assistant", "bad")], [("user", "u"), ("assistant", "")], [("user", 'é "q"\n<tag>'), ("assistant", "🙂")], [("user", "only")],
    ]
    s = [None, None, None, 0.87, 0.41, None, None, None]
    return spark.createDataFrame([(i, t, v) for i, (t, v) in enumerate(zip(c, s))], "conv_id long, conversations array<struct<role:string,content:string>>, final_score double")


@pytest.mark.parametrize("name,n", [("sharegpt", 8), ("oumi", 8), ("raw", 8), ("messages", 7), ("openai", 7), ("llama_factory", 7), ("alpaca", 6), ("alpaca_split", 9), ("dpo", 1)])
def test_format_sizes(spark, name, n):
    assert export.convert(eight(spark), name).count() == n


def test_unknown_format(spark):
    with pytest.raises(ValueError):
        export.convert(eight(spark), "nothing")


def test_sharegpt_merges_neighbours(spark):
    df = spark.createDataFrame([(1, [("system", "s"), ("user", "a"), ("user", "b"), ("assistant", "c"), ("assistant", "d")]), (2, [])], "conv_id long, conversations array<struct<role:string,content:string>>")
    r = export.sharegpt(df, system="top").collect()
    assert len(r) == 1 and [tuple(x) for x in r[0].conversations] == [("system", "top"), ("system", "s"), ("human", "a\nb"), ("gpt", "c\nd")]


def test_dpo_ties(spark):
    rows = [(1, "p", "first best", 0.9), (2, "p", "second best", 0.9), (3, "p", "first worst", 0.1), (4, "p", "last worst", 0.1)]
    df = spark.createDataFrame([(i, [("user", p), ("assistant", a)], s) for i, p, a, s in rows], "conv_id long, conversations array<struct<role:string,content:string>>, final_score double")
    r = export.dpo(df).first()
    assert (r.chosen, r.rejected) == ("first best", "last worst")


def test_tool_calls_are_numbered_across_rows(spark):
    call = [("user", "task"), ("assistant", 'Thought: look\nAction: banking.get_account_balance\nAction Input: {"id": 1}'), ("user", 'Observation: {"b": 2}'), ("assistant", "Thought: ok\nFinal Answer: done")]
    df = spark.createDataFrame([(1, call), (2, call)], "conv_id long, conversations array<struct<role:string,content:string>>")
    got = {r.conv_id: [json.loads(m) for m in r.messages] for r in traces.openai_tools(df).collect()}
    assert got[1][1]["tool_calls"][0]["function"]["name"] == "banking__get_account_balance"
    assert got[1][2]["tool_call_id"] == "call_1" and got[2][2]["tool_call_id"] == "call_2" and got[2][1]["tool_calls"][0]["id"] == "call_2"


def test_preference_statistics(spark):
    rows = [("a", "x", 0.9, "l1", 1), ("a", "y", 0.1, "l2", 2), ("b", "x", 0.6, "l1", 3), ("b", "y", 0.4, "l2", 4), ("c", "x", 0.5, "l1", 5), ("c", "y", 0.45, "l2", 6)]
    p = preference.build_pairs(spark.createDataFrame(rows, "prompt string, content string, score double, variation_label string, ord int"))
    r = preference.statistics(p).first()
    assert (r.attempted, r.valid, r.mean_gap, r.dominated) == (3, 2, 0.5, True)
    assert preference.statistics(p.limit(0)).first().discard_rate == 0.0


def test_taxonomy(spark):
    n = spark.createDataFrame([("f", "r", None, 0, "r"), ("f", "a", "r", 1, "a"), ("f", "b", "r", 1, "b")], taxonomy.NODES)
    cov = lambda ids: {r.depth: r.coverage for r in taxonomy.level_coverage(n, spark.createDataFrame([("f", i) for i in ids], "factor_id string, node_id string")).collect()}
    assert cov(["a", "b"]) == {0: 0.0, 1: 1.0} and cov(["a", "a"]) == {0: 0.0, 1: 0.5}
    assert {r.path for r in taxonomy.paths(n).collect()} == {"r", "r/a", "r/b"}
    assert taxonomy.invalid_nodes(n).count() == 0


def test_elo(spark):
    g = spark.createDataFrame([(0, 1, 1, 0), (0, 2, 2, 1)], "batch int, ord int, winner int, loser int")
    assert {r.item: r.rating for r in taxonomy.elo(g).collect()} == {0: 1484.0, 1: 1499.263693, 2: 1516.736307}


def test_document_weights(spark):
    w = spark.createDataFrame([(0, None), (1, None), (1, 4), (4, 4)], "used int, target int").select(sampling.usage_weight(F.col("used"), F.col("target")).alias("w")).collect()
    assert [r.w for r in w] == [1.0, 0.5, 3.0, 0.0]


def test_weighted_sample_takes_all_with_weight(spark):
    d = spark.createDataFrame([(1, 0.0), (2, 1.0), (3, 2.0)], "id long, weight double")
    assert {r.id for r in sampling.weighted_sample(d, 5).collect()} == {2, 3}


@pytest.mark.parametrize("n,ratio,want", [(100, 0.1, 10), (5, 0.01, 1), (777, 0.25, 194)])
def test_split_sizes(spark, n, ratio, want):
    r = sampling.split(spark.range(n), F.col("id"), ratio).collect()
    assert len(r) == n and sum(x.split == "val" for x in r) == want


def test_composite(spark):
    d = spark.createDataFrame([(1, 0.2, 0.8), (2, None, None)], "conv_id int, coherence double, relevance double")
    w = {"coherence": 1.0, "relevance": 1.0}
    assert [r.overall for r in quality.composite(d, w, "mean").orderBy("conv_id").collect()] == [0.5, 0.0]
    assert quality.composite(d, w, "min").orderBy("conv_id").first().overall == 0.2
    assert quality.composite(d, w).where("conv_id = 2").first().strategy == "general_improvement"


def test_chained_and_ensemble(spark):
    h = spark.createDataFrame([(1, "a", 1, 1, "x" * 15), (1, "b", 3, 2, "y" * 40), (1, "c", 0, 3, "z")], "query_id int, retriever string, weight int, ord int, text string")
    assert vectors.chained(h).count() == 2
    assert [r.retriever for r in vectors.best_by_weight(h).orderBy("rank").collect()] == ["b", "a"]


def test_near_duplicates_equals_all_pairs(spark):
    v = spark.range(60).select(F.lit(1).alias("group"), "id", F.array(F.sin("id"), F.cos("id"), F.lit(0.5)).alias("v"))
    got = {(r.a, r.b) for r in vectors.near_duplicates(v, 0.9).collect()}
    import math

    x = {i: (math.sin(i), math.cos(i), 0.5) for i in range(60)}
    assert got == {(i, j) for i in x for j in x if i < j and round(sum(a * b for a, b in zip(x[i], x[j])) / 1.25, 6) > 0.9}


def test_alerts_without_data(spark):
    m = spark.createDataFrame([], "event_id long, metric string, ts timestamp_ntz, value double, model string")
    assert monitor.alerts(monitor.windows(m)).count() == 0


def test_readers(spark, tmp_path):
    p = tmp_path / "c.jsonl"
    p.write_text("\n".join(json.dumps({"conversations": [{"role": "user", "content": str(i)}]}) for i in range(5)))
    assert readers.conversation_jsonl(spark, str(p)).count() == 5
    assert [r.conversations[0].content for r in readers.conversation_jsonl(spark, str(p), limit=2, offset=1).collect()] == ["1", "2"]
    d = tmp_path / "d.jsonl"
    d.write_text('{"text": " a "}\nnot json\n\n{"text": "  "}\n{"id": "k", "text": "b"}\n')
    assert sorted((r.text, r.doc_id) for r in readers.document_jsonl(spark, str(d)).collect()) == [("a", f"{d}:1"), ("b", "k")]
    (tmp_path / "t.txt").write_text(" whole\nfile ")
    assert readers.text_files(spark, str(tmp_path), ("*.txt",)).first().text == "whole\nfile"
    (tmp_path / "x.csv").write_text("text,n\nhello,1\n,2\n")
    assert [r.text for r in readers.delimited(spark, str(tmp_path / "x.csv"), "text").collect()] == ["hello"]
    with pytest.raises(ValueError):
        readers.delimited(spark, str(tmp_path / "x.csv"), "none")


def test_chunks(spark):
    d = spark.createDataFrame([(1, "abcdefg"), (2, ""), (3, None)], "doc_id int, text string")
    assert [r.text for r in readers.chunked(d, 3).orderBy("chunk").collect()] == ["abc", "def", "g"]
    assert [r.text for r in readers.chunked(d, 4, 2).orderBy("chunk").collect()] == ["abcd", "cdef", "efg", "g"]


def test_call_outcome(spark):
    kind = "array<struct<name:string,args:string>>"
    rows = [([], []), ([], [("a", "1")]), ([("a", "1")], []), ([("a", "1")], [("a", "1")]), ([("a", "1")], [("a", "2")]), ([("a", "1"), ("b", "1")], [("b", "1"), ("a", "1")]), ([("a", "1"), ("b", "1")], [("a", "1")]), ([("a", "1")], [("c", "1")])]
    d = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, w {kind}, g {kind}")
    assert [r.o for r in d.orderBy("i").select(traces.call_outcome(F.col("w"), F.col("g")).alias("o")).collect()] == ["no_tools_needed", "unneeded_call", "missing_call", "exact_match", "wrong_arguments", "wrong_order", "partial_match", "wrong_tool"]


def test_stop_stream(spark, tmp_path):
    from loomspark.streaming import metrics

    spark.createDataFrame([("s", i, 1.0) for i in range(10)] + [("t", 1, 0.5)], "stream string, ord long, cost double").write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("stream string, ord long, cost double").parquet(str(tmp_path / "in"))
    assert [tuple(r) for r in metrics.run_once(metrics.stop_stream(s, 3.0), "stops").collect()] == [("s", 2, 3.0)]


def test_rules(spark):
    from loomspark.operators import rules

    d = spark.createDataFrame([(1, "TRUE", 3), (2, "12", 30), (3, "1.5", 31), (4, "x", 0)], "i int, v string, n int")
    assert [r.c.kind for r in d.select(rules.coerced(F.col("v")).alias("c")).collect()] == ["boolean", "integer", "number", "string"]
    assert [r.d for r in d.select(rules.auto_depth(F.col("n")).alias("d")).collect()] == [0, 1, 1, 0]
    assert d.select(rules.expected_personas(F.lit(2)).alias("e")).first().e == 155
    assert [(round(t.temperature, 2), t.label) for t in d.select(rules.temperatures(3).alias("t")).first().t] == [(0.1, "temperature_0.10"), (0.5, "temperature_0.50"), (0.9, "temperature_0.90")]
    assert rules.task_grid(spark).count() == 108
    assert rules.pick_bucket(spark.range(50).withColumnRenamed("id", "task_id"), rules.task_grid(spark)).count() == 50
    a = d.limit(1).select(rules.action_parts(F.lit('Action: app.go\nAction Input: {"a": 1}')).alias("p"), rules.action_parts(F.lit("Action: go")).alias("q")).first()
    assert tuple(a.p) == ("app", "go", '{"a": 1}') and tuple(a.q) == ("default_app", "go", "")
    s = d.limit(1).select(rules.five_descriptions(F.array(*map(F.lit, ["a", " a ", "b  b", "", "c", "d", "e", "f"]))).alias("s")).first().s
    assert s == ["a", "b b", "c", "d", "e"]
    f = d.limit(1).select(rules.forbidden(F.array(F.lit("Hot Day"), F.lit("snow")), [("hot", "SNOW")]).alias("f"), rules.retryable(F.lit(503), F.lit(None)).alias("r"), rules.backoff(F.lit(9)).alias("b")).first()
    assert (f.f, f.r, f.b) == (True, True, 60.0)
    j = rules.job_progress(spark.createDataFrame([(1, 50, 200, 10.0), (2, 0, 0, 0.0)], "job_id int, done int, total int, seconds double")).orderBy("job_id").collect()
    assert tuple(j[0][1:]) == (25.0, 5.0, 30.0) and j[1].percent == 0.0
    old, new = (spark.createDataFrame(x, "k int, ord int, v string") for x in ([(1, 1, "a"), (2, 1, "b")], [(2, 2, "c"), (2, 3, "d")]))
    assert {(r.k, r.v) for r in rules.upserted(old, new, "k").collect()} == {(1, "a"), (2, "d")}
    q = spark.createDataFrame([(i, "q", t) for i, t in enumerate(["2024-01-01 00:00:00", "2024-01-01 00:30:00", "2024-01-01 01:10:00", "2024-01-01 02:00:00"])], "request_id int, query string, t string").withColumn("ts", F.col("t").cast("timestamp"))
    assert [r.hit for r in rules.cache_hits(q).orderBy("request_id").collect()] == [False, True, False, True]


def test_generation_stage(spark):
    from loomspark.operators import generation

    d = spark.createDataFrame([(1, "a"), (2, None), (3, "a")], "i int, prompt string")
    got = {r.i: r.answer for r in generation.generate(d, "prompt", batch=1).collect()}
    assert got[1] == got[3] and got[2] is None
    r = generation.retried(d, "prompt", lambda c: f"{c} LIKE 'answer%'").collect()
    assert {x.i: x.attempt for x in r} == {1: 0, 2: None, 3: 0}


def test_order_by_ranges(spark):
    from loomspark.functions.order import next_value, running_sum_before

    keys = [3, 4, 9, 1000, 5000, 5001, 10**7]
    d = spark.createDataFrame([(k, k % 7 + 1) for k in keys], "k long, v long")
    want, total = {}, 0
    for k in keys:
        want[k] = total
        total += k % 7 + 1
    assert {r.k: r.s for r in running_sum_before(d, "k", "v", "s").collect()} == want
    assert {r.k: r.n for r in next_value(d, "k", "v", "n").collect()} == {k: (x % 7 + 1 if x else None) for k, x in zip(keys, [*keys[1:], None])}
    assert next_value(d.limit(0), "k", "v", "n").count() == 0


def test_near_duplicates_by_blocks(spark):
    import random

    rng = random.Random(9)
    rows = [(g, i, [rng.gauss(0, 1) for _ in range(3)]) for i in range(60) for g in ("hot",)] + [("b", 100, [1.0, 0.0, 0.0]), ("b", 101, [2.0, 0.0, 0.0]), ("b", 102, [1.0]), ("b", 103, None), ("b", 104, []), ("b", 105, [0.0, 0.0, 0.0]), (None, 106, [1.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "group string, id long, v array<double>")
    norm = lambda x: math.sqrt(sum(t * t for t in x))
    want = set()
    for g, i, x in rows:
        for h, j, y in rows:
            if g and g == h and i < j and x and y and len(x) == len(y) and norm(x) * norm(y) > 0:
                s = round(sum(p * q for p, q in zip(x, y)) / (norm(x) * norm(y)), 6)
                if s > 0.9:
                    want.add((g, i, j, s))
    for block in (7, 2048):
        assert {tuple(r) for r in vectors.near_duplicates(df, 0.9, block).collect()} == want
    q = df.where("group = 'hot' AND id < 20").select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    items = df.where("group = 'hot'").select(F.col("id").alias("item_id"), "v")
    assert sorted(vectors.top_k(q, items, 2, 0.1, 3).collect()) == sorted(vectors.top_k(q, items, 2, 0.1).collect())


def test_lenient_lines_and_order_over_files(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"x": 1}\n\n{"x": \n{"x": null}\nnot json\n{"y": 2}\n')
    assert [r.x for r in readers.lenient_jsonl(spark, str(tmp_path / "a.jsonl"), "x long").collect()] == [1, None, None]
    for name in ("p1", "p2"):
        (tmp_path / f"{name}.json").write_text("".join(f'{{"persona": "{name}{i}"}}\n' for i in range(5)))
    got = readers.conversation_jsonl(spark, str(tmp_path / "p*.json"), limit=4, offset=3).collect()
    assert [r.persona for r in got] == ["p13", "p14", "p20", "p21"]


def test_paths_of_any_depth(spark):
    rows = [("f", f"n{i}", f"n{i - 1}" if i else None, i, str(i)) for i in range(40)] + [("f", "x", "y", 1, "x"), ("f", "y", "x", 2, "y")]
    df = spark.createDataFrame(rows, taxonomy.NODES)
    assert {r.node_id: r.path for r in taxonomy.paths(df).collect()} == {f"n{i}": "/".join(map(str, range(i + 1))) for i in range(40)}
    assert {r.node_id for r in taxonomy.invalid_nodes(df).collect()} == {"x"}


def test_retries_send_each_prompt_once(spark, tmp_path):
    def factory():
        def client(prompts):
            import uuid

            (tmp_path / uuid.uuid4().hex).write_text("\n".join(prompts))
            return ["bad" if p.startswith("no") else "good" for p in prompts]

        return client

    df = spark.createDataFrame([(i, f"{'no' if i % 2 else 'yes'}{i}") for i in range(10)], "i long, prompt string")
    got = generation.retried(df, "prompt", lambda c: f"{c} = 'good'", attempts=4, factory=factory).collect()
    assert {(r.i, r.attempt) for r in got} == {(i, None if i % 2 else 0) for i in range(10)}
    asked = [line for p in tmp_path.iterdir() for line in p.read_text().split()]
    assert sorted(asked) == sorted([f"yes{i}" for i in range(0, 10, 2)] + [f"no{i}" for i in range(1, 10, 2)] * 4)


def test_fixed_values(spark):
    from loomspark.operators import export, relations, rules

    d = spark.createDataFrame([("RESOURCE_EXHAUSTED now", True), ("Too many requests", True), ("temporarily unavailable", True), ("temporarily", False), ("timeout", False), (None, False)], "m string, want boolean")
    assert all(r.got == r.want for r in d.select("want", rules.retryable(F.lit(200), F.col("m")).alias("got")).collect())
    one = spark.createDataFrame([(1, [("user", "q"), ("assistant", "a")], "t1")], "conv_id long, conversations array<struct<role:string,content:string>>, trajectory_id string")
    assert tuple(export.agent_dpo(one).first()) == (1, "q", "a", "Unable to fulfill request.", "t1")
    s = spark.createDataFrame([(1, 0.2), (2, 0.1), (3, 0.9)], "id long, score double")
    assert relations.similarity_summary(s, 0.5, 1).first().examples == "2" and relations.similarity_summary(s.limit(0), 0.5).first().n == 0


def test_written_tables_can_be_cleared(spark):
    from loomspark.sources import shared

    shared.clear(spark)
    df = shared.written(spark.range(5))
    folder, name = shared.shared_dir(spark), shared._paths[-1].rpartition("/")[2]
    assert df.count() == 5 and name in shared.children(spark, folder)
    assert shared.clear(spark) == 1 and name not in shared.children(spark, folder) and shared.clear(spark) == 0
