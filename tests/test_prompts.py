"""Prompts, and preference formats with shared turns, on small rows."""

from pyspark.sql import functions as F

from loomspark.operators import preference, prompts, relations

PAIR = """prompt string, valid boolean, chosen struct<content:string,score:double,variation_label:string>, rejected struct<content:string,score:double,variation_label:string>,
shared_prefix array<struct<role:string,content:string>>, all_scores array<struct<response:string,overall_score:double,model:string>>"""


def test_shared_turns(spark):
    a, b = ("yes", 0.9, "x"), ("no", 0.1, "y")
    rows = [("q", True, a, b, [("system", "s"), ("user", "u"), ("assistant", "v")], [("yes", 0.9, "x"), ("so", 0.5, "z"), ("no", 0.1, "y")]), ("p", True, a, b, None, None), ("r", False, a, b, None, [])]
    df = spark.createDataFrame(rows, PAIR)
    assert {r.chosen for r in preference.as_anthropic_hh(df).collect()} == {"Human: u\n\nAssistant: v\n\nHuman: q\n\nAssistant: yes", "Human: p\n\nAssistant: yes"}
    assert {r.instruction: len(r.completions) for r in preference.as_ultrafeedback(df).collect()} == {"q": 3, "p": 2}
    assert sorted([m.role for m in r.prompt] for r in preference.as_chat(df, "be kind").collect()) == [["system", "system", "user", "assistant", "user"], ["system", "user"]]


def test_prompts_with_nulls(spark):
    df = spark.createDataFrame([(None,), ("",), ("No relevant context found.",), ("c",)], "context string")
    c = F.col("context")
    got = df.select(prompts.without_context(c), prompts.with_retrieved(c, F.lit("f")), prompts.filled("{b}{a}-{other}", a=c, b=F.lit("{a}"))).collect()
    assert [r[0] for r in got] == [True, True, True, False]
    assert [r[1] for r in got][:2] == ["f", "f"] and got[3][1] == "c\n\nAdditional relevant information:\nf"
    assert got[3][2] == "{a}c-{other}" and got[0][2] == "{a}-{other}"
    skills = spark.createDataFrame([(1, "n", "d", " body ")], "context_id int, name string, description string, content string")
    asked = spark.createDataFrame([(1, "p \n"), (None, "p \n"), (2, None)], "context_id int, prompt string")
    out = {r.context_id: r.prompt for r in prompts.with_skills(asked, skills).collect()}
    assert out[1].startswith("p\n\n## ") and out[1].endswith("When to use: d\n\nbody") and out[None] == "p \n" and out[2] is None


def test_synthesized(spark):
    texts = [None, "", "plain", "PROMPT: a", 'PROMPT: "a"', 'PROMPT: a INITIAL_CONTEXT: ```\n{"k": 1}\n```', "PROMPT: a INITIAL_CONTEXT: {broken"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(prompts.synthesized(F.col("t")).alias("x")).select("x.*")
    assert [tuple(r) for r in df.collect()] == [(None, "{}"), ("", "{}"), ("plain", "{}"), ("a", "{}"), ("a", "{}"), ("a", '{"k":1}'), ("a", "{}")]


def test_prompts_that_lack_parts(spark):
    c = spark.createDataFrame([("ctx", None), (None, None), ("ctx", "f")], "context string, found string")
    assert [r[0] for r in c.select(prompts.with_retrieved(F.col("context"), F.col("found"))).collect()] == ["ctx", None, "ctx\n\nAdditional relevant information:\nf"]
    skills = spark.createDataFrame([(1, None, None, "body"), (2, "a", "x", "y"), (2, "b", None, None)], "context_id int, name string, description string, content string")
    asked = spark.createDataFrame([(1, "p"), (2, "p"), (3, "p")], "context_id int, prompt string")
    out = {r.context_id: r.prompt for r in prompts.with_skills(asked, skills).collect()}
    assert len(out) == 3 and out[1].endswith("### \nWhen to use: \n\nbody") and "### b\n" in out[2] and out[3] == "p" and prompts.with_skills(asked, skills).count() == 3


def test_only_json_is_a_context(spark):
    tails = {'{"a":1}': '{"a":1}', '{"a":1} trailing': "{}", "{'a':1}": "{}", "": "{}", '```json\n{"a": 1}\n``` x': '{"a":1}', "```\n[1,]\n```": "{}"}
    df = spark.createDataFrame([(k, f"PROMPT: do INITIAL_CONTEXT: {k}") for k in tails], "k string, t string")
    assert {r.k: (r.x.task, r.x.context) for r in df.select("k", prompts.synthesized(F.col("t")).alias("x")).collect()} == {k: ("do", v) for k, v in tails.items()}


def test_skills_by_the_stripped_text(spark):
    import hashlib

    texts = spark.createDataFrame([(1, "  a text \n"), (2, "a text"), (3, None), (4, "other")], "text_id int, text string")
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    contexts = spark.createDataFrame([(digest("a text"), "c"), (digest(""), "none")], "digest string, context_id string")
    versions = spark.createDataFrame([("c", "v9", 1), ("c", "v10", 2), ("none", "v1", 1)], "context_id string, version string, ord int")
    got = relations.selected_skills(texts, contexts, spark.createDataFrame([], "context_id string, version string"), versions)
    assert {r.text_id: (r.context_id, r.version) for r in got.collect()} == {1: ("c", "v10"), 2: ("c", "v10"), 3: ("none", "v1"), 4: (None, None)}


def test_trajectories_and_tools(spark):
    rows = [("t1", "do it", [("think", "app.act", '{"x": 1}', "seen"), ("so", None, None, None)], "end", '{"ok": true}'), ("t2", None, None, None, None), ("t3", "x", [], "", None)]
    df = spark.createDataFrame(rows, f"trajectory_id string, task string, turns array<{prompts.STEP}>, final_answer string, verdict string")
    got = {r.trajectory_id: r for r in prompts.trajectory_conversations(df).collect()}
    assert [(x.role, x.content) for x in got["t1"].conversations] == [("user", "do it"), ("assistant", 'Thought: think\nAction: app.act\nAction Input: {"x": 1}'), ("user", "Observation: seen"), ("assistant", "Thought: so"), ("assistant", "Final Answer: end")]
    assert got["t1"].metadata == {"trajectory_id": "t1", "judge_verdict": '{"ok": true}'} and got["t2"].metadata == {"trajectory_id": "t2"}
    assert [x.content for x in got["t2"].conversations] == [""] and len(got["t3"].conversations) == 1
