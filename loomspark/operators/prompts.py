"""Prompts and their settings, put together inside a row (one join for skills)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import json as J
from ..functions import text as T

# Fixed values.
NO_CONTEXT = "No relevant context found."
RAG_HEADING = "Additional relevant information:"
SKILL_HEADING = "## Context-Specific Skill"
SKILL_ADVICE = "Use this skill only when it is relevant to the current request and context."
#: strategy: default, factor and cap of the temperature; what is added to the system prompt
STRATEGIES = {
    "coherence": (0.7, 0.8, 0.5, "\nEnsure your responses directly address the questions asked."),
    "grounding": (0.7, 0.7, 0.4, "\nBase your responses strictly on the provided context."),
    "relevance": (0.7, 0.8, 0.5, "\nGenerate questions that are directly relevant to the provided context."),
    "factuality": (0.7, 0.7, 0.3, ""),
}


def without_context(context: Column) -> Column:
    """True for a null or empty context, and for the sentence that stands for none."""
    return F.coalesce((context == "") | (context == NO_CONTEXT), F.lit(True))


def with_retrieved(context: Column, found: Column) -> Column:
    """What was retrieved, after the context if there is one; without anything retrieved the context alone."""
    context = F.coalesce(context, F.lit(""))
    return F.when(context == "", found).when(found.isNull(), context).otherwise(F.concat(context, F.lit(f"\n\n{RAG_HEADING}\n"), found))


def filled(template: str, **values: Column) -> Column:
    """The template with each ``{name}`` replaced; names without a value stay. Text that was put in is not read again."""
    parts, rest = [], template
    while rest:
        at = {rest.find(f"{{{k}}}"): k for k in values if f"{{{k}}}" in rest}
        if not at:
            break
        first = min(at)
        parts += [F.lit(rest[:first]), F.coalesce(values[at[first]].cast("string"), F.lit(""))]
        rest = rest[first + len(at[first]) + 2 :]
    return F.concat(*parts, F.lit(rest))


def with_count(prompt: Column, n: Column) -> Column:
    """``{n_instructions}`` replaced by the number, at least 1."""
    return F.replace(prompt, F.lit("{n_instructions}"), F.greatest(n, F.lit(1)).cast("string"))


def with_skills(prompts: DataFrame, skills: DataFrame) -> DataFrame:
    """``prompts(context_id, prompt, ...)`` and the skills of contexts ``(context_id, name, description, content)``; a
    prompt without one stays as it is. Missing parts of a skill are empty; of several skills of a context the greatest
    by name, description and content is taken, so that no prompt is doubled."""
    none = F.lit("")
    parts = F.struct(F.coalesce("name", none).alias("skill"), F.coalesce("description", none).alias("description"), F.coalesce("content", none).alias("content"))
    s = skills.groupBy("context_id").agg(F.max(parts).alias("x")).select("context_id", "x.*")
    block = F.concat(F.regexp_replace("prompt", r"(?U)\s+$", ""), F.lit(f"\n\n{SKILL_HEADING}\n\n{SKILL_ADVICE}\n\n### "), "skill", F.lit("\nWhen to use: "), "description", F.lit("\n\n"), T.strip(F.col("content")))
    return prompts.join(s, "context_id", "left").withColumn("prompt", F.when(F.col("skill").isNull(), F.col("prompt")).otherwise(block)).drop("description", "content")


def regenerated(strategy: Column, temperature: Column, system: Column) -> Column:
    """A struct of the temperature and the system prompt for another attempt; an unknown strategy changes nothing."""
    warm, said = temperature, F.coalesce(system, F.lit(""))
    new_t, new_s = F.when(F.lit(False), warm), F.when(F.lit(False), said)
    for name, (default, factor, cap, more) in STRATEGIES.items():
        new_t = new_t.when(strategy == name, F.least(F.coalesce(warm, F.lit(default)) * factor, F.lit(cap)))
        new_s = new_s.when(strategy == name, F.concat(said, F.lit(more)))
    return F.struct(new_t.otherwise(warm).alias("temperature"), new_s.otherwise(said).alias("system_prompt"))


# Default, factor, addend and cap of other settings by strategy, and what the safety strategy blocks.
LIMITS = {
    "coherence": {"top_p": (0.9, 0.9, 0.0, 0.7)},
    "grounding": {"context_window": (1000.0, 1.5, 0.0, 4000.0), "retrieval_k": (3.0, 1.0, 2.0, 10.0)},
    "relevance": {"context_window": (1000.0, 1.2, 0.0, 3000.0)},
}
SAFETY = ("HARM_CATEGORY_HARASSMENT", "HARM_CATEGORY_HATE_SPEECH")
THRESHOLD = "BLOCK_MEDIUM"


def regenerated_settings(strategy: Column, top_p: Column, context_window: Column, retrieval_k: Column) -> Column:
    """A struct of ``top_p``, ``context_window``, ``retrieval_k`` and ``safety_settings`` for another attempt: what a
    strategy does not change stays, null too."""
    given = {"top_p": top_p, "context_window": context_window, "retrieval_k": retrieval_k}
    out = []
    for name, old in given.items():
        new = F.when(F.lit(False), old.cast("double"))
        for kind, changes in LIMITS.items():
            if name in changes:
                default, factor, more, cap = changes[name]
                new = new.when(strategy == kind, F.least(F.coalesce(old.cast("double"), F.lit(default)) * factor + more, F.lit(cap)))
        out.append(new.otherwise(old.cast("double")).alias(name))
    blocked = F.array(*(F.struct(F.lit(c).alias("category"), F.lit(THRESHOLD).alias("threshold")) for c in SAFETY))
    return F.struct(*out, F.when(strategy == "safety", blocked).alias("safety_settings"))


def synthesized(text: Column) -> Column:
    """A struct of the task after ``PROMPT:`` and the JSON after ``INITIAL_CONTEXT:``, in a fence or bare; what is no
    JSON gives ``{}``. Without ``PROMPT:`` the whole text is the task."""
    said = F.get(F.split(text, "PROMPT:", 2), F.lit(1))
    halves = F.split(said, "INITIAL_CONTEXT:", 2)
    tail = F.get(halves, F.lit(1))
    fence = F.when(F.contains(tail, F.lit("```json")), "```json").otherwise("```")
    inner = F.when(F.contains(tail, F.lit("```")), F.get(F.split(F.substr(tail, F.locate("```", tail) + F.length(fence)), "```", 2), F.lit(0))).otherwise(tail)
    task = F.when(F.contains(text, F.lit("PROMPT:")), F.get(halves, F.lit(0))).otherwise(text)
    return F.struct(F.regexp_replace(T.strip(task), r'^"+|"+$', "").alias("task"), F.coalesce(F.when(J.parsed(T.strip(inner)).isNotNull(), F.get_json_object(T.strip(inner), "$")), F.lit("{}")).alias("context"))


def display_rows(rows: DataFrame, most: int = 200) -> DataFrame:
    """``rows(conv_id, conversations, context, persona)`` as shown in a list: the first two messages, a short context."""
    content = lambda i: F.coalesce(F.get("conversations", F.lit(i))["content"], F.lit(""))
    context = F.coalesce(F.col("context"), F.lit(""))
    short = F.when(context == "", "").otherwise(F.concat(F.substring(context, 1, most), F.lit("...")))
    persona = F.coalesce(F.nullif(F.col("persona"), F.lit("")), F.lit("N/A"))
    return rows.select("conv_id", content(0).alias("instruction"), content(1).alias("response"), short.alias("context"), persona.alias("persona"))


STEP = "struct<thought:string,tool:string,arguments:string,observation:string>"


def trajectory_conversations(trajectories: DataFrame) -> DataFrame:
    """``trajectories(trajectory_id, task, turns, final_answer, verdict)``, turns of the fields of ``STEP``, as
    conversations: the task, each thought with its call, each observation, the final answer. ``metadata`` holds the id
    and, if there is one, the verdict (JSON)."""
    said = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))

    def step(x):
        call = F.when(x["tool"].isNotNull(), F.concat(F.lit("\nAction: "), x["tool"], F.lit("\nAction Input: "), F.coalesce(x["arguments"], F.lit("{}")))).otherwise("")
        thought = said("assistant", F.concat(F.lit("Thought: "), F.coalesce(x["thought"], F.lit("")), call))
        seen = said("user", F.concat(F.lit("Observation: "), x["observation"]))
        return F.when(x["observation"].isNotNull(), F.array(thought, seen)).otherwise(F.array(thought))

    answer = F.when(F.coalesce("final_answer", F.lit("")) != "", F.array(said("assistant", F.concat(F.lit("Final Answer: "), "final_answer")))).otherwise(F.slice(F.array(said("assistant", F.lit(""))), 1, 0))
    turns = F.flatten(F.transform(F.coalesce("turns", F.array().cast(f"array<{STEP}>")), step))
    metadata = F.map_filter(F.create_map(F.lit("trajectory_id"), F.col("trajectory_id").cast("string"), F.lit("judge_verdict"), F.col("verdict")), lambda k, v: v.isNotNull())
    return trajectories.select("trajectory_id", F.concat(F.array(said("user", F.coalesce("task", F.lit("")))), turns, answer).alias("conversations"), metadata.alias("metadata"))


def tool_documentation(tools: DataFrame) -> DataFrame:
    """``tools(app, app_ord, app_description, action, action_ord, description, parameters)``, parameters an array of
    ``struct<name, type, required>`` -> ``app, documentation``: one text for each app, its actions in their order."""
    shown = F.transform("parameters", lambda p: F.concat(p["name"], F.lit(": "), p["type"], F.when(p["required"], "").otherwise(" (optional)")))
    line = F.concat(F.lit("- `"), "app", F.lit("."), "action", F.lit("("), F.array_join(shown, ", "), F.lit(")`: "), F.coalesce("description", F.lit("")))
    # the actions of an app are a stated interface: a few dozen short lines
    lines = tools.groupBy("app").agg(F.min("app_ord").alias("app_ord"), F.first("app_description", True).alias("about"), F.array_sort(F.collect_list(F.struct("action_ord", line.alias("line")))).alias("lines"))
    head = F.concat(F.lit("### App: "), "app", F.lit("\nDescription: "), F.coalesce("about", F.lit("")), F.lit("\nActions:\n"))
    return lines.select("app", "app_ord", F.concat(head, F.array_join(F.transform("lines", lambda x: x["line"]), "\n"), F.lit("\n")).alias("documentation"))
