"""Agent traces: tool-call formats, trajectory gates, tool statistics and ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.order import running_sum_before, running_sums
from ..functions.text import strip


def _before(text: Column, mark: str) -> Column:
    return F.get(F.split(text, mark, 2), F.lit(0))


def _after(text: Column, mark: str) -> Column:
    return F.get(F.split(text, mark, 2), F.lit(1))


def parsed(rows: DataFrame) -> DataFrame:
    """``rows(conv_id, conversations)`` as one row a message: kind (call, observation, text), role, thought, tool
    name, arguments, text, and ``call``: the number of the last tool call so far.

    Calls are numbered over the whole table in (conv_id, position) order. Numbers inside a conversation come
    from its own rows; the start of each from a running sum over one short row a conversation, by ranges of ids.
    """
    m = rows.select("conv_id", F.posexplode("conversations").alias("pos", "x")).select("conv_id", "pos", F.col("x.role").alias("role"), F.coalesce("x.content", F.lit("")).alias("content")).where("role IN ('user', 'assistant')")
    content = F.col("content")
    is_call = (F.col("role") == "assistant") & content.contains("Action:")
    is_seen = (F.col("role") == "user") & content.startswith("Observation:")
    thought = strip(F.replace(_before(content, "Action:"), F.lit("Thought:"), F.lit("")))
    action = _after(content, "Action:")
    args = F.coalesce(strip(_after(action, "Action Input:")), F.lit("{}"))
    said = strip(F.replace(F.replace(content, F.lit("Final Answer:"), F.lit("")), F.lit("Thought:"), F.lit("")))
    m = m.select(
        "conv_id", "pos", F.when(is_call, "call").when(is_seen, "observation").otherwise("text").alias("kind"),
        F.when(is_seen, "tool").otherwise(F.col("role")).alias("role"), F.when(is_call, F.nullif(thought, F.lit(""))).alias("thought"),
        F.when(is_call, F.replace(strip(_before(action, "Action Input:")), F.lit("."), F.lit("__"))).alias("tool"), F.when(is_call, F.when(args == "", "{}").otherwise(args)).alias("args"),
        F.when(is_seen, strip(F.substring(content, 13, 1 << 30))).when(~is_call, said).alias("text"),
    )
    inside = F.sum((F.col("kind") == "call").cast("long")).over(Window.partitionBy("conv_id").orderBy("pos"))
    per = m.groupBy("conv_id").agg(F.count_if(F.col("kind") == "call").alias("n"))
    start = running_sum_before(per, "conv_id", "n", "start").drop("n")
    return m.withColumn("inside", inside).join(start, "conv_id").withColumn("call", F.col("inside") + F.col("start")).drop("inside", "start")


def _ordered(m: DataFrame, message: Column) -> DataFrame:
    return m.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("pos", message.alias("m")))).alias("t")).select("conv_id", F.transform("t", lambda x: x["m"]).alias("messages"))


def openai_tools(rows: DataFrame) -> DataFrame:
    """Messages as JSON: tool calls with ids ``call_n``, tool results with the id of the call before."""
    m = parsed(rows)
    id_ = F.concat(F.lit("call_"), F.col("call").cast("string"))
    call = F.to_json(F.struct(F.lit("assistant").alias("role"), F.col("thought").alias("content"), F.array(F.struct(id_.alias("id"), F.lit("function").alias("type"), F.struct(F.col("tool").alias("name"), F.col("args").alias("arguments")).alias("function"))).alias("tool_calls")))
    seen = F.to_json(F.struct(F.lit("tool").alias("role"), id_.alias("tool_call_id"), F.col("text").alias("content")))
    text = F.to_json(F.struct("role", F.col("text").alias("content")))
    return _ordered(m, F.when(F.col("kind") == "call", call).when(F.col("kind") == "observation", seen).otherwise(text))


def anthropic_tools(rows: DataFrame) -> DataFrame:
    """Content blocks: text (if there is a thought) and tool_use, tool_result; arguments that are not a JSON
    object become an empty one."""
    m = parsed(rows)
    id_ = F.concat(F.lit("toolu_"), F.col("call").cast("string"))
    args = F.coalesce(F.from_json("args", "map<string,string>", {"mode": "PERMISSIVE"}), F.create_map().cast("map<string,string>"))
    use = F.to_json(F.struct(F.lit("tool_use").alias("type"), id_.alias("id"), F.col("tool").alias("name"), args.alias("input")))
    thought = F.when(F.col("thought").isNotNull(), F.to_json(F.struct(F.lit("text").alias("type"), F.col("thought").alias("text"))))
    result = F.to_json(F.struct(F.lit("tool_result").alias("type"), id_.alias("tool_use_id"), F.col("text").alias("content")))
    said = F.to_json(F.struct(F.lit("text").alias("type"), F.col("text").alias("text")))
    blocks = F.when(F.col("kind") == "call", F.array_compact(F.array(thought, use))).when(F.col("kind") == "observation", F.array(result)).otherwise(F.array(said))
    return _ordered(m, F.struct(F.when(F.col("kind") == "observation", "user").otherwise(F.col("role")).alias("role"), blocks.alias("content")))


def hermes_tools(rows: DataFrame) -> DataFrame:
    """Calls and results as tagged text, without ids."""
    m = parsed(rows)
    call = F.concat(F.coalesce(F.concat("thought", F.lit("\n")), F.lit("")), F.lit('<tool_call>\n{"name": "'), "tool", F.lit('", "arguments": '), "args", F.lit("}\n</tool_call>"))
    seen = F.concat(F.lit("<tool_response>\n"), "text", F.lit("\n</tool_response>"))
    return _ordered(m, F.struct("role", F.when(F.col("kind") == "call", call).when(F.col("kind") == "observation", seen).otherwise(F.col("text")).alias("content")))


def hard_gate(turns: DataFrame) -> DataFrame:
    """``turns(traj_id, status, observation)``: whether a trajectory has a failed observation."""
    bad = (F.col("status") == "error") | F.get_json_object("observation", "$.error").isNotNull()
    return turns.groupBy("traj_id").agg(F.coalesce(F.max(bad), F.lit(False)).alias("rejected"))


def judged(verdicts: DataFrame, rubrics: list[str], limit: float = 0.75) -> DataFrame:
    """Valid flag and mean rubric score together decide."""
    mean = sum((F.col(r) for r in rubrics[1:]), F.col(rubrics[0])) / len(rubrics)
    return verdicts.select("traj_id", F.round(mean, 6).alias("score"), (F.col("is_valid") & (mean >= limit)).alias("accepted"))


def least_used(tools: DataFrame, calls: DataFrame, k: int = 10) -> DataFrame:
    """``tools(tool, reg_ord)``, ``calls(tool)``: the k tools called least; ties in order of registration."""
    c = calls.groupBy("tool").agg(F.count("*").alias("n"))
    return tools.join(c, "tool", "left").select("tool", "reg_ord", F.coalesce("n", F.lit(0)).alias("n")).orderBy("n", "reg_ord").limit(k)


def resolve_tool(names: DataFrame, tools: DataFrame) -> DataFrame:
    """``names(name)`` to ``tools(tool, reg_ord)``: the tool of that name, else the first registered whose last
    part it is. Both are equi-joins."""
    exact = names.join(tools.select(F.col("tool").alias("name"), F.col("tool").alias("exact")), "name", "left")
    last = tools.select(F.element_at(F.split("tool", r"\."), -1).alias("name"), "tool", "reg_ord").groupBy("name").agg(F.min_by("tool", "reg_ord").alias("by_suffix"))
    return exact.join(last, "name", "left").select("name", F.coalesce("exact", "by_suffix").alias("tool"))


def ledger(transfers: DataFrame) -> DataFrame:
    """``transfers(ord, src, dst, amount)`` -> balance of each account after each of its transfers, in cents' precision."""
    sides = transfers.select("ord", F.explode(F.array(F.struct(F.col("src").alias("account"), (-F.col("amount")).alias("delta")), F.struct(F.col("dst").alias("account"), F.col("amount").alias("delta")))).alias("x")).select("ord", "x.*")
    run = running_sums(sides, ["account"], ["ord", "delta"], {"cents": F.round(F.col("delta") * 100).cast("long")})
    return run.select("account", "ord", F.round("delta", 2).alias("delta"), F.round(F.col("cents") / F.lit(100.0), 2).alias("balance"))


def tool_statistics(calls: DataFrame) -> DataFrame:
    return calls.groupBy("tool").agg(F.count("*").alias("n"), F.count_distinct("conv_id").alias("conversations"))


def call_outcome(want: Column, got: Column) -> Column:
    """Category of arrays of ``struct<name, args>``: predicted against wanted calls, by position."""
    names = lambda c: F.transform(c, lambda x: x["name"])
    return (
        F.when((F.size(want) == 0) & (F.size(got) == 0), "no_tools_needed").when(F.size(want) == 0, "unneeded_call").when(F.size(got) == 0, "missing_call").when(want == got, "exact_match")
        .when(names(want) == names(got), "wrong_arguments").when(F.array_sort(names(want)) == F.array_sort(names(got)), "wrong_order").when(F.size(F.array_intersect(names(want), names(got))) > 0, "partial_match").otherwise("wrong_tool")
    )
