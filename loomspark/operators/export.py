"""Dataset formats: conversation rows to training rows.

A format is a function from rows with ``conversations array<struct<role, content>>`` to rows; ``FORMATS`` names
them. Everything stays inside a row, so an export is one projection over the scan.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

C = "conversations"
SHAREGPT = {"user": "human", "assistant": "gpt"}
CONTEXT = "instruction_context"
MESSAGE = "array<struct<role:string,content:string>>"


def _renamed(role: Column) -> Column:
    return F.when(role == "user", "human").when(role == "assistant", "gpt").otherwise(role)


def _empty(kind: str) -> Column:
    return F.array().cast(kind)


def _if(condition: Column, row: Column) -> Column:
    """One output row, or none."""
    one = F.array(row)
    return F.when(condition, one).otherwise(F.slice(one, 1, 0))


def _system(text: str | None, role: str, content: str) -> Column:
    kind = f"array<struct<{role}:string,{content}:string>>"
    return F.array(F.struct(F.lit("system").alias(role), F.lit(text).alias(content))).cast(kind) if text else _empty(kind)


def first_content(role: str) -> Column:
    """The first content of a role that is neither null nor empty."""
    return F.get(F.filter(F.transform(F.filter(C, lambda x: x["role"] == role), lambda x: x["content"]), lambda t: t != ""), F.lit(0))


def last_content(role: str) -> Column:
    return F.try_element_at(F.transform(F.filter(C, lambda x: x["role"] == role), lambda x: x["content"]), F.lit(-1))


def pairs() -> Column:
    """Adjacent (user, assistant) turns with their position; such pairs cannot overlap."""
    n = F.size(C)
    at = F.when(n > 1, F.sequence(F.lit(0), F.greatest(n - 2, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    hit = F.filter(at, lambda i: (F.get(C, i)["role"] == "user") & (F.get(C, i + 1)["role"] == "assistant"))
    return F.transform(hit, lambda i: F.struct(i.alias("at"), F.get(C, i)["content"].alias("u"), F.get(C, i + 1)["content"].alias("a")))


def _sharegpt(system: str | None = None) -> Column:
    kind = "array<struct<from:string,value:string>>"

    def step(acc, x):
        last = F.try_element_at(acc, F.lit(-1))
        role = _renamed(x["role"])
        merged = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(role.alias("from"), F.concat(last["value"], F.lit("\n"), x["content"]).alias("value"))).cast(kind))
        return F.when((F.size(acc) > 0) & (last["from"] == role), merged).otherwise(F.concat(acc, F.array(F.struct(role.alias("from"), x["content"].alias("value"))).cast(kind)))

    turns = F.aggregate(C, _empty(kind), step)
    return _if(F.size(C) > 0, F.struct(F.concat(_system(system, "from", "value"), turns).alias(C)))


def sharegpt(rows: DataFrame, system: str | None = None) -> DataFrame:
    """Neighbouring turns of one role become one, joined by a line end; empty conversations are skipped."""
    return rows.select("conv_id", F.inline(_sharegpt(system)))


def sharegpt_plain(rows: DataFrame) -> DataFrame:
    """Each turn as it is."""
    return rows.select("conv_id", F.transform(C, lambda x: F.struct(_renamed(x["role"]).alias("from"), x["content"].alias("value"))).alias(C))


def _given(rows: DataFrame, context: str | None) -> Column:
    return F.coalesce(F.col(context), F.lit("")) if context and context in rows.columns else F.lit("")


def _alpaca(given: Column) -> Column:
    asked, said = first_content("user"), first_content("assistant")
    return _if(asked.isNotNull() & said.isNotNull(), F.struct(asked.alias("instruction"), given.alias("input"), said.alias("output")))


def alpaca(rows: DataFrame, context: str | None = CONTEXT) -> DataFrame:
    """First user and assistant texts and the context of the instruction; rows without either text are skipped."""
    return rows.select("conv_id", F.inline(_alpaca(_given(rows, context))))


def alpaca_all(rows: DataFrame) -> DataFrame:
    """As ``alpaca`` without context, and nothing is skipped."""
    return rows.select("conv_id", F.coalesce(first_content("user"), F.lit("")).alias("instruction"), F.lit("").alias("input"), F.coalesce(first_content("assistant"), F.lit("")).alias("output"))


def _alpaca_split(given: Column) -> Column:
    p = pairs()

    def row(x, k):
        told = F.array_join(F.transform(F.slice(p, 1, k), lambda y: F.concat(F.lit("User: "), y["u"], F.lit("\nAssistant: "), y["a"])), "\n")
        history = F.when(k > 0, F.concat(F.lit("Previous conversation:\n"), told)).otherwise("")
        about = F.when(given != "", F.concat(F.lit("Context: "), given)).otherwise("")
        both = F.array_join(F.filter(F.array(history, about), lambda t: t != ""), "\n\n")
        return F.struct(x["u"].alias("instruction"), both.alias("input"), x["a"].alias("output"))

    return F.transform(p, row)


def alpaca_split(rows: DataFrame, context: str | None = CONTEXT) -> DataFrame:
    """A row for each pair; the pairs before it are its input's history, then comes the context."""
    out = rows.select("conv_id", F.posexplode(_alpaca_split(_given(rows, context))).alias("pair", "x"))
    return out.select("conv_id", F.col("pair").cast("long").alias("pair"), "x.*")


def _plain_messages() -> Column:
    return F.transform(C, lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).cast(MESSAGE)


def _messages(system: str | None = None, need_assistant: bool = True) -> Column:
    wanted = F.exists(C, lambda x: x["role"] == "assistant") if need_assistant else F.lit(True)
    return _if(wanted, F.struct(F.concat(_system(system, "role", "content"), _plain_messages()).alias("messages")))


def messages(rows: DataFrame, system: str | None = None, need_assistant: bool = True) -> DataFrame:
    return rows.select("conv_id", F.inline(_messages(system, need_assistant)))


def messages_all(rows: DataFrame, system: str | None = None) -> DataFrame:
    """As ``messages``; rows without an assistant turn stay."""
    return messages(rows, system, need_assistant=False)


def _llama_factory(given: Column, system: str | None = None) -> Column:
    p = pairs()
    last = F.try_element_at(p, F.lit(-1))
    history = F.transform(F.slice(p, 1, F.greatest(F.size(p) - 1, F.lit(0))), lambda x: F.array(x["u"], x["a"]))
    fields = [last["u"].alias("instruction"), given.alias("input"), last["a"].alias("output"), history.alias("history")]
    return _if(F.size(p) > 0, F.struct(*fields, *([F.lit(system).alias("system")] if system else [])))


def llama_factory(rows: DataFrame, system: str | None = None, context: str | None = CONTEXT) -> DataFrame:
    """The last pair asks and answers, with the context as input; the pairs before it are the history."""
    return rows.select("conv_id", F.inline(_llama_factory(_given(rows, context), system)))


def raw(rows: DataFrame) -> DataFrame:
    return rows


def _trajectory(rows: DataFrame) -> Column:
    return (F.col("trajectory_id") if "trajectory_id" in rows.columns else F.lit(None)).cast("string").alias("trajectory_id")


def _agent_sft(trajectory: Column) -> Column:
    return F.array(F.struct(_plain_messages().alias("messages"), trajectory))


def agent_sft(rows: DataFrame) -> DataFrame:
    """All messages of a trajectory and its id; empty ones stay."""
    return rows.select("conv_id", F.inline(_agent_sft(_trajectory(rows))))


#: what stands as the rejected answer where there is nothing to cut: a fixed value of the format
REFUSAL = "Unable to fulfill request."


def _agent_dpo(trajectory: Column, refusal: str = REFUSAL) -> Column:
    rest = F.transform(F.slice(C, 2, F.greatest(F.size(C) - 1, F.lit(0))), lambda x: x["content"])
    half = F.array_join(F.slice(rest, 1, F.floor(F.size(rest) / 2).cast("int")), "\n")
    rejected = F.when(F.size(rest) > 1, half).otherwise(refusal)
    return _if(F.size(C) > 0, F.struct(F.get(C, F.lit(0))["content"].alias("prompt"), F.array_join(rest, "\n").alias("chosen"), rejected.alias("rejected"), trajectory))


def agent_dpo(rows: DataFrame, refusal: str = REFUSAL) -> DataFrame:
    """The rest of a trajectory against its first half, or against a refusal if one message is all there is."""
    return rows.select("conv_id", F.inline(_agent_dpo(_trajectory(rows), refusal)))


def dpo(rows: DataFrame, min_gap: float = 0.2, system: str | None = None) -> DataFrame:
    """Best against worst answer to a first question; ties: the first best, the last worst. Rows without a
    score are not taken as bad answers. Groups are not gathered: two ordered picks are pre-aggregated."""
    r = rows.where("final_score IS NOT NULL").where(F.size(C) >= 2).select(F.col("prompt") if "prompt" in rows.columns else first_content("user").alias("prompt"), last_content("assistant").alias("response"), "final_score", "conv_id").where("prompt <> '' AND response <> ''")
    one = F.struct("response", "final_score", "conv_id")
    g = r.groupBy("prompt").agg(F.max_by(one, F.struct("final_score", -F.col("conv_id"))).alias("best"), F.min_by(one, F.struct("final_score", -F.col("conv_id"))).alias("worst"), F.count("*").alias("n")).where("n >= 2")
    prompt = F.concat(F.lit(f"{system}\n\n"), F.col("prompt")) if system else F.col("prompt")
    gap = F.round(F.col("best.final_score") - F.col("worst.final_score"), 6)
    return g.select(prompt.alias("prompt"), F.col("best.response").alias("chosen"), F.col("worst.response").alias("rejected"), F.col("best.conv_id").alias("chosen_id"), F.col("worst.conv_id").alias("rejected_id"), gap.alias("gap")).where(F.col("gap") >= min_gap)


def output_rows(rows: DataFrame, name: str, system: str | None = None) -> Column:
    """The output rows of a format that works row by row, as an array; empty where the row is skipped."""
    given, trajectory = _given(rows, CONTEXT), _trajectory(rows)
    made = {
        "alpaca": lambda: _alpaca(given),
        "alpaca_split": lambda: _alpaca_split(given),
        "llama_factory": lambda: _llama_factory(given, system),
        "messages": lambda: _messages(system),
        "openai": lambda: _messages(system),
        "oumi": lambda: _messages(system, need_assistant=False),
        "sharegpt": lambda: _sharegpt(system),
        "agent_sft": lambda: _agent_sft(trajectory),
        "agent_dpo": lambda: _agent_dpo(trajectory),
    }
    if name not in made:
        raise ValueError(f"{name!r} is not a format of single rows; there are {', '.join(sorted(made))}")
    return made[name]()


FORMATS: dict[str, Callable[..., DataFrame]] = {
    "alpaca": alpaca, "alpaca_split": alpaca_split, "dpo": dpo, "llama_factory": llama_factory, "messages": messages,
    "openai": messages, "oumi": messages_all, "raw": raw, "sharegpt": sharegpt, "agent_dpo": agent_dpo, "agent_sft": agent_sft,
}


def convert(rows: DataFrame, name: str, **options) -> DataFrame:
    if name not in FORMATS:
        raise ValueError(f"unknown format {name!r}; known: {', '.join(sorted(FORMATS))}")
    return FORMATS[name](rows, **options)


def export(rows: DataFrame, name: str, path: str, val_ratio: float | None = None, seed: str = "42", **options) -> None:
    """Writes JSON lines; with ``val_ratio`` under ``split=train`` and ``split=val``. Pairs are mined before the
    split, so that no format loses rows by it."""
    out = convert(rows, name, **options)
    if val_ratio is None:
        out.write.mode("overwrite").json(path)
    else:
        from .sampling import split

        split(out, F.to_json(F.struct("*")), val_ratio, seed).write.mode("overwrite").partitionBy("split").json(path)


def warnings(rows: DataFrame) -> DataFrame:
    """What each row lacks for chat formats, as an array of short texts; rows without a warning are absent."""
    w = F.array_compact(
        F.array(
            F.when(F.size(C) == 0, "no turns"),
            F.when((F.size(C) > 0) & ~F.exists(C, lambda x: x["role"] == "assistant"), "no assistant turn"),
            F.when(F.exists(C, lambda x: F.coalesce(x["content"], F.lit("")) == ""), "empty content"),
            F.when(F.get(C, F.lit(0))["role"] == "assistant", "starts with assistant"),
        )
    )
    return rows.select("conv_id", w.alias("warnings")).where(F.size("warnings") > 0)
