"""Exports: formats with a context, counters, many formats of one scan."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from loomspark.operators import export, exports, generation

ROWS = "conv_id long, conversations array<struct<role:string,content:string>>, instruction_context string, response_context string"


def chat(*turns):
    return [{"role": r, "content": c} for r, c in turns]


U, A = ("user", "u"), ("assistant", "a")


def test_the_context_of_the_instruction_is_the_input(spark):
    rows = spark.createDataFrame([(1, chat(U, A, ("user", "v"), ("assistant", "b")), "Some context.", "not this"), (2, chat(U, A), None, "not this"), (3, [], "c", "d")], ROWS)
    assert [(r.conv_id, r.input) for r in export.alpaca(rows).collect()] == [(1, "Some context."), (2, "")]
    assert [(r.conv_id, r.pair, r.input) for r in export.alpaca_split(rows).collect()] == [(1, 0, "Context: Some context."), (1, 1, "Previous conversation:\nUser: u\nAssistant: a\n\nContext: Some context."), (2, 0, "")]
    assert [(r.conv_id, r.input, r.output) for r in export.llama_factory(rows).collect()] == [(1, "Some context.", "b"), (2, "", "a")]
    assert [(r.conv_id, len(r.messages)) for r in export.agent_sft(rows).collect()] == [(1, 4), (2, 2), (3, 0)]


LINES = [
    {"conversations": chat(U, A), "instruction_context": "ctx", "final_score": 0.9},
    {"conversations": chat(U, ("assistant", "worse")), "final_score": 0.4},
    {"conversations": chat(U, A, ("user", "v"), ("assistant", 'b "q" \n é 🙂'), ("user", "w"), ("assistant", "c")), "metadata": {"trajectory_id": "t3"}},
    {"conversations": chat(U)},
    {"conversations": chat(U, ("assistant", "")), "final_score": 0.1},
    {"conversations": []},
    {"final_score": None},
]


@pytest.fixture
def files(tmp_path):
    lines = [json.dumps(r, ensure_ascii=False) for r in LINES] + ["", "  ", "{broken", "[1, 2]"]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.jsonl").write_text("\n".join(lines[:5]) + "\n", encoding="utf-8")
    (tmp_path / "in/b.jsonl").write_text("\n".join(lines[5:]), encoding="utf-8")
    return tmp_path


def folder(spark, path):
    return sorted(r.value for r in spark.read.text(str(path)).collect()) if Path(path).exists() else []


def test_counters(spark, files):
    counts = {c.format: (c.input, c.output, c.skipped, c.malformed, c.warnings) for c in exports.export_files(spark, str(files / "in"), str(files / "out"), (*exports.ROWWISE, "dpo"))}
    assert counts == {
        "sharegpt": (9, 5, 4, 2, 2), "oumi": (9, 7, 2, 2, 2), "raw": (9, 7, 2, 2, 2), "messages": (9, 4, 5, 2, 2), "openai": (9, 4, 5, 2, 2), "alpaca": (9, 3, 6, 2, 2),
        "alpaca_split": (9, 6, 5, 2, 2), "llama_factory": (9, 4, 5, 2, 2), "agent_sft": (9, 7, 2, 2, 2), "agent_dpo": (9, 5, 4, 2, 2), "dpo": (9, 1, 6, 2, 0),
    }
    for name, (_, n, *_) in counts.items():
        assert len(folder(spark, files / f"out/format={name}")) == n
    assert json.loads(folder(spark, files / "out/format=dpo")[0]) == {"prompt": "u", "chosen": "a", "rejected": "worse"}
    said = [json.loads(x) for x in folder(spark, files / "out/format=agent_sft")]
    assert sorted(str(x["trajectory_id"]) for x in said) == ["None"] * 6 + ["t3"]
    assert sorted(folder(spark, files / "out/format=raw")) == sorted(json.dumps(r, ensure_ascii=False) for r in LINES)


def test_many_formats_equal_single_exports(spark, files):
    exports.export_files(spark, str(files / "in"), str(files / "all"), system="be kind")
    for name in exports.ROWWISE:
        exports.export_files(spark, str(files / "in"), str(files / "one"), (name,), system="be kind")
        assert folder(spark, files / f"one/format={name}") == folder(spark, files / f"all/format={name}") != []
    assert len([p for p in (files / "one").iterdir() if p.name.startswith("format=")]) == len(exports.ROWWISE)  # the others stay


def test_each_format_equals_its_operator(spark, files):
    rows = exports.parsed(spark.read.text(str(files / "in"))).where("NOT __bad").withColumn("conv_id", F.lit(1))
    exports.export_files(spark, str(files / "in"), str(files / "out"))
    for name in sorted({*exports.ROWWISE} - {"raw"}):
        plain = export.convert(rows, name).drop("conv_id", "pair")
        assert folder(spark, files / f"out/format={name}") == sorted(r[0] for r in plain.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).collect())


def test_nothing_to_export(spark, files):
    exports.export_files(spark, str(files / "in"), str(files / "out"), ("alpaca", "dpo"))
    (files / "bad.jsonl").write_text("no json\n")
    got = exports.export_files(spark, str(files / "bad.jsonl"), str(files / "out"), ("alpaca", "dpo"))
    assert [(c.input, c.output, c.skipped, c.warnings) for c in got] == [(1, 0, 1, 1), (1, 0, 1, 1)] and got[1].note == exports.NO_SCORES
    assert folder(spark, files / "out/format=alpaca") == [] and folder(spark, files / "out/format=dpo") == []
    with pytest.raises(ValueError, match="unknown formats"):
        exports.export_files(spark, str(files / "in"), str(files / "out"), ("alpaca", "xml"))


def test_one_scan_for_all_formats(spark, files):
    lines = spark.read.text(str(files / "in")).select("value")
    reads = spark.sparkContext.accumulator(0)

    def seen(batches):
        reads.add(1)
        yield from batches

    exports.export_lines(lines.coalesce(1).mapInArrow(seen, "value string"), str(files / "out"))
    assert reads.value == 1


def test_generation_leaves_other_columns_alone(spark):
    df = spark.createDataFrame([(2**60 + 1, "p", None), (None, None, 1.5), (2**53 + 1, "", 2.5)], "id long, prompt string, x double").coalesce(1)
    got = generation.generate(df, "prompt", factory=lambda: lambda ps: [f"<{p}>" for p in ps]).collect()
    assert [tuple(r) for r in got] == [(2**60 + 1, "p", None, "<p>"), (None, None, 1.5, None), (2**53 + 1, "", 2.5, "<>")]
