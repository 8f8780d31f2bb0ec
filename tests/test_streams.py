"""Streams: metric logs, running reports that survive a repeated batch, weights that follow use."""

import json
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from loomspark.operators import monitor, sampling
from loomspark.sources import logs
from loomspark.streaming import metrics, weights


def lines(n, seed):
    r = random.Random(seed)
    return [{"metric": "total_tokens", "value": 1.5 * i, "timestamp": f"2024-01-0{seed + 1}T00:00:{i % 60:02d}", "model_name": r.choice(["a", "b", None]), "prompt_tokens": r.randrange(100), "completion_tokens": r.randrange(50), "total_tokens": r.randrange(150)} for i in range(n)]


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in").mkdir()
    return tmp_path


def put(folder, k):
    (folder / f"in/{k}.jsonl").write_text("\n".join(json.dumps(x) for x in lines(40, k)) + "\n{bad\n[]\n\n")


def key(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_metric_lines(spark, folder):
    for k in range(3):
        put(folder, k)
    got = logs.metric_lines(spark, str(folder / "in"))
    assert got.count() == 120 and got.where("ts is null").count() == 0 and got.where("model is null").count() == sum(x["model_name"] is None for k in range(3) for x in lines(40, k))
    logs.append_lines(logs.as_lines(got.limit(50)).select("value"), str(folder / "x"))  # a line as a field of a line
    assert spark.read.json(str(folder / "x")).columns == ["value"]


def test_running_report_of_three_files(spark, folder):
    out, state = str(folder / "report"), str(folder / "state")
    usage = logs.metric_line_stream(spark, str(folder / "in"), 1)
    seen = []
    for k in range(3):
        put(folder, k)
        metrics.token_report(usage, out, state).awaitTermination()
        seen.append(key(metrics.latest(spark, out)))
        assert seen[-1] == key(monitor.token_usage(logs.metric_lines(spark, str(folder / "in"))))
    assert len({str(s) for s in seen}) == 3
    # the last batch was written, but its commit was lost: it runs again and counts nothing twice
    commits = sorted((p for p in (folder / "state/commits").iterdir() if p.name.isdigit()), key=lambda p: int(p.name))
    commits[-1].unlink()
    commits[-1].with_name(f".{commits[-1].name}.crc").unlink(missing_ok=True)
    metrics.token_report(usage, out, state).awaitTermination()
    assert key(metrics.latest(spark, out)) == seen[-1]
    assert sorted(p.name for p in Path(out).iterdir()) == ["batch=1", "batch=2"]


def test_no_report_yet(spark, folder):
    with pytest.raises(FileNotFoundError):
        metrics.latest(spark, str(folder / "none"))
    usage = logs.metric_line_stream(spark, str(folder / "in"))
    assert metrics.reported(monitor.token_usage(usage)).count() == 0


EVENTS = "doc_id long, ord long, event string, target long"


@pytest.mark.parametrize("cuts", [[], [17], [1, 2, 40, 41, 90]])
def test_last_weights_whatever_the_batches(spark, folder, cuts):
    r = random.Random(3)
    target = {d: r.choice([None, 0, 2, 5, 100]) for d in range(7)}
    rows = [(d := r.randrange(7), i, "cover" if d == 3 and i > 60 else "use", target[d]) for i in range(120)]
    for k, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(rows)])):
        spark.createDataFrame(rows[a:b], EVENTS).coalesce(1).write.mode("append").parquet(str(folder / f"in/p{k}"))
        Path(folder / f"in/p{k}").rename(folder / f"in/part={k}")
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(folder / "in"))
    got = metrics.appended(weights.adaptive_weights(stream))
    assert got.count() == len(rows)
    last = {r.doc_id: (r.used, r.covered, r.weight) for r in got.groupBy("doc_id").agg(F.max_by(F.struct("used", "covered", "weight"), "ord").alias("x")).select("doc_id", "x.*").collect()}
    uses = spark.createDataFrame(rows, EVENTS).groupBy("doc_id").agg(F.count_if(F.col("event") == "use").alias("used"), F.bool_or(F.col("event") == "cover").alias("covered"), F.max("target").alias("target"))
    want = uses.select(F.col("doc_id").cast("string").alias("doc_id"), "used", "covered", sampling.usage_weight(F.col("used"), F.col("target"), F.col("covered")).alias("weight"))
    assert last == {r.doc_id: (r.used, r.covered, r.weight) for r in want.collect()}
    # and every step on the way
    first = {(r.doc_id, r.used): r.weight for r in got.collect() if not r.covered}
    assert all(w == weights.weight(n, target[int(d)], False) for (d, n), w in first.items())


def test_metric_export(spark, folder):
    rows = [(f"m{i % 3}", f"2024-01-01 00:{i:02d}:00", float(i), "a") for i in range(30)]
    df = spark.createDataFrame(rows, "metric string, ts string, value double, model string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    for kind in logs.METRICS:
        path = str(folder / kind)
        logs.export_metrics(df, path, kind)
        logs.export_metrics(df.where("metric = 'm1'"), path, kind, since="2024-01-01 00:10:00")  # only its own folder is replaced
        read = spark.read.option("header", True).format(kind).load(path)
        assert {r.metric: r.n for r in read.groupBy("metric").agg(F.count("*").alias("n")).collect()} == {"m0": 10, "m1": 7, "m2": 10}
        assert sorted(float(r.value) for r in read.where("metric = 'm1'").collect()) == [float(i) for i in range(10, 30) if i % 3 == 1]
    with pytest.raises(ValueError, match="unknown kind"):
        logs.export_metrics(df, str(folder / "x"), "xlsx")
    df.write.parquet(str(folder / "table"))
    stored = spark.read.parquet(str(folder / "table"))
    plan = stored.where(F.col("ts") >= F.lit("2024-01-01").cast("timestamp_ntz"))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in plan
