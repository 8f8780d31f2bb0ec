"""Running values of keys of any size, stop rules, choices and mixes."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from loomspark.functions import order
from loomspark.operators import drawing, monitor, sampling, traces
from loomspark.operators.taxonomy import NODES


def table(spark, n, hot, seed=1):
    r = random.Random(seed)
    rows = [(None if r.random() < 0.05 else "hot" if r.random() < hot else f"k{r.randrange(20)}", i, None if r.random() < 0.1 else r.randrange(-50, 50), "x") for i in range(n)]
    r.shuffle(rows)
    return rows, spark.createDataFrame(rows, "key string, at long, v long, other string").repartition(5)


def plain(rows, size):
    """Running sum and mean of the last rows, by key."""
    out, by = [], {}
    for k, i, v, _ in sorted(rows, key=lambda x: x[1]):
        seen = by.setdefault(k, [])
        seen.append(v)
        last = [x for x in seen[-size:] if x is not None]
        out.append((k, i, sum(x for x in seen if x is not None), round(sum(last) / len(last), 9) if last else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("n,hot", [(3000, 0.9), (500, 0.3), (40, 1.0), (7, 0.5), (0, 0.0)])
@pytest.mark.parametrize("size", [1, 2, 10, 60])
def test_blocks_give_the_rows_of_a_window(spark, n, hot, size):
    if (n in (3000, 500)) != (size in (1, 10)):
        pytest.skip("enough of it")
    rows, df = table(spark, n, hot)
    want = plain(rows, size)
    for one_task in (0, order.ONE_TASK):
        sums = {(r.key, r.at): r.s for r in order.running_sums(df, ["key"], ["at"], {"s": F.col("v")}, one_task).collect()}
        mean = order.rolling_mean(df, ["key"], ["at"], "v", size, "m", one_task)
        assert mean.columns == [*df.columns, "m"]
        got = sorted(((r.key, r.at, sums[r.key, r.at], None if r.m is None else round(r.m, 9)) for r in mean.collect()), key=repr)
        assert got == want


def test_no_task_holds_a_hot_key(spark):
    """All rows have one key: the largest block has not more than twice the mean of its like."""
    df = spark.range(40_000).select(F.lit("k").alias("key"), F.col("id").alias("at"), F.lit(1).alias("v")).repartition(4)
    blocks = [r["count"] for r in order._blocks(df, ["key"], ["at"]).groupBy("__block").count().collect()]
    assert len(blocks) >= 12 and max(blocks) <= 2 * sum(blocks) / len(blocks)
    got = order.running_sums(df, ["key"], ["at"], {"s": F.col("v")}, one_task=1000)
    assert got.where("s <> at + 1").count() == 0 and got.count() == 40_000
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "Window" in plan
    for line in plan.splitlines():
        if "Exchange hashpartitioning(" in line and "_s" in line:
            assert "__block" in line


def test_operators_over_blocks(spark, monkeypatch):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    metrics = e.select("event_id", F.col("event_type").alias("metric"), "ts", "value", F.lit("m").alias("model"))
    moves = e.select(F.col("event_id").alias("ord"), (F.col("user_id") % 3).alias("src"), (F.col("event_id") % 3).alias("dst"), F.round("value", 2).alias("amount"))
    both = []
    for one_task in (order.ONE_TASK, 10):
        for f in (order.running_sums, order.rolling_mean):
            monkeypatch.setattr(f, "__defaults__", (one_task,))
        both.append([sorted(map(tuple, monitor.rolling(metrics, 7).collect())), sorted(map(tuple, traces.ledger(moves).collect()))])
    assert both[0] == both[1]


# ---- stop rules

ITEMS = "stream string, ord long, cost double, failed boolean, value string"


def test_stop_rules(spark):
    rows = [("a", i, 1.0, i % 2 == 0, f"v{i % 4}") for i in range(40)] + [("b", i, 1.0, False, "v") for i in range(40)] + [("c", 0, 99.0, None, None)]
    state = sampling.running_state(spark.createDataFrame(rows, ITEMS)).cache()
    at = lambda *rules, every=False: {r.stream: r.ord for r in sampling.first_stop(state, *rules, every=every).collect()}
    assert at(sampling.spent_at_least(5)) == {"a": 4, "b": 4, "c": 0}
    assert at(sampling.error_rate_at_least(0.5, 10)) == {"a": 19}  # 10 items have been generated
    assert at(sampling.error_rate_at_least(0.5, 0)) == {"a": 0}
    assert at(sampling.distinct_at_least(4)) == {"a": 3}
    assert at(sampling.spent_at_least(30), sampling.distinct_at_least(4), every=True) == {"a": 29}
    assert at(sampling.spent_at_least(30), sampling.distinct_at_least(4)) == {"a": 3, "b": 29, "c": 0}
    assert at(sampling.generated_at_least(40), sampling.error_rate_at_least(0.1), every=True) == {}
    with pytest.raises(ValueError):
        at()


# ---- choices


@pytest.mark.parametrize("large", [False, True])
def test_choices_of_many_options(spark, large):
    weights = [1000.0 if large and i == 7 else float(i % 5) for i in range(400)]
    options = spark.createDataFrame([(i, f"o{i}", w) for i, w in enumerate(weights)], "ord long, option string, weight double")
    draws = spark.range(3000).withColumnRenamed("id", "draw_id")
    got = [sorted(map(tuple, sampling.weighted_choice(draws, options, few=few).collect())) for few in (100_000, 10)]
    assert got[0] == got[1] and len(got[0]) == 3000
    assert not {o for _, o in got[0]} & {f"o{i}" for i, w in enumerate(weights) if not w}
    if large:
        assert 0.45 < sum(o == "o7" for _, o in got[0]) / 3000 < 0.67


# ---- mixes

TREES = [("a", "ra", None, 0, "root"), ("b", "rb", None, 0, "root"), *(("a", f"a{i}", "ra", 1, f"a{i}") for i in range(3)), *(("b", f"b{i}", "rb", 1, f"b{i}") for i in range(3))]


def test_mixes(spark):
    nodes = spark.createDataFrame(TREES, NODES)
    ids = spark.range(2000).withColumnRenamed("id", "mix_id")
    both = drawing.Strategy("both", 3.0, ("a", "b"), (("A1", "b1"), ("a2", "b")))
    got = drawing.mixes(ids, nodes, [drawing.Strategy("only", 1.0, ("a",)), both]).collect()
    assert sorted(r.mix_id for r in got) == list(range(2000))
    count = {n: sum(r.strategy == n for r in got) for n in ("only", "both")}
    assert 2.4 < count["both"] / count["only"] < 3.7
    pairs = {tuple(e.label for e in r.entries) for r in got if r.strategy == "both"}
    assert pairs == {(x, y) for x in ("a0", "a1") for y in ("b0", "b1", "b2")} - {("a1", "b1")}
    assert {r.entries[0].label for r in got if r.strategy == "only"} == {"a0", "a1", "a2"} and max(r.attempt for r in got) > 2
    again = drawing.mixes(ids.repartition(7).where("mix_id < 50"), nodes.repartition(3), [drawing.Strategy("only", 1.0, ("a",)), both]).collect()
    assert sorted(map(str, again)) == sorted(str(r) for r in got if r.mix_id < 50)


def test_mixes_that_cannot_be(spark):
    nodes, ids = spark.createDataFrame(TREES, NODES), spark.range(5).withColumnRenamed("id", "mix_id")
    for bad in ([], [drawing.Strategy("x", 0.0, ("a",))], [drawing.Strategy("x", 1.0, ("a", "nobody"))]):
        with pytest.raises(ValueError):
            drawing.mixes(ids, nodes, bad)
    with pytest.raises(RuntimeError, match="no attempt of 4 suits 5 ids"):
        drawing.mixes(ids, nodes, [drawing.Strategy("x", 1.0, ("a",), (("a", "a"),))], attempts=4)
    assert drawing.mixes(ids.limit(0), nodes, [drawing.Strategy("x", 1.0, ("a",))]).count() == 0


def test_one_scenario(spark):
    rows = [(m, i, f"t{m}.{i}") for m in range(30) for i in range(m % 5 + 1)]
    df = spark.createDataFrame(rows, "mix_id long, meta_id long, text string")
    got = {r.mix_id: (r.meta_id, r.text) for r in drawing.one_scenario(df).collect()}
    assert set(got) == set(range(30)) and all(t == f"t{m}.{i}" and i <= m % 5 for m, (i, t) in got.items()) and len({i for i, _ in got.values()}) == 5
    con = duckdb.connect()
    for m, (i, _) in got.items():
        best = con.execute(f"select arg_min(i, (('0x' || substr(md5('42|{m}|' || i), 1, 8))::BIGINT, i)) from range({m % 5 + 1}) t(i)").fetchone()[0]
        assert best == i
