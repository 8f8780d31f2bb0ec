"""Plans that must keep their shape: pushed filters, pruned columns, no cross join, no single-task window over rows."""

import pytest
from pyspark.sql import functions as F

from loomspark.operators import export, sampling, vectors
from loomspark.plans.catalogue import QUERIES, Tables

DIR = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["a1_summary", "p1_sharegpt", "a20_dpo_pairs", "a13_coherence", "j6_near_duplicates", "w1_rolling_10", "c7_split", "a7_bigram_repetition"])
def test_no_cartesian_product(spark, name):
    assert "CartesianProduct" not in plan(QUERIES[name](spark, DIR))


def test_filter_reaches_the_scan(spark):
    p = plan(QUERIES["s4_page"](spark, DIR))
    assert "EqualTo(o_orderstatus,F)" in p and "o_totalprice" not in p.split("ReadSchema")[1]


def test_columns_are_pruned(spark):
    p = plan(QUERIES["a11_turn_balance"](spark, DIR))
    assert "ReadSchema: struct<role:string>" in p


def test_formats_do_not_shuffle(spark):
    rows = spark.createDataFrame([(1, [("user", "a")])], "conv_id long, conversations array<struct<role:string,content:string>>")
    for name in ("sharegpt", "alpaca", "alpaca_split", "messages", "llama_factory", "agent_dpo"):
        assert "Exchange" not in plan(export.convert(rows, name))


def test_split_ranks_one_bucket_only(spark):
    p = plan(sampling.split(spark.range(100), F.col("id"), 0.1))
    assert "Window" in p and "rangepartitioning" not in p


def test_top_k_limits_before_the_shuffle(spark):
    e = Tables(spark, DIR).embeddings
    p = plan(vectors.top_k(e.limit(3).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), e.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("v"))))
    assert "WindowGroupLimit" in p
