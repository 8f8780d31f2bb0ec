"""Vector search by blocks: the rows of an exhaustive version, whatever the vectors are."""

import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from loomspark.operators import vectors
from loomspark.plans.catalogue import QUERIES, SQL

NAN, INF = float("nan"), float("inf")


def exhaustive(queries, items, k, threshold):
    def norm(x):
        return None if x is None or None in x else math.sqrt(sum(t * t for t in x))

    out = []
    for query_id in {q for q, _ in queries}:
        hits = []
        for x in (x for q, x in queries if q == query_id):
            for item_id, y in items:
                m, n = norm(x), norm(y)
                if not m or not n:
                    score = 0.0
                elif len(x) != len(y):
                    continue
                else:
                    score = sum(a * b for a, b in zip(x, y)) / (m * n) if m * n else 0.0
                score = score if math.isnan(score) else round(score, 6)
                if not score < threshold:
                    hits.append((not math.isnan(score), -score, item_id))
        key = lambda h: (h[0], h[1] if h[0] else 0, h[2])
        out += [(query_id, h[2], repr(-h[1] + 0.0), r) for r, h in enumerate(sorted(hits, key=key)[:k], 1)]
    return sorted(out)


def found(spark, queries, items, k, threshold, most=10_000, kind="array<double>"):
    q, i = spark.createDataFrame(queries, f"query_id long, q {kind}"), spark.createDataFrame(items, f"item_id string, v {kind}").repartition(5)
    return sorted((r.query_id, r.item_id, repr(r.score + 0.0).replace("-nan", "nan"), r["rank"]) for r in vectors.top_k(q, i, k, threshold, most).collect())


def plain(rows):
    return [(a, b, c.replace("-nan", "nan"), d) for a, b, c, d in rows]


@pytest.mark.parametrize("threshold", [0.3, 0.0, -1.0])
@pytest.mark.parametrize("most", [4, 10_000])
def test_odd_vectors(spark, threshold, most):
    rng = random.Random(5)
    odd = [None, [], [0.0, 0.0, 0.0], [1.0, None, 2.0], [1.0, NAN, 0.0], [INF, 1.0, 0.0], [1e200, 1e200, 0.0], [1e-160, 1e-160, 0.0], [1e-170, 0.0, 0.0], [1.0], [2.0, 1.0], [1.0, 2.0, 3.0, 4.0]]
    items = [(f"i{j:03}", v) for j, v in enumerate(odd + [[float(rng.randint(-2, 2)) for _ in range(3)] for _ in range(150)])]
    queries = [(j, v) for j, (_, v) in enumerate(items[::3] + items[:12])] + [(0, [1.0, 0.0, 0.0])]
    assert found(spark, queries, items, 7, threshold, most) == plain(exhaustive(queries, items, 7, threshold))


def test_equal_scores_over_slices_and_stripes(spark, monkeypatch):
    """Copies in many slices, blocks and stripes: the smallest ids win; scores that differ in the seventh place are equal."""
    monkeypatch.setattr(vectors, "LEAST_ITEMS", 1500)
    rng = random.Random(6)
    base = [[rng.gauss(0, 1) for _ in range(5)] for _ in range(40)]
    near = [[x * (1 + 1e-7 * rng.random()) for x in v] for v in base for _ in range(3)]
    vs = base * 30 + near + [base[0]] * 1500 + [[rng.gauss(0, 1) for _ in range(5)] for _ in range(1700)]
    rng.shuffle(vs)
    items = [(f"i{j:05}", v) for j, v in enumerate(vs)]
    queries = [(j, v) for j, v in enumerate(base[:12])]
    assert found(spark, queries, items, 4, 0.2, 5) == plain(exhaustive(queries, items, 4, 0.2))


def test_fewer_items_than_wanted_and_none(spark):
    items = [("b", [1.0, 1.0]), ("a", [2.0, 2.0])]
    assert [r[1] for r in found(spark, [(1, [1.0, 1.0])], items, 5, 0.5, kind="array<float>")] == ["a", "b"]
    empty = spark.createDataFrame([], "query_id long, q array<double>")
    assert vectors.top_k(empty, spark.createDataFrame(items, "item_id string, v array<double>")).count() == 0


def test_larger_table_same_as_sql(spark):
    """On the table of sf0.1 (four times that of the smaller ones), without a nested loop over all pairs."""
    d = "/root/testdata/sf0.1"
    df = QUERIES["o5_top_k"](spark, d)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "MapInArrow" in plan
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from read_parquet('{d}/embeddings.parquet')")
    assert sorted(map(tuple, df.collect())) == sorted(con.execute(SQL["o5_top_k"]).fetchall())
    assert df.where(F.col("rank") > 3).count() == 0


def test_texts_stay_where_they_are_read(spark):
    hits = spark.createDataFrame([(q, i, r) for q in range(30) for r, i in enumerate((q, q + 1, 99), 1)], "query_id long, item_id long, rank long")
    texts = spark.createDataFrame([(i, f"t{i}" if i % 7 else None) for i in range(60)], "item_id long, text string")
    want = sorted((q, "|".join(f"t{i}" for i in (q, q + 1) if i % 7)) for q in range(30))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for most, join in ((500_000, "BroadcastHashJoin"), (10, "SortMergeJoin")):
            df = vectors.with_texts(hits, texts, "|", most)
            assert join in df._jdf.queryExecution().executedPlan().toString()
            assert sorted(map(tuple, df.collect())) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_larger_tables_retrieved_texts_same_as_sql(spark):
    d = "/root/testdata/sf0.1"
    df = QUERIES["o5_retrieved_texts"](spark, d)
    con = duckdb.connect()
    for t in ("embeddings", "documents"):
        con.execute(f"create view {t} as select * from read_parquet('{d}/{t}.parquet')")
    assert sorted(map(tuple, df.collect())) == sorted(con.execute(SQL["o5_retrieved_texts"]).fetchall())
