"""Small steps of a run: counted logs, texts in memory, pages with totals, numbers as charts show them."""

import pytest
from pyspark.sql import functions as F

from loomspark.functions import text as T
from loomspark.operators import preference, quality, rules, vectors
from loomspark.sources import logs, readers


def test_counted_appends(spark, tmp_path):
    path = str(tmp_path / "log")
    df = spark.createDataFrame([(1, None), (2, "é")], "a long, b string")
    assert logs.append_counted(df, path) == 2 and logs.append_counted(df.limit(0), path) == 0 and logs.append_counted(df.where("a = 2"), path) == 1
    assert sorted(r.value for r in spark.read.text(path).collect()) == ['{"a":1,"b":null}', '{"a":2,"b":"é"}', '{"a":2,"b":"é"}']


def test_skill_logs(spark, tmp_path):
    root = str(tmp_path / "skills")
    rows = spark.createDataFrame([("c1", 1, "v1", 0.5), ("c1", 2, "v1", 0.7), ("c/2", 3, "v1", 0.1)], "context_id string, ord long, version string, rate double")
    logs.append_skill_log(rows, root, "results")
    logs.append_skill_log(rows.where("ord = 1").withColumn("ord", F.lit(9).cast("long")), root, "results")
    got = {(r.context_id, r.version): (r.ord, r.rate) for r in logs.skill_log(spark, root, "results", "ord long, version string, rate double", "version").collect()}
    assert got == {("c1", "v1"): (9, 0.5), ("c/2", "v1"): (3, 0.1)}
    assert logs.skill_log(spark, root, "results", "ord long, version string, rate double").count() == 4
    with pytest.raises(ValueError, match="unknown log"):
        logs.append_skill_log(rows, root, "other")
    with pytest.raises(Exception, match="without context_id"):
        logs.append_skill_log(rows.withColumn("context_id", F.lit(None).cast("string")), root, "results")


def test_texts_in_memory(spark):
    assert [tuple(r) for r in readers.documents_of(spark, ["a", "b"]).collect()] == [("0", "a"), ("1", "b")]
    assert [tuple(r) for r in readers.documents_of(spark, {"x": "a"}).collect()] == [("x", "a")]
    assert readers.documents_of(spark, []).count() == 0


def test_pages_with_totals(spark):
    df = spark.createDataFrame([(i, i % 2) for i in range(9)], "a int, b int")
    got = readers.page_with_total(df, {"b": 0}, [("a", -1)], 2, 1).collect()
    assert sorted((r.a, r.total) for r in got) == [(4, 5), (6, 5)]
    assert readers.page_with_total(df, {"b": 7}, [("a", 1)], 2).count() == 0


@pytest.mark.parametrize("value", [0, 1, 9_999, 10_000, 12_250, 12_350, 12_450, 12_650, 99_949, 99_950, 1_234_567])
def test_whole_numbers_of_charts(spark, value):
    want = f"{value / 1000:.1f}k" if value >= 10_000 else str(value)
    assert spark.range(1).select(T.chart_number(F.lit(value), True)).first()[0] == want


def test_rounding_is_that_of_c(spark):
    values = [0.5, 1.5, 2.5, 2.675, 0.125, 1e6 + 0.005, -0.5, -1.25, 12345.678, 0.0, 1 / 3]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for digits in (0, 1, 2):
        assert [r[0] for r in df.select(T.fixed(F.col("v"), digits)).collect()] == [f"{v:.{digits}f}" for v in values]
    assert [r[0] for r in df.select(T.chart_number(F.col("v"), False)).collect()] == [f"{v:.2f}" for v in values]


def test_mismatched_languages(spark):
    df = spark.createDataFrame([(i, None if i == 3 else "de" if i % 2 else "en") for i in range(20)], "id long, detected string")
    assert tuple(quality.language_mismatch(df, "en").first()) == (20, 9, "1,5,7,9,11")
    assert tuple(quality.language_mismatch(df.limit(0), "en").first()) == (0, 0, "")


def test_texts_of_hits(spark):
    hits = spark.createDataFrame([(1, 10, 2), (1, 11, 1), (2, 12, 1), (1, 12, 3)], "query_id long, item_id long, rank int")
    texts = spark.createDataFrame([(10, "ten"), (11, "eleven"), (12, None)], "item_id long, text string")
    assert [tuple(r) for r in vectors.with_texts(hits, texts, " | ").collect()] == [(1, "eleven | ten")]


def test_random_turns(spark):
    got = [r[0] for r in spark.range(500).select(rules.random_turns(F.col("id"), 4)).collect()]
    assert set(got) == {1, 2, 3, 4} and min(map(got.count, (1, 2, 3, 4))) > 80


def test_preference_log(spark, tmp_path):
    rows = [("p", "good", 0.9, "x", 1), ("p", "bad", 0.1, "y", 2), ("q", "same", 0.5, "x", 3), ("q", "same2", 0.5, "x", 4)]
    pairs = preference.build_pairs(spark.createDataFrame(rows, "prompt string, content string, score double, variation_label string, ord long"))
    path, log = str(tmp_path / "out"), str(tmp_path / "log")
    preference.save(pairs, preference.as_dpo(pairs), path, log)
    assert [tuple(r) for r in spark.read.json(path).select("prompt", "chosen", "rejected").collect()] == [("p", "good", "bad")]
    told = [line for p in sorted((tmp_path / "log").glob("part-*")) for line in p.read_text().splitlines()]
    assert len(told) == 3 and '"_analytics"' in told[-1] and '"attempted":2' in told[-1] and not any("_analytics" in x for x in told[:2])
    preference.save(pairs, preference.as_dpo(pairs), str(tmp_path / "only"))
    assert spark.read.json(str(tmp_path / "only")).count() == 1
