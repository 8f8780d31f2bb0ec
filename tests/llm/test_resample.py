"""Importance resampling against a plain version."""

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from common import LOWER, awkward, without_ids
from loomspark.llm import resample as R

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def plain(docs, target, n=1, buckets=10_000, least=20, percent=10):
    """docs: (id, text) pairs -> sorted (id, n_features, weight, score, rank)."""

    def grams(text):
        w = WORD.findall((text or "").translate(LOWER))
        return len(w), [zlib.crc32(" ".join(w[i : i + m]).encode()) % buckets for m in range(1, n + 1) for i in range(len(w) - m + 1)]

    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(grams(text)[1])
    for text in target:
        t.update(grams(text)[1])
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in s}
    out = []
    for i, text in docs:
        size, g = grams(text)
        weight = sum(gain[b] for b in g) // len(g) if g else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, size >= least])
    drawn = sorted((r for r in out if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(drawn[: percent * len(drawn) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)


def pairs(df):
    return [(r.doc_id, r.text) for r in df.collect()]


@pytest.mark.parametrize("n,buckets,least,percent", [(1, 10_000, 20, 10), (1, 7, 1, 50), (2, 1000, 0, 100), (3, 10_000, 2, 0)])
def test_awkward_rows(spark, n, buckets, least, percent):
    df = awkward(spark, ["Word1 word2-word3, ÉTÉ straße 漢字kanji", "a b a b a b", "a b"])
    target = spark.createDataFrame([("word1 word2 A b",), (None,), ("",)], "text string")
    found = R.resample(df, target, n, buckets, percent=percent, least_words=least)
    assert dict(found.dtypes) == dict.fromkeys(found.columns, "bigint")
    assert got(found) == plain(pairs(df), [r.text for r in target.collect()], n, buckets, least, percent)


def test_rows_without_or_with_equal_ids(spark):
    df = without_ids(spark)
    target = spark.createDataFrame([("word1 word2",)], "text string")
    want = plain(pairs(df), ["word1 word2"], least=1, percent=60)
    found = got(R.resample(df, target, least_words=1, percent=60))
    assert [r[:4] for r in found] == [r[:4] for r in want]  # equal rows may change places
    assert sorted(r[4] for r in found if r[4]) == sorted(r[4] for r in want if r[4])
    order = sorted((r for r in found if r[4]), key=lambda r: r[4])
    assert [(-r[3], r[0] is None, r[0] or 0) for r in order] == sorted((-r[3], r[0] is None, r[0] or 0) for r in order)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(i, f"a b c{i} " * 10) for i in range(30)], "doc_id long, text string")
    none = docs.where("false")
    assert got(R.resample(none, docs)) == [] and R.draw(none, docs).columns == docs.columns
    assert got(R.resample(docs, none)) == plain(pairs(docs), [])


def test_ranks_over_many_partitions_and_hot_words(spark):
    texts = [f"hot hot hot word{i % 50} " * (i % 9 + 2) for i in range(2000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(13)
    target = spark.createDataFrame([("word3 word4 word5",)], "text string")
    want = plain(list(enumerate(texts)), ["word3 word4 word5"])
    assert got(R.resample(df, target)) == want
    drawn = R.draw(df, target)
    assert sorted(r.doc_id for r in drawn.collect()) == sorted(r[0] for r in want if r[4]) and drawn.columns == df.columns


def test_draws_lean_towards_the_target(spark):
    rows = [(i, ("apple pear plum " if i % 10 == 0 else "steel iron zinc ") * 8) for i in range(3000)]
    drawn = R.resample(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([("apple pear plum",)] * 20, "text string")).where("rank is not null")
    assert drawn.count() == 300 and drawn.where("doc_id % 10 = 0").count() > 200


def test_same_as_sql(spark):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{d}/{t}.parquet'")
    want = sorted(map(repr, con.execute(f"select doc_id, n_features, weight, score, rank from ({R.SQL})").fetchall()))
    found = R.resample(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/benchmark.parquet"))
    assert sorted(repr(tuple(r)) for r in found.collect()) == want


def test_plan_has_no_python_and_no_text_in_an_exchange(spark):
    df = awkward(spark)
    plan = R.scores(df.select("doc_id", "text"), df.select("text"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_words_and_grams(spark):
    df = spark.createDataFrame([("A-b  c\x00d É9 x",), (None,), ("",), ("one",)], "t string")
    out = [r[0] for r in df.select(R.n_grams(R.words(F.col("t")), 2)).collect()]
    assert out == [["a", "b", "c", "d", "É9", "x", "a b", "b c", "c d", "d É9", "É9 x"], [], [], ["one"]]
