"""Every query with SQL gives the rows of that SQL; the stream gives the rows of the batch form."""

import decimal
import math
from pathlib import Path

import duckdb
import pytest

from loomspark.operators.quality import first_accepted
from loomspark.plans.catalogue import QUERIES, SQL

DIR = "/root/testdata/sf0.001"
LARGER = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


#: queries of these modules are compared on the larger tables too
WIDER = ("loomspark.plans.stored", "loomspark.plans.steps")
CASES = [(n, DIR) for n in sorted(SQL)] + [(n, LARGER) for n in sorted(SQL) if QUERIES[n].module in WIDER or n.startswith(("p1_", "p2_", "p3_", "p7_", "w1_", "w3_", "w7_", "a33_", "j3_", "x6_"))]


@pytest.fixture(scope="module")
def connect():
    if not Path(DIR).exists():
        pytest.skip("no test tables here")
    known = {}

    def to(folder):
        if folder not in known:
            known[folder] = c = duckdb.connect()
            for t in TABLES:
                c.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet')")
        return known[folder]

    return to


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return None if math.isnan(v) else float(f"{float(v):.9g}")
    return v


def rows(columns, found):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


@pytest.mark.parametrize("name,folder", CASES)
def test_same_as_sql(spark, connect, name, folder):
    df = QUERIES[name](spark, folder)
    cur = connect(folder).execute(SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(names, cur.fetchall())


def test_stream_equals_batch(spark, connect):
    connect(DIR)
    key = lambda df: sorted(tuple(r) for r in df.select("start", "metric", "mean", "least", "most", "n").collect())
    assert key(QUERIES["t1_stream_windows"](spark, DIR)) == key(QUERIES["t1_windows"](spark, DIR))


def test_whole_queries_use_every_row(spark):
    d = "/root/testdata/sf0.01"
    events = [r.event_id for r in spark.read.parquet(f"{d}/events.parquet").select("event_id").collect()]
    assert max(events) >= 2000
    assert sum(r.n for r in QUERIES["a29_tool_statistics"](spark, d).collect()) == sum(i % 4 != 3 for i in events)
    for name in ("p15_openai_tools", "p16_anthropic_tools", "p17_hermes_tools"):
        assert QUERIES[f"{name}"](spark, d).count() == len({i // 4 for i in events})
    assert QUERIES["a25_elo"](spark, d).select("batch").distinct().count() == len({i // 30 for i in events})


def test_first_accepted_has_no_bound(spark):
    rows = [(1, i, "bad") for i in range(40)] + [(1, 40, "good"), (2, 3, None)]
    assert sorted(map(tuple, first_accepted(spark.createDataFrame(rows, "item long, attempt long, grade string")).collect())) == [(1, 40), (2, 3)]


def test_whole_queries_use_whole_texts(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    got = QUERIES["s20_indexed"](spark, DIR).collect()
    assert got and all(r.text == docs[r.vec_id][:120_000] for r in got) and max(len(r.text) for r in got) > 100
    said = {(r.conv_id, r.turn): r.text for r in spark.read.parquet(f"{DIR}/conversations.parquet").collect()}
    for name in ("o6_ensemble", "o7_chained"):
        got = QUERIES[name](spark, DIR).collect()
        assert got and all(r.text == said[r.query_id, r.ord] for r in got) and max(len(r.text) for r in got) > 30
