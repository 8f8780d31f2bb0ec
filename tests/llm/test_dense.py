"""Whitening and exact search against plain versions."""

import math

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomspark.llm import inner_product as S
from loomspark.llm import whitening as W
from loomspark.llm.dense import tiled_product, usable

KIND = "vec_id long, embedding array<double>, label int, score double, rank int, query_id long, n long, id long, asked string, whitened string, block int"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, v, None, 1.0, None, 2, 3, 4, "a", None, 5) for i, v in rows], KIND).repartition(parts)


def fine(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def padded(rows, scale):
    """Rows that take part, as whole numbers."""
    rows = [(i, v) for i, v in rows if fine(v)]
    d = max((len(v) for _, v in rows), default=0)
    return [(i, [math.floor(scale * x) for x in v] + [0] * (d - len(v))) for i, v in rows]


# ---- exact search


def plain_top(rows, k=5, every=50):
    rows = [(i, v) for i, v in padded([r for r in rows if r[0] is not None], 256)]
    out = []
    for q, a in rows:
        if q % every == 0:
            best = sorted(((-sum(x * y for x, y in zip(a, b)), i) for i, b in rows if i != q))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


def top(spark, rows, k=5, every=50, parts=3):
    df = S.top_k(frame(spark, rows, parts), F.col("vec_id") % every == 0, k)
    assert df.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]
    return sorted(map(tuple, df.collect()))


AWKWARD = [
    (0, [1.0, 0.5]), (1, None), (2, [None, 1.0]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, []), (6, [0.0, 0.0]), (7, [1.0, 0.5]), (8, [1.0, 0.5]),
    (9, [-1.0, -0.001, 0.25]), (10, [0.1]), (None, [9.0, 9.0]), (50, [-1.0, 2.0]), (100, None), (150, []), (-50, [0.3, 0.3, 0.3]), (11, [1.0, 0.5]),
]


def test_search_awkward_rows(spark):
    assert top(spark, AWKWARD) == plain_top(AWKWARD)
    assert top(spark, [(0, [1.0]), (1, [2.0])]) == [(0, 1, 1, 256 * 512)]
    assert top(spark, [(0, [1.0])]) == [] and top(spark, []) == [] and top(spark, [(1, [1.0]), (2, [1.0])]) == []
    twice = top(spark, [(0, [1.0]), (0, [1.0]), (0, [2.0]), (3, [1.0]), (3, [1.0])])
    assert twice == sorted([(0, 1, 3, 65536), (0, 2, 3, 65536)] * 2 + [(0, 1, 3, 131072), (0, 2, 3, 131072)])


@pytest.mark.parametrize("name,n,d", [("flat", 700, 16), ("spread", 900, 24), ("equal", 600, 8), ("low rank", 800, 40)])
def test_search_by_brute_force(spark, monkeypatch, name, n, d):
    monkeypatch.setattr(S, "ITEMS", 64)
    monkeypatch.setattr(S, "QUERIES", 9)
    monkeypatch.setattr(S, "STRIPE", 300)
    r = np.random.default_rng(n)
    v = r.normal(size=(n, d))
    if name == "flat":
        v /= np.linalg.norm(v, axis=1)[:, None]
    if name == "spread":
        v *= r.pareto(1.0, size=(n, 1)) + 0.01
    if name == "equal":
        v[: n // 2] = v[0]
    if name == "low rank":
        v = r.normal(size=(n, 3)) @ r.normal(size=(3, d)) + 0.01 * v
    rows = [(int(i), [float(x) for x in row]) for i, row in enumerate(v)]
    assert top(spark, rows, every=20, parts=5) == plain_top(rows, every=20)
    assert top(spark, rows, k=40, every=100) == plain_top(rows, k=40, every=100)


@pytest.mark.parametrize("size", [3e3, 3e6, 3e12])
def test_search_of_large_numbers(spark, size):
    """Scores of over 53 bits are exact; those beyond a long stay at its border."""
    r = np.random.default_rng(5)
    rows = [(i, [float(np.float32(x)) for x in row]) for i, row in enumerate(r.normal(size=(60, 4)) * size)]
    border = lambda s: max(-(2**63), min(2**63 - 1, s))
    vs = {i: v for i, v in padded(rows, 256)}
    want = []
    for q in vs:
        if q % 50 == 0:
            best = sorted((-border(sum(a * b for a, b in zip(vs[q], v))), i) for i, v in vs.items() if i != q)[:5]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert top(spark, rows) == sorted(want)


def searched(rows, k, terms, items):
    """The task's own search, with blocks of so many items, sorted by length."""
    d = max(len(v) for _, v in rows)
    x = np.array([v for _, v in rows], np.int64)
    _, rotation = np.linalg.eigh((x.T @ x).astype(float))
    x_by = sorted(rows, key=lambda r: -np.linalg.norm(r[1]))
    pack = lambda part: (np.array([i for i, _ in part], np.int64).tobytes(), np.array([v for _, v in part], "<i8").tobytes())
    batch = [(0, 0, False, 0.0, *pack(rows))]
    batch += [(0, 0, True, float(np.linalg.norm(x_by[at][1])), *pack(x_by[at : at + items])) for at in range(0, len(x_by), items)]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*batch)], ["block", "stripe", "is_item", "top", "ids", "data"])
    out = []
    for b in S._search(rotation[:, ::-1], min(terms, d), "<i8", int(np.abs(x).max()), k)([batch]):
        out += zip(*(b.column(c).to_pylist() for c in ("query_id", "vec_id", "score")))
    return sorted(out)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(-6, 6), min_size=3, max_size=3), min_size=2, max_size=40), st.integers(1, 4), st.integers(1, 3), st.integers(1, 7))
def test_pruning_loses_nothing(vectors, k, terms, items):
    rows = list(enumerate(vectors))
    want = []
    for q, a in rows:
        want += [(q, i, -s) for s, i in sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in rows if i != q)[:k]]
    assert searched(rows, k, terms, items) == sorted(want)


def test_search_same_as_sql(spark):
    con = duckdb.connect()
    con.execute("create view embeddings as select * from '/root/testdata/sf0.001/embeddings.parquet'")
    found = S.top_k(spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet"), F.col("vec_id") % 50 == 0)
    assert sorted(map(tuple, found.collect())) == sorted(con.execute(S.SQL).fetchall())


# ---- whitening


def check_whitening(spark, rows, k=32, parts=3):
    used = padded(rows, 64)
    x = np.array([v for _, v in used], np.int64) + 1_000_000
    n, sums = len(x), x.sum(0)
    centred = (n * x - sums) / n
    e, u = np.linalg.eigh(centred.T @ centred / n)
    e, u = e[::-1], u[:, ::-1]
    k = min(k, int((e > 1e-12 * e[0]).sum()))
    got = W.whiten(frame(spark, rows, parts), k).collect()
    assert len(got) == n * k and {r.n for r in got} == {n}
    exact = {}
    for (i, _), row in zip(used, x):
        exact.setdefault(i, []).append(sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums)))
    by = {}
    for r in got:
        by.setdefault((r.vec_id, r.deviation), {}).setdefault(r.component, []).append(r.whitened)
        assert r.explained == pytest.approx(e[r.component - 1] / e.sum(), rel=1e-8) and 0 <= r.identity_error < 1e-8
    assert sorted(map(repr, by)) == sorted({repr((i, s)) for i, many in exact.items() for s in many})
    white = np.array([[sorted(by[i, sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums))][c + 1], key=abs)[0] for c in range(k)] for (i, _), row in zip(used, x)])
    want = centred @ u[:, :k] / np.sqrt(e[:k])
    apart = np.abs(np.diff(e[: k + 1], append=0)) > 1e-6 * e[0] if len(e) > k else np.abs(np.diff(e, append=-1)) > 1e-6 * e[0]
    for c in range(k):
        if apart[c] and (c == 0 or apart[c - 1]):  # components of equal variance have no direction of their own
            sign = np.sign(white[:, c] @ want[:, c])
            assert np.allclose(sign * white[:, c], want[:, c], atol=1e-7)


def test_whitening_awkward_rows(spark):
    check_whitening(spark, AWKWARD)
    names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    for rows in ([], [(1, [1.0, 2.0])], [(1, [1.0, 2.0])] * 5, [(1, None), (2, [None])], [(1, []), (2, [])]):
        out = W.whiten(frame(spark, rows))
        assert out.columns == names and out.collect() == []


def test_whitening_by_brute_force(spark):
    r = np.random.default_rng(1)
    v = r.normal(size=(700, 40)) * np.linspace(5, 0.1, 40) + r.normal(size=40) * 3
    v[:250] = v[0]  # copies
    check_whitening(spark, [(int(i), [float(x) for x in row]) for i, row in enumerate(v)], parts=5)
    flat = r.normal(size=(200, 4)) @ r.normal(size=(4, 9))
    check_whitening(spark, [(int(i), [float(np.round(x * 64)) for x in row]) for i, row in enumerate(flat)])


def test_whitening_of_whole_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    check_whitening(spark, [(r.vec_id, [float(x) for x in r.embedding]) for r in df.collect()])


def test_deviation_beyond_a_long_is_null(spark):
    rows = [(1, [1e13]), (2, [-1e13]), (3, [0.0])]
    out = {r.vec_id: r for r in W.whiten(frame(spark, rows)).collect()}
    assert out[1].deviation is None and out[3].deviation == 0 and out[1].whitened == pytest.approx(-out[2].whitened)


# ---- matrices


def test_usable_vectors():
    col = pa.array([[1.0, 2.0], None, [None], [], [float("nan")], [3.0]], pa.list_(pa.float32()))
    ok, m = usable(col)
    assert ok.tolist() == [True, False, False, True, False, True] and m.tolist() == [[1, 2], [0, 0], [3, 0]]
    ok, m = usable(col.slice(3), 4)
    assert ok.tolist() == [True, False, True] and m.tolist() == [[0] * 4, [3, 0, 0, 0]]
    ok, m = usable(pa.array([[5, 6]], pa.large_list(pa.int64())))
    assert m.tolist() == [[5, 6]]


@pytest.mark.parametrize("d,tile,rows", [(1, 32, 7), (7, 3, 5), (64, 32, 4096), (33, 32, 10)])
def test_tiled_product(spark, d, tile, rows):
    m = np.random.default_rng(d).normal(size=(200, d))
    df = spark.createDataFrame([([float(x) for x in r],) for r in m], "v array<double>").repartition(4)
    centre = m.mean(0)
    found = tiled_product(df, lambda b: usable(b.column("v"), d)[1], "<f8", centre, tile, rows)
    assert np.allclose(found, (m - centre).T @ (m - centre))
