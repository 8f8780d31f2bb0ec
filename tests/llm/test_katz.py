"""Scores against the definition evaluated token by token; exact normalisation."""

import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from common import awkward, rest, words
from loomspark.llm import katz


def model(texts):
    uni, bi, ctx = Counter(), Counter(), Counter()
    for w in texts:
        s = ["<s>", *w, "</s>"]
        uni.update(s[1:])
        bi.update(zip(s, s[1:]))
        ctx.update(s[:-1])
    n = sum(uni.values())
    of = lambda c: [Counter(min(x, katz.KMAX + 2) for x in c.values())[i] for i in range(1, katz.KMAX + 2)]
    d1, d2 = katz.discounts(of(uni)), katz.discounts(of(bi))
    p1 = {w: d1[min(c, katz.KMAX + 1)] * c / n for w, c in uni.items()}
    left, after = 1 - sum(p1.values()), defaultdict(list)
    for (h, w), c in bi.items():
        after[h].append((w, c))

    def alpha(h):
        if h not in after:
            return 1.0
        return (1 - sum(d2[min(c, katz.KMAX + 1)] * c for _, c in after[h]) / ctx[h]) / (1 - sum(p1[w] for w, _ in after[h]))

    def p(h, w):
        c = bi.get((h, w), 0)
        return d2[min(c, katz.KMAX + 1)] * c / ctx[h] if c else alpha(h) * p1.get(w, left)

    return uni, n, p, left


def check(spark, df):
    """Rows in order of id, tokens and score, so that null and repeated ids are held to their own rows."""
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    out = lambda i: i is None or rest(i, 7) == 2
    rows = [(r.doc_id, words(r.text)) for r in df.collect()]
    uni, n, p, _ = model([w for i, w in rows if not out(i)])
    score = lambda w: sum(math.log10(p(h, x)) for h, x in zip(["<s>", *w], [*w, "</s>"]))
    rows.sort(key=lambda x: (x[0] is not None, x[0] or 0, len(x[1]), score(x[1])))
    got = sorted(katz.katz_scores(df, held).collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.score))
    assert [g.doc_id for g in got] == [i for i, _ in rows]
    for (i, w), g in zip(rows, got):
        s = ["<s>", *w, "</s>"]
        assert (g.held_out, g.n_tokens, g.n_known, g.train_tokens) == (out(i), len(s) - 1, sum(x in uni for x in s[1:]), n)
        assert math.isclose(g.base_score, sum(math.log10((uni[x] + 1) / (n + len(uni) + 1)) for x in s[1:]), rel_tol=1e-9)
        assert math.isclose(g.score, sum(math.log10(p(h, x)) for h, x in zip(s, s[1:])), rel_tol=1e-7)
    return uni, p


def test_equals_definition(spark):
    texts = [" ".join(f"w{(i * j) % (7 + j % 5)}" for j in range(1, 30 + i % 17)) + (f" rare{i}" if i % 3 else "") for i in range(80)]
    uni, p = check(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3))
    for h in ("<s>", "w1", "w2", "never"):
        seen = sum(p(h, w) for w in uni)
        assert abs(seen + p(h, "unknown word") - 1) < 1e-9


def test_null_and_repeated_ids(spark):
    texts = ["a b c", "a b c", "a b a b", None, "", "c c c a", "a b", "b a c d", "only here", "a b c"]
    ids = [None, 1, 1, 1, 2, 2, None, None, 3, 4]
    check(spark, spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").repartition(3))


@pytest.mark.parametrize("heavy", [3, 20, 10**9])
def test_any_number_of_frequent_words(spark, monkeypatch, heavy):
    """Which pairs are scored where they are read, and which contexts are sent to all, changes no score."""
    monkeypatch.setattr(katz, "HEAVY", heavy)
    monkeypatch.setattr(katz, "BUCKET_BYTES", 500)
    monkeypatch.setattr(katz, "LEAST_BUCKETS", 1)
    monkeypatch.setattr(katz, "FLUSH", 300)
    texts = [" ".join(["the"] * (i % 3) + [f"w{(i * j) % 11}" for j in range(1, 9 + i % 7)] + [f"rare{i}"] * (i % 2) + ["the", "end"]) for i in range(60)]
    check(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3))


def test_awkward_rows(spark):
    check(spark, awkward(spark))
    empty = awkward(spark).limit(0)
    assert katz.katz_scores(empty, F.lit(False)).count() == 0
    assert katz.katz_scores(awkward(spark), F.lit(True)).where("n_known > 0").count() == 0
