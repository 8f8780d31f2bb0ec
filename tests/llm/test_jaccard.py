"""The join against an inverted index in plain Python."""

import random
from collections import Counter, defaultdict

import pytest

from common import awkward, words
from loomspark.llm.components import components
from loomspark.llm.jaccard import Bands, apart, jaccard_join, sketch


def brute(rows, k=5, p=75):
    sets = {}
    for i, t in rows:
        w = words(t)
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} or ({tuple(w)} if w else set())
    has, root = defaultdict(list), {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sorted(sets):
        common = Counter(j for g in sets[i] for j in has[g])
        for j, o in common.items():
            if 100 * o >= p * (len(sets[i]) + len(sets[j]) - o):
                a, b = sorted((find(i), find(j)))
                root[b] = a
        for g in sets[i]:
            has[g].append(i)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def check(spark, df, **how):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join(df, **how).collect()}
    assert got == brute([(r.doc_id, r.text) for r in df.collect()])


def edited(rng, base, n, share):
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(max(1, int(len(w) * share))):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    """Families of near copies of many sizes, on both sides of the threshold, a shared passage, and strangers."""
    rng = random.Random(seed)
    passage = [f"p{i}" for i in range(30)]
    texts = []
    for size in (4, 5, 6, 8, 9, 12, 20, 40, 90, 300):
        for _ in range(3):
            base = [f"w{rng.randrange(10**6)}" for _ in range(size)]
            texts += [" ".join(base)] * 2 + edited(rng, base, 6, rng.choice([0.01, 0.02, 0.03, 0.04])) + [" ".join(base[: int(size * 0.8)]), " ".join([*base, *base[:3], "z"])]
    texts += [" ".join([f"s{rng.randrange(10**6)}" for _ in range(40)] + passage) for _ in range(60)]
    rng.shuffle(texts)
    check(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4))


def test_crowded_group(spark):
    """More near copies than the direct way expands: the exact second way finds the rest."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(120)]
    texts = edited(rng, base, 150, 0.025) + [" ".join(base)] * 20
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    check(spark, df)
    check(spark, df, crowd=4)


def test_awkward_rows(spark):
    check(spark, awkward(spark))
    assert jaccard_join(awkward(spark).limit(0)).count() == 0


def test_bands_reach_all_partners():
    b = Bands(75)
    for s in range(1, 3000):
        for t in {s, s * 100 // 75}:
            assert b.band(t) - b.band(s) in (0, 1)
        own = b.band(s)
        assert b.used(own, s) <= b.used(own, s + 1) or b.band(s + 1) != own


def test_sketch_is_a_lower_bound():
    import numpy as np

    rng = np.random.default_rng(1)
    for _ in range(200):
        x = np.unique(rng.integers(0, 2**63, rng.integers(1, 400)).astype(np.uint64))
        y = np.unique(np.concatenate((x[: len(x) * 3 // 4], rng.integers(0, 2**63, rng.integers(0, 400)).astype(np.uint64))))
        assert apart(sketch(x), sketch(y)) <= len(np.setxor1d(x, y))


def test_components_of_a_chain(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (101, 100)], "a long, b long")
    got = {r.node: r.component for r in components(df).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
    assert components(df.limit(0)).count() == 0
