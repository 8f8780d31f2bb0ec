"""What the findings of a round were about."""

import random

import numpy as np
import pyarrow as pa

from loomspark.llm import jaccard


def _texts(n, words, seed=1):
    rng = random.Random(seed)
    return [" ".join(f"w{rng.randrange(10**6)}" for _ in range(words)) for _ in range(n)]


def test_packed_signatures_stay_small():
    """Sets that can spare their empty segments send no signature of them, and one that is dealt to many buckets
    is named in few bytes: 8 for its name, mostly one or two more, 6 for a signature."""
    texts = _texts(150, 300)
    batches = lambda: [pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])]
    size = {}
    for parts in (1, 64):
        rows = [x for b in jaccard._index(5, 75, parts)(batches()) for x in b.column(1).to_pylist()]
        size[parts] = sum(len(pa.compress(x, codec="lz4", asbytes=True)) for x in rows)
    assert size[1] < 230_000 and size[64] < 330_000  # 290,045 and 369,311 before


def test_a_set_tells_its_lost_units_once():
    """However many buckets its signatures are dealt to, a set shows the units of its empty segments in one row."""
    import pandas as pd

    batch = pa.RecordBatch.from_arrays([pa.array(_texts(60, 200))], names=["text"])
    frames = {}
    for out in jaccard._index(5, 75, 8)([batch]):
        for p, blob in zip(out.column(0).to_pylist(), out.column(1).to_pylist()):
            frames.setdefault(p, []).append(blob)
    assert len(frames) == 8
    found = pd.concat([jaccard._probe(75, 16)(pd.DataFrame({"bucket": p, "blob": x})) for p, x in frames.items()])
    lost = found[found["kind"].isin([1, 3])]
    role = np.asarray(lost["b"]) >> 40
    assert len(lost) and not pd.DataFrame({"a": lost["a"], "r": role}).duplicated().any()


def test_crowded_families_equal_brute_force(spark):
    """Families of 40 near copies with many empty segments (short texts) and few (long ones)."""
    from test_jaccard import check, edited

    rng = random.Random(8)
    texts = []
    for size in (7, 11, 16, 30, 64, 150):
        base = [f"w{rng.randrange(10**6)}" for _ in range(size)]
        texts += edited(rng, base, 40, 0.02) + [" ".join(base[: int(size * 0.85)]), " ".join([*base, *base[:2]])]
    rng.shuffle(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    check(spark, df, crowd=4)
    check(spark, df)


def test_the_latent_space_is_fitted_on_all_texts(spark, monkeypatch):
    from loomspark.llm import decontaminate as D

    seen, real = [], D.latent_basis

    def spy(texts, *rest):
        seen.append(texts.count())
        return real(texts, *rest)

    monkeypatch.setattr(D, "latent_basis", spy)
    docs = spark.range(30_000).selectExpr("id AS doc_id", "concat('w', id % 40, ' w', id % 7) AS text")
    items = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(40)))], "item_id long, text string")
    assert D.leaks(docs, items).count() == 0
    assert seen == [30_000]


def test_products_of_terms_are_exact(spark):
    """A'A from the texts: every pair of places in a block of 16 words, over chunks and tasks."""
    from collections import Counter

    from pyspark.sql import functions as F

    from common import words
    from loomspark.llm import decontaminate as D
    from loomspark.llm import kernel as K

    rng = random.Random(4)
    texts = [" ".join(f"w{rng.randrange(30)}" for _ in range(rng.randrange(60))) for _ in range(300)]
    names = [f"w{i}" for i in range(25)]
    h = np.concatenate([x for _, _, x, _ in K.words(pa.array(names))])
    terms = D.Terms([h])
    number = dict(zip(names, terms.of(h).tolist()))
    weight = np.ones(terms.size)
    weight[number["w3"]] = 0
    want = Counter()
    for t in texts:
        w = words(t)
        for i in range(0, len(w), 16):
            known = [number[x] for x in w[i : i + 16] if x in number and x != "w3"]
            want.update((a, b) for a in known for b in known if a <= b)
    sc = spark.sparkContext
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    got = df.mapInArrow(D._together(sc.broadcast(terms), sc.broadcast(weight)), "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
    assert {(r.a, r.b): r.n for r in got.collect()} == dict(want)
