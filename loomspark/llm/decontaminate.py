"""Benchmark decontamination by latent semantic retrieval.

Texts are cut into blocks of words; windows of two and of four blocks are the passages, and for items longer
than these, windows of doubled block counts about as long as the item. TF-IDF over the
benchmark's terms (document frequencies over all texts) is projected to a latent space from a distributed
randomised SVD; windows whose cosine with an item is high are candidates. A candidate is a leak if the longest
common subsequence of words covers the item, or most of it together with its answer words, which catches
paraphrases too.
"""

from __future__ import annotations

from copy import copy
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .store import written

U64 = np.uint64
BLOCK = 16
SCALES = (2, 4)  # blocks in a window; longer items have wider ones, see wide()
STRIDE = 4  # a wide window begins at each so-many-th part of its length
SLOT_BITS = 20
SHIFT = U64(64 - SLOT_BITS)
RANK, OVER = 128, 16
TOGETHER = 1 << 21  # pairs of terms that a task holds before it adds them up
COMMON = 0.2  # terms in more of the texts weigh nothing
COSINE, COVER = 0.4, 0.25
LCS_ALONE, LCS_ANSWER, ANSWER = 0.85, 0.6, 3
OWN = 4.0  # weight of the items against the texts in the fit
BLOCK_WORDS = 250_000  # words of the items searched at once, about; bounds what driver and workers hold of them


class Terms:
    """The distinct words of the benchmark by their whole hash, and their numbers; other words have none."""

    def __init__(self, items: list[np.ndarray]):
        self.word = np.unique(np.concatenate(items)) if items else np.zeros(0, U64)
        self.size = len(self.word)
        slot = (self.word >> SHIFT).astype(np.int64)
        self.first = np.full(1 << SLOT_BITS, -1, np.int32)
        self.first[slot[::-1]] = np.arange(self.size, dtype=np.int32)[::-1]
        self.shared = np.zeros(1 << SLOT_BITS, bool)
        self.shared[slot[1:][slot[1:] == slot[:-1]]] = True

    def of(self, h: np.ndarray) -> np.ndarray:
        out = self.first[(h >> SHIFT).astype(np.int64)]
        at = np.flatnonzero(out >= 0)
        wrong = at[self.word[out[at]] != h[at]]
        out[wrong] = -1
        wrong = wrong[self.shared[(h[wrong] >> SHIFT).astype(np.int64)]]  # another word of the slot may be it
        if len(wrong):
            i = np.minimum(np.searchsorted(self.word, h[wrong]), self.size - 1)
            out[wrong] = np.where(self.word[i] == h[wrong], i, -1)
        return out


class Sparse:
    """Items by terms: weights of the terms of each item."""

    def __init__(self, rows: list[np.ndarray], weight: np.ndarray):
        got = [np.unique(t, return_counts=True) for t in rows]
        self.term = np.concatenate([t for t, _ in got])
        self.row = np.repeat(np.arange(len(got)), [len(t) for t, _ in got])
        self.value = np.concatenate([n for _, n in got]) * weight[self.term]
        self.shape = len(got), len(weight)

    def unit(self) -> Sparse:
        """The same with items of length one, so that none is left out of a space."""
        n = np.sqrt(np.bincount(self.row, weights=self.value**2, minlength=self.shape[0]))
        out = copy(self)
        out.value = self.value / np.maximum(n, 1e-9)[self.row]
        return out

    def _product(self, into: np.ndarray, of: np.ndarray, size: int, x: np.ndarray) -> np.ndarray:
        out = np.zeros((size, x.shape[1]), x.dtype)
        order = np.argsort(into, kind="stable")
        for a in range(0, len(order), 1 << 15):
            part = order[a : a + (1 << 15)]
            at = np.flatnonzero(np.concatenate(([True], into[part][1:] != into[part][:-1])))
            out[into[part][at]] += np.add.reduceat(x[of[part]] * self.value[part, None].astype(x.dtype), at, axis=0)
        return out

    def times(self, x: np.ndarray) -> np.ndarray:
        return self._product(self.row, self.term, self.shape[0], x)

    def transposed_times(self, x: np.ndarray) -> np.ndarray:
        return self._product(self.term, self.row, self.shape[1], x)


def _frequency(shared):
    """Texts that have each term: one packed vector for each task."""

    def run(batches):
        terms: Terms = shared.value
        df, n = np.zeros(terms.size + 1, np.int64), 0
        for batch in batches:
            n += batch.num_rows
            for _, _, h, row in K.words(batch.column(0)):
                t = terms.of(h)
                ok = t >= 0
                got = np.unique(row[ok].astype(np.int64) * terms.size + t[ok])
                df[:-1] += np.bincount(got % terms.size, minlength=terms.size) if len(got) else 0
        df[-1] = n
        at = np.flatnonzero(df)
        K.release()
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(df[at])], names=["term", "n"])

    return run


def windows(t: np.ndarray, row: np.ndarray, weight: np.ndarray, project: np.ndarray):
    """Latent vectors of the blocks of a chunk of texts: (row of each block, number in its row, vectors)."""
    if not len(row):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, project.shape[1]), np.float32)
    size = np.bincount(row)
    begin = (np.cumsum(size) - size)[row]
    number = (np.arange(len(row)) - begin) // BLOCK
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (number[1:] != number[:-1])
    block = np.cumsum(new) - 1
    out = np.zeros((block[-1] + 1, project.shape[1]), np.float32)
    ok = np.flatnonzero((t >= 0) & (weight[t] > 0))
    for a in range(0, len(ok), 1 << 14):
        part = ok[a : a + (1 << 14)]
        at = np.flatnonzero(np.concatenate(([True], block[part][1:] != block[part][:-1])))
        out[block[part][at]] += np.add.reduceat(project[t[part]], at, axis=0)  # project: rows weighted by idf
    return row[new], number[new], out


def _stretch(rows: np.ndarray, z: np.ndarray, scale: int) -> np.ndarray:
    """Sums of each block and the next scale-1 of the same text."""
    out = z.copy()
    for k in range(1, scale):
        same = rows[k:] == rows[:-k]
        out[:-k][same] += z[k:][same]
    return out


def wide(lengths: list[int]) -> list[tuple[int, np.ndarray]]:
    """(blocks in a window, items searched with it) beyond SCALES: for an item of more words than the largest of
    these, the windows of at least half and less than twice its words."""
    n = np.array(lengths, np.int64)
    out, scale = [], 2 * SCALES[-1]
    while len(n) and BLOCK * scale < 2 * n.max():
        items = np.flatnonzero((n > BLOCK * SCALES[-1]) & (2 * BLOCK * scale >= n) & (BLOCK * scale < 2 * n))
        out.append((scale, items))
        scale *= 2
    return out


def _near(r: np.ndarray, number: np.ndarray, s: np.ndarray, at: np.ndarray, vectors: np.ndarray, norms: np.ndarray):
    """(row, number of the first block, item, cosine) of the windows ``at`` that lie close to an item."""
    size = np.linalg.norm(s[at], axis=1)
    ok = size > (COVER * norms.min() if len(norms) else 0.0)
    at, size = at[ok], size[ok]
    for a in range(0, len(at), 2048):
        x, n = at[a : a + 2048], size[a : a + 2048, None]
        c = (s[x] / n) @ vectors
        i, j = np.nonzero((c >= COSINE) & (c * n >= COVER * norms))
        yield from zip(r[x[i]].tolist(), number[x[i]].tolist(), j.tolist(), c[i, j].tolist())


def _together(shared, weight):
    """How often two terms that weigh something stand in one block: rows (a, b, n), a <= b; with A the blocks by
    counts of terms, A'A."""

    def run(batches):
        terms: Terms = shared.value
        heavy = weight.value > 0
        key, n, more, held = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

        def merged():
            own, times = np.unique(np.concatenate(more), return_counts=True)
            both, count = np.concatenate((key, own)), np.concatenate((n, times))
            order = np.argsort(both, kind="stable")
            both, count = both[order], count[order]
            at = np.flatnonzero(np.concatenate(([True], both[1:] != both[:-1])))
            return both[at], np.add.reduceat(count, at)

        def batch_of(key, n):
            return pa.RecordBatch.from_arrays([pa.array((key // terms.size).astype(np.int32)), pa.array((key % terms.size).astype(np.int32)), pa.array(n)], names=["a", "b", "n"])

        for batch in batches:
            for _, _, h, row in K.words(batch.column(0)):
                if not len(row):
                    continue
                t = terms.of(h)
                size = np.bincount(row)
                number = (np.arange(len(row)) - (np.cumsum(size) - size)[row]) // BLOCK
                ok = np.flatnonzero((t >= 0) & heavy[t])
                t, row, number = t[ok].astype(np.int64), row[ok], number[ok]
                if not len(t):
                    continue
                more.append(t * terms.size + t)
                for d in range(1, BLOCK):
                    same = np.flatnonzero((row[d:] == row[:-d]) & (number[d:] == number[:-d]))
                    if not len(same):
                        break
                    x, y = t[same], t[same + d]
                    two = np.minimum(x, y) * terms.size + np.maximum(x, y)
                    more += [two, two[x == y]]  # two places of one term make two products
                    held += len(two)
                held += len(t)
                if held > TOGETHER:
                    key, n = merged()
                    more, held = [], 0
                    if len(key) > TOGETHER // 2:
                        yield from K.sliced(batch_of(key, n))
                        key, n = key[:0], n[:0]
        if more:
            key, n = merged()
        if len(key):
            yield from K.sliced(batch_of(key, n))
        K.release()

    return run


def _gram(weight, basis):
    """A'A times ``basis`` from the pairs (a, b, n) of a task, as rows (term, vector)."""

    def run(batches):
        w, q = weight.value, basis.value
        p = (q * w[:, None]).astype(np.float32)
        total = np.zeros_like(q, dtype=np.float64)
        for batch in batches:
            x, y, n = (batch.column(i).to_numpy() for i in range(3))
            apart = x != y
            for to, of, n in ((x, y, n), (y[apart], x[apart], n[apart])):
                order = np.argsort(to, kind="stable")
                for i in range(0, len(order), 1 << 14):
                    part = order[i : i + (1 << 14)]
                    at = np.flatnonzero(np.concatenate(([True], to[part][1:] != to[part][:-1])))
                    total[to[part][at]] += np.add.reduceat(p[of[part]] * n[part, None].astype(np.float32), at, axis=0)
        total *= w[:, None]
        at = np.flatnonzero(np.abs(total).sum(axis=1))
        K.release()
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array([x.tobytes() for x in total[at]], pa.binary())], names=["term", "v"])

    return run


def _add(frame: pd.DataFrame) -> pd.DataFrame:
    v = np.sum([np.frombuffer(b, np.float64) for b in frame["v"]], axis=0)
    return pd.DataFrame({"term": [frame["term"].iloc[0]], "v": [v.tobytes()]})


def latent_basis(texts: DataFrame, shared, weight, items: Sparse, rank: int, turns: int = 2) -> np.ndarray:
    """Orthonormal term vectors (terms, rank): randomised subspace iteration on A'A, where A has the texts'
    blocks and, OWN times as heavy in sum, the items at unit length. The texts are read once, for the counts of A'A, which
    the turns read. Tasks send sums by term, which are added before they come to the driver; it holds terms x rank, of
    at most BLOCK_WORDS terms."""
    sc = texts.sparkSession.sparkContext
    together = written(texts.mapInArrow(_together(shared, weight), "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n")))
    items = items.unit()
    n, r = items.shape[1], min(items.shape[1], rank + OVER)
    q = np.linalg.qr(np.random.default_rng(7).standard_normal((n, r)))[0].astype(np.float32)
    for _ in range(turns):
        basis = sc.broadcast(q)
        y = np.zeros_like(q)
        for term, v in together.mapInArrow(_gram(weight, basis), "term long, v binary").groupBy("term").applyInPandas(_add, "term long, v binary").toLocalIterator():
            y[term] = np.frombuffer(v, np.float64)
        own = items.transposed_times(items.times(q))
        size = np.linalg.norm(y)
        y = y * (np.linalg.norm(own) / size) + OWN * own if size else own
        q = np.linalg.qr(y)[0]
        basis.unpersist()
    return q[:, :rank]


def lcs(a: list[int], b: list[int]) -> int:
    """Longest common subsequence by bit vectors: a step of word operations for each element of b."""
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for y in b:
        m = v & where.get(y, 0)
        v = ((v + m) | (v - m)) & full
    return len(a) - bin(v).count("1")


HITS = "doc_id long, item_id long, cosine double, lcs long, item_words long, answer_found boolean"


class Model(NamedTuple):
    """What tasks search texts with: terms, weights, basis, and the items' vectors, ids, words and answer words."""

    terms: Terms
    weight: np.ndarray
    project: np.ndarray
    vectors: np.ndarray
    norms: np.ndarray
    ids: np.ndarray
    items: list[list[int]]
    answers: list[list[int]]


def search(col: pa.Array, model: Model):
    """(row, item id, cosine of the best window, common subsequence, item words, answer found) of each leak in a
    column of texts."""
    _, _, project, vectors, norms, ids, items, answers = model
    wider = [(scale, at, vectors[:, at], norms[at]) for scale, at in wide([len(x) for x in items])]
    for first, rows, h, row in K.words(col):
        if not len(h):
            continue
        begin = np.searchsorted(row, np.arange(rows + 1))
        r, number, z = windows(model.terms.of(h), row, model.weight, project)
        tried: dict[tuple[int, int], list] = {}
        for scale in SCALES:
            s = _stretch(r, z, scale)
            for doc, k, item, v in _near(r, number, s, np.arange(len(s)), vectors, norms):
                tried.setdefault((doc, item), []).append((k, scale, v))
        for scale, own, v_own, n_own in wider:
            half = s.copy()
            same = r[scale // 2 :] == r[: -(scale // 2)]
            s[: -(scale // 2)][same] += half[scale // 2 :][same]
            for doc, k, j, v in _near(r, number, s, np.flatnonzero(number % (scale // STRIDE) == 0), v_own, n_own):
                tried.setdefault((doc, int(own[j])), []).append((k, scale, v))
        for (doc, item), places in tried.items():
            words = items[item]
            best = None
            for number_, scale, cosine in places:
                lo = begin[doc] + max(0, number_ - 1) * BLOCK
                hi = min(begin[doc + 1], begin[doc] + (number_ + scale + 1) * BLOCK)
                if len(words) > BLOCK * scale:  # an item longer than the window: as far as it may reach
                    lo, hi = max(begin[doc], lo - len(words)), min(begin[doc + 1], hi + len(words))
                elif scale > SCALES[-1]:  # one of the windows holds three quarters of it or more
                    lo, hi = max(begin[doc], lo - len(words) // 2), min(begin[doc + 1], hi + len(words) // 2)
                near = h[lo:hi].tolist()
                there = set(near)
                found = all(x in there for x in answers[item])
                if sum(x in there for x in words) < (LCS_ANSWER if found else LCS_ALONE) * len(words):
                    continue  # no subsequence can be longer than the words there are
                n = lcs(words, near)
                if n >= LCS_ALONE * len(words) or (found and n >= LCS_ANSWER * len(words)):
                    got = (n, cosine, found)
                    best = max(best, got) if best else got
            if best:
                yield first + doc, int(ids[item]), best[1], best[0], len(words), best[2]


def _hits(model):
    def run(batches):
        for batch in batches:
            hits = list(search(batch.column(0), model.value))
            docs = batch.column(1).take(pa.array([x[0] for x in hits], pa.int64()))
            rest = zip(pa.schema([("item_id", pa.int64()), ("cosine", pa.float64()), ("lcs", pa.int64()), ("item_words", pa.int64()), ("answer_found", pa.bool_())]), range(1, 6))
            columns = {f.name: pa.array([x[i] for x in hits], f.type) for f, i in rest}
            yield pa.RecordBatch.from_arrays([docs, *columns.values()], names=["doc_id", *columns])
        K.release()

    return run


def _leaky(model):
    def run(col: pa.Array) -> pa.Array:
        out = np.zeros(len(col), bool)
        out[[x[0] for x in search(col, model.value)]] = True
        K.release()
        return pa.array(out)

    return F.arrow_udf(run, "boolean")


def _fitted(docs: DataFrame, items: list[tuple[int, str]], rank: int, fit: int | None):
    """The broadcast model of one block of items; None if no item has a word."""
    sc = docs.sparkSession.sparkContext
    hashed: list[np.ndarray] = [np.zeros(0, U64)] * len(items)
    for first, rows, h, row in K.words(pa.array([t for _, t in items], pa.string())):
        at = np.searchsorted(row, np.arange(rows + 1))
        for i in range(rows):
            hashed[first + i] = h[at[i] : at[i + 1]]
    keep = [i for i, h in enumerate(hashed) if len(h)]
    hashed, ids = [hashed[i] for i in keep], np.array([items[i][0] for i in keep], np.int64)
    if not keep:
        return None
    terms = Terms(hashed)
    shared = sc.broadcast(terms)  # the words of a block of items
    text = docs.select(F.col("text").cast("string").alias("text"))
    df = np.zeros(terms.size + 1, np.int64)
    for term, n in text.mapInArrow(_frequency(shared), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():  # a row a term
        df[term] = n
    total, df = max(int(df[-1]), 1), df[:-1]
    idf = np.maximum(np.log((total + 1) / (df + 0.5)), 0.05)
    weight = np.where(df <= COMMON * total, idf, 0.0)
    numbers = [terms.of(h) for h in hashed]
    for t in numbers:  # an item of common words keeps them: it could not be found without
        if (weight[t] > 0).mean() < 0.5:
            weight[t] = idf[t]
    matrix = Sparse(numbers, weight)
    shared_weight = sc.broadcast(weight)
    if fit is not None:
        u = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(1 << 30)) / F.lit(float(1 << 30))
        text = docs.where(u < min(1.0, fit / total)).select(F.col("text").cast("string").alias("text"))
    q = latent_basis(text, shared, shared_weight, matrix, rank)
    z = matrix.times(q)
    norms = np.linalg.norm(z, axis=1)
    norms[norms == 0] = 1e-9
    # answer words: those of the item that fewest texts have; its last words break ties
    answers = []
    for h, t in zip(hashed, numbers):
        picked: list[int] = []
        for i in np.lexsort((-np.arange(len(h)), df[t])):
            if int(h[i]) not in picked:
                picked.append(int(h[i]))
            if len(picked) == ANSWER:
                break
        answers.append(picked)
    project = (q * weight[:, None]).astype(np.float32)
    return sc.broadcast(Model(terms, weight, project, (z / norms[:, None]).T.astype(np.float32), norms.astype(np.float32), ids, [h.tolist() for h in hashed], answers))


def _models(docs: DataFrame, benchmark: DataFrame, rank: int, fit: int | None):
    rows = benchmark.where("text IS NOT NULL AND item_id IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    words = rows.agg(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))).first()[0] or 0
    blocks = max(1, -(-words // BLOCK_WORDS))
    for b in range(blocks):
        items = [(r[0], r[1]) for r in rows.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).orderBy("item_id", "text").collect()]
        if (model := _fitted(docs, items, rank, fit)) is not None:
            yield model


def leaks(docs: DataFrame, benchmark: DataFrame, rank: int = RANK, fit: int | None = None) -> DataFrame:
    """One row for each document and item that it leaks: ``doc_id, item_id, cosine`` (of the best window),
    ``lcs`` (words in common, in order), ``item_words``, ``answer_found``.

    ``docs(doc_id, text, ...)``, ``benchmark(item_id, text, ...)``; other columns are ignored. Null or empty
    texts and items, and items without a word or an id, match nothing; a null doc_id is shown as it is; repeated rows
    each give their hits; if either table is empty there are none. The benchmark is a query set: it is searched in
    blocks of about BLOCK_WORDS words, which bounds what is broadcast and what the driver holds. The latent space is
    fitted on all texts (with ``fit``, on about so many of them only); every text is searched, whole.
    """
    out = docs.sparkSession.createDataFrame([], HITS)
    for model in _models(docs, benchmark, rank, fit):
        out = out.union(docs.select(F.col("text").cast("string").alias("text"), F.col("doc_id").cast("long").alias("doc_id")).mapInArrow(_hits(model), HITS))
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, rank: int = RANK, fit: int | None = None) -> DataFrame:
    """The rows whose text leaks no item, with their columns (of any name) as they are; each row is judged by its own
    text, so null and repeated ids need no care. Only the text goes to Python; nothing is shuffled."""
    out = docs
    for model in _models(docs, benchmark, rank, fit):
        out = out.where(~_leaky(model)(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    return out
