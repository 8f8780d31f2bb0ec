"""Vector search and near-duplicates."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.vectors import norm
from ..sources.shared import written


#: Entries of a matrix that a task works on at a time.
CELLS = 1 << 19
#: Items that a task compares at a time, and those of a stripe of items: few of them are not worth a task of their own.
AT_ONCE, LEAST_ITEMS, MOST_ITEMS = 1024, 1 << 14, 1 << 17
#: Scores have six places: half of the last one, and how far a product of matrices is certain to be from a sum.
_HALF, _NEAR = 0.5e-6, 0.1e-6


def _matrix(v: pa.Array, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows of a matrix, cut or filled up with zeros to ``width`` (default: the longest), and their sizes."""
    size = pc.fill_null(pc.list_value_length(v), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    width = int(size.max(initial=0)) if width is None else width
    if (size == width).all():
        return values.reshape(len(size), width), size
    row, place = np.repeat(np.arange(len(size)), size), np.arange(len(values)) - np.repeat(np.cumsum(size) - size, size)
    out, fits = np.zeros((len(size), width)), place < width
    out[row[fits], place[fits]] = values[fits]
    return out, size


def _unit(x: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """Rows of length 1; zeros where there is no direction, NaN where the length is too extreme to be sure of anything."""
    unit = x / norm[:, None]
    unit[~((norm > 1e-100) & (norm < 1e100))] = np.nan
    unit[norm == 0] = 0.0
    return unit


def _cosines(x: np.ndarray, x_norm: np.ndarray, y: np.ndarray, y_norm: np.ndarray) -> np.ndarray:
    """Of pairs of rows: added up one entry after the other and rounded half away from zero, as SQL does."""
    total, norm = np.zeros(len(x)), x_norm * y_norm
    for j in range(x.shape[1]):
        total += x[:, j] * y[:, j]
    score = np.divide(total, norm, out=np.zeros(len(x)), where=(x_norm != 0) & (y_norm != 0) & (norm != 0))
    whole = np.trunc(score * 1e6)
    whole += np.where(np.abs(score * 1e6 - whole) >= 0.5, np.sign(score), 0.0)
    return np.where(np.isfinite(whole), whole / 1e6, score)


class _Asked:
    """A block of queries with the k best items so far. Items come in the order of their ids, so a later one has to have a
    higher score than the k-th. A product of matrices leaves out the pairs that cannot; the others are worked out."""

    def __init__(self, rows: pa.RecordBatch, k: int, threshold: float):
        self.ids, self.norm, self.k, self.threshold = rows.column("query_id"), rows.column("n").to_numpy(), k, threshold
        self.x, self.size = _matrix(rows.column("v"))
        self.unit = _unit(self.x, self.norm)
        self.rough, self.slack = self.unit.astype(np.float32), (self.x.shape[1] + 8) * 2.0**-23  # twice what rounding can be
        self.bar = np.full(len(self.x), max(threshold - _HALF - _NEAR, -1e30))
        self.query, self.score, self.item = np.zeros(0, np.int64), np.zeros(0), None

    def _reach(self, at: slice, unit: np.ndarray, rough: np.ndarray, size: np.ndarray, norm: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of some queries and these items that may have a place among the best: by a product in single precision
        first, and again where that leaves many."""
        sizes = self.size[at]
        mixed = (size != sizes[0]).any() or (sizes != sizes[0]).any() or (norm == 0).any() or (self.norm[at] == 0).any()

        def product(x, y, rows):
            s = x @ y.T
            if mixed:
                flat = (self.norm[at][rows] == 0)[:, None] | (norm == 0)
                s = np.where(flat, 0.0, np.where(sizes[rows, None] == size, s, -np.inf))
            return s

        s = product(self.rough[at], rough, slice(None))
        low = (self.bar[at] - self.slack).astype(np.float32)
        rows = np.flatnonzero(~(s.max(axis=1) < low))
        near = ~(s[rows] < low[rows, None])  # NaN is near
        if s.shape[1] > self.k and np.count_nonzero(near) > 4 * self.k * len(rows):
            s, bar = product(self.unit[at][rows], unit, rows), self.bar[at][rows]
            best = np.partition(np.where(np.isnan(s), -np.inf, s), -self.k, axis=1)[:, -self.k]
            near = ~(s < np.maximum(bar, best - 2 * (_HALF + _NEAR))[:, None])
        query, item = np.divmod(np.flatnonzero(near), len(size))
        return rows[query] + at.start, item

    def look(self, rows: pa.RecordBatch) -> None:
        norm = rows.column("n").to_numpy()
        y, size = _matrix(rows.column("v"), self.x.shape[1])
        unit = _unit(y, norm)
        rough = unit.astype(np.float32)
        step, pairs = max(1, CELLS // len(y)), max(1, CELLS // max(1, y.shape[1]))
        for i in range(0, len(self.x), step):
            query, item = self._reach(slice(i, min(i + step, len(self.x))), unit, rough, size, norm)
            parts = [(query[p : p + pairs], item[p : p + pairs]) for p in range(0, len(query), pairs)]
            for q, t in parts:
                score = _cosines(self.x[q], self.norm[q], y[t], norm[t])
                keep = ~(score < self.threshold)
                self._add(q[keep], score[keep], rows.column("item_id").take(pa.array(t[keep])))

    def _add(self, query: np.ndarray, score: np.ndarray, item: pa.Array) -> None:
        """New hits, by query and place; those of a query stand by falling score, equal ones in the order they came."""
        if not len(query):
            return
        hit = np.zeros(len(self.x), bool)
        hit[query] = True
        old = hit[self.query]
        if self.item is None:
            self.item = item.slice(0, 0)
        rest = self.query[~old], self.score[~old], self.item.filter(pa.array(~old))
        query, score, item = np.concatenate([self.query[old], query]), np.concatenate([self.score[old], score]), pa.concat_arrays([self.item.filter(pa.array(old)), item])
        order = np.lexsort((-np.where(np.isnan(score), np.inf, np.minimum(score, np.finfo(float).max)), query))  # NaN first, as in SQL
        query, score = query[order], score[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        last = score[rank == self.k - 1]
        self.bar[query[rank == self.k - 1]] = np.where(np.isnan(last), np.inf, last + _HALF - _NEAR)
        keep = rank < self.k
        self.query, self.score = np.concatenate([rest[0], query[keep]]), np.concatenate([rest[1], score[keep]])
        self.item = pa.concat_arrays([rest[2], item.take(pa.array(order[keep]))])

    def hits(self):
        for i in range(0, len(self.query), 50_000):
            at = slice(i, i + 50_000)
            yield pa.RecordBatch.from_arrays([self.ids.take(pa.array(self.query[at])), self.item.slice(i, 50_000), pa.array(self.score[at])], ["query_id", "item_id", "score"])


def _nearest(k: int, threshold: float):
    """Of one task: a block of queries, then a stripe of items by their ids."""

    def run(batches):
        asked, block = [], None
        with np.errstate(all="ignore"):
            for batch in batches:
                n = batch.num_rows - (pc.sum(batch.column("is_item")).as_py() or 0)
                if n:
                    asked.append(batch.slice(0, n))
                if not asked:
                    continue  # a block without queries
                for i in range(n, batch.num_rows, AT_ONCE):
                    block = block or _Asked(pa.Table.from_batches(asked).combine_chunks().to_batches()[0], k, threshold)
                    block.look(batch.slice(i, AT_ONCE))
            if block:
                yield from block.hits()

    return run


def top_k(queries: DataFrame, items: DataFrame, k: int = 3, threshold: float = 0.5, most_queries: int = 10_000) -> DataFrame:
    """``queries(query_id, q)``, ``items(item_id, v)`` -> the k most similar items of each query above a threshold,
    ties by id: every query against every item.

    Queries are dealt to blocks of about ``most_queries`` (fewer if vectors are wide) and items to stripes, as many as
    their counts ask for. A block and a stripe are a task, which holds the block, reads the stripe and keeps k items of
    each query; the work grows with queries times items. Vectors of different sizes are no hits; null ones, those with
    null entries and zeros score 0.
    """
    (n, width), n_items = queries.select(F.count("*"), F.max(F.size("q"))).first(), items.count()
    blocks = max(1, -(-n // max(1, min(most_queries, 8 * CELLS // max(1, width or 0)))))
    wanted = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stripes = max(1, -(-n_items // MOST_ITEMS), min(-(-wanted // blocks), -(-n_items // LEAST_ITEMS)))

    kinds = {queries.schema["q"].dataType.elementType.typeName(), items.schema["v"].dataType.elementType.typeName()}
    kind = "array<float>" if kinds == {"float"} else "array<double>"
    q = queries.select("query_id", F.col("q").cast(kind).alias("v"), F.coalesce(norm(F.col("q")), F.lit(0.0)).alias("n"))
    i = items.select("item_id", F.col("v").cast(kind).alias("v"), F.coalesce(norm(F.col("v")), F.lit(0.0)).alias("n"))
    if threshold > 0:
        q, i = q.where("n > 0"), i.where("n > 0")
    q, i = q.withColumn("block", F.pmod(F.xxhash64("query_id", "v"), F.lit(blocks))), i.withColumn("stripe", F.pmod(F.xxhash64("item_id", "v"), F.lit(stripes)))
    ids = {c: d.schema[c].dataType for d, c in ((q, "query_id"), (i, "item_id"))}
    ask = q.select(F.lit(False).alias("is_item"), "query_id", F.lit(None).cast(ids["item_id"]).alias("item_id"), "v", "n", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(stripes - 1).cast("long"))).alias("stripe"))
    give = i.select(F.lit(True).alias("is_item"), F.lit(None).cast(ids["query_id"]).alias("query_id"), "item_id", "v", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), "stripe")
    met = ask.union(give).repartitionById(blocks * stripes, (F.col("block") * stripes + F.col("stripe")).cast("int")).sortWithinPartitions("is_item", "item_id")
    found = met.mapInArrow(_nearest(k, threshold), StructType([StructField(c, t) for c, t in ids.items()] + [StructField("score", DoubleType())]))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "item_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).withColumn("rank", F.col("rank").cast("long"))


def with_texts(hits: DataFrame, texts: DataFrame, separator: str = "\n\n---\n\n", most_sent: int = 500_000) -> DataFrame:
    """``hits(query_id, item_id, rank, ...)`` of ``top_k`` and ``texts(item_id, text)`` -> ``query_id, context``: the
    texts of the hits in their order (at most k of them), joined; hits without a text are passed over. The hits are
    written and counted: at most ``most_sent`` go to where the texts are read, so that only texts that were hit are
    shuffled; more are joined by a shuffle of all texts."""
    hits = written(hits.select("query_id", "item_id", "rank"))
    found = F.broadcast(hits) if hits.count() <= most_sent else hits
    met = texts.where("text IS NOT NULL").join(found, "item_id").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("x"))
    return met.select("query_id", F.array_join(F.transform("x", lambda h: h["text"]), separator).alias("context"))


def _close(threshold: float):
    """Pairs of one pair of blocks (or of one block) that exceed the threshold, by a product of matrices."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        group, p, q = f["group"].iloc[0], f["p"].iloc[0], f["q"].iloc[0]
        found = []
        for _, same in f.groupby(f["v"].map(len)):
            a, b = (same[same["c"] == c] for c in (p, q))
            if not len(a) or not len(b):
                continue
            x, y = (np.stack(t["v"].to_numpy()).astype(np.float64) for t in (a, b))
            size = np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(y, axis=1)
            score = np.round(np.divide(x @ y.T, size, out=np.zeros_like(size), where=size > 0), 6)
            i, j = np.nonzero(score > threshold)
            left, right, s = a["id"].to_numpy()[i], b["id"].to_numpy()[j], score[i, j]
            keep = left < right if p == q else np.ones(len(i), bool)
            found.append(pd.DataFrame({"group": group, "a": np.minimum(left, right)[keep], "b": np.maximum(left, right)[keep], "score": s[keep]}))
        return pd.concat(found) if found else pd.DataFrame({"group": [], "a": [], "b": [], "score": []})

    return run


def near_duplicates(vectors: DataFrame, threshold: float, block: int = 2048) -> DataFrame:
    """Pairs of one group whose cosine exceeds the threshold (not negative): ``vectors(group, id, v)``.

    A group is dealt to blocks of about ``block`` vectors, as many as its count asks for, and each pair of blocks is
    a task of its own with two blocks in memory: a hot group is many small tasks. Vectors of different sizes, empty
    and null ones have no partner; rows without a group or an id are left out.
    """
    v = vectors.where("v IS NOT NULL AND id IS NOT NULL").select("group", "id", "v")
    blocks = v.groupBy("group").agg(F.ceil(F.count("*") / block).alias("blocks"))
    dealt = v.join(blocks, "group").withColumn("c", F.pmod(F.xxhash64("id"), "blocks")).withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    both = dealt.select("group", "id", "v", "c", F.least("c", "o").alias("p"), F.greatest("c", "o").alias("q"))
    kind = vectors.schema
    return both.groupBy("group", "p", "q").applyInPandas(_close(threshold), StructType([StructField("group", kind["group"].dataType), StructField("a", kind["id"].dataType), StructField("b", kind["id"].dataType), StructField("score", DoubleType())]))


def best_by_weight(hits: DataFrame, most: int = 3) -> DataFrame:
    """``hits(query_id, retriever, weight, ord, text)``: non-empty texts of retrievers with weight, heaviest first."""
    w = Window.partitionBy("query_id").orderBy(F.desc("weight"), "ord")
    return hits.where("weight > 0 AND text <> ''").withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= most)


def chained(hits: DataFrame, least: int = 50) -> DataFrame:
    """Retrievers in order until their texts have ``least`` characters together."""
    before = Window.partitionBy("query_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    return hits.where("text <> ''").withColumn("before", F.coalesce(F.sum(F.length("text")).over(before), F.lit(0))).where(F.col("before") < least)
