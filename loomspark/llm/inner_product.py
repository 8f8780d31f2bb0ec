"""Exact top-k search by inner product: norm-sorted blocks, rotated partial sums, Cauchy-Schwarz bounds.

All vectors are sorted by falling length and packed into blocks; queries are packed into blocks too. Each task holds
one block of queries and reads one stripe of the item blocks, longest vectors first, one block at a time. With the right
singular vectors of the data most of an inner product lies in its first few terms; what the rest can add is bounded
by the product of the lengths that are left. Only pairs whose bound reaches the query's k-th best score so far
are worked out, in whole numbers; a block whose longest vector cannot reach it ends the stripe.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import kernel as K
from .dense import MOST_DIMS, batch_of, scaled, tiled_product, usable
from .store import buckets, written

SCALE, BEST = 256, 5
QUERIES, ITEMS = 8192, 4096
#: Items of one stripe at most: about so many are read by a task for each block of queries.
STRIPE = 1 << 20
#: Share of the energy that the first terms of the partial sums hold.
ENERGY = 0.9
#: Queries that are compared at a time with one block of items: bounds the matrices of a task.
AT_ONCE = 512

_ITEM = "top double, ids binary, data binary"
_MEASURES = pa.schema([("width", pa.int64()), ("most", pa.int64()), ("n", pa.int64()), ("asked", pa.int64())])
_ROWS = pa.schema([("id", pa.int64()), ("asked", pa.bool_()), ("length", pa.float64()), ("data", pa.binary())])
_PACKED = pa.schema([("top", pa.float64()), ("ids", pa.binary()), ("data", pa.binary())])
_FOUND = pa.schema([("block", pa.int64()), ("at", pa.int32()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _measure(batches):
    width = most = n = asked = 0
    for batch in batches:
        ok, values = usable(batch.column("embedding"))
        x = scaled(values, SCALE)
        width, most, n = max(width, x.shape[1]), max(most, int(np.abs(x).max(initial=0))), n + len(x)
        asked += int((batch.column("asked").fill_null(False).to_numpy(zero_copy_only=False) & ok).sum())
    yield batch_of(_MEASURES, [(width, most, n, asked)])


def _matrix(width: int, kind: str):
    return lambda batch: scaled(usable(batch.column("embedding"), width)[1], SCALE).astype(kind)


def _lengths(width: int, kind: str):
    """Rows that take part, with the length of their vector."""

    def run(batches):
        for batch in batches:
            ok, values = usable(batch.column("embedding"), width)
            x = scaled(values, SCALE)
            data = pa.array([r.tobytes() for r in x.astype(kind)], pa.binary())
            keep = batch.filter(pa.array(ok))
            yield pa.RecordBatch.from_arrays([keep.column("id"), keep.column("asked").fill_null(False), pa.array(np.linalg.norm(x.astype(np.float64), axis=1)), data], schema=_ROWS)

    return run


def _pack(rows: int, by: str | None = None):
    """Neighbouring rows, of one value of ``by`` if it is given, as blocks of at most ``rows`` rows."""

    def run(batches):
        ids, data, lengths, key = [], [], [], None
        for batch in batches:
            keys = batch.column(by).to_pylist() if by else [None] * batch.num_rows
            for k, i, n, x in zip(keys, batch.column("id").to_pylist(), batch.column("length").to_pylist(), batch.column("data").to_pylist()):
                if ids and (k != key or len(ids) == rows):
                    yield batch_of(_PACKED, [(lengths[0], np.array(ids, np.int64).tobytes(), b"".join(data))])
                    ids, data, lengths = [], [], []
                key = k
                ids.append(i)
                data.append(x)
                lengths.append(n)
        if ids:
            yield batch_of(_PACKED, [(lengths[0], np.array(ids, np.int64).tobytes(), b"".join(data))])

    return run


def _number_type(most: int, width: int):
    """In which numbers inner products are exact."""
    bound = width * most * most
    return np.float64 if bound < 1 << 53 else np.int64 if bound < 1 << 63 else object


class _Best:
    """The k best items so far of each query of a block."""

    def __init__(self, ids: np.ndarray, k: int):
        self.ids, self.k = ids, k
        self.query, self.item, self.score = (np.zeros(0, np.int64) for _ in range(3))
        self.least = np.full(len(ids), -np.inf)  # the k-th score of each query

    def add(self, query: np.ndarray, item: np.ndarray, score: np.ndarray) -> None:
        query, item, score = (np.concatenate(p) for p in ((self.query, query), (self.item, item), (self.score, score)))
        order = np.lexsort((item, ~score, query))
        query, item, score = query[order], item[order], score[order]
        start = np.searchsorted(query, np.arange(len(self.ids)))
        keep = np.arange(len(query)) - start[query] < self.k
        self.query, self.item, self.score = query[keep], item[keep], score[keep]
        full = np.flatnonzero(np.bincount(self.query, minlength=len(self.ids)) == self.k)
        last = np.searchsorted(self.query, full, "right") - 1
        self.least[full] = self.score[last]


def _search(rotation: np.ndarray, terms: int, kind: str, most: int, k: int):
    """Streams of (block of queries, then item blocks by falling length), one after the other."""
    width = len(rotation)
    number = _number_type(most, width)
    exact = lambda m: m.astype(number)

    def parts(x):
        turned = x.astype(np.float64) @ rotation
        return turned[:, :terms], np.sqrt((turned[:, terms:] ** 2).sum(1))

    def scores(a, b):
        s = exact(a) @ exact(b).T
        return np.clip(s, -(1 << 63), (1 << 63) - 1).astype(np.int64) if number is object else s.astype(np.int64)

    def compare(best, some, q, q_parts, items, x, x_parts, slack):
        """All pairs of some queries and one block of items whose bound reaches the queries' k-th score."""
        bound = q_parts[0][some] @ x_parts[0].T + np.outer(q_parts[1][some], x_parts[1])
        reach = bound >= (best.least[some] - slack[some])[:, None]
        reach &= best.ids[some][:, None] != items
        if reach.mean() > 0.05:  # the product of the matrices is cheaper than many single ones
            s = scores(q[some], x)
            kept = min(k, s.shape[1])
            floor = np.partition(np.where(reach, s, np.iinfo(np.int64).min), -kept, axis=1)[:, -kept]
            at, item = np.nonzero(reach & (s >= np.maximum(floor.astype(np.float64), best.least[some] if number is np.float64 else -np.inf)[:, None]))
            found = s[at, item]
        else:
            at, item = np.nonzero(reach)
            found = np.concatenate([np.zeros(0, np.int64), *(pairwise(q[some][at[i : i + 65536]], x[item[i : i + 65536]]) for i in range(0, len(at), 65536))])
        if len(at):
            best.add(some[at], items[item], found)

    def pairwise(a, b):
        s = (exact(a) * exact(b)).sum(1)
        return np.clip(s, -(1 << 63), (1 << 63) - 1).astype(np.int64) if number is object else s.astype(np.int64)

    def finish(block, best):
        order = np.arange(len(best.query))
        for i in range(0, len(order), 50_000):
            at = order[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), block)), pa.array(best.query[at].astype(np.int32)), pa.array(best.ids[best.query[at]]), pa.array(best.item[at]), pa.array(best.score[at])], schema=_FOUND)

    def run(batches):
        key = best = None
        for batch in batches:
            for block, stripe, is_item, top, ids, data in zip(*(batch.column(c).to_pylist() for c in ("block", "stripe", "is_item", "top", "ids", "data"))):
                ids = np.frombuffer(ids, np.int64)
                x = np.frombuffer(data, kind).reshape(len(ids), width)
                if not is_item:
                    if best:
                        yield from finish(key, best)
                    key, best, q, q_parts, done = block, _Best(ids, k), x, parts(x), False
                    length = np.linalg.norm(x.astype(np.float64), axis=1)
                    continue
                slack = 1e-9 * length * top + 1e-6  # far more than rounding can be
                alive = np.flatnonzero(length * top >= best.least - slack) if not done else ()
                done = done or not len(alive)  # no later block is longer
                if not done:
                    x_parts = parts(x)
                    for i in range(0, len(alive), AT_ONCE):
                        compare(best, alive[i : i + AT_ONCE], q, q_parts, ids, x, x_parts, slack)
        if best:
            yield from finish(key, best)
        K.release()

    return run


def top_k(vectors: DataFrame, asked: Column, k: int = BEST) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row of ``vectors(vec_id, embedding)`` for which ``asked`` holds, the
    ``k`` rows of other ids with the highest inner product (all, if they are fewer), ties to smaller ``vec_id``.

    Components are scaled to floor(256 * x); scores are exact (long; beyond its range they stay at its border). Null
    vectors, vectors with null or non-finite entries, and rows without an id take no part; shorter vectors, empty ones
    included, count as filled up with zeros. Rows that share an id are no partners of each other; a repeated row is asked
    and found as often as it occurs. Other columns are not looked at; an empty table gives no rows. Texts do not occur.
    Equal vectors in any number only tie. Nothing is broadcast but the rotation (d x d, d at most ``MOST_DIMS``).
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), asked.alias("asked"), "embedding").where("id IS NOT NULL")
    width, most, n, n_asked = rows.mapInArrow(_measure, "width long, most long, n long, asked long").agg(F.max("width"), F.max("most"), F.sum("n"), F.sum("asked")).first()
    if not n_asked or n < 2:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if width > MOST_DIMS:
        raise ValueError(f"vectors of at most {MOST_DIMS} entries are supported")
    width = max(width, 1)
    kind = "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8"
    energy, rotation = np.linalg.eigh(tiled_product(rows.select("embedding"), _matrix(width, kind), kind, np.zeros(width)))
    energy, rotation = np.maximum(energy[::-1], 0.0), rotation[:, ::-1]
    terms = min(width, int(np.searchsorted(np.cumsum(energy), ENERGY * energy.sum())) + 1)

    named = rows.mapInArrow(_lengths(width, kind), "id long, asked boolean, length double, data binary")
    parts = max(buckets(spark), -(-n // (16 * ITEMS)))
    items = written(named.select("id", "length", "data").repartitionByRange(parts, F.desc("length"), "id").sortWithinPartitions(F.desc("length"), "id").mapInArrow(_pack(ITEMS), _ITEM))
    blocks = -(-n_asked // QUERIES)
    dealt = named.where("asked").select("id", "length", "data", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)).alias("part"))
    # blocks may hold somewhat more or fewer than QUERIES rows; the packing cuts those that hold more
    asked_blocks = written(dealt.repartition(max(1, min(blocks, 10_000)), "part").sortWithinPartitions("part").mapInArrow(_pack(QUERIES, "part"), _ITEM).withColumn("block", F.monotonically_increasing_id()))
    n_blocks, n_items = asked_blocks.count(), items.count()
    stripes = max(-(-n // STRIPE), min(-(-buckets(spark) // n_blocks), -(-n_items // 4)))
    numbers = written(asked_blocks.select("block").withColumn("number", F.row_number().over(Window.orderBy("block")) - 1))  # one row for each block

    every = F.explode(F.sequence(F.lit(0), F.lit(stripes - 1)))
    ask = asked_blocks.join(numbers, "block").select(F.col("number").cast("long").alias("block"), every.alias("stripe"), F.lit(False).alias("is_item"), "top", "ids", "data")
    give = items.withColumn("stripe", F.pmod(F.xxhash64("top", "ids"), F.lit(stripes)).cast("int")).select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))).alias("block"), "stripe", F.lit(True).alias("is_item"), "top", "ids", "data")
    met = ask.union(give).repartitionById(n_blocks * stripes, (F.col("block") * stripes + F.col("stripe")).cast("int")).sortWithinPartitions("block", "stripe", "is_item", F.desc("top"))
    found = met.mapInArrow(_search(rotation, terms, kind, most, k), "block long, at int, query_id long, vec_id long, score long")
    best = Window.partitionBy("block", "at").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: The same in SQL.
SQL = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda c: floor({SCALE} * c::DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND NOT list_contains(list_transform(embedding, lambda c: coalesce(isfinite(c), false)), false)
), s AS (
  SELECT q.vec_id AS query_id, v.vec_id, list_dot_product(q.x, v.x)::BIGINT AS score FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {BEST}
"""
