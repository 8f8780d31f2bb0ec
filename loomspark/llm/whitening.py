"""Whitening of embeddings by their principal components, from a covariance that is worked out by tiles."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .dense import MOST_DIMS, batch_of, scaled, tiled_product, usable

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 32
#: Components whose variance is a smaller share of the largest one are rounding noise and have no whitened values.
NOISE = 1e-12

_SUMS = pa.schema([("dim", pa.int32()), ("n", pa.int64()), ("total", pa.decimal128(38, 0)), ("low", pa.int64()), ("high", pa.int64())])


@dataclass
class Space:
    """A fitted whitening: ``n`` vectors with sums ``sums`` (exact), variances by falling size, unit components."""

    n: int
    sums: list[int]
    low: int
    high: int
    trace: float = 0.0
    variances: np.ndarray = None
    components: np.ndarray = None

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - sums, exactly."""
        big = self.n * max(abs(self.low), abs(self.high), 1) >= 1 << 61
        return x.astype(object) * self.n - np.array(self.sums, object) if big else x * self.n - np.array(self.sums, np.int64)


def whole(batch: pa.RecordBatch, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Which rows take part, and their vectors in whole numbers."""
    ok, values = usable(batch.column("embedding"), width)
    return ok, scaled(values, SCALE) + SHIFT


def _sums(batches):
    """Of one task: count, sum and extremes by dimension; dimension -1 counts the rows."""
    n, found = 0, {}
    for batch in batches:
        ok, x = whole(batch)
        n += len(x)
        for dim in range(x.shape[1]):
            _, total, low, high = found.get(dim, (0, 0, SHIFT, SHIFT))
            c = x[:, dim]
            found[dim] = (dim, total + int(c.sum()) - SHIFT * len(c), min(low, int(c.min(initial=low))), max(high, int(c.max(initial=high))))
    rows = [(-1, n, Decimal(0), SHIFT, SHIFT), *((dim, 0, Decimal(total), low, high) for dim, total, low, high in found.values())]
    yield batch_of(_SUMS, rows)


def _totals(vectors: DataFrame) -> Space:
    """Counts and exact sums; a missing entry counts as zero, which is SHIFT in whole numbers."""
    sums = vectors.mapInArrow(_sums, "dim int, n long, total decimal(38,0), low long, high long")
    rows = sums.groupBy("dim").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("low").alias("low"), F.max("high").alias("high")).orderBy("dim").limit(MOST_DIMS + 2).collect()
    if len(rows) > MOST_DIMS + 1:
        raise ValueError(f"vectors of at most {MOST_DIMS} entries are supported")
    n = rows[0].n if rows else 0
    return Space(n, [int(r.total) + SHIFT * n for r in rows[1:]], min([SHIFT, *(r.low for r in rows)]), max([SHIFT, *(r.high for r in rows)]))


def fit(vectors: DataFrame) -> Space:
    """Principal components of ``vectors(embedding)``: all rows count, the d x d covariance is decomposed on the driver."""
    s = _totals(vectors)
    d = len(s.sums)
    if not s.n or not d:
        return Space(s.n, s.sums, s.low, s.high, 0.0, np.zeros(0), np.zeros((d, 0)))
    near = [round(t / s.n) for t in s.sums]  # whole numbers near the means, so that what is shuffled is small
    kind = "<i4" if max(abs(s.high - min(near)), abs(max(near) - s.low)) < 1 << 31 else "<i8"
    rest = np.array([(t - m * s.n) / s.n for t, m in zip(s.sums, near)])
    base = np.array(near, np.int64)
    covariance = tiled_product(vectors, lambda batch: (whole(batch, d)[1] - base).astype(kind), kind, rest) / s.n
    e, u = np.linalg.eigh(covariance)
    e, u = e[::-1], u[:, ::-1]
    u = u * np.where(u[np.abs(u).argmax(0), range(d)] < 0, -1.0, 1.0)
    keep = e > NOISE * max(e[0], 0.0)
    return Space(s.n, s.sums, s.low, s.high, float(np.trace(covariance)), e[keep], u[:, keep])


def _project(space: Space, k: int):
    """``vec_id, deviation, whitened`` of each row that takes part."""
    weights = space.components[:, :k] / np.sqrt(space.variances[:k])

    def run(batches):
        for batch in batches:
            ok, x = whole(batch, len(space.sums))
            m = space.centred(x)
            big = int(np.abs(m).max(initial=0))
            if big * big * max(m.shape[1], 1) >= 1 << 63:
                exact = [int(v) for v in (m.astype(object) ** 2).sum(1)]
                deviation = pa.array([v if v < 1 << 63 else None for v in exact], pa.int64())
            else:
                deviation = pa.array((m**2).sum(1).astype(np.int64))
            white = (m / space.n).astype(np.float64) @ weights
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, white.size + 1, k, dtype=np.int32)), pa.array(white.ravel()))
            ids = batch.column("vec_id").filter(pa.array(ok))
            yield from K.sliced(pa.RecordBatch.from_arrays([ids, deviation, lists], ["vec_id", "deviation", "whitened"]))

    return run


def _stacked(width: int):
    return lambda batch: batch.column("whitened").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def identity_error(white: DataFrame, n: int, k: int) -> float:
    """Largest absolute entry of the covariance of ``white(whitened)`` minus the identity."""
    means = {r.pos: r.mean for r in white.select(F.posexplode("whitened")).groupBy("pos").agg(F.avg("col").alias("mean")).collect()}  # k rows
    covariance = tiled_product(white.select("whitened"), _stacked(k), "<f8", np.array([means.get(i, 0.0) for i in range(k)])) / n
    return float(np.abs(covariance - np.eye(k)).max())


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error``: a row for each row of
    ``vectors(vec_id, embedding)`` and each of the first ``components`` principal components.

    Rows whose vector is null or holds null or non-finite entries are dropped and not fitted. Vectors shorter than the
    longest one, empty ones included, count as filled up with zeros; scaled entries beyond 2**52 stay at that bound. A
    null id stays null, repeated rows count each, equal variances are in any order, and other columns are not looked
    at. Components without variance (``NOISE``) cannot be whitened and give no rows: none at all for an empty table, for
    one row, or for equal rows. A deviation that does not fit a long is null. Only d and d x d numbers come to the
    driver or go to the tasks, d at most ``MOST_DIMS``.
    """
    vectors = vectors.select("vec_id", "embedding")
    space = fit(vectors.select("embedding"))
    k = min(components, len(space.variances))
    id_type = vectors.schema["vec_id"].dataType.simpleString()
    out = "vec_id {}, component int, n long, deviation long, whitened double, explained double, identity_error double".format(id_type)
    if not k:
        return vectors.sparkSession.createDataFrame([], out)
    white = vectors.mapInArrow(_project(space, k), f"vec_id {id_type}, deviation long, whitened array<double>")
    error = identity_error(white, space.n, k)
    shares = F.array(*(F.lit(float(e / space.trace)) for e in space.variances[:k]))
    rows = white.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return rows.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(space.n).cast("long").alias("n"), "deviation", "whitened", shares[F.col("at")].alias("explained"), F.lit(error).alias("identity_error"))
