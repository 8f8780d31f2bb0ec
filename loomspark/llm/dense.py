"""Dense vectors inside Arrow tasks, and products of matrices whose rows are dealt over all tasks.

A product of all rows with themselves is worked out by tiles: every task cuts its rows into row blocks and their
columns into column blocks; a pair of column blocks of one row block meets in one task, which multiplies it and adds up
its tiles; the tiles of all tasks are added by their place. Only the finished matrix (its size is the dimension squared)
comes to the driver.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from . import kernel as K

#: Widest vectors: a matrix of this width squared is assembled on the driver (128 MB).
MOST_DIMS = 4096
TILE, ROWS = 32, 4096


def usable(col: pa.Array, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors are not null and hold finite entries only, and those vectors as a float64 matrix; shorter ones are
    filled up with zeros to ``width`` (default: the longest of the batch)."""
    size = pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ok = pc.is_valid(col).to_numpy(zero_copy_only=False).copy()
    size[~ok] = 0
    values = np.asarray(col.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False), np.float64)  # a null becomes NaN
    row = np.repeat(np.arange(len(size)), size)
    ok[row[~np.isfinite(values)]] = False
    width = int(size[ok].max(initial=0)) if width is None else width
    out = np.zeros((len(size), width))
    good = ok[row]
    place = np.arange(len(values)) - np.repeat(np.cumsum(size) - size, size)
    out[row[good], place[good]] = values[good]
    return ok, out[ok]


def scaled(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * value) as int64; what lies beyond 2**52 stays at that bound."""
    return np.clip(np.floor(scale * values), -(2.0**52), 2.0**52).astype(np.int64)


def batch_of(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)


_BLOCK = pa.schema([("block", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("side", pa.int32()), ("data", pa.binary())])
_TILES = pa.schema([("i", pa.int32()), ("j", pa.int32()), ("data", pa.binary())])


def _column_blocks(matrix_of: Callable[[pa.RecordBatch], np.ndarray], tile: int, rows: int):
    def run(batches):
        task, k = TaskContext.get().partitionId(), 0
        for batch in batches:
            m = matrix_of(batch)
            for at in range(0, len(m), rows):
                piece, k = m[at : at + rows], k + 1
                cuts = [piece[:, c : c + tile].tobytes() for c in range(0, m.shape[1], tile)]
                for i, j in combinations_with_replacement(range(len(cuts)), 2):
                    for side, c in ((0, i), (1, j))[: 1 + (i < j)]:
                        yield batch_of(_BLOCK, [((task << 32) + k, i, j, side, cuts[c])])

    return run


def _multiply(kind: str, centre: np.ndarray, tile: int):
    """Adds up the products of one task; rows come sorted by block, tile and side."""

    def run(batches):
        sums: dict[tuple[int, int], np.ndarray] = {}
        left = None
        for batch in batches:
            for i, j, side, data in zip(*(batch.column(c).to_pylist() for c in range(1, 4)), batch.column(4)):
                c = centre[tile * (j if side else i) :][:tile]
                m = np.frombuffer(data.as_buffer(), kind).reshape(-1, len(c)) - c
                if i == j or side:
                    part = (m if i == j else left).T @ m
                    sums[i, j] = sums[i, j] + part if (i, j) in sums else part
                else:
                    left = m
        for (i, j), s in sums.items():
            yield batch_of(_TILES, [(i, j, s.tobytes())])
        K.release()

    return run


def _add_up(batches):
    sums: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for i, j, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            part = np.frombuffer(data.as_buffer())
            sums[i, j] = sums[i, j] + part if (i, j) in sums else part
    for (i, j), s in sums.items():
        yield batch_of(_TILES, [(i, j, s.tobytes())])


def tiled_product(df: DataFrame, matrix_of: Callable[[pa.RecordBatch], np.ndarray], kind: str, centre: np.ndarray, tile: int = TILE, rows: int = ROWS) -> np.ndarray:
    """The sum of (r - centre)(r - centre)' over all rows r that ``matrix_of`` makes of the batches of ``df``: matrices
    of ``len(centre)`` columns and of number type ``kind``. Rows are centred before they are multiplied."""
    d = len(centre)
    blocks = df.mapInArrow(_column_blocks(matrix_of, tile, rows), "block long, i int, j int, side int, data binary")
    met = blocks.repartition("block", "i", "j").sortWithinPartitions("block", "i", "j", "side")
    tiles = met.mapInArrow(_multiply(kind, np.asarray(centre, np.float64), tile), "i int, j int, data binary")
    out = np.zeros((d, d))
    for i, j, data in tiles.repartition("i", "j").mapInArrow(_add_up, "i int, j int, data binary").collect():
        rows_, cols = range(d)[i * tile : (i + 1) * tile], range(d)[j * tile : (j + 1) * tile]
        part = np.frombuffer(data).reshape(len(rows_), len(cols))
        out[np.ix_(rows_, cols)], out[np.ix_(cols, rows_)] = part, part.T
    return out
