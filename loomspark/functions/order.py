"""Running sums and neighbours in the order of an integer key, without one task that sees all rows.

Keys are cut into equal-width ranges; each range is a window partition of its own, and what passes from range to
range is a table of at most RANGES rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written

RANGES = 1024


def _ranged(df: DataFrame, key: str) -> DataFrame:
    lim = df.agg(F.min(key).alias("__lo"), F.max(key).alias("__hi"))
    width = F.greatest(F.ceil((F.col("__hi") - F.col("__lo") + 1) / RANGES), F.lit(1))
    return df.join(F.broadcast(lim)).withColumn("__r", F.floor((F.col(key) - F.col("__lo")) / width)).drop("__lo", "__hi")


def running_sum_before(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """Adds the sum of ``value`` over all rows of smaller ``key``; keys are distinct."""
    d = _ranged(df, key)
    sums = d.groupBy("__r").agg(F.sum(value).alias("__s"))
    before = sums.select("__r", F.coalesce(F.sum("__s").over(Window.orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__b"))
    own = F.coalesce(F.sum(value).over(Window.partitionBy("__r").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return d.withColumn("__o", own).join(F.broadcast(before), "__r").withColumn(name, F.col("__o") + F.col("__b")).drop("__r", "__o", "__b")


def next_value(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """Adds the ``value`` of the next larger ``key`` (null at the last); keys are distinct, values not null."""
    d = _ranged(df, key)
    first = d.groupBy("__r").agg(F.min_by(value, key).alias("__f"))
    following = first.select("__r", F.lead("__f").over(Window.orderBy("__r")).alias("__n"))
    inside = F.lead(value).over(Window.partitionBy("__r").orderBy(key))
    return d.withColumn("__i", inside).join(F.broadcast(following), "__r").withColumn(name, F.coalesce("__i", "__n")).drop("__r", "__i", "__n")


# ---- running values by key, for keys of any size

#: Rows of one key that one task may sort and scan by a plain window; larger keys go by blocks.
ONE_TASK = 1_000_000
#: Blocks for each partition of a shuffle: so many small ones even out.
BLOCKS = 4


def largest_key(df: DataFrame, keys: list[str]) -> int:
    """Rows of the most frequent key."""
    return df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0


def _blocks(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The rows in ranges of (keys, order), numbered by ``__block`` and written, as the ranges are sampled anew each time;
    a key with many rows lies in many neighbouring blocks."""
    parts = BLOCKS * max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return written(df.repartitionByRange(parts, *keys, *order).withColumn("__block", F.spark_partition_id()))


def _on(keys: list[str]) -> Column:
    """Equal keys, nulls too, of the sides ``a`` and ``b``."""
    return reduce(lambda x, y: x & y, (F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys))


def running_sums(df: DataFrame, keys: list[str], order: list[str], values: dict[str, Column], one_task: int = ONE_TASK) -> DataFrame:
    """Adds under each name the sum of a value over all rows of the same keys up to this one; null values count as
    nothing; ``order`` is distinct within a key.

    A key of more than ``one_task`` rows is summed by blocks: sums inside each block, and before it the sums of the
    blocks before (a row for each block and key). The result is the same, up to the rounding of other orders of adding.
    """
    d = df.withColumns({f"__v_{n}": c for n, c in values.items()})
    up = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    if largest_key(df, keys) <= one_task:
        return d.withColumns({n: F.coalesce(F.sum(f"__v_{n}").over(up), F.lit(0)) for n in values}).drop(*(f"__v_{n}" for n in values))
    d = _blocks(d, keys, order)
    inside = Window.partitionBy("__block", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    own = d.withColumns({f"__s_{n}": F.coalesce(F.sum(f"__v_{n}").over(inside), F.lit(0)) for n in values})
    sums = d.groupBy("__block", *keys).agg(*(F.sum(f"__v_{n}").alias(f"__v_{n}") for n in values))
    before = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    carry = sums.select("__block", *keys, *(F.coalesce(F.sum(f"__v_{n}").over(before), F.lit(0)).alias(f"__c_{n}") for n in values))
    both = own.alias("a").join(carry.alias("b"), (F.col("a.__block") == F.col("b.__block")) & _on(keys))
    return both.select(*(F.col(f"a.`{c}`") for c in df.columns), *((F.col(f"a.__s_{n}") + F.col(f"b.__c_{n}")).alias(n) for n in values))


def rolling_mean(df: DataFrame, keys: list[str], order: list[str], value: str, rows: int, name: str, one_task: int = ONE_TASK) -> DataFrame:
    """Adds the mean of ``value`` over this row and the ``rows - 1`` before it of the same keys (fewer at their start).

    A key of more than ``one_task`` rows goes by blocks; the last rows of a block are copied to the blocks after it that
    need them: less than ``rows`` squared copies for each border between blocks.
    """
    if largest_key(df, keys) <= one_task:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-(rows - 1), 0)
        return df.withColumn(name, F.avg(value).over(w))
    d = _blocks(df, keys, order)
    inside = Window.partitionBy("__block", *keys)
    at = d.withColumn("__at", F.row_number().over(inside.orderBy(*order)) - 1).withColumn("__size", F.count(F.lit(1)).over(inside))
    by_block = Window.partitionBy(*keys).orderBy("__block")
    counts = d.groupBy("__block", *keys).agg(F.count(F.lit(1)).alias("__n"))
    counts = counts.withColumns({"__start": F.coalesce(F.sum("__n").over(by_block.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "__k": F.row_number().over(by_block)})
    last = counts.groupBy(*keys).agg(F.max("__k").alias("__last"))
    counts = counts.alias("a").join(last.alias("b"), _on(keys)).select("a.*", "b.__last")
    # the last rows of every block that is not its key's last one, and the blocks after it that may need them
    ends = at.where(F.col("__at") >= F.col("__size") - (rows - 1)).alias("a").join(counts.alias("b"), (F.col("a.__block") == F.col("b.__block")) & _on(keys)).where("b.__k < b.__last")
    to = F.explode(F.sequence(F.col("b.__k") + 1, F.least(F.col("b.__k") + (rows - 1), F.col("b.__last"))))
    sent = ends.select(*(F.col(f"a.`{c}`") for c in df.columns), (F.col("b.__start") + F.col("a.__at")).alias("__index"), to.alias("__to")) if rows > 1 else None
    whole = d.withColumn("__carried", F.lit(False))
    if sent is not None:
        met = sent.alias("a").join(counts.alias("b"), (F.col("a.__to") == F.col("b.__k")) & _on(keys)).where(f"b.__start - a.__index < {rows}")
        whole = whole.unionByName(met.select(*(F.col(f"a.`{c}`") for c in df.columns), F.col("b.__block").alias("__block"), F.lit(True).alias("__carried")))
    w = inside.orderBy(*order).rowsBetween(-(rows - 1), 0)
    return whole.withColumn(name, F.avg(value).over(w)).where("NOT __carried").drop("__block", "__carried")
