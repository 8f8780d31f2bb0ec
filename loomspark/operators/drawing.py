"""Drawing mixes of taxonomy leaves, by rejection in rounds."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import hash_unit
from ..sources.shared import written
from .rules import forbidden
from .taxonomy import leaves

ATTEMPTS = 50


@dataclass(frozen=True)
class Strategy:
    """Factors that are drawn together, how often, and pairs of labels that must not meet."""

    name: str
    weight: float
    factors: tuple[str, ...]
    forbidden: tuple[tuple[str, str], ...] = ()


def _by_strategy(strategies: list[Strategy], of) -> Column:
    """A column chosen by the number of the strategy."""
    out = F.when(F.col("__s") == 0, of(strategies[0]))
    for i, s in enumerate(strategies[1:], 1):
        out = out.when(F.col("__s") == i, of(s))
    return out


def mixes(ids: DataFrame, nodes: DataFrame, strategies: list[Strategy], seed: str = "42", attempts: int = ATTEMPTS) -> DataFrame:
    """``ids(mix_id)`` (distinct, not null) and a taxonomy -> ``mix_id, strategy, attempt, entries``: for each id a
    strategy by weight and one leaf of each of its factors, none of its forbidden pairs of labels among them.

    Every draw is a hash of the seed, the id, the attempt and the factor, and so does not depend on partitions. An
    attempt is a join of the drawn places with the numbered leaves; only ids whose labels are forbidden go on to the next
    one. An unknown factor, weights without a positive sum, or an id that no attempt suits, is an error.
    """
    total = sum(s.weight for s in strategies)
    if not strategies or total <= 0:
        raise ValueError("strategies need weights of a positive sum")
    wanted = sorted({f for s in strategies for f in s.factors})
    numbered = leaves(nodes.where(F.col("factor_id").isin(wanted))).select("factor_id", "node_id", "label", (F.row_number().over(Window.partitionBy("factor_id").orderBy("node_id")) - 1).alias("__place"))
    numbered = written(numbered)
    sizes = {r.factor_id: r.n for r in numbered.groupBy("factor_id").agg(F.count("*").alias("n")).collect()}  # one for each factor of the strategies
    if missing := [f for f in wanted if f not in sizes]:
        raise ValueError(f"unknown factors, or factors without a leaf: {', '.join(missing)}")
    at, up = hash_unit(f"{seed}|strategy", F.col("mix_id")) * F.lit(float(total)), 0.0
    number = F.lit(len(strategies) - 1)
    for i in reversed(range(len(strategies) - 1)):
        up = sum(s.weight for s in strategies[: i + 1])
        number = F.when(at < up, F.lit(i)).otherwise(number)
    left = ids.select("mix_id", number.alias("__s"))
    size = F.create_map(*(F.lit(x) for kv in sizes.items() for x in kv))
    factors = _by_strategy(strategies, lambda s: F.array(*map(F.lit, s.factors)))
    banned = _by_strategy(strategies, lambda s: forbidden(F.transform("entries", lambda e: e["label"]), list(s.forbidden)))
    name = _by_strategy(strategies, lambda s: F.lit(s.name))
    out = None
    for attempt in range(attempts):
        drawn = left.select("mix_id", "__s", F.posexplode(factors).alias("__k", "factor_id"))
        u = hash_unit(f"{seed}|{attempt}", F.concat_ws("|", F.col("mix_id").cast("string"), "factor_id"))
        placed = drawn.withColumn("__place", F.least(F.floor(u * size[F.col("factor_id")]), size[F.col("factor_id")] - 1).cast("int"))
        met = placed.join(numbered, ["factor_id", "__place"]).groupBy("mix_id", "__s")
        # as many entries as the strategy has factors
        entries = met.agg(F.array_sort(F.collect_list(F.struct("__k", "factor_id", "node_id", "label"))).alias("entries"))
        tried = written(entries.withColumn("entries", F.transform("entries", lambda e: F.struct(e["factor_id"].alias("factor_id"), e["node_id"].alias("node_id"), e["label"].alias("label")))).withColumn("__bad", banned))
        good = tried.where("NOT __bad").select("mix_id", name.alias("strategy"), F.lit(attempt).alias("attempt"), "entries")
        out = good if out is None else out.union(good)
        left = tried.where("__bad").select("mix_id", "__s")
        if left.isEmpty():
            return out
    raise RuntimeError(f"no attempt of {attempts} suits {left.count()} ids")


def one_scenario(metas: DataFrame, seed: str = "42") -> DataFrame:
    """``metas(mix_id, meta_id, text)`` -> one row for each mix, chosen by a hash; summed before anything is shuffled, so
    a mix may have any number of them."""
    key = F.struct(hash_unit(seed, F.concat_ws("|", F.col("mix_id").cast("string"), F.col("meta_id").cast("string"))), "meta_id")
    return metas.groupBy("mix_id").agg(F.min_by(F.struct("meta_id", "text"), key).alias("x")).select("mix_id", "x.*")
