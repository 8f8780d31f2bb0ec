"""Mixing sources to target weights by iterative proportional fitting, with DataFrame functions only.

Documents are summed into cells (source, language, topic). The cells' token weights are raked to the three
target marginals in turn; a common scale, found by fixed-point steps, turns weights into probabilities of at
most one whose expected tokens meet the budget; each document is drawn by a hash of its id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import held, join_small, let_go, written

DIMS = ("source", "lang", "topic")
WORD = r"[^\x20\x09-\x0D]+"
ROUNDS, SCALES = 8, 16
BUDGET, TEMPER, SEED = 0.8, 0.7, "mix"
SMALL_CELLS = 200_000


def default_topic(text: Column) -> Column:
    """A coarse kind of text where the table names no topic."""
    text = F.coalesce(text, F.lit(""))
    n = F.length(text)
    symbols = n - F.length(F.translate(text, "#*$%&|<>", ""))
    digits = n - F.length(F.translate(text, "0123456789", ""))
    return F.when(n == 0, "empty").when(symbols * 20 > n, "symbols").when(digits * 50 > n, "numbers").when(n < 600, "short").when(n >= 6000, "long").otherwise("prose")


def keys(topic: Column | None = None) -> list[Column]:
    """The cell keys ``__source, __lang, __topic`` of a document; a null value is a category of its own."""
    topic = default_topic(F.col("text").cast("string")) if topic is None else topic
    return [*(F.coalesce(F.col(d).cast("string"), F.lit("")).alias(f"__{d}") for d in DIMS[:2]), F.coalesce(topic, F.lit("")).alias("__topic")]


def n_tokens() -> Column:
    return F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("n_tokens")


def draw(seed: str = SEED) -> Column:
    """A number in [0, 1) from the document's id."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def calibrated(cells: DataFrame, targets: dict[str, dict[str, float]] | None = None, budget: float = BUDGET, temper: float = TEMPER, rounds: int = ROUNDS) -> DataFrame:
    """``cells(__source, __lang, __topic, tokens)`` -> with ``weight`` (raked share) and ``p`` (probability).

    ``targets[dim][value]`` are the wanted shares of a marginal; values without one get none, and shares are
    scaled to those that occur. A marginal without targets is its own token share to the power ``temper``.
    """
    whole = Window.partitionBy(F.lit(1))
    cells = written(cells.where("tokens > 0"))
    if cells.limit(SMALL_CELLS + 1).count() <= SMALL_CELLS:
        cells = cells.coalesce(1)  # so that no window below has to shuffle
    w = cells.withColumn("weight", F.col("tokens") / F.sum("tokens").over(whole))
    for d in DIMS:
        own = Window.partitionBy(f"__{d}")
        wanted = (targets or {}).get(d)
        if wanted is None:
            share = F.pow(F.sum("tokens").over(own).cast("double"), F.lit(temper))
        else:
            share = F.coalesce(F.create_map(*[F.lit(x) for kv in wanted.items() for x in (kv[0], float(kv[1]))])[F.col(f"__{d}")], F.lit(0.0))
        # each row carries its value's share; a value's rows count once
        w = w.withColumn(f"t_{d}", share).withColumn("n_", F.count("*").over(own))
        w = w.withColumn(f"t_{d}", F.col(f"t_{d}") / F.sum(F.col(f"t_{d}") / F.col("n_")).over(whole)).drop("n_")
    for _ in range(rounds):
        for d in DIMS:
            have = F.sum("weight").over(Window.partitionBy(f"__{d}"))
            w = w.withColumn("weight", F.when(have > 0, F.col("weight") * F.col(f"t_{d}") / have).otherwise(0.0))
    w = w.withColumn("weight", F.col("weight") / F.sum("weight").over(whole)).withColumn("goal", F.sum("tokens").over(whole) * F.lit(budget)).withColumn("scale", F.col("goal"))
    for _ in range(SCALES):
        w = w.withColumn("scale", F.col("scale") * F.col("goal") / F.sum(F.least(F.col("tokens").cast("double"), F.col("scale") * F.col("weight"))).over(whole))
    return w.select(*(f"__{d}" for d in DIMS), "tokens", F.round("weight", 9).alias("weight"), F.round(F.least(F.lit(1.0), F.col("scale") * F.col("weight") / F.col("tokens")), 9).alias("p"))


def _cells(docs: DataFrame) -> DataFrame:
    return docs.groupBy(*(f"__{d}" for d in DIMS)).agg(F.sum("n_tokens").alias("tokens"))


def _joined(rows: DataFrame, cells: DataFrame) -> DataFrame:
    on = [f"__{d}" for d in DIMS]
    return join_small(rows, cells.select(*on, F.col("weight").alias("__weight"), F.col("p").alias("__p")), on, "left")


def mix_sources(docs: DataFrame, topic: Column | None = None, **how) -> DataFrame:
    """One row per row of ``docs(doc_id, text, source, lang, ...)``: ``doc_id, source, lang, topic, n_tokens``,
    ``cell_weight`` (the cell's raked share of the tokens), ``p`` (its documents' probability), ``sampled``.

    Null text: no tokens, probability 0 (as for any text without a word whose cell has no token). Null source,
    language or topic: shown as an empty string and raked as a category. Repeated ids are drawn alike; other
    columns are ignored; an empty table gives an empty result.
    """
    rows = written(docs.select("doc_id", *keys(topic), n_tokens()))
    p = F.coalesce("__p", F.lit(0.0))
    return _joined(rows, calibrated(_cells(rows), **how)).select("doc_id", *(F.col(f"__{d}").alias(d) for d in DIMS), "n_tokens", F.coalesce("__weight", F.lit(0.0)).alias("cell_weight"), p.alias("p"), (draw() < p).alias("sampled"))


def sample(docs: DataFrame, topic: Column | None = None, **how) -> DataFrame:
    """The rows that ``mix_sources`` samples, with their columns (of any name) as they are; texts are not shuffled."""
    p = calibrated(_cells(docs.select(*keys(topic), n_tokens())), **how)
    rows = held(docs, *keys(topic), draw().alias("__draw"))
    return let_go(_joined(rows, p).where(F.col("__draw") < F.coalesce("__p", F.lit(0.0))))


def _sql() -> str:
    key = "source, lang, topic"
    steps = []
    share = ", ".join(f"pow(sum(tokens) OVER (PARTITION BY {d})::DOUBLE, {TEMPER}) AS r_{d}, count(*) OVER (PARTITION BY {d}) AS n_{d}" for d in DIMS)
    steps.append(f"c0 AS (SELECT {key}, tokens, tokens / sum(tokens) OVER () AS weight, {share} FROM cells WHERE tokens > 0)")
    steps.append(f"w0 AS (SELECT {key}, tokens, weight, {', '.join(f'r_{d} / sum(r_{d} / n_{d}) OVER () AS t_{d}' for d in DIMS)} FROM c0)")
    k = 0
    for _ in range(ROUNDS):
        for d in DIMS:
            steps.append(f"w{k + 1} AS (SELECT {key}, tokens, weight * t_{d} / sum(weight) OVER (PARTITION BY {d}) AS weight, {', '.join(f't_{x}' for x in DIMS)} FROM w{k})")
            k += 1
    steps.append(f"s0 AS (SELECT {key}, tokens, weight / sum(weight) OVER () AS weight, sum(tokens) OVER () * {BUDGET} AS goal, sum(tokens) OVER () * {BUDGET} AS scale FROM w{k})")
    for i in range(SCALES):
        steps.append(f"s{i + 1} AS (SELECT {key}, tokens, weight, goal, scale * goal / sum(least(tokens::DOUBLE, scale * weight)) OVER () AS scale FROM s{i})")
    steps.append(f"cal AS (SELECT {key}, round(weight, 9) AS weight, round(least(1.0, scale * weight / tokens), 9) AS p FROM s{SCALES})")
    return ",\n".join(steps)


#: d: documents with cell keys; cal: calibrated cells
SQL = (
    r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, CASE
    WHEN n = 0 THEN 'empty' WHEN s * 20 > n THEN 'symbols' WHEN g * 50 > n THEN 'numbers'
    WHEN n < 600 THEN 'short' WHEN n >= 6000 THEN 'long' ELSE 'prose' END AS topic, n_tokens
  FROM (SELECT *, length(t) AS n, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS s,
          length(t) - length(regexp_replace(t, '[0-9]', '', 'g')) AS g,
          len(regexp_extract_all(t, '[^\x20\x09-\x0D]+'))::BIGINT AS n_tokens
        FROM (SELECT *, coalesce(text, '') AS t FROM documents))
), cells AS (SELECT source, lang, topic, sum(n_tokens)::BIGINT AS tokens FROM d GROUP BY ALL),
"""
    + _sql()
    + f"""
SELECT doc_id, d.source, d.lang, d.topic, n_tokens, coalesce(weight, 0.0) AS cell_weight, coalesce(p, 0.0) AS p,
  ('0x' || substr(md5('{SEED}|' || doc_id), 1, 8))::BIGINT / 4294967296.0 < coalesce(p, 0.0) AS sampled
FROM d LEFT JOIN cal ON d.source = cal.source AND d.lang = cal.lang AND d.topic = cal.topic
"""
)
