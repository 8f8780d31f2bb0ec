"""Small rules on rows: gates, normal forms, retry and key-pool arithmetic, grids. All are column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import hash_unit, strip

# Fixed values that results must share with other producers of such data
DIFFICULTIES = ("easy", "medium", "hard")
ACTIONS = ("read", "write", "mixed")
FOCUS = ("single", "chain", "branch", "recover")
RETRY_STATUS = (429, 500, 502, 503, 504)
RETRY_MARKERS = ("resource_exhausted", "rate limit", "too many requests", "temporarily unavailable", "service unavailable")


def doubly_accepted(correct: Column, incorrect: Column) -> Column:
    """One critic says correct and the other does not say incorrect."""
    return F.coalesce(correct & ~incorrect, F.lit(False))


def last_verdict(verdicts: Column) -> Column:
    """Whether the last of an array of booleans holds; none does not."""
    return F.coalesce(F.try_element_at(verdicts, F.lit(-1)), F.lit(False))


def forbidden(labels: Column, pairs: list[tuple[str, str]]) -> Column:
    """Both parts of any forbidden pair occur in the joined lower-cased labels."""
    text = F.lower(F.array_join(labels, " "))
    hit = F.lit(False)
    for a, b in pairs:
        hit = hit | (text.contains(a.lower()) & text.contains(b.lower()))
    return hit


def five_descriptions(lines: Column, width: int = 5) -> Column:
    """White space collapsed, empty and repeated lines dropped in order; null unless ``width`` are left."""
    clean = F.array_distinct(F.filter(F.transform(lines, lambda x: strip(F.regexp_replace(x, r"\s+", " "))), lambda x: x != ""))
    return F.when(F.size(clean) >= width, F.slice(clean, 1, width))


def retryable(status: Column, message: Column) -> Column:
    return F.coalesce(status.isin(*RETRY_STATUS), F.lit(False)) | F.coalesce(F.lower(message).rlike("|".join(RETRY_MARKERS)), F.lit(False))


def backoff(attempt: Column, first: float = 1.0, most: float = 60.0) -> Column:
    """Seconds before a retry, without jitter."""
    return F.least(F.lit(most), F.lit(first) * F.pow(F.lit(2.0), attempt))


def temperatures(n: int, low: float = 0.1, high: float = 0.9) -> Column:
    """n evenly spaced values, with labels."""
    step = (high - low) / max(n - 1, 1)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct(F.round(F.lit(low) + i * step, 6).alias("temperature"), F.format_string("temperature_%.2f", F.lit(low) + i * step).alias("label")))


def expected_personas(depth: Column) -> Column:
    """Sum of 5^(i+1) up to a depth."""
    return F.aggregate(F.sequence(F.lit(0), depth), F.lit(0).cast("long"), lambda s, i: s + F.pow(F.lit(5), i + 1).cast("long"))


def auto_depth(wanted: Column, most: int = 6) -> Column:
    """The depth whose expected number is closest; the lower of equals."""
    options = F.transform(F.sequence(F.lit(0), F.lit(most)), lambda d: F.struct(F.abs(expected_personas(d) - wanted).alias("gap"), d.alias("depth")))
    return F.array_min(options)["depth"]


def coerced(value: Column) -> Column:
    """Boolean, integer and decimal readings of a text, the first that fits: ``struct<kind, text>``."""
    v = F.lower(F.trim(value))
    kind = F.when(v.isin("true", "false"), "boolean").when(value.try_cast("long").isNotNull() & ~v.contains("."), "integer").when(value.try_cast("double").isNotNull(), "number").otherwise("string")
    return F.struct(kind.alias("kind"), F.when(kind == "boolean", v).otherwise(value).alias("text"))


def action_parts(text: Column) -> Column:
    """App, action and arguments of a ReAct step; an action without an app belongs to ``default_app``."""
    name = strip(F.regexp_extract(text, r"(?s)Action:\s*(.*?)(?:\n|Action Input:|$)", 1))
    args = strip(F.regexp_extract(text, r"(?s)Action Input:\s*(.*?)(?:\nObservation:|$)", 1))
    split = F.split(name, r"\.", 2)
    return F.struct(F.when(F.size(split) > 1, F.get(split, F.lit(0))).otherwise("default_app").alias("app"), F.element_at(split, -1).alias("action"), args.alias("arguments"))


def key_usage(calls: DataFrame) -> DataFrame:
    """``calls(api_key, ts, failed)``: calls of the last hour and day before the key's last call, and errors."""
    last = calls.groupBy("api_key").agg(F.max("ts").alias("last"))
    j = calls.join(last, "api_key")
    within = lambda what: F.count_if(F.col("ts") > F.col("last") - F.expr(f"INTERVAL 1 {what}"))
    return j.groupBy("api_key").agg(within("HOUR").alias("hourly"), within("DAY").alias("daily"), F.count_if("failed").alias("errors"), F.max("last").alias("last_used"))


def next_key(usage: DataFrame, hourly: int, daily: int) -> DataFrame:
    """The key used longest ago among those within their quotas."""
    return usage.where((F.col("hourly") < hourly) & (F.col("daily") < daily)).agg(F.min_by("api_key", F.struct("last_used", "hourly", "daily", "api_key")).alias("api_key"))


def job_progress(jobs: DataFrame) -> DataFrame:
    """``jobs(job_id, done, total, seconds)``: percent, rate and seconds left, to one decimal."""
    rate = F.try_divide(F.col("done"), F.col("seconds"))
    return jobs.select("job_id", F.round(F.coalesce(F.try_divide(F.col("done") * 100, F.col("total")), F.lit(0.0)), 1).alias("percent"), F.round(rate, 1).alias("rate"), F.round(F.try_divide(F.col("total") - F.col("done"), rate), 1).alias("eta"))


def task_grid(spark: SparkSession, apps: int = 3) -> DataFrame:
    """Every combination of difficulty, action, focus and number of apps: a fixed small table."""
    side = lambda name, values: F.explode(F.array(*map(F.lit, values))).alias(name)
    g = spark.range(1).select(side("difficulty", DIFFICULTIES)).select("*", side("action", ACTIONS)).select("*", side("focus", FOCUS)).select("*", side("apps", range(1, apps + 1)))
    return g.withColumn("bucket", F.row_number().over(Window.orderBy("difficulty", "action", "focus", "apps")) - 1)


def pick_bucket(tasks: DataFrame, grid: DataFrame, seed: str = "grid") -> DataFrame:
    """A bucket for each ``task_id``; the grid is a fixed table and is broadcast."""
    n = grid.count()
    return tasks.withColumn("bucket", F.floor(hash_unit(seed, F.col("task_id")) * n).cast("int")).join(F.broadcast(grid), "bucket")


def upserted(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows replace old ones of their key; of equal keys in one table the last by ``ord`` wins."""
    both = old.withColumn("__t", F.lit(0)).unionByName(new.withColumn("__t", F.lit(1)))
    w = Window.partitionBy(key).orderBy(F.desc("__t"), F.desc("ord"))
    return both.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k", "__t")


def cache_hits(requests: DataFrame, ttl_seconds: int = 3600) -> DataFrame:
    """``requests(query, ts)``: whether each would be answered from a cache filled at its last miss.

    A fill lives for the time to live, so fills follow each other; they are folded in order within one query's
    distinct times.
    """
    t = F.unix_seconds(F.col("ts").cast("timestamp"))
    g = requests.groupBy("query").agg(F.array_sort(F.collect_set(t)).alias("times"))
    none = F.array().cast("array<bigint>")
    fills = F.aggregate("times", none, lambda acc, x: F.when((F.size(acc) == 0) | (x - F.try_element_at(acc, F.lit(-1)) >= ttl_seconds), F.concat(acc, F.array(x))).otherwise(acc))
    first = F.row_number().over(Window.partitionBy("query", "ts").orderBy("request_id")) == 1
    return requests.join(g.select("query", fills.alias("fills")), "query").select("request_id", "query", (~(F.array_contains("fills", t) & first)).alias("hit"))


def random_turns(conversation: Column, most: int, seed: str = "42") -> Column:
    """How many turns a conversation gets: 1 to ``most``, from a hash of its id."""
    return (F.floor(hash_unit(f"{seed}|turns", conversation) * most) + 1).cast("long")
