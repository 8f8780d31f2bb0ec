"""Importance resampling towards a target set, with DataFrame functions only.

The n-grams of all documents and of all target texts are exploded and counted by hashed bucket. A bucket's gain is the
scaled logarithm of how much more frequent it is in the target; a document's weight is the mean gain of its n-grams,
and its score adds Gumbel noise from its id, so that the highest scores are a draw without replacement in proportion to
the importance weights. Ranks come from one distributed sort: place in the partition plus the partition's offset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import held, join_small, let_go, written

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
N_GRAM, BUCKETS, SEED, LEAST_WORDS, PERCENT = 1, 10_000, 2024, 20, 10
#: Most buckets that are sent to every executor as the gain table (16 bytes each).
MOST_BUCKETS = 1_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Letters, digits and all beyond ASCII make words; A-Z become lower case; a null text has none."""
    return F.regexp_extract_all(F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def n_grams(found: Column, most: int) -> Column:
    """All runs of 1 to ``most`` consecutive words, joined by one space."""
    out = found
    for n in range(2, most + 1):
        size = F.lit(n)
        runs = F.transform(F.sequence(F.lit(1), F.size(found) - n + 1), lambda i: F.array_join(F.slice(found, i, size), " "))  # noqa: B023
        out = F.concat(out, F.when(F.size(found) >= n, runs).otherwise(F.array().cast("array<string>")))
    return out


def bucket(feature: Column, buckets: int) -> Column:
    return (F.crc32(feature.cast("binary")) % buckets).cast("int")


def bucket_counts(texts: DataFrame, n: int, buckets: int, name: str) -> DataFrame:
    """``__bucket, <name>``: how many n-grams of all ``texts(text)`` fall into each bucket; summed before the shuffle."""
    found = texts.select(words(F.col("text")).alias("__words"))
    return found.select(F.explode(n_grams(F.col("__words"), n)).alias("__gram")).groupBy(bucket(F.col("__gram"), buckets).alias("__bucket")).agg(F.count("*").alias(name))


def gain_table(docs: DataFrame, target: DataFrame, n: int = N_GRAM, buckets: int = BUCKETS) -> DataFrame:
    """``__bucket int, __gain long`` of each bucket that ``docs`` use; at most ``buckets`` rows."""
    both = written(bucket_counts(docs, n, buckets, "s").join(bucket_counts(target, n, buckets, "t"), "__bucket", "full"))
    both = both.select("__bucket", *(F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in ("s", "t")))
    all_s, all_t = both.agg(F.coalesce(F.sum("s"), F.lit(0.0)), F.coalesce(F.sum("t"), F.lit(0.0))).first()
    ratio = (F.col("t") + 1.0) * F.lit(all_s + buckets) / ((F.col("s") + 1.0) * F.lit(all_t + buckets))
    return both.where("s > 0").select("__bucket", F.floor(F.lit(1000.0) * F.log(ratio)).alias("__gain"))


def noise(key: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, from the first 8 hexadecimal digits of SHA-256 of ``<seed>:<key>``."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def scores(docs: DataFrame, target: DataFrame, n: int = N_GRAM, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """``doc_id, __n_words, n_features, weight, score`` of every row of ``docs(doc_id, text)``."""
    if not 0 < buckets <= MOST_BUCKETS:
        raise ValueError(f"the gain table is sent to all executors: at most {MOST_BUCKETS} buckets")
    found = docs.select(F.monotonically_increasing_id().alias("__row"), "doc_id", words(F.col("text")).alias("__words"))
    grams = found.select("__row", "doc_id", F.size("__words").alias("__n_words"), F.explode_outer(n_grams(F.col("__words"), n)).alias("__gram"))
    gains = grams.withColumn("__bucket", bucket(F.col("__gram"), buckets)).join(F.broadcast(gain_table(docs, target, n, buckets)), "__bucket", "left")
    # a row's n-grams are neighbours in one task, so one row of sums for each leaves it
    sums = gains.groupBy("__row", "doc_id", "__n_words").agg(F.count("__gram").alias("n_features"), F.sum("__gain").alias("__sum"))
    floored = F.when(F.col("n_features") > 0, F.expr("(__sum - pmod(__sum, n_features)) div n_features")).otherwise(F.lit(0)).cast("long")
    return sums.withColumn("weight", floored).select("doc_id", "__n_words", "n_features", "weight", (F.col("weight") + noise(F.col("doc_id"), seed)).alias("score"))


def ranked(scored: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """Adds ``rank`` (long): 1, 2, 3 ... by falling score, ties by ``doc_id`` (null last), for ``percent`` of a hundred
    of the rows with at least ``least_words`` words; null for all others."""
    order = [F.desc("__in"), F.desc("score"), F.col("doc_id").asc_nulls_last()]
    # written, as the borders of the ranges are sampled anew each time a sort is run
    rows = written(scored.withColumn("__in", F.col("__n_words") >= least_words).orderBy(*order).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)
    counts = rows.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"), F.count_if("__in").alias("__n_in"))
    drawn = (counts.agg(F.coalesce(F.sum("__n_in"), F.lit(0))).first()[0] * percent) // 100
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("__part", before.alias("__before"))  # one row for each partition of the sort
    place = F.col("__before") + F.expr("__at & 8589934591") + 1
    out = rows.withColumn("__part", part).join(F.broadcast(offsets), "__part")
    return out.withColumn("rank", F.when(F.col("__in") & (place <= drawn), place)).drop("__in", "__at", "__part", "__before")


def resample(docs: DataFrame, target: DataFrame, n: int = N_GRAM, buckets: int = BUCKETS, seed: int = SEED, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` (all long) of every row of ``docs(doc_id, text, ...)``, drawn towards
    ``target(text, ...)``.

    Null and empty texts, and texts without a word, have no n-gram, weight 0 and no rank unless ``least_words`` is 0;
    very long texts are read whole. A null id has the noise of an empty one and comes after all others in a tie;
    repeated rows are ranked each, in any order. Other columns, of any name, are not looked at. An empty table gives no
    row; an empty target gives every bucket a count of 0. Only the gain table (``buckets`` rows at most) and the sort's
    partition offsets are broadcast.
    """
    scored = scores(docs.select("doc_id", "text"), target.select("text"), n, buckets, seed)
    return ranked(scored, percent, least_words).select(F.col("doc_id").cast("long").alias("doc_id"), "n_features", "weight", "score", "rank")


def draw(docs: DataFrame, target: DataFrame, **how) -> DataFrame:
    """The drawn documents, with all their columns; rows that share an id stay if one of them is drawn, rows without
    an id do not stay."""
    drawn = resample(docs, target, **how).where("rank IS NOT NULL").select(F.col("doc_id").alias("__id")).distinct()
    return let_go(join_small(held(docs, F.col("doc_id").cast("long").alias("__id")), drawn, "__id", "left_semi", most=500_000))


#: The same in SQL; CRC-32 is worked out by its table, once for each distinct word.
SQL = rf"""
WITH crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i::BIGINT, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc
), d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents
), x AS (SELECT doc_id, unnest(w) AS word FROM d),
y AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}')) AS word FROM benchmark),
v AS (
  SELECT word, list_transform(range(octet_length(encode(word))), lambda i: ('0x' || substr(hex(encode(word)), 2 * i + 1, 2))::BIGINT) AS bytes
  FROM (SELECT word FROM x UNION SELECT word FROM y)
), b AS (
  SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, k: xor(c >> 8, crc[(xor(c, k) & 255) + 1])), 4294967295) % {BUCKETS} AS bucket FROM v, crc
), s AS (SELECT bucket, count(*)::DOUBLE AS s FROM x JOIN b USING (word) GROUP BY 1),
t AS (SELECT bucket, count(*)::DOUBLE AS t FROM y JOIN b USING (word) GROUP BY 1),
g AS (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1) * ((SELECT sum(s) FROM s) + {BUCKETS}) / ((s + 1) * ((SELECT sum(t) FROM t) + {BUCKETS}))))::BIGINT AS gain
  FROM s LEFT JOIN t USING (bucket)
), m AS (SELECT doc_id, count(*) AS n, sum(gain)::BIGINT AS total FROM x JOIN b USING (word) JOIN g USING (bucket) GROUP BY 1),
z AS (
  SELECT doc_id, len(w) AS n_words, coalesce(n, 0)::BIGINT AS n_features,
    CASE WHEN n > 0 THEN (total - ((total % n) + n) % n) // n ELSE 0 END::BIGINT AS weight,
    ('0x' || substr(sha256('{SEED}:' || doc_id::VARCHAR), 1, 8))::BIGINT AS h
  FROM d LEFT JOIN m USING (doc_id)
), f AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM z),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM f WHERE n_words >= {LEAST_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT {PERCENT} * count(*) // 100 FROM r) THEN rank END AS rank FROM f LEFT JOIN r USING (doc_id)
"""
