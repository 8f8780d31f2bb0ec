"""Quality rules judged by host: rule failures by domain, shrunk by an empirical beta prior.

Each text gets counts in one vectorised pass. Hosts get failures and documents (pre-aggregated before the
shuffle); a beta prior fitted to the host rates by moments shrinks each rate, so that a host with few
documents is judged mostly as hosts in general. A host whose shrunk rate passes the limit is rejected, and
its verdict is joined back.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from . import kernel as K
from .store import held, join_small, let_go, written

U64 = np.uint64
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _sum(row, rows, weight=None):
    return np.bincount(row, weights=weight, minlength=rows).astype(np.int64)


def _repeats(name: np.ndarray, row: np.ndarray) -> np.ndarray:
    """True where (row, name) occurs more than once."""
    order = np.lexsort((name, row))
    n, r = name[order], row[order]
    same = (n[1:] == n[:-1]) & (r[1:] == r[:-1])
    out = np.zeros(len(name), bool)
    out[order] = np.concatenate((same, [False])) | np.concatenate(([False], same)) if len(name) else False
    return out


def text_counts(col: pa.Array, window: int = 5) -> np.ndarray:
    """The COUNTS of each row of a string column, shape (rows, 5)."""
    data, off = K.buffers(col)
    out = np.zeros((len(off) - 1, 5), np.int64)
    for i, j in K.chunks(off):
        part, own = data[off[i] : off[j]], off[i : j + 1] - off[i]
        rows, n = j - i, len(part)
        if not n:
            continue
        at = out[i:j]
        s, e, row = K.spans(part, own)
        at[:, 0] = _sum(row, rows)
        head = (part & 0xC0) != 0x80
        run = np.concatenate(([0], np.cumsum(head & ~K.SPACE[part])))
        at[:, 1] = run[own[1:]] - run[own[:-1]]
        run = np.concatenate(([0], np.cumsum(SYMBOL[part])))
        at[:, 2] = run[own[1:]] - run[own[:-1]]
        # lines with a word: each but the first of its content counts
        cut = np.flatnonzero(part == 10)
        begin = np.unique(np.concatenate((own[:-1][own[:-1] < n], cut[cut + 1 < n] + 1)))
        end = np.append(begin[1:], n)
        end = end - (part[end - 1] == 10)
        filled = np.concatenate(([0], np.cumsum(~K.SPACE[part])))
        keep = (end > begin) & (filled[end] > filled[begin])
        begin, end = begin[keep], end[keep]
        line_row = np.searchsorted(own, begin, "right") - 1
        name = K.hashes(part, begin, end, lower=False)
        order = np.lexsort((name, line_row))
        a, b = name[order], line_row[order]
        again = np.flatnonzero((a[1:] == a[:-1]) & (b[1:] == b[:-1])) + 1
        at[:, 3] = _sum(b[again], rows)
        # words inside windows that the text has twice or more
        h = K.hashes(part, s, e, lower=False)
        gram, start = K.sequences(h, row, window)
        hit = start[_repeats(gram, row[start])] if len(start) else start
        if len(hit):
            edge = np.zeros(len(h) + 1, np.int64)
            np.add.at(edge, hit, 1)
            np.add.at(edge, hit + window, -1)
            at[:, 4] = _sum(row[np.cumsum(edge[:-1]) > 0], rows)
    return out


def add_counts(docs: DataFrame) -> DataFrame:
    """All columns of ``docs``, and the COUNTS under names with a ``__`` prefix."""
    names = [f"__{c}" for c in COUNTS]
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            got = text_counts(batch.column(at))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(got[:, i]) for i in range(5))], names=[*batch.schema.names, *names])
        K.release()

    schema = StructType([*docs.schema.fields, *(StructField(c, LongType()) for c in names)])
    return docs.mapInArrow(run, schema)


def base_failed() -> Column:
    return (F.col("__n_words") < 10) | (100 * F.col("__n_repeat_words") > 20 * F.col("__n_words"))


def any_failed() -> Column:
    """The rules whose failures hosts are judged by."""
    return base_failed() | (F.col("__n_symbols") > 0.5 * F.col("__n_words")) | (F.col("__word_chars") > 20 * F.col("__n_words"))


def host_verdicts(failures: DataFrame, limit: float = 0.6) -> DataFrame:
    """``failures(host, failed)`` by document -> ``host, n_docs, n_failed, shrunk, host_rejected``.

    The prior's mean and strength come from the mean and variance of the host rates. If the rates do not
    vary, all hosts share the mean; if none fails, nothing is rejected. A null host is a host of its own.
    """
    hosts = failures.groupBy(F.coalesce("host", F.lit("")).alias("host")).agg(F.count("*").alias("n_docs"), F.sum(F.col("failed").cast("long")).alias("n_failed"))
    hosts = written(hosts)
    rate = F.col("n_failed") / F.col("n_docs")
    prior = hosts.agg(F.avg(rate).alias("m"), F.var_pop(rate).alias("v")).select("m", F.when(F.col("v") > 1e-9, F.greatest(F.col("m") * (1 - F.col("m")) / F.col("v") - 1, F.lit(0.0))).otherwise(1e9).alias("k"))
    shrunk = (F.col("n_failed") + F.col("m") * F.col("k")) / (F.col("n_docs") + F.col("k"))
    return hosts.crossJoin(F.broadcast(prior)).withColumn("shrunk", shrunk).withColumn("host_rejected", shrunk > limit).drop("m", "k")  # prior: one row


def quality_rules(docs: DataFrame, host: Column | None = None, limit: float = 0.6) -> DataFrame:
    """One row per row of ``docs(doc_id, text, source, ...)``: COUNTS, ``base_failed``, ``host_rate``, ``kept``.

    ``host`` defaults to ``source``. A null text has no word and fails; a null host is judged as one host;
    repeated rows each count and each get a row; an empty table gives an empty result; other columns are
    ignored. ``base_failed``: under 10 words, or over a fifth of the words in repeated 5-word windows.
    """
    c = {n: F.col(f"__{n}").alias(n) for n in COUNTS}
    host = F.col("source") if host is None else host
    rows = written(add_counts(docs.select("doc_id", F.col("text").cast("string").alias("text"), host.cast("string").alias("host"))).select("doc_id", F.coalesce("host", F.lit("")).alias("host"), *c.values(), base_failed().alias("base_failed"), any_failed().alias("failed")))
    out = join_small(rows, host_verdicts(rows, limit).select("host", "shrunk", "host_rejected"), "host", "left")
    return out.select("doc_id", *COUNTS, "base_failed", F.round("shrunk", 9).alias("host_rate"), (~F.col("base_failed") & ~F.coalesce("host_rejected", F.lit(False))).alias("kept"))


def _verdict(col: pa.Array) -> pa.Array:
    """2 for a text that fails the base rules, 1 for one that fails another rule that hosts are judged by, else 0."""
    n_words, chars, symbols, _, repeat = text_counts(col).T
    base = (n_words < 10) | (100 * repeat > 20 * n_words)
    K.release()
    return pa.array(np.where(base, 2, ((symbols > 0.5 * n_words) | (chars > 20 * n_words)).astype(int)), pa.int32())


def keep_good(docs: DataFrame, limit: float = 0.6) -> DataFrame:
    """The documents that ``quality_rules`` keeps, with their columns as they are.

    Only the text goes to Python, and one number comes back; texts are not shuffled: the rules are tried again
    beside the verdicts of the hosts. Nulls, repeated rows and empty tables as in ``quality_rules``; columns of any name
    stay as they are, as they are held in one struct meanwhile.
    """
    verdict = F.arrow_udf(_verdict, "int")(F.coalesce(F.col("text").cast("string"), F.lit("")))
    host = F.coalesce(F.col("source").cast("string"), F.lit(""))
    bad = host_verdicts(docs.select(host.alias("host"), (verdict > 0).alias("failed")), limit).where("host_rejected").select("host")
    return let_go(join_small(held(docs, verdict.alias("verdict"), host.alias("host")).where("verdict < 2"), bad, "host", "left_anti"))
