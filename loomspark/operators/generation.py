"""The boundary to language models: one stage that sends a prompt column through a client, by partition.

A client is any callable from a list of prompts to a list of answers; it is made once a partition by a factory,
so that connections live where the rows are. The default is a fixed offline stub. Vendors are not part of it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..sources.shared import written

Client = Callable[[list[str]], list[str]]


def offline() -> Client:
    """Answers that depend on the prompt only."""
    return lambda prompts: [f"answer {hashlib.md5(p.encode()).hexdigest()[:12]}" for p in prompts]


def generate(df: DataFrame, prompt: str, answer: str = "answer", factory: Callable[[], Client] = offline, batch: int = 64, partitions: int | None = None) -> DataFrame:
    """Adds ``answer``; null prompts get null. ``partitions`` is how many clients work at once."""

    kept = [x for x in df.schema.fields if x.name != answer]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client = factory()
        for b in batches:
            prompts = b.column(prompt).to_pylist()
            out: list[str | None] = [None] * len(prompts)
            have = [i for i, p in enumerate(prompts) if p is not None]
            for k in range(0, len(have), batch):
                part = have[k : k + batch]
                for i, a in zip(part, client([prompts[i] for i in part]), strict=True):
                    out[i] = a
            # the other columns pass as they are: no number is changed beside a null
            yield pa.RecordBatch.from_arrays([*(b.column(x.name) for x in kept), pa.array(out, pa.string())], [*(x.name for x in kept), answer])

    df = df.repartition(partitions) if partitions else df
    return df.mapInArrow(run, StructType([*kept, StructField(answer, StringType())]))


def retried(df: DataFrame, prompt: str, accept: Callable[[str], str], attempts: int = 3, **how) -> DataFrame:
    """Generates again, at most ``attempts`` times, the rows whose answer does not pass ``accept`` (an SQL condition
    made from the answer's column name). Adds ``answer`` and ``attempt`` (null if none passed). The answers of each
    attempt are written in the shared folder before they are judged, so that no prompt is sent twice and the answer
    that is kept is the one that passed."""
    left, out = df, None
    for i in range(attempts):
        got = written(generate(left, prompt, "answer", **how))
        ok = got.where(F.expr(accept("answer"))).withColumn("attempt", F.lit(i))
        out = ok if out is None else out.unionByName(ok)
        left = got.where(~F.coalesce(F.expr(accept("answer")), F.lit(False))).drop("answer")
    return out.unionByName(left.withColumn("answer", F.lit(None).cast("string")).withColumn("attempt", F.lit(None).cast("int")))
