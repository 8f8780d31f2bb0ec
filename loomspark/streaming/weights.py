"""Weights of documents that follow their use."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
WEIGHTS = "doc_id string, ord long, used long, covered boolean, weight double"


def weight(used: int, target: int | None, covered: bool) -> float:
    """As ``operators.sampling.usage_weight``."""
    if covered:
        return 0.0
    return 1.0 / (used + 1) if target is None else float(max(target - used, 0)) if target > 0 else 0.0


class _Weights(StatefulProcessor):
    """Uses so far, and whether the document is covered, for each document."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("document", "used long, covered boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        used, covered = self.state.get() if self.state.exists() else (0, False)
        seen = pd.concat(rows).sort_values("ord", kind="stable")  # a document's events of one batch
        out = []
        for o, kind, target in zip(seen["ord"], seen["event"], seen["target"]):
            used, covered = used + (kind == "use"), covered or kind == "cover"
            out.append((key[0], o, used, covered, weight(used, None if pd.isna(target) else int(target), covered)))
        self.state.update((used, covered))
        yield pd.DataFrame(out, columns=["doc_id", "ord", "used", "covered", "weight"])

    def close(self) -> None:
        pass


def adaptive_weights(events: DataFrame) -> DataFrame:
    """A stream ``events(doc_id, ord, event, target)`` to the weight of a document after each of its events.

    ``event`` is ``use`` (counts) or ``cover`` (weight 0 from then on); ``target`` is the wanted number of uses at that
    time, null for none. Within a batch events go by ``ord``; the state of a document is one number and a flag, without
    timers. Documents without an event have the weight of no use and do not appear.
    """
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    # the worker that sets the state up on the driver does not get the files that are added to a session
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    rows = events.selectExpr("cast(doc_id as string) as doc_id", "cast(ord as long) as ord", "event", "cast(target as long) as target").where("doc_id IS NOT NULL")
    return rows.groupBy("doc_id").transformWithStateInPandas(_Weights(), WEIGHTS, "append", "None")
