"""Streaming ingest: exactly-once steps by key, counters, and a latch for triggers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepweave.schema import LOOP_LENGTH
from stepweave.sources.store import new_steps
from stepweave.streaming.grow import read_or_none


def ingest(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Append the steps of a stream (with dedup_key and step_id) to the table at `path`, each key once, and stop when none is left.

    A batch that is run again after a failure finds its own keys stored and adds nothing.
    """

    def batch(arriving: DataFrame, _: int) -> None:
        spark = arriving.sparkSession
        new_steps(arriving, read_or_none(spark, path)).write.mode("append").parquet(path)

    query = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def daily_counts(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """Steps by day and outcome, with late rows up to `delay`."""
    return stream.withWatermark("occurred_at", delay).groupBy(F.window("occurred_at", "1 day"), "outcome").agg(F.count("*").alias("n"))


def repetition_latch(stream: DataFrame, k: int = LOOP_LENGTH) -> DataFrame:
    """Of a stream of (conversation_id, step_id, node): one row for each node of a conversation whose run first reaches k.

    State of a conversation: the last node, the length of its run, and the nodes that have fired.
    """

    def run(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        node, length, fired = state.get if state.exists else ("", 0, [])
        fired, out = list(fired), []
        for step, name in sorted((s, n) for p in parts for s, n in zip(p["step_id"], p["node"], strict=True)):
            node, length = name, length + 1 if name == node else 1
            if length >= k and name not in fired:
                fired.append(name)
                out.append((key[0], int(step), name))
        state.update((node, length, fired))
        yield pd.DataFrame(out, columns=["conversation_id", "step_id", "node"])

    return stream.groupBy("conversation_id").applyInPandasWithState(run, "conversation_id string, step_id long, node string", "node string, length int, fired array<string>", "append", "NoTimeout")
