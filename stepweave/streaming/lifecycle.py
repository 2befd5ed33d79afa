"""The life of sequences as state of a stream: opened by their first event, ended by an explicit mark, by a new epoch or by idle time.

State of a conversation: its epoch, and the sequences of that epoch by prompt and agent. A sequence that has ended stays so, though steps may
still come. Every batch gives a row for each
sequence that it touched, with what is known of it then; the last row of a sequence is its present state.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from stepweave.schema import KEY
from stepweave.sources.store import current

#: Kinds of events: a step, a mark that its sequence has ended, a mark that the conversation begins anew, any other start.
STEP, STOP, ROTATE, START = "step", "stop", "rotate", "start"
OPEN, CLOSED, LEFT = "open", "closed", "incomplete"
_TOLD = "conversation_id string, session_epoch long, prompt_id string, agent_id string, status string, steps long, failed long, started_at long, ended_at long, change_id long"
_STATE = "epoch long, changes long, open string"
_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _folded(idle_ms: int):
    """A function for applyInPandasWithState: events of a conversation, in order of arrival within a batch, to changes of its sequences.

    The state is one value, which comes and goes with the rows of its conversation; its open sequences are rows of JSON.
    """
    names = [c.split()[0] for c in _TOLD.split(", ")]

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        epoch, change, stored = state.get if state.exists else (0, 0, "[]")
        held = {(k[0], k[1]): tuple(v) for *k, v in json.loads(stored)}
        out: list[tuple] = []

        def add(own: tuple, status: str, ended: int | None) -> None:
            nonlocal change
            change += 1
            steps, failed, started, *_ = held[own]
            out.append((key[0], epoch, *own, status, steps, failed, started, ended, change))

        if state.hasTimedOut:
            for own in [k for k, v in held.items() if not v[4]]:
                add(own, LEFT, held[own][3])
                del held[own]
        else:
            touched, last = set(), 0
            events = sorted(row for part in parts for row in zip(*[part[c].tolist() for c in ("arrival", "kind", "prompt_id", "agent_id", "outcome", "at_us")], strict=True))
            for _, kind, prompt, agent, outcome, at in events:
                own = (prompt, agent)
                last = max(last, at)
                if kind == ROTATE:
                    for k in held:
                        if k in touched or not held[k][4]:
                            add(k, CLOSED, at)
                    held, touched, epoch = {}, set(), epoch + 1
                elif kind == STOP and own in held and not held[own][4]:
                    held[own] = (*held[own][:4], True)
                    touched.add(own)
                elif kind == STEP:
                    steps, failed, started, _, closed = held.get(own, (0, 0, at, at, False))
                    held[own] = (steps + 1, failed + (outcome == "failure"), min(started, at), at, closed)
                    touched.add(own)
            for k in sorted(touched):
                add(k, CLOSED if held[k][4] else OPEN, held[k][3] if held[k][4] else None)
            if idle_ms and not all(v[4] for v in held.values()):
                state.setTimeoutTimestamp(max(last // 1000 + idle_ms, state.getCurrentWatermarkMs() + 1))
        state.update((epoch, change, json.dumps([(*k, v) for k, v in held.items()])))
        if out:
            columns = dict(zip(names, map(list, zip(*out, strict=True)), strict=True))
            yield pd.DataFrame(columns | {"ended_at": pd.array(columns["ended_at"], "Int64")})

    return run


def changes(stream: DataFrame, idle_ms: int = 0, delay: str = "1 hour") -> DataFrame:
    """Changes of sequences from a stream of (conversation_id, prompt_id, agent_id, kind, outcome, at, arrival).

    idle_ms: a conversation without events for so long (event time, behind the watermark) leaves its open sequences incomplete.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)
    told = ["conversation_id", "prompt_id", "agent_id", "kind", "outcome", "arrival", F.unix_micros("at").alias("at_us")]
    rows = stream.withWatermark("at", delay).select(*told, "at") if idle_ms else stream.select(*told)
    found = rows.groupBy("conversation_id").applyInPandasWithState(_folded(idle_ms), _TOLD, _STATE, "append", "EventTimeTimeout" if idle_ms else "NoTimeout")
    return found.withColumns({c: F.timestamp_micros(c) for c in ("started_at", "ended_at")})


def follow(stream: DataFrame, path: str, checkpoint: str, idle_ms: int = 0) -> None:
    """Append the changes of a stream to the table at `path` until none is left; the file sink commits each batch once."""
    query = changes(stream, idle_ms).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()


def current_sequences(changed: DataFrame) -> DataFrame:
    """The last row of every sequence."""
    return current(changed, KEY, "change_id").drop("change_id")


def lifecycle(events: DataFrame) -> DataFrame:
    """The same from a whole table, for rebuilding: running counts of marks in place of state; no idle time."""
    so_far = W.partitionBy("conversation_id").orderBy("arrival").rowsBetween(W.unboundedPreceding, 0)
    mark = lambda kind: F.when(F.col("kind") == kind, 1).otherwise(0)
    timed = events.withColumn("session_epoch", F.sum(mark(ROTATE)).over(so_far).cast("long"))
    last = timed.groupBy("conversation_id").agg(F.max("session_epoch").alias("_last"))
    is_step = F.col("kind") == STEP
    ended = F.coalesce(F.max(F.when(F.col("kind") == STOP, F.col("arrival"))) > F.min(F.when(is_step, F.col("arrival"))), F.lit(False))
    found = timed.where(F.col("kind").isin(STEP, STOP)).groupBy(*KEY).agg(F.count_if(is_step).alias("steps"), F.count_if(is_step & (F.col("outcome") == "failure")).alias("failed"), F.min(F.when(is_step, F.col("at"))).alias("started_at"), ended.alias("_ended")).where("steps > 0")
    return found.join(last, "conversation_id").withColumn("status", F.when((F.col("session_epoch") < F.col("_last")) | F.col("_ended"), CLOSED).otherwise(OPEN)).drop("_last", "_ended")
