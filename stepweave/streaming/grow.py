"""A store of steps and its graph that grow with a stream: each key once, each batch folded once, little of the store read.

Steps lie in folders by bucket of their conversation, and by batch within. A batch reads the buckets that it touches and no others, so
what it reads is bounded by the conversations it brings, not by the store. Its steps are written first; then the graph's state is
advanced by the touched conversations and committed as a version that names the batch. A batch that is run again finds its
steps stored and its version committed, and does what is left to do.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stepweave.plans import snapshot
from stepweave.schema import KEY
from stepweave.sources.arrival import written
from stepweave.sources.store import new_steps

#: Folders of the store. A number of folders, not of rows, is what the driver lists for a batch.
BUCKETS = 64
_VERSION = "batch long, version string, written long"


def bucket(conversation: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(conversation), F.lit(buckets)).cast("int")


def read_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at a path, None if nothing is there; any other error is one."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def stored_steps(spark: SparkSession, path: str, touched: list[int] | None = None) -> DataFrame | None:
    """The steps of a store, of some buckets only if they are named: a filter on the folders."""
    found = read_or_none(spark, f"{path}/steps")
    return found if found is None or touched is None else found.where(F.col("bucket").isin(touched))


def versions(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.schema(_VERSION).json(f"{path}/versions")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def latest(spark: SparkSession, path: str) -> tuple[int, snapshot.State] | None:
    """The batch and state committed last."""
    known = versions(spark, path)
    newest = known.orderBy(F.desc("batch"), F.desc("written")).first() if known is not None else None
    return None if newest is None else (newest["batch"], snapshot.read_state(spark, f"{path}/{newest['version']}"))


def add_batch(arriving: DataFrame, batch: int, path: str, sequences_of: Callable[[DataFrame], DataFrame], level: str = "class/program", buckets: int = BUCKETS) -> None:
    """One batch of steps (with dedup_key, step_id, position) into the store and the graph.

    sequences_of gives the sequence rows of whole conversations from their steps. A store keeps its number of buckets.
    """
    spark = arriving.sparkSession
    placed = written(arriving.withColumn("bucket", bucket(F.col("conversation_id"), buckets)))
    touched = [r[0] for r in placed.select("bucket").distinct().collect()]
    old = stored_steps(spark, path, touched)
    new_steps(placed, old).withColumn("batch", F.lit(batch)).repartition("bucket").write.partitionBy("bucket", "batch").mode("append").parquet(f"{path}/steps")
    done = latest(spark, path)
    if done is not None and done[0] >= batch:
        return
    held = stored_steps(spark, path, touched)
    if held is None:
        return
    own = written(held.join(held.where(F.col("batch") == batch).select("conversation_id").distinct(), "conversation_id", "left_semi"))
    before = own.where(F.col("batch") < batch)
    if done is None:
        state = snapshot.fold(own, sequences_of(own), level)
    else:
        state = snapshot.advance(done[1], (before, sequences_of(before)), (own, sequences_of(own)), level)
    version = f"{time.time_ns():020}-{uuid.uuid4().hex[:8]}"
    state.write(f"{path}/{version}")
    spark.createDataFrame([(batch, version, time.time_ns())], _VERSION).coalesce(1).write.mode("append").json(f"{path}/versions")


def grow(stream: DataFrame, path: str, checkpoint: str, sequences_of: Callable[[DataFrame], DataFrame], level: str = "class/program", buckets: int = BUCKETS) -> None:
    """Feed a stream of steps to add_batch until none is left."""
    query = stream.writeStream.foreachBatch(lambda df, n: add_batch(df, n, path, sequences_of, level, buckets)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def closed_by_later_epochs(steps: DataFrame) -> DataFrame:
    """Sequence rows from steps alone: a sequence is closed once its conversation has a later epoch; their own columns as told by the steps."""
    last = steps.groupBy("conversation_id").agg(F.max("session_epoch").alias("_last"))
    told = [c for c in ("project_dir_key", "process_type") if c in steps.columns]
    found = steps.groupBy(*KEY).agg(F.min("occurred_at").alias("started_at"), *[F.first(c).alias(c) for c in told])
    return found.join(last, "conversation_id").withColumn("status", F.when(F.col("session_epoch") < F.col("_last"), "closed").otherwise("open")).drop("_last")
