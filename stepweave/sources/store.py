"""The episodic store as append-only tables: deduplicated inserts, latest-wins updates, counters, prune and snapshots."""

from __future__ import annotations

import time
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stepweave.schema import COUNTERS, KEY, RESULT_CHARS

SNAPSHOT_FORMAT = 1


def new_steps(arriving: DataFrame, stored: DataFrame | None) -> DataFrame:
    """The first arrival of each dedup_key that is not stored yet, its result cut to size."""
    first = arriving.withColumn("rank", F.row_number().over(W.partitionBy("dedup_key").orderBy("step_id"))).where("rank = 1").drop("rank")
    fresh = first if stored is None else first.join(stored.select("dedup_key"), "dedup_key", "left_anti")
    return fresh.withColumn("result_snippet", F.substring("result_snippet", 1, RESULT_CHARS)) if "result_snippet" in fresh.columns else fresh


def counters(log: DataFrame) -> DataFrame:
    """Counts of the names of a log, with every known name at zero at least."""
    known = log.sparkSession.createDataFrame([(c,) for c in COUNTERS], "name string")
    return known.join(log.groupBy("name").agg(F.count("*").alias("n")), "name", "full_outer").select("name", F.coalesce("n", F.lit(0)).alias("n"))


def counted(df: DataFrame, observation: Observation, rules: dict[str, str]) -> DataFrame:
    """df, whose next action also counts the rows for which each rule (a name and its condition in SQL) holds, in the same pass. Write df whole as that action:
    a task that is run again counts once, and rows that nobody reads are not counted."""
    return df.observe(observation, *[F.count_if(F.coalesce(F.expr(rule), F.lit(False))).alias(name) for name, rule in rules.items()])


def log_counts(spark: SparkSession, observation: Observation, path: str, run: str) -> None:
    """Appends what an observed run counted to the log of counters; waits for its action."""
    rows = [(run, name, int(n or 0)) for name, n in observation.get.items()]
    spark.createDataFrame(rows, "run string, name string, n long").coalesce(1).write.mode("append").parquet(path)


def totals(log: DataFrame) -> DataFrame:
    """Sums of a log of counts (run, name, n), with every known name at zero at least; a run that was logged again counts once."""
    once = log.groupBy("run", "name").agg(F.max("n").alias("n"))
    known = log.sparkSession.createDataFrame([(c,) for c in COUNTERS], "name string")
    return known.join(once.groupBy("name").agg(F.sum("n").alias("n")), "name", "full_outer").select("name", F.coalesce("n", F.lit(0)).alias("n"))


def current(changes: DataFrame, by: tuple[str, ...] = KEY, order: str = "change_id") -> DataFrame:
    """The latest row of each key of an append-only log of changes."""
    return changes.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(F.desc(order)))).where("rank = 1").drop("rank")


def prune(steps: DataFrame, sequences: DataFrame, project: str, cutoff) -> tuple[DataFrame, DataFrame]:
    """Steps and sequences without the whole sequences of a project that started before the cutoff."""
    old = sequences.where((F.col("project_dir_key") == project) & (F.col("started_at") < cutoff)).select(*KEY)
    return steps.join(old, list(KEY), "left_anti"), sequences.join(old, list(KEY), "left_anti")


_MANIFEST = "format int, level string, episode_high_water long, version string, written long"


def write_snapshot(edges: DataFrame, nodes: DataFrame, path: str, level: str, high_water: int) -> None:
    """A snapshot as a folder of its own; the manifest that names it is added last, in one commit, so half a snapshot is never read.

    A write that fails leaves the snapshot before it as it was. Folders that no manifest names any more may be deleted.
    """
    written = time.time_ns()
    version = f"{written:020}-{uuid.uuid4().hex[:8]}"
    edges.write.parquet(f"{path}/{version}/edges")
    nodes.write.parquet(f"{path}/{version}/nodes")
    row = (SNAPSHOT_FORMAT, level, high_water, version, written)
    edges.sparkSession.createDataFrame([row], _MANIFEST).coalesce(1).write.mode("append").json(f"{path}/manifest")


def read_snapshot(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, dict]:
    """edges, nodes and manifest of the snapshot written last; a missing one or an unknown format is refused with ValueError."""
    try:
        manifest = spark.read.schema(_MANIFEST).json(f"{path}/manifest").orderBy(F.desc("written")).first()
    except AnalysisException as e:
        raise ValueError(f"no snapshot at {path}") from e
    if manifest is None or manifest["format"] != SNAPSHOT_FORMAT:
        raise ValueError(f"no snapshot of format {SNAPSHOT_FORMAT} at {path}")
    folder = f"{path}/{manifest['version']}"
    return spark.read.parquet(f"{folder}/edges"), spark.read.parquet(f"{folder}/nodes"), manifest.asDict()
