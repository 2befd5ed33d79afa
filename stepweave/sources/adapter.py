"""Core tables from event logs: steps and sequences of the `events` table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stepweave.schema import KEY, PROCESS_TYPES

_CLASSES = ("Inspection", "Search", "ChangeImplementation", "ArtifactEvaluation")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epochs(events: DataFrame, conversation: str, order: list[str], reset: str) -> DataFrame:
    """Adds session_epoch: how many resets a conversation has had, this event included."""
    so_far = W.partitionBy(conversation).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return events.withColumn("session_epoch", F.sum(F.expr(f"CASE WHEN {reset} THEN 1 ELSE 0 END")).over(so_far))


def _choice(number, names: tuple[str, ...]):
    return F.element_at(F.array(*[F.lit(n) for n in names]), (number + 1).cast("int"))


def event_steps(spark: SparkSession, sf_dir: str, tasks: int | None = None) -> DataFrame:
    """The fact table: one step for each event but resets, with its sequence key, position and taxonomy.

    tasks: how many put sequences in order, whatever Spark would make of small shuffles.
    """
    raw = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("int").alias("k"))
    timed = epochs(raw, "user_id", ["ts", "event_id"], "event_type = 'signup'").where("event_type <> 'signup'")
    cls, program, ext = _choice(F.col("k") % 4, _CLASSES), F.concat(F.lit("p"), F.col("k") % 3), F.when(F.col("value") < 20, "lo").otherwise("hi")
    named = timed.select(
        (F.col("event_id") + 1).alias("step_id"), F.col("user_id").cast("string").alias("conversation_id"), F.col("session_epoch").cast("long"), F.lit("p").alias("prompt_id"), F.lit("").alias("agent_id"),
        cls.alias("activity_class"), program.alias("program"), ext.alias("file_ext"), F.concat(program, F.lit(" t"), F.col("k") % 7).alias("template"), F.array(F.concat(F.lit("f"), F.col("k") % 8)).alias("files"),
        F.when(F.col("event_type") == "error", "failure").when(F.col("event_type") == "purchase", "success").otherwise("neutral").alias("outcome"),
        F.col("ts").cast("timestamp").alias("occurred_at"), F.concat(F.lit("call"), F.col("event_id")).alias("tool_call_id"),
    )
    return positions(named.repartition(tasks, "conversation_id", "session_epoch") if tasks else named)  # the rest of the key is constant


def positions(steps: DataFrame) -> DataFrame:
    """Adds position: the rank of a step within its sequence, by time and arrival."""
    return steps.withColumn("position", (F.row_number().over(W.partitionBy(*KEY).orderBy("occurred_at", "step_id")) - 1).cast("long"))


def event_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dimension: every sequence with steps; all but the last epoch of a conversation are closed."""
    raw = epochs(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type = 'signup'")
    last = raw.groupBy("user_id").agg(F.max("session_epoch").alias("last_epoch"))
    found = raw.where("event_type <> 'signup'").groupBy("user_id", "session_epoch").agg(F.min("ts").cast("timestamp").alias("started_at"))
    return found.join(last, "user_id").select(
        F.col("user_id").cast("string").alias("conversation_id"), F.col("session_epoch").cast("long"), F.lit("p").alias("prompt_id"), F.lit("").alias("agent_id"),
        (F.col("user_id") % 5).cast("string").alias("project_dir_key"), _choice((F.col("user_id") + F.col("session_epoch")) % 7, PROCESS_TYPES).alias("process_type"),
        F.when(F.col("session_epoch") < F.col("last_epoch"), "closed").otherwise("open").alias("status"), "started_at",
    )


#: The same tables in SQL, as common table expressions (DuckDB).
BASE_SQL = """
ev AS (SELECT event_id + 1 AS step_id, user_id, ts, event_type, value, CAST(json_extract_string(props, '$.k') AS INT) AS k,
  CAST(SUM(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS epoch FROM events),
mx AS (SELECT user_id, MAX(epoch) AS mxe FROM ev GROUP BY user_id),
st AS (SELECT step_id, ev.user_id, ev.epoch, ts, CASE WHEN ev.epoch < mx.mxe THEN 'closed' ELSE 'open' END AS status,
  CASE event_type WHEN 'error' THEN 'failure' WHEN 'purchase' THEN 'success' ELSE 'neutral' END AS outcome,
  CASE k % 4 WHEN 0 THEN 'Inspection' WHEN 1 THEN 'Search' WHEN 2 THEN 'ChangeImplementation' ELSE 'ArtifactEvaluation' END AS cls,
  'p' || CAST(k % 3 AS VARCHAR) AS program, 'f' || CAST(k % 8 AS VARCHAR) AS file, CASE WHEN value < 20 THEN 'lo' ELSE 'hi' END AS ext,
  'p' || CAST(k % 3 AS VARCHAR) || ' t' || CAST(k % 7 AS VARCHAR) AS template,
  CASE (ev.user_id + ev.epoch) % 7 {types} END AS process_type, CAST(ev.user_id % 5 AS VARCHAR) AS project,
  CASE k % 4 WHEN 0 THEN 'Inspection' WHEN 1 THEN 'Search' WHEN 2 THEN 'ChangeImplementation' ELSE 'ArtifactEvaluation' END || '/p' || CAST(k % 3 AS VARCHAR) AS node,
  ROW_NUMBER() OVER (PARTITION BY ev.user_id, ev.epoch ORDER BY ts, step_id) - 1 AS position
  FROM ev JOIN mx ON ev.user_id = mx.user_id WHERE event_type <> 'signup'),
clean AS (SELECT user_id, epoch, status = 'closed' AND bool_and(outcome <> 'failure') AS clean FROM st GROUP BY user_id, epoch, status),
lg AS (SELECT st.*, clean.clean, LAG(node) OVER w AS pnode, LAG(file) OVER w AS pfile, LAG(outcome) OVER w AS pout, LEAD(node) OVER w AS nnode
  FROM st JOIN clean USING (user_id, epoch) WINDOW w AS (PARTITION BY st.user_id, st.epoch ORDER BY position)),
mv AS (SELECT user_id, epoch, project, coalesce(pnode, 'Start') AS source, node AS target, step_id, outcome, process_type, CASE WHEN pnode IS NULL THEN NULL ELSE pfile = file END AS same_file, pout AS previous_outcome, clean, ts FROM lg
  UNION ALL SELECT user_id, epoch, project, node, 'End', step_id, outcome, process_type, NULL, outcome, clean, ts FROM lg WHERE nnode IS NULL)
""".replace("{types}", " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(PROCESS_TYPES)))
