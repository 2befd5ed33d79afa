"""Queries of served documents and of prompts: the whole way from events to bodies and back, and to what prompts are told."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from stepweave.plans import documents, prompts
from stepweave.plans import graph as g
from stepweave.plans.queries import CONDITION_SQL, NODE_SQL, PITFALL_CTE, RUN_CTE
from stepweave.schema import COUNTERS
from stepweave.sources.adapter import BASE_SQL, epochs, event_sequences, event_steps, table
from stepweave.sources.arrival import shared_folder
from stepweave.sources.store import counted, log_counts, totals

DENY = ["# a project that wants no record", "/w/4*"]


def document_edges(spark: SparkSession, d: str) -> DataFrame:
    """All edges written as documents and read back; moves onto themselves are damaged on the way and come with the reason."""
    folder = f"{shared_folder(spark)}/documents-{uuid.uuid4().hex}"
    steps = event_steps(spark, d)
    made = g.moves(steps, event_sequences(spark, d))
    bodies = documents.edge_bodies(g.edges(made), g.modal_conditions(made), g.failure_prone(made), g.repetition_loops(steps), g.supporting_steps(made))
    own = F.get_json_object("body", "$.source") == F.get_json_object("body", "$.target")
    bodies.withColumn("body", F.when(own, F.regexp_replace("body", '"process_type":"[A-Za-z]+"', '"process_type":"Party"')).otherwise(F.col("body"))).write.json(folder)
    good, bad = documents.rehydrate_edges(spark.read.schema("kind string, key string, body string").json(folder))
    pitfalls = F.array_join(F.transform("pitfalls", lambda p: F.concat_ws(":", p["kind"], p["evidence"], p["support"])), ",")
    typed = good.select(F.col("edge_key").alias("key"), "support", "failures", "weight", F.unix_micros("last_seen").alias("last_seen"), "process_type", "same_file", "previous_outcome", F.array_join(F.col("supporting_steps").cast("array<string>"), ",").alias("steps"), pitfalls.alias("pitfalls"))
    return typed.withColumn("reason", F.lit(None).cast("string")).unionByName(bad.select("key", "reason"), allowMissingColumns=True)


def document_nodes(spark: SparkSession, d: str) -> DataFrame:
    """All nodes written as documents and read back."""
    folder = f"{shared_folder(spark)}/documents-{uuid.uuid4().hex}"
    steps = event_steps(spark, d)
    documents.node_bodies(g.nodes(steps), g.top_templates(steps), "class/program").write.json(folder)
    good, _ = documents.rehydrate_nodes(spark.read.schema("kind string, key string, body string").json(folder))
    templates = F.array_join(F.transform("templates", lambda t: F.concat_ws(":", t["text"], t["count"])), ",")
    return good.select("key", F.array_join("is_a", ",").alias("is_a"), templates.alias("templates"), "support", F.unix_micros("last_seen").alias("last_seen"), "n_failure", "n_neutral", "n_success")


def _asked(spark: SparkSession, d: str) -> DataFrame:
    """A prompt for each signup, in the epoch that it begins."""
    events = epochs(table(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type = 'signup'").where("event_type = 'signup'")
    project = (F.col("user_id") % 5).cast("string")
    return events.select(F.col("user_id").cast("string").alias("conversation_id"), F.col("session_epoch").cast("long"), F.lit("p").alias("prompt_id"), F.lit("").alias("agent_id"), F.concat(F.lit("/w/"), project).alias("project_dir"), project.alias("project_dir_key"), F.col("ts").cast("timestamp").alias("at"))


def _notes(spark: SparkSession, d: str) -> DataFrame:
    """A note for each nation, on the first move that its number picks."""
    kind = F.element_at(F.array(*[F.lit(c) for c in ("Inspection", "Search", "ChangeImplementation", "ArtifactEvaluation")]), (F.col("n_nationkey") % 4 + 1).cast("int"))
    return table(spark, d, "nation").select(F.concat(F.lit("Start -> "), kind, F.lit("/p"), F.col("n_nationkey") % 3).alias("edge_key"), F.concat(F.lit("as in "), "n_name").alias("text"))


def _told(spark: SparkSession, d: str, process_type: str | None) -> DataFrame:
    made = g.moves(event_steps(spark, d), event_sequences(spark, d)).where(F.col("source") == "Start")
    on, by = ["source", "target"], ("project_dir_key",)
    kind = ("source", "target", "process_type")
    own = g.edges(made, scope=by).join(g.modal_conditions(made, by).select(*by, *kind), [*by, *on])
    wide = g.edges(made).join(g.modal_conditions(made).select(*kind), on)
    asked = _asked(spark, d)
    return prompts.answered(asked, prompts.openings(asked, own, wide, _notes(spark, d), process_type), DENY)


def prompt_serve(spark: SparkSession, d: str) -> DataFrame:
    """What each prompt is told, from moves of the type that prompts have (Unknown) and from all moves, and whether it opened a sequence."""
    asked = _asked(spark, d)
    new = prompts.opened(asked, event_sequences(spark, d), DENY).select("conversation_id", "session_epoch", F.lit(True).alias("opened"))
    both = _told(spark, d, "Unknown").withColumn("conditioned", F.lit(True)).unionByName(_told(spark, d, None).withColumn("conditioned", F.lit(False)))
    return both.join(new, ["conversation_id", "session_epoch"], "left").select("conversation_id", "session_epoch", "conditioned", "text", "scope", "reason", F.coalesce("opened", F.lit(False)).alias("opened"))


def prompt_counters(spark: SparkSession, d: str) -> DataFrame:
    """The counters after the answers were written, counted by that write; the run is logged twice and counts once."""
    folder = f"{shared_folder(spark)}/prompts-{uuid.uuid4().hex}"
    seen = Observation()
    counted(_told(spark, d, None), seen, prompts.COUNTED).write.parquet(f"{folder}/answers")
    for _ in range(2):
        log_counts(spark, seen, f"{folder}/counters", "first")
    return totals(spark.read.parquet(f"{folder}/counters"))


_TOLD_SQL = f"""WITH {BASE_SQL}, sc AS (SELECT project, target, process_type, COUNT(*) AS n FROM mv WHERE source = 'Start' GROUP BY ALL),
pe AS (SELECT project, target, CAST(SUM(n) AS BIGINT) AS support, FIRST(process_type ORDER BY n DESC, process_type) AS kind FROM sc GROUP BY ALL),
ge AS (SELECT target, CAST(SUM(n) AS BIGINT) AS support, FIRST(process_type ORDER BY n DESC, process_type) AS kind FROM (SELECT target, process_type, SUM(n) AS n FROM sc GROUP BY ALL) GROUP BY ALL),
su AS (SELECT user_id, epoch, CAST(user_id % 5 AS VARCHAR) AS project FROM ev WHERE event_type = 'signup'),
cd AS (SELECT unnest([true, false]) AS conditioned),
rk AS (SELECT conditioned, project, 'Start -> ' || target AS edge_key, support, true AS own FROM pe, cd WHERE project IN (SELECT project FROM su) AND (NOT conditioned OR kind = 'Unknown')
  UNION ALL SELECT conditioned, project, 'Start -> ' || target, support, false FROM ge, cd, (SELECT DISTINCT project FROM su) WHERE NOT conditioned OR kind = 'Unknown'),
fu AS (SELECT conditioned, project, edge_key, bool_or(own) AS own, SUM(score) AS score, coalesce(MAX(CASE WHEN own THEN support END), MAX(support)) AS support
  FROM (SELECT *, 1.0::DOUBLE / (60 + ROW_NUMBER() OVER (PARTITION BY conditioned, project, own ORDER BY support DESC, edge_key)) AS score FROM rk) GROUP BY ALL),
pl AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY conditioned, project ORDER BY own DESC, score DESC, edge_key) AS place FROM fu),
nt AS (SELECT 'Start -> ' || ['Inspection', 'Search', 'ChangeImplementation', 'ArtifactEvaluation'][n_nationkey % 4 + 1] || '/p' || (n_nationkey % 3) AS edge_key, 'as in ' || n_name AS text FROM nation),
li AS (SELECT conditioned, project, place, 0 AS n, support, '- a prompt like this usually starts with ' || substr(edge_key, 10) || ' (' || support || ' episodes)' AS text FROM pl WHERE support >= 2
  UNION ALL SELECT conditioned, project, place, ROW_NUMBER() OVER (PARTITION BY conditioned, project, edge_key ORDER BY text), support, '- note: ' || text || ' (' || support || ' episodes)' FROM pl JOIN nt USING (edge_key) WHERE support >= 2),
nu AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY conditioned, project ORDER BY place, n) AS pos FROM li),
he AS (SELECT *, SUM(length(text)) OVER w + ROW_NUMBER() OVER w - 1 AS held FROM nu WINDOW w AS (PARTITION BY conditioned, project ORDER BY support DESC, pos ROWS UNBOUNDED PRECEDING)),
sd AS (SELECT conditioned, project, string_agg(text, chr(10) ORDER BY pos) FILTER (held <= 1200) AS text, COUNT(*) FILTER (held > 1200) AS dropped FROM he GROUP BY ALL),
sp AS (SELECT conditioned, project, CASE WHEN bool_or(own) THEN 'project' ELSE 'global' END AS scope FROM fu GROUP BY ALL),
an AS (SELECT su.user_id, su.epoch, cd.conditioned, CASE WHEN su.project <> '4' THEN sd.text END AS text, CASE WHEN su.project <> '4' THEN sp.scope END AS scope, CASE WHEN su.project <> '4' THEN dropped END AS dropped,
  CASE WHEN su.project = '4' THEN 'excluded' WHEN sp.scope IS NULL THEN '{prompts.NOTHING}' WHEN sd.project IS NULL THEN '{prompts.UNSUPPORTED}' WHEN sd.text IS NULL THEN '{prompts.OVER}' END AS reason
  FROM su CROSS JOIN cd LEFT JOIN sp ON sp.project = su.project AND sp.conditioned = cd.conditioned LEFT JOIN sd ON sd.project = su.project AND sd.conditioned = cd.conditioned)
"""

QUERIES = {f.__name__: f for f in (document_edges, document_nodes, prompt_serve, prompt_counters)}
ORACLE = {
    "document_edges": f"""WITH {BASE_SQL}{PITFALL_CTE}{RUN_CTE}, lp AS (SELECT node, COUNT(*) AS loops FROM rn WHERE length >= 3 GROUP BY node),
ed AS (SELECT source, target, COUNT(*) AS support, COUNT(*) FILTER (outcome = 'failure') AS failures, SUM(CASE WHEN clean THEN 4.0::DOUBLE ELSE 1.0::DOUBLE END) AS weight, epoch_us(MAX(ts)) AS last_seen FROM mv GROUP BY ALL),
co AS (SELECT * FROM ({CONDITION_SQL.replace(', c AS', 'WITH c AS', 1)})),
ss AS (SELECT source, target, string_agg(step_id, ',' ORDER BY step_id) AS steps FROM (SELECT source, target, step_id FROM mv QUALIFY ROW_NUMBER() OVER (PARTITION BY source, target ORDER BY step_id DESC) <= 50) GROUP BY ALL)
SELECT source || ' -> ' || target AS key, ed.support, failures, weight, last_seen, process_type, same_file, previous_outcome, steps, coalesce('failure_prone:' || pf.evidence || ':' || pf.support, '') AS pitfalls, CAST(NULL AS VARCHAR) AS reason
FROM ed JOIN co USING (source, target) JOIN ss USING (source, target) LEFT JOIN pf USING (source, target) WHERE source <> target
UNION ALL SELECT source || ' -> ' || target, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'condition.process_type is out of bounds' FROM ed WHERE source = target""",
    "document_nodes": f"""WITH {BASE_SQL}, nd AS ({NODE_SQL.format(key="node")}), tp AS (SELECT node AS key, string_agg(template || ':' || n, ',' ORDER BY n DESC, template) AS templates FROM (SELECT node, template, COUNT(*) AS n FROM st GROUP BY node, template QUALIFY ROW_NUMBER() OVER (PARTITION BY node ORDER BY COUNT(*) DESC, template) <= 5) GROUP BY node)
SELECT nd.*, coalesce(templates, '') AS templates, CASE WHEN key IN ('Start', 'End') THEN '' ELSE split_part(key, '/', 1) END AS is_a FROM nd LEFT JOIN tp USING (key)""",
    "prompt_serve": _TOLD_SQL + "SELECT CAST(user_id AS VARCHAR) AS conversation_id, epoch AS session_epoch, conditioned, text, scope, reason, (user_id, epoch) NOT IN (SELECT (user_id, epoch) FROM st) AND user_id % 5 <> 4 AS opened FROM an",
    "prompt_counters": _TOLD_SQL + f""", ct AS (SELECT unnest([CASE WHEN reason = 'excluded' THEN 'capture_excluded' WHEN text IS NOT NULL THEN 'guidance_served' ELSE 'guidance_silent' END, CASE WHEN reason = '{prompts.UNSUPPORTED}' THEN 'guidance_below_support' END,
  CASE WHEN scope = 'global' THEN 'guidance_fallback_global' END, CASE WHEN dropped > 0 THEN 'guidance_over_budget' END]) AS name FROM an WHERE NOT conditioned)
SELECT name, COUNT(ct.name) AS n FROM (VALUES {", ".join(f"('{c}')" for c in COUNTERS)}) c(name) LEFT JOIN ct USING (name) GROUP BY name""",
}
