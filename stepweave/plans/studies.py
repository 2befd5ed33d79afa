"""Queries of held-out studies, of all that steps say, and of reports, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepweave.functions import scalars as fn
from stepweave.plans import evaluate as ev
from stepweave.plans import graph as g
from stepweave.plans import reports
from stepweave.schema import KEY, LEVELS
from stepweave.sources.adapter import BASE_SQL, event_sequences, event_steps, table

SEQ = ("conversation_id", "session_epoch")


def _samples(spark: SparkSession, d: str) -> DataFrame:
    return ev.samples(event_steps(spark, d), event_sequences(spark, d))


def conditioning_levels(spark: SparkSession, d: str) -> DataFrame:
    """Next-step accuracy of four conditionings at three levels, with the size of the training graph."""
    made = _samples(spark, d)
    return ev.evaluate(made, ev.conditionings()).join(F.broadcast(ev.graph_size(made)), "level")  # three rows


def prediction_variants(spark: SparkSession, d: str) -> DataFrame:
    """Same-file contexts, clean sequences weighted or alone, and back-off, at three levels."""
    return ev.evaluate(_samples(spark, d), ev.variants())


def prompt_types(spark: SparkSession, d: str) -> DataFrame:
    """Turns of users as prompts, every seventh one sent by the harness, every fifth one cut short, typed by the labels of their documents' numbers."""
    turns = table(spark, d, "conversations").where("role = 'user'")
    text = F.when(F.col("turn") % 7 == 2, F.concat(F.lit("<System-Reminder> "), "text")).when(F.col("conv_id") % 5 == 1, F.concat(F.lit(" <b>"), F.substring("text", 1, 11), F.lit("</b>\n"))).otherwise(F.col("text"))
    labels = table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("n")).where("conv_id % 3 > 0").select("conv_id", F.when(F.col("n") % 2 == 0, "BugFix").otherwise("Enhancement").alias("process_type"), F.lit(0.5).alias("confidence"))
    typed = ev.typed_prompts(turns.select("conv_id", "turn", text.alias("text")), labels, ("conv_id",))
    return typed.select("conv_id", "turn", "process_type", "confidence", F.char_length(ev.human_text(F.col("text"))).alias("n_chars"))


def _told_steps(spark: SparkSession, d: str, tasks: int) -> DataFrame:
    """Steps of the events with what else a transcript says of them: two steps an action, models, results and intents."""
    number = F.col("step_id")
    return event_steps(spark, d, tasks).withColumns({
        "tool_call_id": F.concat(F.lit("call"), F.floor(number / 2).cast("string")), "model": F.concat(F.lit("m"), (number % 3).cast("string")), "sidechain": number % 4 == 0,
        "activity_class": F.when(number % 9 == 0, "Checkin").otherwise(F.col("activity_class")), "result": F.concat(F.lit("[main "), F.substring(F.sha1(number.cast("string").cast("binary")), 1, 8), F.lit("] done")),
        "intended": F.when(number % 5 == 0, F.col("program")), "ended_at": F.when(number % 6 > 0, F.timestamp_micros(F.unix_micros("occurred_at") + number * 1000)),
        "files": F.array(F.concat(F.col("files")[0], F.when(number % 2 == 0, ".py").otherwise(""))),
    })


def triplet_projections(spark: SparkSession, d: str) -> DataFrame:
    """All triplets of all steps, counted by their types."""
    tasks = table(spark, d, "events").count() // ev.STEPS_EACH + 1  # the count comes from the files' footers
    return ev.projection_types(_told_steps(spark, d, tasks), event_sequences(spark, d), tasks)


def _prompts(sequences: DataFrame) -> DataFrame:
    """Sequences whose prompts recur: one prompt for all users with a number in common."""
    return sequences.withColumn("prompt_id", F.concat(F.lit("p"), (F.col("conversation_id").cast("long") % 40).cast("string")))


def mark_by_prompt(spark: SparkSession, d: str) -> DataFrame:
    """A mark from each conversation, on the prompt of its number, some of which nobody opened; every seventh one names none."""
    steps = event_steps(spark, d)
    known = _prompts(g.sequence_outcomes(steps).join(event_sequences(spark, d), list(KEY)))
    marks = table(spark, d, "conversations").groupBy("conv_id").agg(F.max("turn").alias("declared_at")).select(
        F.col("conv_id").alias("mark_id"), F.when(F.col("conv_id") % 7 > 0, F.concat(F.lit("p"), (F.col("conv_id") % 50).cast("string"))).alias("prompt_id"),
        F.when(F.col("conv_id") % 2 == 0, "failure").otherwise("success").alias("outcome"), "declared_at",
    )
    return reports.mark_outcomes(known, marks).select("mark_id", "prompt_id", *SEQ, "stored", "declared_outcome", "derived_outcome", "state", "reason")


def ingest_dry_run(spark: SparkSession, d: str) -> DataFrame:
    """What a second run over all events would record for each user, if the steps with even numbers are stored and every third one arrives twice."""
    keyed = event_steps(spark, d).withColumn("dedup_key", fn.dedup_key(F.col("tool_call_id"), F.lit(0), F.col("conversation_id"))).select("step_id", "dedup_key", "conversation_id")
    return reports.dry_run(keyed.unionByName(keyed.where("step_id % 3 = 0")), keyed.where("step_id % 2 = 0"), ("conversation_id",))


def graph_changes(spark: SparkSession, d: str) -> DataFrame:
    """The graph against the one of the first four projects in which no sequence counts as clean: weights differ where support does not."""
    steps, sequences = event_steps(spark, d), event_sequences(spark, d)
    left = g.edges(g.moves(steps, sequences))
    some = sequences.where("project_dir_key <> '4'").withColumn("status", F.lit("open"))
    right = g.edges(g.moves(steps.join(some.select(*KEY), list(KEY), "left_semi"), some))
    return reports.changes(left, right).withColumn("differs", F.array_join("differs", ","))


def show_graph(spark: SparkSession, d: str) -> DataFrame:
    """The lines of the graph's report."""
    steps = event_steps(spark, d)
    made = g.moves(steps, event_sequences(spark, d))
    return reports.show_graph(g.nodes(steps), g.edges(made), g.modal_conditions(made))


def show_sequences(spark: SparkSession, d: str) -> DataFrame:
    """The lines of the report on all sequences."""
    return reports.show_sequences(event_sequences(spark, d), g.sequence_outcomes(event_steps(spark, d))).select("project_dir_key", "line")


_LEVELS_SQL = ", ".join(f"'{x}'" for x in LEVELS)
SAMPLE_CTE = f""", lv AS (SELECT st.user_id, st.epoch, position, outcome, process_type, clean.clean, file, level, substr(sha1(st.user_id || '|' || st.epoch), 1, 1) IN ('0', '1', '2', '3') AS test,
  CASE level WHEN 'class' THEN cls WHEN 'class/program' THEN cls || '/' || program ELSE cls || '/' || program || '/' || ext END AS target FROM st JOIN clean USING (user_id, epoch), (SELECT unnest([{_LEVELS_SQL}]) AS level)),
sm AS (SELECT level, test, target, clean, process_type, position, LAG(target) OVER w AS node, LAG(target, 2) OVER w AS bef, LAG(target, 3) OVER w AS fur, LAG(outcome) OVER w AS pout, coalesce(LAG(file) OVER w = LAG(file, 2) OVER w, FALSE) AS same
  FROM lv WINDOW w AS (PARTITION BY user_id, epoch, level ORDER BY position))
"""


def _ways_sql(ways: list[tuple[str, str, str, str, int]]) -> str:
    """Evaluation of ways (name, list of contexts, weight, asked, least)."""
    rows = " UNION ALL ".join(f"SELECT level, '{n}' AS way, test, target, [{c}] AS cs, {w} AS weight, {a} AS asked, {k} AS least FROM sm WHERE position > 0" for n, c, w, a, k in ways)
    return f"""{SAMPLE_CTE}, vr AS ({rows}),
tc AS (SELECT level, way, target, weight, 0 AS o, '' AS context FROM vr WHERE NOT test AND weight > 0 UNION ALL SELECT level, way, target, weight, i, cs[i] FROM vr, (SELECT unnest([1, 2, 3]) AS i) WHERE NOT test AND weight > 0 AND cs[i] IS NOT NULL),
tb AS (SELECT level, way, o, context, target, SUM(SUM(weight)) OVER (PARTITION BY level, way, o, context) AS total, ROW_NUMBER() OVER (PARTITION BY level, way, o, context ORDER BY SUM(weight) DESC, target) AS rank FROM tc GROUP BY level, way, o, context, target),
ts AS (SELECT *, ROW_NUMBER() OVER () AS id FROM (SELECT level, way, cs, least, target, COUNT(*) AS n FROM vr WHERE test AND asked GROUP BY ALL)),
ti AS (SELECT id, level, way, least, i, cs[i] AS context FROM ts, (SELECT unnest([1, 2, 3]) AS i)),
tq AS (SELECT id, MAX(i) AS o FROM ti JOIN tb ON tb.level = ti.level AND tb.way = ti.way AND tb.o = ti.i AND tb.context = ti.context WHERE rank = 1 AND total >= least GROUP BY id),
pk AS (SELECT ts.*, coalesce(tq.o, 0) AS o, CASE WHEN tq.o IS NULL THEN '' ELSE cs[tq.o] END AS context FROM ts LEFT JOIN tq USING (id)),
sc AS (SELECT pk.level, pk.way, CAST(SUM(n) AS BIGINT) AS tested, CAST(SUM(CASE WHEN h.rank = 1 THEN n ELSE 0 END) AS BIGINT) AS top1, CAST(SUM(CASE WHEN h.rank <= 3 THEN n ELSE 0 END) AS BIGINT) AS top3,
  CAST(SUM(CASE WHEN b.rank = 1 THEN n ELSE 0 END) AS BIGINT) AS base_top1, CAST(SUM(CASE WHEN b.rank <= 3 THEN n ELSE 0 END) AS BIGINT) AS base_top3
  FROM pk LEFT JOIN tb h ON h.level = pk.level AND h.way = pk.way AND h.o = pk.o AND h.context = pk.context AND h.target = pk.target LEFT JOIN tb b ON b.level = pk.level AND b.way = pk.way AND b.o = 0 AND b.target = pk.target GROUP BY ALL),
sz AS (SELECT level, way, CAST(MAX(total) FILTER (o = 0) AS BIGINT) AS trained, COUNT(DISTINCT (o, context)) FILTER (o > 0) AS contexts FROM tb GROUP BY ALL)
"""


_NODES_SQL = """, ns AS (SELECT key, COUNT(*) AS support, SUM(f) AS f, SUM(n) AS n, SUM(s) AS s FROM (SELECT node AS key, CAST(outcome = 'failure' AS INT) AS f, CAST(outcome = 'neutral' AS INT) AS n, CAST(outcome = 'success' AS INT) AS s FROM st
 UNION ALL SELECT e, 0, 0, 0 FROM (SELECT DISTINCT user_id, epoch FROM st), (SELECT unnest(['Start', 'End']) AS e)) GROUP BY key),
c AS (SELECT source, target, process_type, same_file, previous_outcome, COUNT(*) AS n FROM mv GROUP BY ALL),
mo AS (SELECT * FROM c QUALIFY ROW_NUMBER() OVER (PARTITION BY source, target ORDER BY n DESC, process_type, CASE WHEN same_file IS NULL THEN 1 WHEN same_file THEN 2 ELSE 0 END, previous_outcome NULLS LAST) = 1),
es AS (SELECT source, target, COUNT(DISTINCT step_id) AS support FROM mv GROUP BY ALL)
SELECT '0 shape' AS part, 'nodes' AS key, 'nodes ' || COUNT(*) AS line FROM ns UNION ALL SELECT '0 shape', 'edges', 'edges ' || COUNT(*) FROM es
UNION ALL SELECT '1 node', key, key || '  support=' || support || '  n_failure=' || f || '  n_neutral=' || n || '  n_success=' || s FROM ns
UNION ALL SELECT '2 edge', source || ' -> ' || target, source || ' -> ' || target || '  support=' || support || '  process_type=' || process_type || ' same_file=' || coalesce(CAST(same_file AS VARCHAR), 'none') || ' previous_outcome=' || coalesce(previous_outcome, 'none') FROM es JOIN mo USING (source, target)"""

_TOLD_SQL = """, tl AS (SELECT step_id, user_id, epoch, position, ts, outcome, program, process_type, CASE WHEN step_id % 9 = 0 THEN 'Checkin' ELSE cls END AS cls, file || CASE WHEN step_id % 2 = 0 THEN '.py' ELSE '' END AS file, step_id // 2 AS call,
  'step:' || step_id AS me, 'm' || (step_id % 3) || CASE WHEN step_id % 4 = 0 THEN '/subagent' ELSE '' END AS model, '[main ' || substr(sha1(step_id::VARCHAR), 1, 8) || '] done' AS result FROM st),
tw AS (SELECT *, LAG(me) OVER w AS last, LAG(cls) OVER w AS last_class, COUNT(*) OVER (PARTITION BY user_id, epoch, call) AS parts, LAG(me) OVER a AS part, LAG(cls) OVER a AS part_class, first_value(cls) OVER a AS whole_class FROM tl WINDOW w AS (PARTITION BY user_id, epoch ORDER BY position), a AS (PARTITION BY user_id, epoch, call ORDER BY position)),
tr AS (SELECT 'action:call' || call AS s, whole_class AS st, 'composed of' AS p, me AS o, cls AS ot FROM tw WHERE parts > 1
 UNION ALL SELECT me, cls, 'depends on', part, part_class FROM tw WHERE part IS NOT NULL
 UNION ALL SELECT me, cls, 'uses', 'Software Resource:' || program, 'Software Resource' FROM tw
 UNION ALL SELECT me, cls, 'uses', CASE WHEN contains(file, '.') THEN 'File:' ELSE 'Directory:' END || file, CASE WHEN contains(file, '.') THEN 'File' ELSE 'Directory' END FROM tw
 UNION ALL SELECT me, cls, 'has outcome', 'Information Item:outcome=' || outcome, 'Information Item' FROM tw
 UNION ALL SELECT me, cls, 'creates', 'Evaluation Report:' || me || ' ' || outcome, 'Evaluation Report' FROM tw WHERE cls = 'ArtifactEvaluation'
 UNION ALL SELECT me || '/nc', 'Noncompliance Identification', 'creates', 'Noncompliance Register:' || result, 'Noncompliance Register' FROM tw WHERE cls = 'ArtifactEvaluation' AND outcome = 'failure'
 UNION ALL SELECT me || '/nc', 'Noncompliance Identification', 'depends on', me, cls FROM tw WHERE cls = 'ArtifactEvaluation' AND outcome = 'failure'
 UNION ALL SELECT me, cls, 'creates', 'Version:' || substr(sha1(step_id::VARCHAR), 1, 8), 'Version' FROM tw WHERE cls = 'Checkin'
 UNION ALL SELECT 'Stakeholder:' || model, 'Stakeholder', 'is in charge of', me, cls FROM tw
 UNION ALL SELECT 'Prompt:' || user_id || '/p', 'Prompt', 'composed of', me, cls FROM tw
 UNION ALL SELECT 'Prompt:' || user_id || '/p', 'Prompt', 'caused by', 'Intended Process:' || process_type, 'Intended Process' FROM tw WHERE last IS NULL
 UNION ALL SELECT me, cls, 'caused by', 'Intended Activity:' || program, 'Intended Activity' FROM tw WHERE step_id % 5 = 0
 UNION ALL SELECT me, cls, 'framed by', 'Time Interval:' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || '/' || step_id || 'ms', 'Time Interval' FROM tw WHERE step_id % 6 > 0
 UNION ALL SELECT me, cls, 'depends on', last, last_class FROM tw WHERE last IS NOT NULL)
SELECT st AS subject_type, p AS predicate, ot AS object_type, COUNT(*) AS n, COUNT(DISTINCT s) AS subjects, COUNT(DISTINCT o) AS objects, MIN(o) AS least, MAX(o) AS most FROM tr GROUP BY ALL"""

QUERIES = {f.__name__: f for f in (conditioning_levels, prediction_variants, prompt_types, triplet_projections, mark_by_prompt, ingest_dry_run, graph_changes, show_graph, show_sequences)}

ORACLE: dict[str, str] = {
    "conditioning_levels": f"WITH {BASE_SQL}" + _ways_sql([("node", "node", "1", "TRUE", 1), ("outcome", "node || '|' || pout", "1", "TRUE", 1), ("process", "node || '|' || process_type", "1", "TRUE", 1), ("previous", "node || '|' || coalesce(bef, '<start>')", "1", "TRUE", 1)])
    + """, pr AS (SELECT DISTINCT level, node, target FROM sm WHERE position > 0 AND NOT test), ec AS (SELECT level, COUNT(*) AS edges FROM pr GROUP BY level), nc AS (SELECT level, COUNT(DISTINCT k) AS nodes FROM (SELECT level, node AS k FROM pr UNION ALL SELECT level, target FROM pr) GROUP BY level)
SELECT level, way, trained, contexts, tested, top1, top3, base_top1, base_top3, nodes, edges FROM sc JOIN sz USING (level, way) JOIN ec USING (level) JOIN nc USING (level)""",
    "prediction_variants": f"WITH {BASE_SQL}" + _ways_sql([
        ("pair", "node", "1", "TRUE", 1), ("same_file", "node || '|' || CASE WHEN same THEN 'same' ELSE 'other' END", "1", "TRUE", 1), ("pair_on_clean", "node", "1", "clean", 1), ("weighted", "node", "CASE WHEN clean THEN 4 ELSE 1 END", "TRUE", 1),
        ("weighted_on_clean", "node", "CASE WHEN clean THEN 4 ELSE 1 END", "clean", 1), ("only_clean", "node", "CAST(clean AS INT)", "clean", 1), ("backoff_2", "node, bef || '|' || node", "1", "TRUE", 2), ("backoff_3", "node, bef || '|' || node, fur || '|' || bef || '|' || node", "1", "TRUE", 2),
    ]) + "SELECT level, way, trained, contexts, tested, top1, top3, base_top1, base_top3 FROM sc JOIN sz USING (level, way)",
    "prompt_types": r"""WITH t AS (SELECT conv_id, turn, CASE WHEN turn % 7 = 2 THEN '<System-Reminder> ' || text WHEN conv_id % 5 = 1 THEN ' <b>' || substring(text, 1, 11) || '</b>' || chr(10) ELSE text END AS text FROM conversations WHERE role = 'user'),
l AS (SELECT conv_id, CASE WHEN COUNT(*) % 2 = 0 THEN 'BugFix' ELSE 'Enhancement' END AS process_type FROM conversations WHERE conv_id % 3 > 0 GROUP BY conv_id),
h AS (SELECT conv_id, turn, regexp_replace(regexp_replace(coalesce(text, ''), '<[^>]{1,60}>', ' ', 'g'), '^[\t-\r ]+|[\t-\r ]+$', '', 'g') AS plain, regexp_matches(coalesce(text, ''), '(?i)<task-notification>|<system-reminder>|<command-name>|\[SYSTEM NOTIFICATION') AS sent FROM t),
k AS (SELECT conv_id, turn, plain, NOT sent AND length(plain) >= 12 AS human FROM h)
SELECT k.conv_id, turn, CASE WHEN NOT human THEN 'Automated' ELSE coalesce(process_type, 'Unknown') END AS process_type, CASE WHEN NOT human THEN 1.0::DOUBLE WHEN process_type IS NULL THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END AS confidence, CASE WHEN human THEN CAST(length(plain) AS INT) END AS n_chars FROM k LEFT JOIN l ON l.conv_id = k.conv_id""",
    "triplet_projections": f"WITH {BASE_SQL}{_TOLD_SQL}",
    "mark_by_prompt": f"""WITH {BASE_SQL}, sq AS (SELECT user_id, epoch, status, MIN(ts) AS first, 'p' || (user_id % 40) AS prompt, CASE WHEN bool_or(outcome = 'failure') THEN 'failure' WHEN bool_or(outcome = 'success') THEN 'success' ELSE 'neutral' END AS derived FROM st GROUP BY user_id, epoch, status),
bp AS (SELECT * FROM sq QUALIFY ROW_NUMBER() OVER (PARTITION BY prompt ORDER BY first DESC, user_id::VARCHAR DESC, epoch DESC) = 1), op AS (SELECT * FROM sq WHERE status <> 'closed' ORDER BY first DESC, user_id::VARCHAR DESC, epoch DESC LIMIT 1),
mk AS (SELECT DISTINCT conv_id AS mark_id, CASE WHEN conv_id % 7 > 0 THEN 'p' || (conv_id % 50) END AS asked, CASE WHEN conv_id % 2 = 0 THEN 'failure' ELSE 'success' END AS said FROM conversations),
fd AS (SELECT mk.*, bp.prompt, bp.user_id, bp.epoch, bp.derived FROM mk LEFT JOIN bp ON bp.prompt = asked WHERE asked IS NOT NULL UNION ALL SELECT mk.*, op.prompt, op.user_id, op.epoch, op.derived FROM mk LEFT JOIN op ON TRUE WHERE asked IS NULL)
SELECT mark_id, coalesce(prompt, asked) AS prompt_id, user_id::VARCHAR AS conversation_id, epoch AS session_epoch, prompt IS NOT NULL AS stored, CASE WHEN prompt IS NOT NULL THEN said END AS declared_outcome, derived AS derived_outcome,
 CASE WHEN prompt IS NOT NULL THEN CASE WHEN said = derived THEN 'confirmed' ELSE 'overridden' END END AS state, CASE WHEN prompt IS NULL THEN CASE WHEN asked IS NULL THEN '{reports.NONE_OPEN}' ELSE '{reports.NO_PROMPT}' END END AS reason FROM fd""",
    "ingest_dry_run": f"WITH {BASE_SQL}SELECT user_id::VARCHAR AS conversation_id, COUNT(*) FILTER (step_id % 2 = 1) AS recorded, COUNT(*) FILTER (step_id % 2 = 0) + COUNT(*) FILTER (step_id % 3 = 0) AS duplicates FROM st GROUP BY 1",
    "graph_changes": f"""WITH {BASE_SQL}, a AS (SELECT source, target, COUNT(DISTINCT step_id) AS support, SUM(CASE WHEN clean THEN 4.0::DOUBLE ELSE 1.0::DOUBLE END) AS weight FROM mv GROUP BY ALL), b AS (SELECT source, target, COUNT(DISTINCT step_id) AS support, CAST(COUNT(*) AS DOUBLE) AS weight FROM mv WHERE project <> '4' GROUP BY ALL),
f AS (SELECT coalesce(a.source, b.source) AS source, coalesce(a.target, b.target) AS target, CASE WHEN b.source IS NULL THEN 'left' WHEN a.source IS NULL THEN 'right' ELSE 'both' END AS side, a.support AS left_support, b.support AS right_support, a.weight AS left_weight, b.weight AS right_weight FROM a FULL JOIN b ON a.source = b.source AND a.target = b.target)
SELECT source, target, side, concat_ws(',', CASE WHEN left_support IS DISTINCT FROM right_support THEN 'support' END, CASE WHEN left_weight IS DISTINCT FROM right_weight THEN 'weight' END) AS differs, left_support, right_support, left_weight, right_weight FROM f WHERE side <> 'both' OR left_support IS DISTINCT FROM right_support OR left_weight IS DISTINCT FROM right_weight""",
    "show_graph": f"WITH {BASE_SQL}{_NODES_SQL}",
    "show_sequences": f"""WITH {BASE_SQL}SELECT project AS project_dir_key, user_id || '/' || epoch || '/p  process=' || process_type || '  steps=' || COUNT(*) || '  status=' || status || '  derived=' || CASE WHEN bool_or(outcome = 'failure') THEN 'failure' WHEN bool_or(outcome = 'success') THEN 'success' ELSE 'neutral' END || '  declared=none' AS line
FROM st GROUP BY user_id, epoch, project, process_type, status""",
}
