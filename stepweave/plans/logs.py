"""Queries from raw logs to steps and graphs. The logs are the `events` table written as transcripts and as hook payloads."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stepweave.functions import scalars as fn
from stepweave.plans import graph as g
from stepweave.plans import record, snapshot
from stepweave.plans.queries import CONDITION_SQL, PITFALL_CTE, RUN_CTE
from stepweave.schema import KEY
from stepweave.sources import lines, packs, transcript
from stepweave.sources.adapter import BASE_SQL, event_sequences, event_steps, table
from stepweave.sources.arrival import high_water, shared_folder, spread, written
from stepweave.streaming.grow import closed_by_later_epochs, grow, latest
from stepweave.streaming.lifecycle import ROTATE, STEP, current_sequences, follow

HOME = "/home/u"


def _events(spark: SparkSession, d: str) -> DataFrame:
    """Events with their rank within their user, and what each did: a tool, its arguments, its result.

    They are dealt out by the name of the user's log, as the reader of logs wants them, so that its rows need not be shuffled again.
    """
    k = F.get_json_object("props", "$.k").cast("int")
    rank = F.row_number().over(W.partitionBy("file").orderBy("ts", "event_id"))
    path = F.concat(F.lit("/p/src/f"), F.col("k") % 8, F.lit(".py"))
    command = F.concat(F.lit("cat notes"), F.col("k") % 3, F.lit(".md && pytest -q tests | tail -n 5"))
    named = table(spark, d, "events").withColumns({"k": k, "file": F.concat(F.lit("u"), "user_id")})
    return spread(named, "file").select(
        "file", "event_id", "user_id", "event_type", F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("at"), rank.alias("r"),
        F.element_at(F.array(F.lit("Read"), F.lit("Grep"), F.lit("Edit"), F.lit("Bash")), F.col("k") % 4 + 1).alias("tool"),
        F.to_json(F.struct(F.when(F.col("k") % 4 == 3, command).alias("command"), F.when((F.col("k") % 4).isin(0, 2), path).alias("file_path"), F.when(F.col("k") % 4 == 1, "x").alias("pattern"))).alias("arguments"),
        F.when(F.col("event_type") == "error", "1 failed, 2 passed").when(F.col("event_type") == "purchase", "3 passed").otherwise("ok").alias("result"),
    )


def transcript_lines(spark: SparkSession, d: str) -> DataFrame:
    """(file, ordinal, line): a transcript for each user; a signup is a turn of the user, any other event a call and its result.

    Every seventh event leaves a line that is no record.
    """
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    line = lambda kind, uuid, content: F.to_json(F.struct(F.lit(kind).alias("type"), uuid.alias("uuid"), F.col("user_id").cast("string").alias("sessionId"), F.lit("/p").alias("cwd"), F.col("at").alias("timestamp"), message(kind, content).alias("message")))
    call = line("assistant", F.concat(F.lit("a"), "event_id"), F.array(F.struct(F.lit("tool_use").alias("type"), F.concat(F.lit("t"), "event_id").alias("id"), F.col("tool").alias("name"), F.from_json("arguments", "map<string,string>").alias("input"))))
    answer = line("user", F.concat(F.lit("r"), "event_id"), F.array(F.struct(F.lit("tool_result").alias("type"), F.concat(F.lit("t"), "event_id").alias("tool_use_id"), F.col("result").alias("content"))))
    turn = line("user", F.concat(F.lit("e"), "event_id"), F.lit("please"))
    told = F.when(F.col("event_type") == "signup", F.array(turn)).otherwise(F.array(call, answer))
    told = F.concat(told, F.when(F.col("event_id") % 7 == 0, F.array(F.lit("torn {"))).otherwise(F.array().cast("array<string>")))
    rows = _events(spark, d).select("file", "r", F.posexplode_outer(told).alias("n", "line"))  # never empty; the other form would write every line twice, to look for empty ones
    return rows.select("file", (F.col("r") * 3 + F.col("n")).cast("int").alias("ordinal"), "line")


def _transcript(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return transcript.events(transcript.parsed(transcript_lines(spark, d)))


def transcript_steps(spark: SparkSession, d: str) -> DataFrame:
    """Transcripts to numbered steps; calls before the first turn of a user have the prompt ''."""
    made = record.steps_of(_transcript(spark, d)[0], packs.default_tools(spark), HOME)
    return made.select("step_id", "conversation_id", "prompt_id", "position", "activity_class", "program", "file_ext", "template", F.array_join("files", ",").alias("files"), "outcome", "dedup_key", F.unix_micros("occurred_at").alias("at"))


def transcript_skips(spark: SparkSession, d: str) -> DataFrame:
    """Records of the transcripts that give no event, by reason."""
    return _transcript(spark, d)[1].groupBy("category").agg(F.count("*").alias("n"))


def transcript_refresh(spark: SparkSession, d: str) -> DataFrame:
    """Edges after the transcripts grew: the first records of each file, then all of them, those read before included."""
    events, tools = written(_transcript(spark, d)[0]), packs.default_tools(spark)
    early = written(record.steps_of(events.where("record <= 30"), tools, HOME))
    late = written(record.steps_of(events, tools, HOME, stored=early))
    opened = record.open_sequences(early)
    existing = g.edges(g.moves(early, opened))
    steps = early.unionByName(late)
    return g.refresh(existing, steps, record.open_sequences(late, opened), high_water(early)).select("source", "target", "support", "failures", "weight", F.unix_micros("last_seen").alias("last_seen"))


def hook_steps(spark: SparkSession, d: str) -> DataFrame:
    """Payloads without call ids to steps: every activity of a compound line has a key of its own, repeats of a call are one step."""
    rows = _events(spark, d).withColumn("prompt", F.concat(F.lit("p"), F.col("r") % 5))
    payload = F.to_json(F.struct(
        F.lit("PostToolUse").alias("hook_event_name"), F.col("user_id").cast("string").alias("session_id"), "prompt", F.when(F.col("event_id") % 11 > 0, F.col("prompt")).alias("prompt_id"), F.lit("/p").alias("cwd"),
        F.col("tool").alias("tool_name"), F.from_json("arguments", "map<string,string>").alias("tool_input"), F.col("result").alias("tool_result"),
    ))
    events, _ = transcript.hook_events(rows.select("event_id", payload.alias("value")))
    made = record.steps_of(events.withColumn("occurred_at", F.timestamp_seconds("event_id")), packs.default_tools(spark), HOME, order=("event_id",))
    return made.select("step_id", "conversation_id", "prompt_id", "position", "program", "dedup_key")


def transcript_source(spark: SparkSession, d: str) -> DataFrame:
    """Transcripts of sixteen users a file, written out and read by ranges of 256 kB; the folder of every tenth user is denied."""
    folder = f"{shared_folder(spark)}/logs-{uuid.uuid4().hex}"
    user = F.substring("file", 2, 20).cast("long")
    moved = F.when(user % 10 == 3, F.replace("line", F.lit('"cwd":"/p"'), F.lit('"cwd":"/private/q"'))).otherwise(F.col("line"))
    rows = transcript_lines(spark, d).select(F.floor(user / 16).alias("log"), user.alias("user"), "ordinal", moved.alias("value"))
    rows.repartition("log").sortWithinPartitions("log", "user", "ordinal").select("log", "value").write.partitionBy("log").text(folder)
    kept, _ = lines.permitted(lines.records(spark, folder, "*.txt", split=1 << 18), ["# not these", "/private/*"])
    found, _ = transcript.events(transcript.parsed(kept))
    return found.select(F.regexp_extract("file", "/log=([0-9]+)/", 1).cast("long").alias("log"), "record", "conversation_id", "prompt_id", "tool_call_id")


def _grown(spark: SparkSession, d: str) -> snapshot.State:
    """The graph after the steps of `events` came as a stream in three batches, the second one twice."""
    folder = f"{shared_folder(spark)}/grown-{uuid.uuid4().hex}"
    steps = event_steps(spark, d).join(event_sequences(spark, d).select(*KEY, "project_dir_key", "process_type"), list(KEY))
    keyed = written(steps.withColumn("dedup_key", fn.dedup_key(F.col("tool_call_id"), F.lit(0))))
    third = F.pmod(F.floor(F.col("step_id") * 3 / (F.lit(high_water(keyed)) + 1)), F.lit(3))
    # an epoch is closed by the next one's first step; one that has none yet stays open for now
    for part in range(3):
        keyed.where(third == part).write.mode("append").parquet(f"{folder}/in")
        if part == 2:
            keyed.where(third == 1).write.mode("append").parquet(f"{folder}/in")
        grow(spark.readStream.schema(keyed.schema).parquet(f"{folder}/in"), f"{folder}/store", f"{folder}/state", closed_by_later_epochs, buckets=8)
    return latest(spark, f"{folder}/store")[1]


def stream_snapshot_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges of the grown graph with modal condition, supporting steps and pitfalls."""
    state = _grown(spark, d)
    on = ["source", "target"]
    whole = g.assembled_pitfalls(snapshot.edges(state), snapshot.pitfalls(state), state.loops)
    both = whole.join(snapshot.conditions(state), on).join(snapshot.supporting(state), on)
    return both.select(*on, "support", "failures", "weight", F.unix_micros("last_seen").alias("last_seen"), "process_type", "same_file", "previous_outcome", "n", F.array_join(F.col("steps").cast("array<string>"), ",").alias("steps"), F.array_join("pitfalls", ",").alias("pitfalls"))


def stream_snapshot_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Nodes of the grown graph with their templates."""
    state = _grown(spark, d)
    top = snapshot.templates(state).groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.concat_ws(":", "template", "n").alias("t")))), lambda x: x["t"]), ",").alias("templates"))
    return snapshot.nodes(state).join(top, "key", "left").withColumn("last_seen", F.unix_micros("last_seen"))


def sequence_lifecycle(spark: SparkSession, d: str) -> DataFrame:
    """Sequences of `events` as a stream in three parts: a signup rotates the epoch and ends what is open, an event opens what is not."""
    folder = f"{shared_folder(spark)}/lifecycle-{uuid.uuid4().hex}"
    kind = F.when(F.col("event_type") == "signup", ROTATE).otherwise(STEP)
    marked = written(table(spark, d, "events").select(
        F.col("user_id").cast("string").alias("conversation_id"), F.lit("p").alias("prompt_id"), F.lit("").alias("agent_id"), kind.alias("kind"),
        F.when(F.col("event_type") == "error", "failure").when(F.col("event_type") == "purchase", "success").otherwise("neutral").alias("outcome"), F.col("ts").cast("timestamp").alias("at"), F.struct("ts", "event_id").alias("arrival"),
    ).withColumn("arrival", F.unix_micros(F.col("arrival.ts").cast("timestamp")) * 1000 + F.col("arrival.event_id") % 1000))
    cut = marked.agg(F.percentile_approx("arrival", [0.33, 0.66])).first()[0]
    part = F.when(F.col("arrival") <= (cut or [0, 0])[0], 0).when(F.col("arrival") <= (cut or [0, 0])[1], 1).otherwise(2)
    for n in range(3):  # the query stops after each part and starts again from its checkpoint
        marked.where(part == n).write.mode("append").parquet(f"{folder}/in")
        follow(spark.readStream.schema(marked.schema).parquet(f"{folder}/in"), f"{folder}/changes", f"{folder}/state")
    found = current_sequences(spark.read.parquet(f"{folder}/changes"))
    return found.select("conversation_id", "session_epoch", "status", "steps", "failed", F.unix_micros("started_at").alias("started_at"))


_RAW_SQL = """ev AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events),
act AS (SELECT ev.*, part, CASE k % 4 WHEN 0 THEN 'Read' WHEN 1 THEN 'Grep' WHEN 2 THEN 'Edit' ELSE ['cat', 'pytest', 'tail'][part + 1] END AS program,
  CASE k % 4 WHEN 0 THEN 'Inspection' WHEN 1 THEN 'Search' WHEN 2 THEN 'ChangeImplementation' ELSE ['Inspection', 'ArtifactEvaluation', 'Inspection'][part + 1] END AS activity_class,
  CASE k % 4 WHEN 0 THEN 'Read file_path' WHEN 1 THEN 'Grep pattern' WHEN 2 THEN 'Edit file_path' ELSE ['cat <File>', 'pytest -q tests', 'tail -n <N>'][part + 1] END AS template,
  CASE WHEN k % 4 IN (0, 2) THEN 'src/f' || (k % 8) || '.py' WHEN k % 4 = 3 AND part = 0 THEN 'notes' || (k % 3) || '.md' ELSE '' END AS files,
  CASE WHEN k % 4 IN (0, 2) THEN 'py' WHEN k % 4 = 3 AND part = 0 THEN 'md' ELSE '--' END AS file_ext,
  CASE event_type WHEN 'error' THEN 'failure' WHEN 'purchase' THEN 'success' ELSE 'neutral' END AS outcome
  FROM ev, (SELECT unnest([0, 1, 2]) AS part) WHERE part = 0 OR k % 4 = 3)"""
_STEPS_SQL = f"""{_RAW_SQL},
turns AS (SELECT event_id, LAST_VALUE(CASE WHEN event_type = 'signup' THEN 'e' || event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS prompt_id FROM ev),
ts0 AS (SELECT act.*, coalesce(prompt_id, '') AS prompt_id, CAST(user_id AS VARCHAR) AS conversation_id FROM act JOIN turns USING (event_id) WHERE event_type <> 'signup'),
steps AS (SELECT *, ROW_NUMBER() OVER (ORDER BY 'u' || user_id, r, part) AS step_id, ROW_NUMBER() OVER (PARTITION BY user_id, prompt_id ORDER BY r, part) - 1 AS position FROM ts0)"""

#: The base tables where an epoch is closed once a later one has a step.
GROWN_SQL = BASE_SQL.replace("mx AS (SELECT user_id, MAX(epoch) AS mxe FROM ev GROUP BY user_id)", "mx AS (SELECT user_id, MAX(epoch) AS mxe FROM ev WHERE event_type <> 'signup' GROUP BY user_id)")

QUERIES = {f.__name__: f for f in (transcript_steps, transcript_skips, transcript_source, transcript_refresh, hook_steps, stream_snapshot_edges, stream_snapshot_nodes, sequence_lifecycle)}
ORACLE = {
    "transcript_steps": f"WITH {_STEPS_SQL} SELECT step_id, conversation_id, prompt_id, position, activity_class, program, file_ext, template, files, outcome, 't' || event_id || '#' || part AS dedup_key, epoch_us(ts) AS at FROM steps",
    "transcript_skips": "SELECT 'not JSON' AS category, COUNT(*) AS n FROM events WHERE event_id % 7 = 0 HAVING COUNT(*) > 0",
    "transcript_source": f"""WITH {_RAW_SQL},
ln AS (SELECT event_id, user_id, event_type, user_id // 16 AS log, r, n FROM ev, (SELECT unnest([0, 1, 2]) AS n) WHERE n < CASE WHEN event_type = 'signup' THEN 1 ELSE 2 END + CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END),
pl AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY log ORDER BY user_id, r, n) - 1 AS record FROM ln),
said AS (SELECT *, LAST_VALUE(CASE WHEN event_type = 'signup' AND n = 0 THEN 'e' || event_id END IGNORE NULLS) OVER (PARTITION BY log ORDER BY record ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS prompt_id FROM pl WHERE user_id % 10 <> 3)
SELECT log, record, CAST(user_id AS VARCHAR) AS conversation_id, prompt_id, 't' || event_id AS tool_call_id FROM said WHERE n = 1 AND event_type <> 'signup'""",
    "transcript_refresh": f"""WITH {_STEPS_SQL},
lg AS (SELECT *, activity_class || '/' || program AS node, LAG(activity_class || '/' || program) OVER w AS pnode, LEAD(program) OVER w AS nprogram FROM steps WINDOW w AS (PARTITION BY user_id, prompt_id ORDER BY position)),
mv AS (SELECT coalesce(pnode, 'Start') AS source, node AS target, outcome, ts FROM lg UNION ALL SELECT node, 'End', outcome, ts FROM lg WHERE nprogram IS NULL)
SELECT source, target, COUNT(*) AS support, COUNT(*) FILTER (outcome = 'failure') AS failures, CAST(COUNT(*) AS DOUBLE) AS weight, epoch_us(MAX(ts)) AS last_seen FROM mv GROUP BY ALL""",
    "hook_steps": f"""WITH {_RAW_SQL},
said AS (SELECT *, CAST(user_id AS VARCHAR) AS conversation_id, 'p' || (r % 5) AS prompt_id, CASE k % 4 WHEN 0 THEN 'Read' WHEN 1 THEN 'Grep' WHEN 2 THEN 'Edit' ELSE 'Bash' END AS tool,
  CASE k % 4 WHEN 1 THEN '{{"pattern":"x"}}' WHEN 3 THEN '{{"command":"cat notes' || (k % 3) || '.md && pytest -q tests | tail -n 5"}}' ELSE '{{"file_path":"/p/src/f' || (k % 8) || '.py"}}' END AS arguments FROM act WHERE event_id % 11 > 0),
keyed AS (SELECT *, 'syn-' || substr(sha256(conversation_id || '|0|' || prompt_id || '||' || part || '|' || tool || '|' || arguments), 1, 24) AS dedup_key FROM said),
once AS (SELECT * FROM keyed QUALIFY ROW_NUMBER() OVER (PARTITION BY dedup_key ORDER BY event_id, part) = 1)
SELECT ROW_NUMBER() OVER (ORDER BY event_id, part) AS step_id, conversation_id, prompt_id, ROW_NUMBER() OVER (PARTITION BY conversation_id, prompt_id ORDER BY event_id, part) - 1 AS position, program, dedup_key FROM once""",
    "stream_snapshot_edges": f"""WITH {GROWN_SQL}{PITFALL_CTE}{RUN_CTE}, lp AS (SELECT node, COUNT(*) AS loops FROM rn WHERE length >= 3 GROUP BY node),
ed AS (SELECT source, target, COUNT(*) AS support, COUNT(*) FILTER (outcome = 'failure') AS failures, SUM(CASE WHEN clean THEN 4.0::DOUBLE ELSE 1.0::DOUBLE END) AS weight, epoch_us(MAX(ts)) AS last_seen FROM mv GROUP BY ALL),
co AS (SELECT * FROM ({CONDITION_SQL.replace(', c AS', 'WITH c AS', 1)})),
su AS (SELECT source, target, string_agg(step_id, ',' ORDER BY step_id) AS steps FROM (SELECT source, target, step_id FROM mv QUALIFY ROW_NUMBER() OVER (PARTITION BY source, target ORDER BY step_id DESC) <= 50) GROUP BY ALL)
SELECT ed.*, process_type, same_file, previous_outcome, n, steps, concat_ws(',', CASE WHEN pf.evidence IS NOT NULL THEN 'failure_prone' END, CASE WHEN lp.node IS NOT NULL THEN 'repetition_loop' END) AS pitfalls
FROM ed JOIN co USING (source, target) JOIN su USING (source, target) LEFT JOIN pf USING (source, target) LEFT JOIN lp ON lp.node = ed.source AND ed.source = ed.target""",
    "stream_snapshot_nodes": f"""WITH {GROWN_SQL}, tp AS (SELECT node AS key, string_agg(template || ':' || n, ',' ORDER BY n DESC, template) AS templates FROM (SELECT node, template, COUNT(*) AS n FROM st GROUP BY node, template QUALIFY ROW_NUMBER() OVER (PARTITION BY node ORDER BY COUNT(*) DESC, template) <= 5) GROUP BY node),
nd AS (SELECT node AS key, COUNT(*) AS support, epoch_us(MAX(ts)) AS last_seen, COUNT(*) FILTER (outcome = 'failure') AS n_failure, COUNT(*) FILTER (outcome = 'neutral') AS n_neutral, COUNT(*) FILTER (outcome = 'success') AS n_success FROM st GROUP BY node
  UNION ALL SELECT 'Start', COUNT(*), epoch_us(MAX(ts)), 0, 0, 0 FROM st WHERE position = 0 UNION ALL SELECT 'End', COUNT(*), epoch_us(MAX(ts)), 0, 0, 0 FROM lg WHERE nnode IS NULL)
SELECT nd.*, templates FROM nd LEFT JOIN tp USING (key)""",
    "sequence_lifecycle": f"WITH {BASE_SQL} SELECT CAST(st.user_id AS VARCHAR) AS conversation_id, epoch AS session_epoch, CASE WHEN epoch < mxe THEN 'closed' ELSE 'open' END AS status, COUNT(*) AS steps, COUNT(*) FILTER (outcome = 'failure') AS failed, epoch_us(MIN(ts)) AS started_at FROM st JOIN mx ON mx.user_id = st.user_id GROUP BY ALL",
}
