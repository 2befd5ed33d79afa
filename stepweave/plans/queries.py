"""Queries over the given tables, one for each operator, with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stepweave.functions import scalars as fn
from stepweave.plans import graph as g
from stepweave.plans import reach, serve, tools
from stepweave.plans import sequences as s
from stepweave.schema import COUNTERS, KEY
from stepweave.sources import store
from stepweave.sources.adapter import BASE_SQL, event_sequences, event_steps, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
SEQ = ("conversation_id", "session_epoch")
#: Benchmark items that may be broadcast.
LEAK_ITEMS = 100_000


def query(sql: str | None = None, base: bool = True):
    """Registers a function under its name, with its SQL after the base tables."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = f"WITH {BASE_SQL}{sql}" if base else sql
        return f

    return add


def _made(spark: SparkSession, d: str, level: str = "class/program") -> DataFrame:
    return g.moves(event_steps(spark, d), event_sequences(spark, d), level)


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return g.edges(_made(spark, d))


def _micros(c: str):
    return F.unix_micros(c)


# ---- moves, nodes and edges ----


@query("SELECT user_id::VARCHAR AS conversation_id, epoch AS session_epoch, source, target, step_id, same_file, previous_outcome, process_type, clean FROM mv")
def moves(spark, d):
    return _made(spark, d).select(*SEQ, "source", "target", "step_id", "same_file", "previous_outcome", "process_type", "clean")


EDGE_SQL = "SELECT source, target, COUNT(DISTINCT step_id) AS support, COUNT(*) FILTER (outcome = 'failure') AS failures, ROUND(COUNT(*) FILTER (outcome = 'failure') / COUNT(*), 9) AS failure_rate FROM mv {where} GROUP BY ALL"


@query(EDGE_SQL.format(where="WHERE source <> 'Start' AND target <> 'End'"))
def edges_support(spark, d):
    made = _made(spark, d).where(~g.is_bookend())
    return g.edges(made).select("source", "target", "support", "failures", F.round(F.col("failures") / F.col("observations"), 9).alias("failure_rate"))


@query(EDGE_SQL.format(where=""))
def edges_bookends(spark, d):
    return _edges(spark, d).select("source", "target", "support", "failures", F.round(F.col("failures") / F.col("observations"), 9).alias("failure_rate"))


NODE_SQL = """SELECT {key} AS key, COUNT(*) AS support, epoch_us(MAX(ts)) AS last_seen, COUNT(*) FILTER (outcome = 'failure') AS n_failure, COUNT(*) FILTER (outcome = 'neutral') AS n_neutral, COUNT(*) FILTER (outcome = 'success') AS n_success FROM st GROUP BY 1
UNION ALL SELECT 'Start', COUNT(*), epoch_us(MAX(ts)), 0, 0, 0 FROM st WHERE position = 0
UNION ALL SELECT 'End', COUNT(*), epoch_us(MAX(ts)), 0, 0, 0 FROM lg WHERE nnode IS NULL"""


def _nodes(spark, d, level):
    return g.nodes(event_steps(spark, d), level).withColumn("last_seen", _micros("last_seen"))


@query(NODE_SQL.format(key="node"))
def nodes_fold(spark, d):
    return _nodes(spark, d, "class/program")


@query(NODE_SQL.format(key="cls"))
def nodes_by_level_class(spark, d):
    return _nodes(spark, d, "class")


@query(NODE_SQL.format(key="node || '/' || ext"))
def nodes_by_level_ext(spark, d):
    return _nodes(spark, d, "class/program/ext")


@query("SELECT cls AS activity_class, program, ext AS file_ext, COUNT(*) AS support FROM st GROUP BY ROLLUP (cls, program, ext)")
def rollup_levels(spark, d):
    return event_steps(spark, d).rollup("activity_class", "program", "file_ext").agg(F.count("*").alias("support"))


@query("SELECT source, target, SUM(CASE WHEN clean THEN 4.0::DOUBLE ELSE 1.0::DOUBLE END) AS weight FROM mv GROUP BY ALL")
def edge_weight_clean(spark, d):
    return _edges(spark, d).select("source", "target", "weight")


CONDITION_SQL = """, c AS (SELECT source, target, process_type, same_file, previous_outcome, COUNT(*) AS n FROM mv GROUP BY ALL)
SELECT source, target, process_type, same_file, previous_outcome, n FROM c QUALIFY ROW_NUMBER() OVER (PARTITION BY source, target
 ORDER BY n DESC, process_type, CASE WHEN same_file IS NULL THEN 1 WHEN same_file THEN 2 ELSE 0 END, previous_outcome NULLS LAST) = 1"""


@query(CONDITION_SQL)
def edge_modal_condition(spark, d):
    return g.modal_conditions(_made(spark, d)).select("source", "target", "process_type", "same_file", "previous_outcome", "n")


@query("SELECT ROUND(COUNT(*) FILTER (outcome = 'failure') / COUNT(*), 9) AS base_rate FROM mv WHERE source <> 'Start' AND target <> 'End'")
def base_failure_rate(spark, d):
    return g.base_failure_rate(_made(spark, d)).select(F.round("base_rate", 9).alias("base_rate"))


PITFALL_CTE = """, im AS (SELECT * FROM mv WHERE source <> 'Start' AND target <> 'End'),
base AS (SELECT COUNT(*) FILTER (outcome = 'failure') / COUNT(*) AS r FROM im),
pe AS (SELECT source, target, COUNT(DISTINCT step_id) AS support, COUNT(*) FILTER (outcome = 'failure') / COUNT(*) AS rate FROM im GROUP BY ALL),
evd AS (SELECT source, target, template FROM im JOIN st USING (step_id) WHERE im.outcome = 'failure' GROUP BY source, target, template QUALIFY ROW_NUMBER() OVER (PARTITION BY source, target ORDER BY COUNT(*) DESC, template) = 1),
pf AS (SELECT source, target, support, ROUND(rate, 9) AS failure_rate, template AS evidence FROM pe JOIN evd USING (source, target), base WHERE support >= 2 AND rate > r)
"""


OWN_PITFALL_SQL = """, io AS (SELECT * FROM im WHERE project = '0'), bo AS (SELECT COUNT(*) FILTER (outcome = 'failure') / COUNT(*) AS r FROM io),
po0 AS (SELECT source, target, COUNT(DISTINCT step_id) AS support, COUNT(*) FILTER (outcome = 'failure') / COUNT(*) AS rate FROM io GROUP BY ALL),
evo AS (SELECT source, target, template FROM io JOIN st USING (step_id) WHERE io.outcome = 'failure' GROUP BY source, target, template QUALIFY ROW_NUMBER() OVER (PARTITION BY source, target ORDER BY COUNT(*) DESC, template) = 1),
po AS (SELECT source, target, template AS evidence FROM po0 JOIN evo USING (source, target), bo WHERE support >= 2 AND rate > r)
"""


def _pitfalls(spark, d):
    return g.failure_prone(_made(spark, d))


@query(PITFALL_CTE + "SELECT * FROM pf")
def pitfall_failure_prone(spark, d):
    return _pitfalls(spark, d).withColumn("failure_rate", F.round("failure_rate", 9))


RUN_CTE = """, isl AS (SELECT *, position - ROW_NUMBER() OVER (PARTITION BY user_id, epoch, node ORDER BY position) AS island FROM st),
rn AS (SELECT user_id, epoch, node, island, MIN(position) AS begins, MAX(position) AS ends, COUNT(*) AS length FROM isl GROUP BY ALL)
"""


@query(RUN_CTE + "SELECT node, COUNT(*) AS loops FROM rn WHERE length >= 3 GROUP BY node")
def pitfall_repetition_loop(spark, d):
    return g.repetition_loops(event_steps(spark, d))


@query(PITFALL_CTE + RUN_CTE + """, lp AS (SELECT node, COUNT(*) AS loops FROM rn WHERE length >= 3 GROUP BY node)
SELECT e.source, e.target, concat_ws(',', CASE WHEN pf.evidence IS NOT NULL THEN 'failure_prone' END, CASE WHEN lp.node IS NOT NULL THEN 'repetition_loop' END) AS pitfalls
FROM (SELECT DISTINCT source, target FROM mv) e LEFT JOIN pf USING (source, target) LEFT JOIN lp ON lp.node = e.source AND e.source = e.target""")
def edge_pitfalls(spark, d):
    made = _made(spark, d)
    whole = g.assembled_pitfalls(g.edges(made), g.failure_prone(made), g.repetition_loops(event_steps(spark, d)))
    return whole.select("source", "target", F.array_join("pitfalls", ",").alias("pitfalls"))


@query("SELECT epoch_us(coalesce(MAX(ts), TIMESTAMP '1970-01-01')) AS generated_at FROM st")
def generated_at(spark, d):
    return g.generated_at(event_steps(spark, d)).select(F.unix_micros("generated_at").alias("generated_at"))


@query("SELECT source, target, string_agg(step_id, ',' ORDER BY step_id) AS steps FROM (SELECT DISTINCT source, target, step_id FROM mv QUALIFY ROW_NUMBER() OVER (PARTITION BY source, target ORDER BY step_id DESC) <= 50) GROUP BY ALL")
def supporting_merged(spark, d):
    """The supporting steps of even and of odd steps, merged."""
    made = _made(spark, d)
    even, odd = (g.supporting_steps(made.where(f"step_id % 2 = {r}")) for r in (0, 1))
    return g.merge_supporting(even, odd).select("source", "target", F.array_join(F.col("steps").cast("array<string>"), ",").alias("steps"))


@query(RUN_CTE + "SELECT user_id::VARCHAR AS conversation_id, epoch AS session_epoch, node, length FROM rn QUALIFY ROW_NUMBER() OVER (PARTITION BY user_id, epoch ORDER BY ends DESC) = 1")
def trailing_run(spark, d):
    return s.trailing_runs(g.runs(event_steps(spark, d))).select(*SEQ, "node", "length")


@query("SELECT node AS key, template, n, rank FROM (SELECT node, template, COUNT(*) AS n, CAST(ROW_NUMBER() OVER (PARTITION BY node ORDER BY COUNT(*) DESC, template) AS INT) AS rank FROM st GROUP BY node, template) WHERE rank <= 5")
def templates_top5(spark, d):
    return g.top_templates(event_steps(spark, d))


@query("SELECT source, target, string_agg(step_id, ',' ORDER BY step_id) AS steps FROM (SELECT DISTINCT source, target, step_id FROM mv QUALIFY ROW_NUMBER() OVER (PARTITION BY source, target ORDER BY step_id DESC) <= 50) GROUP BY ALL")
def supporting_steps_last50(spark, d):
    return g.supporting_steps(_made(spark, d)).select("source", "target", F.array_join(F.col("steps").cast("array<string>"), ",").alias("steps"))


@query("SELECT node AS key, outcome, COUNT(*) AS n FROM st GROUP BY ALL")
def outcome_histogram(spark, d):
    return event_steps(spark, d).groupBy(g.key_at("class/program").alias("key"), "outcome").agg(F.count("*").alias("n"))


OUTCOME_SQL = "SELECT user_id::VARCHAR AS conversation_id, epoch AS session_epoch, CASE WHEN bool_or(outcome = 'failure') THEN 'failure' WHEN bool_or(outcome = 'success') THEN 'success' ELSE 'neutral' END AS derived_outcome, COUNT(*) AS step_count FROM st GROUP BY ALL"


@query(OUTCOME_SQL)
def sequence_outcome(spark, d):
    return g.sequence_outcomes(event_steps(spark, d)).select(*SEQ, "derived_outcome", "step_count")


@query("SELECT project AS project_dir_key, arg_max(user_id::VARCHAR, (first, -user_id)) AS conversation_id FROM (SELECT project, user_id, epoch, MIN(ts) AS first FROM st WHERE status <> 'closed' GROUP BY ALL) GROUP BY 1")
def latest_open_sequence(spark, d):
    return serve.latest(event_sequences(spark, d), ("project_dir_key",)).select("project_dir_key", "conversation_id")


@query("SELECT user_id::VARCHAR AS conversation_id, MAX(epoch) AS epochs FROM ev GROUP BY 1")
def epochs(spark, d):
    from stepweave.sources.adapter import epochs as numbered

    return numbered(table(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type = 'signup'").groupBy(F.col("user_id").cast("string").alias("conversation_id")).agg(F.max("session_epoch").alias("epochs"))


# ---- store: dedup, high water, merge, diff, prune ----


@query("SELECT COUNT(*) AS recorded, COUNT(*) AS duplicates FROM st")
def dedup_replay(spark, d):
    """Every action arrives twice, half of them after they were stored; the second arrival of a key is a duplicate."""
    steps = event_steps(spark, d).select("step_id", "tool_call_id", "conversation_id")
    keyed = steps.withColumn("dedup_key", fn.dedup_key(F.col("tool_call_id"), F.lit(0), F.col("conversation_id")))
    stored = store.new_steps(keyed.where("step_id % 2 = 0"), None)
    arriving = keyed.unionByName(keyed.where("step_id % 2 = 1"))
    added = store.new_steps(arriving, stored)
    counted = stored.select(F.lit(1).alias("kept")).unionByName(added.select(F.lit(1).alias("kept"))).agg(F.count("*").alias("recorded"))
    return counted.join(F.broadcast(keyed.agg((2 * F.count("*")).alias("arrived")))).select("recorded", (F.col("arrived") - F.col("recorded")).alias("duplicates"))


REBUILT_SQL = "SELECT source, target, COUNT(DISTINCT step_id) AS support, COUNT(*) AS observations, COUNT(*) FILTER (outcome = 'failure') AS failures, COUNT(*) FILTER (outcome = 'success') AS successes, SUM(CASE WHEN clean THEN 4.0::DOUBLE ELSE 1.0::DOUBLE END) AS weight, epoch_us(MAX(ts)) AS last_seen FROM mv GROUP BY ALL"


def _refreshed(spark, d, since, before):
    steps, sequences = event_steps(spark, d), event_sequences(spark, d)
    early = steps.where(F.col("step_id") <= since)
    known = before(sequences).join(early.select(*KEY).distinct(), list(KEY), "left_semi")
    existing = g.edges(g.moves(early, known))
    return g.refresh(existing, steps, sequences, since, before=known).withColumn("last_seen", F.unix_micros("last_seen"))


@query(REBUILT_SQL)
def high_water_delta(spark, d):
    """The graph of the first half of the events, refreshed with the second."""
    half = table(spark, d, "events").agg(F.floor(F.max("event_id") / 2)).first()[0]
    return _refreshed(spark, d, half, lambda sequences: sequences)


@query(REBUILT_SQL)
def refresh_after_close(spark, d):
    """The graph as it was while every sequence was open, refreshed after most have been closed and no step was added."""
    last = table(spark, d, "events").agg(F.max("event_id") + 1).first()[0]
    return _refreshed(spark, d, last, lambda sequences: sequences.withColumn("status", F.lit("open")))


@query("SELECT source, target, COUNT(DISTINCT step_id) AS support, COUNT(*) FILTER (outcome = 'failure') AS failures, SUM(CASE WHEN clean THEN 4.0::DOUBLE ELSE 1.0::DOUBLE END) AS weight FROM mv GROUP BY ALL")
def merge_incremental(spark, d):
    """The fold of closed sequences with the fold of the open ones merged onto it."""
    made = _made(spark, d).join(event_sequences(spark, d).select(*KEY, "status"), list(KEY))
    return g.merge(g.edges(made.where("status = 'closed'")), g.edges(made.where("status <> 'closed'"))).select("source", "target", "support", "failures", "weight")


@query("""SELECT coalesce(a.source, b.source) AS source, coalesce(a.target, b.target) AS target, a.support AS left_support, b.support AS right_support
FROM (SELECT source, target, COUNT(DISTINCT step_id) AS support FROM mv GROUP BY ALL) a FULL JOIN (SELECT source, target, COUNT(DISTINCT step_id) AS support FROM mv WHERE project = '0' GROUP BY ALL) b
ON a.source = b.source AND a.target = b.target WHERE a.support IS DISTINCT FROM b.support""")
def snapshot_diff(spark, d):
    made = _made(spark, d)
    return g.diff(g.edges(made), g.edges(made.where("project_dir_key = '0'")))


@query("""SELECT project AS project_dir_key, COUNT(*) AS sequences, CAST(SUM(n) AS BIGINT) AS steps FROM (SELECT project, user_id, epoch, MIN(ts) AS first, COUNT(*) AS n FROM st GROUP BY ALL)
WHERE first < (SELECT MIN(ts) + INTERVAL 10 DAY FROM events) GROUP BY 1""")
def prune_before(spark, d):
    """What a prune of everything that started in the first ten days would remove."""
    cutoff = table(spark, d, "events").agg((F.min("ts").cast("timestamp") + F.expr("INTERVAL 10 DAY")).alias("cutoff")).first()["cutoff"]
    steps, sequences = event_steps(spark, d), event_sequences(spark, d)
    projects = sequences.select("project_dir_key").distinct()
    kept = store.prune(steps, sequences, F.col("project_dir_key"), cutoff)
    gone = sequences.join(kept[1].select(*KEY), list(KEY), "left_anti")
    lost = steps.join(kept[0].select("step_id"), "step_id", "left_anti").groupBy(*KEY).agg(F.count("*").alias("n"))
    return gone.join(lost, list(KEY)).join(projects, "project_dir_key").groupBy("project_dir_key").agg(F.count("*").alias("sequences"), F.sum("n").alias("steps"))



# ---- n-grams and evaluation ----

NGRAM_CTE = """, lags AS (SELECT *, LAG(node, 1) OVER w AS l1, LAG(node, 2) OVER w AS l2, LAG(node, 3) OVER w AS l3, LAG(file, 1) OVER w AS f1, LAG(file, 2) OVER w AS f2 FROM st WINDOW w AS (PARTITION BY user_id, epoch ORDER BY position)),
cx AS (SELECT user_id, epoch, step_id, 1 AS ord, l1 AS ctx, '@other-file' AS marker, node AS target FROM lags WHERE position >= 1
 UNION ALL SELECT user_id, epoch, step_id, 2, l2 || '|' || l1, CASE WHEN f1 = f2 THEN '@same-file' ELSE '@other-file' END, node FROM lags WHERE position >= 2
 UNION ALL SELECT user_id, epoch, step_id, 3, l3 || '|' || l2 || '|' || l1, CASE WHEN f1 = f2 THEN '@same-file' ELSE '@other-file' END, node FROM lags WHERE position >= 3),
ng AS (SELECT ord, ctx, marker, target, COUNT(*) AS support FROM cx GROUP BY ALL)
"""


def _ngrams(spark, d, n):
    return s.ngrams(s.contexts(event_steps(spark, d)).where(F.col("ord") == n)).drop("ord")


@query(NGRAM_CTE + "SELECT ctx, marker, target, support FROM ng WHERE ord = 1")
def ngram_o1(spark, d):
    return _ngrams(spark, d, 1)


@query(NGRAM_CTE + "SELECT ctx, marker, target, support FROM ng WHERE ord = 2")
def ngram_o2(spark, d):
    return _ngrams(spark, d, 2)


@query(NGRAM_CTE + "SELECT ctx, marker, target, support FROM ng WHERE ord = 3")
def ngram_o3(spark, d):
    return _ngrams(spark, d, 3)


@query(NGRAM_CTE + """, rk AS (SELECT *, SUM(support) OVER (PARTITION BY ord, ctx, marker) AS total, ROW_NUMBER() OVER (PARTITION BY ord, ctx, marker ORDER BY support DESC, target) AS rank FROM ng),
cand AS (SELECT cx.step_id, cx.ord, cx.target, rk.target AS predicted, rk.rank FROM cx JOIN rk USING (ord, ctx, marker) WHERE rk.total >= 2 AND rk.rank = 1)
SELECT step_id, CAST(ord AS INT) AS ord, target, predicted FROM cand QUALIFY ROW_NUMBER() OVER (PARTITION BY step_id ORDER BY ord DESC) = 1""")
def backoff_rank(spark, d):
    asked = s.contexts(event_steps(spark, d))
    return s.backoff(asked, s.ngrams(asked), top=1).select("step_id", "ord", "target", "predicted")


@query("SELECT source, target, COUNT(*) AS n, ROUND(AVG(CASE WHEN same_file THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 9) AS same_file_rate FROM mv WHERE same_file IS NOT NULL GROUP BY ALL")
def same_file_rate(spark, d):
    return _made(spark, d).where("same_file IS NOT NULL").groupBy("source", "target").agg(F.count("*").alias("n"), F.round(F.avg(F.col("same_file").cast("double")), 9).alias("same_file_rate"))


HOLD_CTE = NGRAM_CTE + """, ho AS (SELECT ctx, target, substr(sha1(user_id || '|' || epoch), 1, 1) IN ('0', '1', '2', '3') AS test FROM cx WHERE ord = 1),
tr AS (SELECT ctx, target, ROW_NUMBER() OVER (PARTITION BY ctx ORDER BY COUNT(*) DESC, target) AS rank FROM ho WHERE NOT test GROUP BY ctx, target),
mj AS (SELECT target, ROW_NUMBER() OVER (ORDER BY COUNT(*) DESC, target) AS rank FROM ho WHERE NOT test GROUP BY target)
"""


def _held(spark, d):
    made = s.contexts(event_steps(spark, d), orders=1)
    return made.withColumn("test", s.held_out(F.concat_ws("|", "conversation_id", "session_epoch")))


@query(HOLD_CTE + "SELECT COUNT(*) AS tested, COUNT(*) FILTER (rank = 1) AS top1, COUNT(*) FILTER (rank <= 3) AS top3 FROM ho LEFT JOIN tr USING (ctx, target) WHERE test")
def holdout_eval(spark, d):
    made = _held(spark, d)
    return s.accuracy(made.where("NOT test"), made.where("test"), ["ctx"])


@query(HOLD_CTE + "SELECT COUNT(*) AS tested, COUNT(*) FILTER (rank = 1) AS top1, COUNT(*) FILTER (rank <= 3) AS top3 FROM ho LEFT JOIN mj USING (target) WHERE test")
def majority_baseline(spark, d):
    made = _held(spark, d)
    return s.majority(made.where("NOT test"), made.where("test"))


@query(NGRAM_CTE + """, tp AS (SELECT ctx, target, user_id % 5 AS project FROM cx WHERE ord = 1),
t0 AS (SELECT ctx, target, ROW_NUMBER() OVER (PARTITION BY ctx ORDER BY COUNT(*) DESC, target) AS rank FROM tp WHERE project = 0 GROUP BY ctx, target)
SELECT COUNT(*) AS tested, COUNT(*) FILTER (rank = 1) AS top1, COUNT(*) FILTER (rank <= 3) AS top3 FROM tp LEFT JOIN t0 USING (ctx, target) WHERE project = 1""")
def transfer_eval(spark, d):
    made = s.contexts(event_steps(spark, d), orders=1).withColumn("project", F.col("conversation_id").cast("long") % 5)
    return s.accuracy(made.where("project = 0"), made.where("project = 1"), ["ctx"])


@query("""SELECT ext AS file_ext, COUNT(*) AS changes, CAST(SUM(v) AS BIGINT) AS verified FROM (SELECT ext, cls, coalesce(MAX(CASE WHEN cls = 'ArtifactEvaluation' THEN 1 ELSE 0 END) OVER
(PARTITION BY user_id, epoch ORDER BY position ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING), 0) AS v FROM st) WHERE cls = 'ChangeImplementation' GROUP BY 1""")
def edit_verify_rate(spark, d):
    return s.verify_rate(event_steps(spark, d))


@query(""", bz AS (SELECT file, COUNT(*) AS touches FROM st GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8),
nb AS (SELECT file, touches, cls, ROW_NUMBER() OVER (PARTITION BY file ORDER BY ts, step_id) AS at0, ROW_NUMBER() OVER (PARTITION BY file, cls ORDER BY ts, step_id) AS own FROM st JOIN bz USING (file)),
il AS (SELECT file, touches, cls, MIN(at0) AS begins, COUNT(*) AS n FROM nb GROUP BY file, touches, cls, at0 - own),
fi AS (SELECT * FROM il QUALIFY ROW_NUMBER() OVER (PARTITION BY file ORDER BY begins) <= 12)
SELECT file, touches, string_agg(CASE WHEN n > 1 THEN cls || ' x' || n ELSE cls END, ' > ' ORDER BY begins) AS chain FROM fi GROUP BY ALL""")
def artifact_chains(spark, d):
    return s.touch_chains(event_steps(spark, d))


@query("SELECT predicate, COUNT(*) AS n, COUNT(DISTINCT subject) AS subjects FROM (SELECT 'composed of' AS predicate, user_id || ':' || epoch AS subject FROM st UNION ALL SELECT 'is a', step_id::VARCHAR FROM st UNION ALL SELECT 'has outcome', step_id::VARCHAR FROM st UNION ALL SELECT 'uses', step_id::VARCHAR FROM st UNION ALL SELECT DISTINCT 'has type', user_id || ':' || epoch FROM st) GROUP BY 1")
def triplets_emitted(spark, d):
    return s.triplets(event_steps(spark, d), event_sequences(spark, d)).groupBy("predicate").agg(F.count("*").alias("n"), F.count_distinct("subject").alias("subjects"))


# ---- guidance ----

E_CTE = ", eg AS (SELECT source, target, source || ' -> ' || target AS edge_key, COUNT(DISTINCT step_id) AS support FROM mv GROUP BY ALL), e0 AS (SELECT source, target, source || ' -> ' || target AS edge_key, COUNT(DISTINCT step_id) AS support FROM mv WHERE project = '0' GROUP BY ALL)\n"


@query(E_CTE + """, sc AS (SELECT source, edge_key, support, 1.0::DOUBLE / (60 + ROW_NUMBER() OVER (PARTITION BY source ORDER BY support DESC, edge_key)) AS score, 0 AS wide FROM e0
UNION ALL SELECT source, edge_key, support, 1.0::DOUBLE / (60 + ROW_NUMBER() OVER (PARTITION BY source ORDER BY support DESC, edge_key)), 1 FROM eg),
fu AS (SELECT source, edge_key, SUM(score) AS score, MIN(wide) AS wide FROM sc GROUP BY ALL)
SELECT source, edge_key, ROUND(score, 12) AS score, CASE wide WHEN 0 THEN 'project' ELSE 'global' END AS scope, CAST(ROW_NUMBER() OVER (PARTITION BY source ORDER BY wide, ROUND(score, 12) DESC, edge_key) AS INT) AS place FROM fu""")
def fusion_rrf(spark, d):
    made = _made(spark, d)
    fused = serve.fuse(g.edges(made.where("project_dir_key = '0'")), g.edges(made), ("source",))
    place = F.row_number().over(W.partitionBy("source").orderBy(F.col("scope") == "global", F.desc("score"), "edge_key"))
    return fused.withColumn("score", F.round("score", 12)).withColumn("place", place).select("source", "edge_key", "score", "scope", "place")


@query(RUN_CTE + """, cnt AS (SELECT user_id, epoch, node, position, ROW_NUMBER() OVER (PARTITION BY user_id, epoch, node, island ORDER BY position) AS len FROM isl)
SELECT user_id::VARCHAR AS conversation_id, epoch AS session_epoch, node, MIN(position) AS position FROM cnt WHERE len = 3 AND node IN (SELECT source FROM mv WHERE source = target) GROUP BY ALL""")
def trigger_repetition_latched(spark, d):
    return serve.repetition_firings(event_steps(spark, d), _edges(spark, d)).select(*SEQ, "node", "position")


LIKELY = ", lk AS (SELECT * FROM eg WHERE source <> 'Start' AND target <> 'End' QUALIFY ROW_NUMBER() OVER (PARTITION BY source ORDER BY support DESC, target) = 1)\n"


@query(PITFALL_CTE + E_CTE + LIKELY + "SELECT source, target, pf.support, evidence FROM lk JOIN pf USING (source, target)")
def trigger_pitfall(spark, d):
    return serve.pitfall_firings(_edges(spark, d).where(~g.is_bookend()), _pitfalls(spark, d))


@query(", eu AS (SELECT user_id, source, target, COUNT(DISTINCT step_id) AS support FROM mv WHERE source <> 'Start' AND target <> 'End' GROUP BY ALL), lu AS (SELECT * FROM eu QUALIFY ROW_NUMBER() OVER (PARTITION BY user_id, source ORDER BY support DESC, target) = 1) SELECT user_id::VARCHAR AS conversation_id, source, target, support FROM lu WHERE source LIKE 'ChangeImplementation/%' AND target LIKE 'ArtifactEvaluation/%'")
def trigger_after_write(spark, d):
    """In the graph of each conversation's own moves."""
    own = g.edges(_made(spark, d).where(~g.is_bookend()), scope=("conversation_id",))
    return serve.after_write_firings(own, ("conversation_id",))


@query(E_CTE + """SELECT project AS project_dir_key, COUNT(*) AS asked, COUNT(*) FILTER (strong) AS served, ROUND(COUNT(*) FILTER (strong) / COUNT(*), 9) AS served_ratio
FROM (SELECT project, EXISTS (SELECT 1 FROM eg WHERE eg.source = lg.node AND support >= 40) AS strong FROM lg WHERE nnode IS NULL) GROUP BY 1""")
def served_ratio(spark, d):
    """Of the places where sequences end, the share whose successors reach a support of 40."""
    strong = _edges(spark, d).where("support >= 40").select(F.col("source").alias("node")).distinct().withColumn("strong", F.lit(1))
    asked = serve.locate(event_steps(spark, d)).join(event_sequences(spark, d).select(*KEY, "project_dir_key"), list(KEY)).join(strong, "node", "left")
    counted = asked.groupBy("project_dir_key").agg(F.count("*").alias("asked"), F.count("strong").alias("served"))
    return counted.withColumn("served_ratio", F.round(F.col("served") / F.col("asked"), 9))


@query(E_CTE + """, tx AS (SELECT source, target, edge_key, support, '- ' || CASE source WHEN 'Start' THEN 'a prompt like this usually starts with ' || target ELSE 'after ' || source || ' the work usually goes to ' || target END || ' (' || support || ' episodes)' AS text FROM eg WHERE support >= 2),
bd AS (SELECT *, SUM(length(text)) OVER w + ROW_NUMBER() OVER w - 1 AS held FROM tx WINDOW w AS (PARTITION BY source ORDER BY support DESC, edge_key ROWS UNBOUNDED PRECEDING))
SELECT user_id::VARCHAR AS conversation_id, epoch AS session_epoch, node, bd.target, support, text FROM lg JOIN bd ON node = source WHERE nnode IS NULL AND held <= 1200""")
def recall_position(spark, d):
    return serve.recall(event_steps(spark, d), _edges(spark, d)).select(*SEQ, "node", "target", "support", "text")


OWN_PITFALL_CTE = PITFALL_CTE + OWN_PITFALL_SQL


@query(OWN_PITFALL_CTE + """SELECT source, target, CASE WHEN po.evidence IS NOT NULL THEN 'project' ELSE 'global' END AS scope, coalesce(po.evidence, pf.evidence) || ' is known to fail after ' || source AS reason
FROM (SELECT DISTINCT source, target FROM im) LEFT JOIN po USING (source, target) LEFT JOIN pf USING (source, target) WHERE coalesce(po.evidence, pf.evidence) IS NOT NULL""")
def enforce_lookup(spark, d):
    """Pitfalls of project 0 before those of all projects."""
    made = _made(spark, d)
    asked = made.where(~g.is_bookend()).select("source", "target").distinct()
    return serve.enforce(asked, g.failure_prone(made.where("project_dir_key = '0'")), g.failure_prone(made))


HOP_CTE = ", eo AS (SELECT DISTINCT source, target FROM mv WHERE project = '0'), ss AS (SELECT DISTINCT source AS start FROM eo)\n"


@query(HOP_CTE + """, h1 AS (SELECT start, 1 AS hop, source, target FROM ss JOIN eo ON source = start),
h2 AS (SELECT DISTINCT start, 2, eo.source, eo.target FROM (SELECT DISTINCT start, target AS n FROM h1 WHERE target <> start) JOIN eo ON eo.source = n) SELECT * FROM h1 UNION ALL SELECT * FROM h2""")
def hop2_neighborhood(spark, d):
    pairs = _made(spark, d).where("project_dir_key = '0'").select("source", "target").distinct()
    return reach.neighbourhood(pairs, pairs.select(F.col("source").alias("node")), 2)



@query(None)
def reachable_from_start(spark, d):
    return reach.reachable(_edges(spark, d).where("support >= 3"))


ORACLE["reachable_from_start"] = f"WITH RECURSIVE {BASE_SQL}{E_CTE}, rs AS (SELECT 'Start' AS node UNION SELECT target FROM rs JOIN eg ON eg.source = rs.node WHERE eg.support >= 3) SELECT node FROM rs"


@query(None)
def dead_ends(spark, d):
    return reach.structure(_edges(spark, d).where("support >= 3"))


ORACLE["dead_ends"] = f"""WITH RECURSIVE {BASE_SQL}{E_CTE}, ek AS (SELECT * FROM eg WHERE support >= 3), rs AS (SELECT 'Start' AS node UNION SELECT target FROM rs JOIN ek ON ek.source = rs.node),
re AS (SELECT 'End' AS node UNION SELECT source FROM re JOIN ek ON ek.target = re.node)
SELECT node, node IN (SELECT node FROM rs) AS from_start, node IN (SELECT node FROM re) AS to_end FROM (SELECT source AS node FROM ek UNION SELECT target FROM ek)"""

NOTE_SQL = """, nt AS (SELECT 'note ' || conv_id AS text, CASE WHEN conv_id % 3 = 0 THEN 'Gone -> Gone' ELSE k.edge_key END AS edge_key
 FROM (SELECT DISTINCT conv_id FROM conversations) c JOIN (SELECT edge_key, ROW_NUMBER() OVER (ORDER BY edge_key) - 1 AS i, COUNT(*) OVER () AS n FROM eg) k ON c.conv_id % k.n = k.i)
"""


def _notes(spark, d, edges):
    """A note for each conversation, on an edge that its number picks; every third one on an edge that is gone."""
    keyed = edges.select(g.edge_key(F.col("source"), F.col("target")).alias("edge_key"))
    numbered = keyed.withColumns({"i": F.row_number().over(W.orderBy("edge_key")) - 1, "n": F.count("*").over(W.partitionBy())})
    asked = table(spark, d, "conversations").select("conv_id").distinct()
    size = keyed.agg(F.count("*").alias("n"))
    placed = asked.join(F.broadcast(size)).withColumn("i", F.col("conv_id") % F.col("n")).join(numbered.drop("n"), "i")
    return placed.select(F.concat(F.lit("note "), "conv_id").alias("text"), F.when(F.col("conv_id") % 3 == 0, "Gone -> Gone").otherwise(F.col("edge_key")).alias("edge_key"))


@query(E_CTE + NOTE_SQL + "SELECT eg.edge_key, support, string_agg(text, ';' ORDER BY text) AS notes FROM eg LEFT JOIN nt USING (edge_key) GROUP BY ALL")
def annotations_reattach(spark, d):
    edges = _edges(spark, d)
    return serve.reattach(edges, _notes(spark, d, edges))[0].select("edge_key", "support", F.array_join("notes", ";").alias("notes"))


@query(E_CTE + NOTE_SQL + "SELECT text, edge_key FROM nt WHERE edge_key NOT IN (SELECT edge_key FROM eg)")
def annotations_orphaned(spark, d):
    edges = _edges(spark, d)
    return serve.reattach(edges, _notes(spark, d, edges))[1].select("text", "edge_key")


# ---- texts ----


def _rlike_sql(column: str, rules) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({column}, '{p}') THEN '{n}'" for p, n in rules) + " END"


CREDENTIAL_SQL = _rlike_sql("text", [(p, n) for n, p in fn.CREDENTIALS])


@query(f"SELECT doc_id, {CREDENTIAL_SQL} AS credential FROM documents WHERE {CREDENTIAL_SQL} IS NOT NULL", base=False)
def credential_screen(spark, d):
    return table(spark, d, "documents").select("doc_id", fn.credential(F.col("text")).alias("credential")).where("credential IS NOT NULL")


@query("SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)", base=False)
def leak_containment(spark, d):
    """Which documents hold a benchmark text as it is.

    The second to fourth words of an item, of five words or more, stand as whole words wherever it does; a document is
    looked at only if it has those of some item. Words are hashed once, and three neighbours' hashes make a window's. Shorter
    items are looked for in every text, if there are any. Items are broadcast where a count shows them to be few.
    """
    three = lambda a, b, c: F.xxhash64(F.xxhash64(a, b), c)
    items = table(spark, d, "benchmark").select("item_id", F.col("text").alias("wanted"), F.split("text", " ").alias("iw")).where("wanted IS NOT NULL")
    long = items.where(F.size("iw") >= 5).select("item_id", "wanted", three(*[F.xxhash64(F.get("iw", i)) for i in (1, 2, 3)]).alias("h"))
    sizes = items.select(F.size("iw").alias("n")).limit(LEAK_ITEMS + 1).agg(F.count("*").alias("n"), F.count_if(F.col("n") < 5).alias("short")).first()
    few = sizes["n"] <= LEAK_ITEMS
    small = F.broadcast if few else lambda df: df
    docs = table(spark, d, "documents").select("doc_id", "text").where("text IS NOT NULL")
    words = docs.withColumn("w", F.transform(F.split("text", " "), lambda x: F.xxhash64(x)))
    shifted = lambda n: F.slice("w", n, F.size("w"))
    hashes = F.zip_with(F.zip_with("w", shifted(2), lambda a, b: F.xxhash64(a, b)), shifted(3), lambda ab, c: F.xxhash64(ab, c))
    if few:  # texts stay where they are
        met = words.join(F.broadcast(long.agg(F.collect_set("h").alias("all")))).select("doc_id", "text", F.explode(F.array_intersect(hashes, "all")).alias("h"))
        found = met.join(F.broadcast(long), "h").where(F.contains("text", "wanted"))
    else:
        met = words.select("doc_id", F.explode(F.array_distinct(hashes)).alias("h")).join(long.select("item_id", "h"), "h").select("doc_id", "item_id").distinct()
        found = met.join(docs, "doc_id").join(long, "item_id").where(F.contains("text", "wanted"))
    found = found.select("doc_id", "item_id")
    if not few or sizes["short"]:
        short = items.where(F.size("iw") < 5).select("item_id", "wanted")
        found = found.unionByName(docs.join(small(short), F.contains("text", "wanted")).select("doc_id", "item_id"))
    return found.distinct()


@query("SELECT conv_id, turn, coalesce(" + _rlike_sql("text", fn.OUTCOME_RULES) + ", 'neutral') AS outcome FROM conversations", base=False)
def outcome_regex(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", fn.outcome(F.col("text")).alias("outcome"))


@query("SELECT page_id, substr(sha256(url), 1, 16) AS project_key FROM pages", base=False)
def project_key_sha(spark, d):
    return table(spark, d, "pages").select("page_id", fn.project_key(F.col("url")).alias("project_key"))


@query("""SELECT category, COUNT(*) AS n FROM (SELECT CASE WHEN text IS NULL OR text = '' THEN 'empty' WHEN role NOT IN ('user', 'assistant') THEN 'unknown role' WHEN turn > 0 AND prev IS NULL THEN 'orphan' END AS category
FROM (SELECT *, LAG(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations)) WHERE category IS NOT NULL GROUP BY 1""", base=False)
def skip_reasons(spark, d):
    """Turns that a reader would skip, by reason."""
    rows = table(spark, d, "conversations").withColumn("prev", F.lag("turn").over(W.partitionBy("conv_id").orderBy("turn")))
    reason = F.when(F.coalesce(F.col("text"), F.lit("")) == "", "empty").when(~F.col("role").isin("user", "assistant"), "unknown role").when((F.col("turn") > 0) & F.col("prev").isNull(), "orphan")
    return rows.select(reason.alias("category")).where("category IS NOT NULL").groupBy("category").agg(F.count("*").alias("n"))


@query("SELECT name, coalesce(n, 0) AS n FROM (VALUES " + ", ".join(f"('{c}')" for c in COUNTERS) + ") c(name) LEFT JOIN (SELECT 'steps_recorded' AS name, COUNT(*) AS n FROM st UNION ALL SELECT 'guidance_silent', COUNT(*) FROM st WHERE outcome = 'neutral' UNION ALL SELECT 'guidance_served', COUNT(*) FROM st WHERE outcome <> 'neutral') USING (name)")
def counters_table(spark, d):
    """All known counters, at zero where nothing was counted."""
    from stepweave.sources.store import counters

    steps = event_steps(spark, d)
    log = steps.select(F.explode(F.array(F.lit("steps_recorded"), F.when(F.col("outcome") == "neutral", "guidance_silent").otherwise("guidance_served"))).alias("name"))
    return counters(log)


@query("SELECT declared, derived, COUNT(*) AS n, CASE WHEN declared = derived THEN 'confirmed' ELSE 'overridden' END AS state FROM (SELECT CASE quality WHEN 1 THEN 'success' ELSE 'failure' END AS declared, CASE toxic WHEN 1 THEN 'failure' ELSE 'success' END AS derived FROM labels) GROUP BY ALL", base=False)
def outcome_agreement(spark, d):
    both = table(spark, d, "labels").select(F.when(F.col("quality") == 1, "success").otherwise("failure").alias("declared"), F.when(F.col("toxic") == 1, "failure").otherwise("success").alias("derived"))
    return both.groupBy("declared", "derived").agg(F.count("*").alias("n")).withColumn("state", F.when(F.col("declared") == F.col("derived"), "confirmed").otherwise("overridden"))


# ---- tools and filters ----


@query("SELECT user_id::VARCHAR AS conversation_id, epoch AS session_epoch, position, node, position + 1 AS length, (SELECT COUNT(DISTINCT b.node) FROM st b WHERE b.user_id = a.user_id AND b.epoch = a.epoch AND b.position <= a.position) AS seen FROM st a")
def prefix_replay(spark, d):
    made = tools.prefixes(event_steps(spark, d), g.key_at("class/program"))
    return made.select(*SEQ, "position", "node", "length", F.col("seen").cast("long").alias("seen"))


@query("SELECT node AS key, COUNT(*) AS support FROM st WHERE ts >= TIMESTAMP '2024-01-10' AND ts < (SELECT MAX(ts) FROM events) GROUP BY 1")
def time_range_filter(spark, d):
    last = table(spark, d, "events").agg(F.max("ts").cast("timestamp")).first()[0]
    return tools.between(event_steps(spark, d), F.to_timestamp(F.lit("2024-01-10")), F.lit(last)).groupBy(g.key_at("class/program").alias("key")).agg(F.count("*").alias("support"))


@query("SELECT node || '/' || ext AS key, node || ',' || cls AS is_a, COUNT(*) AS support FROM st GROUP BY ALL")
def is_a_projection(spark, d):
    steps = event_steps(spark, d)
    return steps.select(g.key_at("class/program/ext").alias("key"), F.array_join(tools.is_a("class/program/ext"), ",").alias("is_a")).groupBy("key", "is_a").agg(F.count("*").alias("support"))


@query("SELECT CASE event_type WHEN 'click' THEN 'Inspection' WHEN 'view' THEN 'Search' ELSE 'Unknown' END AS activity_class, COUNT(*) AS n FROM events GROUP BY 1", base=False)
def tool_vocabulary(spark, d):
    from stepweave.sources.packs import classify_tools

    dim = spark.createDataFrame([("click", "Inspection"), ("view", "Search")], "tool_name string, tool_class string")
    return classify_tools(table(spark, d, "events").select("event_type"), dim, "event_type").groupBy("activity_class").agg(F.count("*").alias("n"))


@query("SELECT user_id::VARCHAR AS conversation_id, epoch AS session_epoch, derived_outcome, declared AS declared_outcome, CASE WHEN declared = derived_outcome THEN 'confirmed' WHEN declared IS NOT NULL THEN 'overridden' END AS state FROM (SELECT user_id, epoch, CASE WHEN bool_or(outcome = 'failure') THEN 'failure' WHEN bool_or(outcome = 'success') THEN 'success' ELSE 'neutral' END AS derived_outcome, CASE WHEN epoch % 2 = 0 THEN arg_max(outcome, position) END AS declared FROM st GROUP BY user_id, epoch)")
def mark_outcome(spark, d):
    """The outcome of the last step, declared for every second epoch, beside the derived one."""
    steps = event_steps(spark, d)
    said = steps.where("session_epoch % 2 = 0").select(*KEY, F.col("outcome").alias("declared_outcome"), F.col("position").alias("declared_at"))
    return tools.declare(g.sequence_outcomes(steps), said).select(*SEQ, "derived_outcome", "declared_outcome", "state")


@query("SELECT source || ' -> ' || target AS key, support, weight FROM (SELECT source, target, COUNT(DISTINCT step_id) AS support, SUM(CASE WHEN clean THEN 4.0::DOUBLE ELSE 1.0::DOUBLE END) AS weight FROM mv GROUP BY ALL)")
def served_edges(spark, d):
    """The served documents, read back from their JSON bodies."""
    made = tools.served_document(g.nodes(event_steps(spark, d)), tools.inspect_edges(_edges(spark, d)))
    return made.where("kind = 'edge'").select("key", F.from_json("body", "support long, weight double").alias("b")).select("key", "b.*")


@query("SELECT program, COUNT(DISTINCT template) AS templates, COUNT(*) FILTER (contains(template, 't3')) AS with_t3 FROM st GROUP BY 1")
def template_counts(spark, d):
    return event_steps(spark, d).groupBy("program").agg(F.count_distinct("template").alias("templates"), F.count_if(F.contains("template", F.lit("t3"))).alias("with_t3"))


CONDITIONING = {"node": "ctx", "outcome": "ctx, pout", "process": "ctx, ptype", "previous": "ctx, l2"}


@query(NGRAM_CTE + """, cd AS (SELECT lags.user_id, lags.epoch, l1 AS ctx, node AS target, LAG(outcome) OVER (PARTITION BY user_id, epoch ORDER BY position) AS pout, process_type AS ptype, coalesce(l2, '') AS l2, position,
 substr(sha1(user_id || '|' || epoch), 1, 1) IN ('0', '1', '2', '3') AS test FROM lags)
""" + " UNION ALL ".join(f"""SELECT '{name}' AS conditioning, COUNT(*) AS tested, COUNT(*) FILTER (rank = 1) AS top1, COUNT(*) FILTER (rank <= 3) AS top3 FROM (SELECT * FROM cd WHERE test AND position > 0) LEFT JOIN
 (SELECT {on}, target, ROW_NUMBER() OVER (PARTITION BY {on} ORDER BY COUNT(*) DESC, target) AS rank FROM cd WHERE NOT test AND position > 0 GROUP BY {on}, target) USING ({on}, target)""" for name, on in CONDITIONING.items()))
def conditioning_eval(spark, d):
    """Next-step accuracy given the node alone, and with outcome, process type or the node before."""
    chain = W.partitionBy(*KEY).orderBy("position")
    seq = event_sequences(spark, d).select(*KEY, F.col("process_type").alias("ptype"))
    node = g.key_at("class/program")
    made = event_steps(spark, d).withColumns({"target": node, "ctx": F.lag(node).over(chain), "pout": F.lag("outcome").over(chain), "l2": F.coalesce(F.lag(node, 2).over(chain), F.lit(""))}).join(seq, list(KEY)).where("position > 0").withColumn("test", s.held_out(F.concat_ws("|", "conversation_id", "session_epoch")))
    parts = [s.accuracy(made.where("NOT test"), made.where("test"), on.split(", ")).select(F.lit(name).alias("conditioning"), "*") for name, on in CONDITIONING.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ---- larger chains: orders of customers, and turns of conversations ----


@query("""SELECT source, target, COUNT(*) AS n FROM (SELECT LAG(o_orderpriority) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS source, o_orderpriority AS target FROM orders) WHERE source IS NOT NULL GROUP BY ALL""", base=False)
def order_chains(spark, d):
    chain = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, d, "orders").select(F.lag("o_orderpriority").over(chain).alias("source"), F.col("o_orderpriority").alias("target")).where("source IS NOT NULL").groupBy("source", "target").agg(F.count("*").alias("n"))


@query("""SELECT source, target, COUNT(*) AS n, CAST(SUM(l_quantity) AS DOUBLE) AS quantity FROM (SELECT LAG(l_returnflag || l_linestatus) OVER w AS source, l_returnflag || l_linestatus AS target, l_quantity FROM lineitem
WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber)) WHERE source IS NOT NULL GROUP BY ALL""", base=False)
def lineitem_chains(spark, d):
    chain = W.partitionBy("l_suppkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber")
    flag = F.concat("l_returnflag", "l_linestatus")
    return table(spark, d, "lineitem").select(F.lag(flag).over(chain).alias("source"), flag.alias("target"), "l_quantity").where("source IS NOT NULL").groupBy("source", "target").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))


@query("SELECT source, target, COUNT(*) AS n FROM (SELECT coalesce(LAG(role) OVER w, 'Start') AS source, role AS target FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) GROUP BY ALL", base=False)
def role_moves(spark, d):
    chain = W.partitionBy("conv_id").orderBy("turn")
    return table(spark, d, "conversations").select(F.coalesce(F.lag("role").over(chain), F.lit("Start")).alias("source"), F.col("role").alias("target")).groupBy("source", "target").agg(F.count("*").alias("n"))
