from pyspark.sql import Observation
from pyspark.sql import functions as F

from stepweave.plans import prompts
from stepweave.sources.store import counted, log_counts, totals

EDGE = "project_dir_key string, source string, target string, support long, process_type string"
PROMPT = "conversation_id string, session_epoch long, prompt_id string, agent_id string, project_dir string, project_dir_key string"


def asked(spark, *projects):
    rows = [(f"c{n}", 0, "p", "", f"/w/{p}", p) for n, p in enumerate(projects)]
    return spark.createDataFrame(rows, PROMPT).withColumn("at", F.timestamp_seconds(F.lit(5)))


def told(spark, edges, notes=(), projects=("a",), **more):
    own = spark.createDataFrame([e for e in edges if e[0]], EDGE)
    wide = spark.createDataFrame([e for e in edges if not e[0]], EDGE).drop("project_dir_key")
    found = prompts.openings(asked(spark, *projects), own, wide, spark.createDataFrame(list(notes), "edge_key string, text string"), **more)
    return {r.project_dir_key: r for r in found.collect()}


def test_project_moves_come_first_with_their_notes(spark):
    edges = [("a", "Start", "Read", 3, "Unknown"), ("a", "Read", "Edit", 9, "Unknown"), ("a", "Start", "Plan", 9, "BugFix"), (None, "Start", "Read", 50, "Unknown"), (None, "Start", "Grep", 40, "Unknown"), (None, "Start", "Once", 1, "Unknown")]
    notes = [("Start -> Grep", "b"), ("Start -> Grep", "a"), ("Start -> Once", "never said"), ("Gone -> Gone", "x")]
    got = told(spark, edges, notes, ("a", "b"))
    claim = "- a prompt like this usually starts with {} ({} episodes)"
    grep = [claim.format("Grep", 40), "- note: a (40 episodes)", "- note: b (40 episodes)"]
    assert got["a"].text.split("\n") == [claim.format("Read", 3), *grep] and got["a"].scope == "project"
    assert got["b"].text.split("\n") == [claim.format("Read", 50), *grep] and got["b"].scope == "global"
    assert "Plan" in told(spark, edges, process_type=None)["a"].text


def test_silence_has_a_reason(spark):
    assert (told(spark, [])["a"].reason, told(spark, [])["a"].text) == (prompts.NOTHING, None)
    weak = told(spark, [("a", "Start", "Read", 1, "Unknown")])["a"]
    assert (weak.reason, weak.text, weak.scope) == (prompts.UNSUPPORTED, None, "project")


def test_the_weakest_lines_go_and_the_order_stays(spark):
    edges = [("a", "Start", f"step {n} {'x' * (n % 7)}", 2 + n % 5, "Unknown") for n in range(60)]
    notes = [(f"Start -> step {n} {'x' * (n % 7)}", "y" * (n % 11 + 1)) for n in range(0, 60, 3)]
    for budget in (10, 60, 61, 500, 1200, 100_000):
        got = told(spark, edges, notes, budget=budget)["a"]
        lines = []  # in order of fusion: all moves are the project's own and absent elsewhere, so by support and key
        for _, _, target, support, _ in sorted(edges, key=lambda e: (-e[3], f"Start -> {e[2]}")):
            lines.append((support, f"- a prompt like this usually starts with {target} ({support} episodes)"))
            lines += [(support, f"- note: {t} ({support} episodes)") for k, t in notes if k == f"Start -> {target}"]
        kept = list(lines)
        while kept and sum(len(t) for _, t in kept) + len(kept) - 1 > budget:
            kept.remove(min(kept, key=lambda s: (s[0], -kept.index(s))))
        assert (got.text or "").split("\n") == ([t for _, t in kept] or [""]) and got.dropped == len(lines) - len(kept), budget


def test_prompts_open_once_and_denied_ones_leave_nothing(spark):
    twice = asked(spark, "a", "b", "c").unionByName(asked(spark, "a", "b", "c"))
    there = asked(spark, "a").select("conversation_id", "session_epoch", "prompt_id", "agent_id")
    made = prompts.opened(twice, there, ["/w/c"]).collect()
    assert [(r.conversation_id, r.status, r.process_type) for r in made] == [("c1", "open", "Unknown")]


def test_answers_are_counted_by_the_write(spark, tmp_path):
    edges = spark.createDataFrame([("a", "Start", "Read", 3, "Unknown")], EDGE)
    guidance = prompts.openings(asked(spark, "a", "b"), edges, edges.where("false"), spark.createDataFrame([], "edge_key string, text string"))
    for run, rows in (("one", asked(spark, "a", "a", "b", "c")), ("none", asked(spark, "a").limit(0))):
        seen = Observation()
        counted(prompts.answered(rows, guidance, ["/w/c"]), seen, prompts.COUNTED).write.parquet(f"{tmp_path}/{run}")
        log_counts(spark, seen, f"{tmp_path}/log", run)
        log_counts(spark, seen, f"{tmp_path}/log", run)
    got = {r.name: r.n for r in totals(spark.read.parquet(f"{tmp_path}/log")).collect()}
    assert (got["guidance_served"], got["guidance_silent"], got["capture_excluded"], got["steps_recorded"]) == (2, 1, 1, 0)
    reasons = {r.project_dir_key: r.reason for r in spark.read.parquet(f"{tmp_path}/one").collect()}
    assert reasons == {"a": None, "b": prompts.NOTHING, "c": prompts.EXCLUDED}
