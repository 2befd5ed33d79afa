"""The folds on small hand-made chains."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from stepweave.plans import graph as g
from stepweave.plans import reach, serve
from stepweave.plans import sequences as s
from stepweave.sources import store

START_TIME = datetime(2026, 1, 5, 9, 30)
STEP = "step_id long, conversation_id string, session_epoch long, prompt_id string, agent_id string, position long, activity_class string, program string, file_ext string, template string, files array<string>, outcome string, occurred_at timestamp"
SEQUENCE = "conversation_id string, session_epoch long, prompt_id string, agent_id string, project_dir_key string, process_type string, status string, started_at timestamp"


def chain(spark, *sequences):
    """Steps of sequences; each a list of (class/program, outcome, file)."""
    out = []
    for p, steps in enumerate(sequences):
        for i, (node, outcome, file) in enumerate(steps):
            cls, program = node.split("/")
            out.append((p * 1000 + i + 1, "c", 0, f"p{p}", "", i, cls, program, "py", f"{program} <File>", [file], outcome, START_TIME + timedelta(minutes=p * 60 + i)))
    return spark.createDataFrame(out, STEP)


def closed(spark, n, status="closed", kinds=None):
    return spark.createDataFrame([("c", 0, f"p{p}", "", "k", (kinds or {}).get(p, "Unknown"), status, START_TIME + timedelta(minutes=p)) for p in range(n)], SEQUENCE)


READ, EDIT, TEST = ("Inspection/Read", "success", "a"), ("ChangeImplementation/Edit", "success", "a"), ("ArtifactEvaluation/pytest", "success", "b")
FAILED = ("ArtifactEvaluation/pytest", "failure", "b")


def by_edge(df, *columns):
    return {(r.source, r.target): tuple(r[c] for c in columns) for r in df.collect()}


def test_bookends_and_weight(spark):
    steps, seqs = chain(spark, [READ, EDIT, TEST], [READ, EDIT, FAILED]), closed(spark, 2)
    edges = by_edge(g.edges(g.moves(steps, seqs)), "support", "weight", "failures")
    assert edges["Start", "Inspection/Read"] == (2, 5.0, 0)
    assert edges["ChangeImplementation/Edit", "ArtifactEvaluation/pytest"] == (2, 5.0, 1)
    assert edges["ArtifactEvaluation/pytest", "End"] == (2, 5.0, 1)


def test_open_sequences_and_missing_ones_are_not_clean(spark):
    steps = chain(spark, [READ])
    assert by_edge(g.edges(g.moves(steps, closed(spark, 1, "open"))), "weight")["Start", "Inspection/Read"] == (1.0,)
    lost = g.moves(steps, closed(spark, 1).where("false"))
    assert {(r.process_type, r.clean) for r in lost.collect()} == {("Unknown", False)}


def test_single_step_gives_two_moves(spark):
    made = g.moves(chain(spark, [READ]), closed(spark, 1)).collect()
    assert sorted((r.source, r.target, r.previous_outcome) for r in made) == [("Inspection/Read", "End", "success"), ("Start", "Inspection/Read", None)]


def test_pitfall_needs_support_and_more_than_the_base_rate(spark):
    walk = [READ, EDIT, FAILED]
    steps = chain(spark, walk, walk)
    found = by_edge(g.failure_prone(g.moves(steps, closed(spark, 2)), steps), "support", "failure_rate", "evidence")
    assert found == {("ChangeImplementation/Edit", "ArtifactEvaluation/pytest"): (2, 1.0, "pytest <File>")}
    once = chain(spark, walk)
    assert g.failure_prone(g.moves(once, closed(spark, 1)), once).isEmpty()


def test_loops_count_once_a_run(spark):
    assert [r.loops for r in g.repetition_loops(chain(spark, [READ] * 5)).collect()] == [1]
    assert g.repetition_loops(chain(spark, [READ] * 2)).isEmpty()


def test_condition_ties_go_to_the_smaller_type(spark):
    steps = chain(spark, [READ, EDIT], [READ, EDIT])
    made = g.modal_conditions(g.moves(steps, closed(spark, 2, kinds={0: "Investigation", 1: "BugFix"})))
    assert by_edge(made, "process_type", "same_file")["Inspection/Read", "ChangeImplementation/Edit"] == ("BugFix", True)


def test_supporting_steps_are_the_last_fifty(spark):
    steps = chain(spark, *[[READ] for _ in range(60)])
    kept = by_edge(g.supporting_steps(g.moves(steps, closed(spark, 60))), "steps")["Start", "Inspection/Read"][0]
    assert len(kept) == 50 and kept == sorted(kept) and kept[-1] == 59 * 1000 + 1


def test_backoff_uses_the_longest_context_with_support(spark):
    walk = [READ, EDIT, TEST]
    asked = s.contexts(chain(spark, walk, walk, [EDIT, TEST]))
    found = {r.step_id: (r.ord, r.predicted) for r in s.backoff(asked, s.ngrams(asked)).where("rank = 1").collect()}
    assert found[3] == (2, "ArtifactEvaluation/pytest") and found[2002] == (1, "ArtifactEvaluation/pytest")
    markers = {r.marker for r in asked.where("ord = 2").collect()}
    assert markers == {"@same-file"} and {r.marker for r in s.contexts(chain(spark, walk), same_file=False).collect()} == {""}


def rows_of(edges):
    return sorted(map(tuple, edges.select("source", "target", "support", "observations", "failures", "successes", "weight", "last_seen").collect()))


def test_merge_and_refresh_equal_a_rebuild(spark):
    steps, seqs = chain(spark, [READ, EDIT, TEST], [READ, READ, EDIT], [EDIT, TEST]), closed(spark, 3)
    whole = g.edges(g.moves(steps, seqs))
    before = steps.where("step_id <= 1001")
    again = g.refresh(g.edges(g.moves(before, seqs)), steps, seqs, 1001)
    assert rows_of(again) == rows_of(whole)
    opened = seqs.withColumn("status", F.lit("open"))
    stale = g.edges(g.moves(steps, opened))
    assert rows_of(stale) != rows_of(whole) == rows_of(g.refresh(stale, steps, seqs, 10**9, before=opened))
    made = g.moves(steps, seqs)
    merged = g.merge(g.edges(made.where("prompt_id = 'p0'")), g.edges(made.where("prompt_id <> 'p0'")))
    assert g.diff(whole, merged).isEmpty()


EDGES = "source string, target string, support long, weight double, process_type string"


def graph_of(spark, *pairs):
    return spark.createDataFrame([(a, b, n, 1.0, "Unknown") for a, b, n in pairs], EDGES)


def test_neighbourhood_and_reachability(spark):
    edges = graph_of(spark, ("Start", "A", 1), ("A", "B", 1), ("B", "A", 1), ("B", "End", 1), ("A", "A", 1), ("C", "D", 1))
    near = reach.neighbourhood(edges, spark.createDataFrame([("A",)], "node string"), 2).collect()
    assert sorted((r.hop, r.source, r.target) for r in near) == [(1, "A", "A"), (1, "A", "B"), (2, "B", "A"), (2, "B", "End")]
    assert {r.node for r in reach.reachable(edges).collect()} == {"Start", "A", "B", "End"}
    assert {r.node: (r.from_start, r.to_end) for r in reach.structure(edges).collect()}["C"] == (False, False)


def test_editor_refuses_what_breaks_the_graph(spark):
    editor = reach.GraphEditor(graph_of(spark, ("Start", "A", 1), ("A", "B", 1), ("B", "End", 1)))
    assert editor.add("A", "End") and not editor.add("A", "End") and not editor.add("A", "X")
    assert not editor.delete("B", "End") and not editor.delete("X", "Y") and not editor.delete("Start", "A")
    assert [r for *_, r in editor.rejections] == ["duplicate_move", "unknown_node", "dead_end", "unknown_move", "unreachable"]
    assert editor.revise("A", "End", "A") and editor.edges.where("source = 'A' AND target = 'A'").count() == 1


def test_fusion_puts_project_first_and_sums_scores(spark):
    project, everywhere = graph_of(spark, ("S", "READ", 5), ("S", "TEST", 9)), graph_of(spark, ("S", "READ", 9), ("S", "EDIT", 3))
    fused = [(r.edge_key, r.scope) for r in serve.fuse(project, everywhere).orderBy("place").collect()]
    assert fused == [("S -> READ", "project"), ("S -> TEST", "project"), ("S -> EDIT", "global")]


def test_triggers(spark):
    steps = chain(spark, [READ] * 20)
    edges = g.edges(g.moves(steps, closed(spark, 1)))
    assert serve.repetition_firings(steps, edges).count() == 1
    verify = graph_of(spark, ("ChangeImplementation/Edit", "ArtifactEvaluation/pytest", 3), ("ChangeImplementation/Edit", "Inspection/Read", 2))
    assert serve.after_write_firings(verify).count() == 1
    assert serve.after_write_firings(verify.withColumn("support", -F.col("support"))).count() == 0


def test_budget_drops_the_weakest(spark):
    rows = [("n", f"e{i}", "x" * 300, n) for i, n in enumerate([5, 9, 2, 7, 1, 8])]
    said = spark.createDataFrame(rows, "node string, edge_key string, text string, support long")
    assert sorted(r.support for r in serve.within_budget(said, ("node",)).collect()) == [7, 8, 9]
    long = spark.createDataFrame([("n", "e", "x" * 1300, 1)], said.schema)
    assert serve.within_budget(long, ("node",)).isEmpty()


def test_store(spark):
    rows = spark.createDataFrame([(1, "a", "x" * 3000), (2, "a", "y"), (3, "b", "z")], "step_id long, dedup_key string, result_snippet string")
    first = store.new_steps(rows, None)
    assert sorted((r.step_id, len(r.result_snippet)) for r in first.collect()) == [(1, 2048), (3, 1)]
    assert store.new_steps(rows, first).isEmpty()
    steps, seqs = chain(spark, [READ], [READ, EDIT]), closed(spark, 2)
    left, kept = store.prune(steps, seqs, "k", F.lit(START_TIME + timedelta(seconds=30)))
    assert (left.count(), kept.count()) == (2, 1)


def test_snapshot_round_trip(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    edges = graph_of(spark, ("Start", "A", 1))
    nodes = edges.select(F.col("target").alias("key"))
    with pytest.raises(ValueError):
        store.read_snapshot(spark, path)
    store.write_snapshot(edges, nodes, path, "class", 7)
    back, _, manifest = store.read_snapshot(spark, path)
    assert back.collect() == edges.collect() and manifest["episode_high_water"] == 7
    with pytest.raises(Exception, match="broken"):  # a write that stops between the tables
        store.write_snapshot(graph_of(spark, ("A", "B", 2)), nodes.withColumn("x", F.raise_error(F.lit("broken"))), path, "class", 8)
    back, _, manifest = store.read_snapshot(spark, path)
    assert back.collect() == edges.collect() and manifest["episode_high_water"] == 7
    store.write_snapshot(graph_of(spark, ("A", "B", 2)), nodes, path, "class", 9)
    assert store.read_snapshot(spark, path)[2]["episode_high_water"] == 9
    spark.createDataFrame([(9, "class", 1, "v", 2**62)], "format int, level string, episode_high_water long, version string, written long").write.mode("append").json(f"{path}/manifest")
    with pytest.raises(ValueError):
        store.read_snapshot(spark, path)


def test_refresh_folds_moves_once(spark, sf):
    from stepweave.sources.adapter import event_sequences, event_steps

    steps, sequences = event_steps(spark, sf), event_sequences(spark, sf)
    early = steps.where("step_id <= 500")
    made = g.refresh(g.edges(g.moves(early, sequences)), steps, sequences, 500)
    assert "Window" not in made._jdf.queryExecution().optimizedPlan().toString()  # the caller reads what was folded to look for doubtful edges
    assert made.select("source", "target", "support").exceptAll(g.edges(g.moves(steps, sequences)).select("source", "target", "support")).isEmpty()
