"""A transcript becomes a graph; sequences open and close; triggers, notes and merges."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from stepweave.functions import scalars as fn
from stepweave.functions import udf
from stepweave.plans import graph as g
from stepweave.plans import record, serve
from stepweave.schema import KEY
from stepweave.sources import packs, transcript
from stepweave.sources.arrival import numbered


def line(kind, uuid, content, at="2025-01-01T10:00:00Z"):
    return json.dumps({"type": kind, "uuid": uuid, "sessionId": "c1", "cwd": "/p", "timestamp": at, "message": {"role": kind, "content": content}})


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    calls = [("Read", {"file_path": "/p/src/a.py"}, "ok"), ("Edit", {"file_path": "/p/src/a.py"}, "ok"), ("Bash", {"command": "cd /p && pytest -q tests/x.py | tail -n 5"}, "3 passed"), ("Mystery", {}, "?")]
    rows = [line("user", "u1", "please mend it")]
    for i, (name, arguments, result) in enumerate(calls):
        rows.append(line("assistant", f"a{i}", [{"type": "tool_use", "id": f"t{i}", "name": name, "input": arguments}]))
        rows += [line("user", f"r{i}", [{"type": "tool_result", "tool_use_id": f"t{i}", "content": result}], f"2025-01-01T10:00:0{i + 1}Z")]
    folder = tmp_path_factory.mktemp("transcripts")
    (folder / "s.jsonl").write_text("\n".join(rows))
    events, skipped = transcript.events(transcript.parsed(transcript.records(spark, f"file://{folder}/*.jsonl")))
    assert skipped.count() == 0
    return record.steps_of(events.unionByName(events), packs.default_tools(spark), "/home/u").cache()  # each call arrives twice


def test_steps_of_a_transcript(steps):
    rows = [(r.activity_class, r.program, r.file_ext, r.template, list(r.files), r.outcome, r.position) for r in steps.orderBy("position").collect()]
    assert rows == [
        ("Inspection", "Read", "py", "Read file_path", ["src/a.py"], "neutral", 0), ("ChangeImplementation", "Edit", "py", "Edit file_path", ["src/a.py"], "neutral", 1),
        ("ArtifactEvaluation", "pytest", "py", "pytest -q <File>", ["tests/x.py"], "success", 2), ("Inspection", "tail", "--", "tail -n <N>", [], "success", 3),
        ("Unknown", "Mystery", "--", "Mystery", [], "neutral", 4),
    ]


def test_a_transcript_becomes_a_graph(steps):
    sequences = record.open_sequences(steps)
    assert record.open_sequences(steps, sequences).count() == sequences.count() == 1
    closed = record.close_sequences(record.close_sequences(sequences, steps.select(*KEY)), steps.select(*KEY))
    edges = {(r.source, r.target): r.weight for r in g.edges(g.moves(steps, closed, "class/program/ext")).collect()}
    assert edges[("Start", "Inspection/Read/py")] == 4.0 and len(edges) == 6


@pytest.mark.parametrize(("path", "suffix"), [("a/b.PY", "py"), (".profile", "--"), ("a.tar.gz", "gz"), ("a.", "--"), ("dir/", "--"), (None, "--")])
def test_procedure_suffix(spark, path, suffix):
    df = spark.createDataFrame([([path] if path else [],)], "files array<string>")
    assert df.select(record.procedure_suffix(F.col("files"))).first()[0] == suffix


def test_triggers_do_not_fall_through(spark):
    rows = [(1, 9, 9), (None, 1, 9), (None, None, 3), (5, None, None), (None, None, None)]
    df = spark.createDataFrame(rows, "r int, p int, a int")
    got = [(x.f.trigger, x.f.below_support) for x in df.select(serve.fire(F.col("r"), F.col("p"), F.col("a")).alias("f")).collect()]
    assert got == [(None, True), (None, True), ("after_write", False), ("repetition", False), (None, False)]


def test_prompt_start_and_notes(spark):
    edges = spark.createDataFrame([("Start", "A", 3), ("Start", "B", 1), ("A", "B", 5)], "source string, target string, support long")
    assert [r.target for r in serve.prompt_start(edges).collect()] == ["A"]
    notes = spark.createDataFrame([("A -> B", "mind the gap"), ("A -> C", "lost"), ("A -> B", " "), ("A -> B", "x" * 501)], "edge_key string, text string")
    kept, refused = serve.remember(notes, edges, fn.credential(F.col("text")))
    assert [r.text for r in kept.collect()] == ["mind the gap"] and sorted(r.reason for r in refused.collect()) == ["no_such_edge", "too_long", "too_long"]


def test_merges_and_pitfalls(spark):
    a = spark.createDataFrame([("x", "y", [1, 2, 3])], "source string, target string, steps array<long>")
    b = spark.createDataFrame([("x", "y", [3, 9]), ("x", "z", [4])], "source string, target string, steps array<long>")
    assert {(r.target, tuple(r.steps)) for r in g.merge_supporting(a, b, 3).collect()} == {("y", (2, 3, 9)), ("z", (4,))}
    one, two = (spark.createDataFrame(rows, "key string, template string, n long") for rows in ([("k", "a", 5), ("k", "b", 4)], [("k", "b", 3), ("k", "c", 1)]))
    assert [(r.template, r.n) for r in g.merge_templates(one, two, 2).orderBy("rank").collect()] == [("b", 7), ("a", 5)]
    assert g.generated_at(spark.createDataFrame([], "occurred_at timestamp")).select(F.unix_micros("generated_at")).first()[0] == 0
    assert g.generated_at(spark.createDataFrame([(datetime(2025, 1, 1),)], "occurred_at timestamp")).first()[0] == datetime(2025, 1, 1)


def test_compound_lines_without_ids_and_equal_times(spark):
    """Every activity of a line is a step; steps of one second keep their order of arrival; replays and later calls number on."""
    when = datetime(2025, 1, 1)
    rows = [("c", "p", "", "/p", "Bash", None, json.dumps({"command": f"git add f{i}.py && git commit -m x && pytest -q"}), "ok", when, i) for i in range(6)]
    names = "conversation_id string, prompt_id string, agent_id string, project_dir string, tool_name string, tool_call_id string, tool_call_arguments string, tool_call_result string, occurred_at timestamp, place int"
    events, tools = spark.createDataFrame(rows, names), packs.default_tools(spark)
    early = record.steps_of(events.where("place < 4"), tools, "/home/u", order=("place",)).cache()
    late = record.steps_of(events, tools, "/home/u", stored=early, order=("place",)).cache()
    both = early.unionByName(late).orderBy("step_id").collect()
    assert [r.step_id for r in both] == list(range(1, 19)) and [r.position for r in both] == list(range(18))
    assert [r.program for r in both] == ["git add", "git commit", "pytest"] * 6 and len({r.dedup_key for r in both}) == 18
    assert early.count() == 12 and late.count() == 6
    assert record.steps_of(events, tools, "/home/u", stored=early.unionByName(late), order=("place",)).count() == 0


@pytest.mark.parametrize("value", [{"b": [1, {"z": None, "a": "é\n\u20ac😀"}], "a": "x y", "B": True}, {}, {"n": -5, "m": 2.5}])
def test_canonical_json(spark, value):
    messy = json.dumps(value, indent=2, ensure_ascii=False)
    df = spark.createDataFrame([(messy,), ("no json",)], "a string").select(fn.canonical_json(F.col("a")).alias("c"))
    assert [r.c for r in df.collect()] == [json.dumps(value, sort_keys=True, separators=(",", ":")), "no json"]


def test_ids_without_a_window(spark):
    from stepweave.sources.arrival import high_water, numbered

    df = spark.range(5000).select((F.hash("id") % 1000).alias("x"), "id")
    made = numbered(df.repartition(7), ("x", "id"), "n", 10).orderBy("x", "id").collect()
    assert [r.n for r in made] == list(range(11, 5011))
    assert high_water(df.limit(0), "id") == 0 and numbered(df.limit(0), ("x",), "n").count() == 0


def test_python_runs_before_rows_are_shuffled_for_numbering(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(record, "numbered", lambda df, order, *rest: seen.append(df) or numbered(df, order, *rest))
    row = ("f", 1, 0, "c", "p", "", "/p", "Bash", "t1", '{"command":"cat a.md && cat a.md"}', "ok", 7)
    events = spark.createDataFrame([row], "file string, record long, part int, conversation_id string, prompt_id string, agent_id string, project_dir string, tool_name string, tool_call_id string, tool_call_arguments string, tool_call_result string, at long")
    made = record.steps_of(events.withColumn("occurred_at", F.timestamp_seconds("at")), packs.default_tools(spark), "/home/u")
    assert [(r.step_id, r.template, r.files) for r in made.orderBy("step_id").collect()] == [(1, "cat <File>", ["a.md"]), (2, "cat <File>", ["a.md"])]
    plan = seen[0]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Window") < plan.index("ArrowEvalPython")


def _plan(df, which="optimizedPlan"):
    return getattr(df._jdf.queryExecution(), which)().toString()


def test_payloads_are_parsed_once(spark):
    payload = F.concat(F.lit('{"hook_event_name":"PostToolUse","session_id":"s","prompt_id":"p","tool_name":"Read","cwd":"'), "id", F.lit('"}'))
    found, _ = transcript.hook_events(spark.range(1).select(payload.alias("value"), "id"))
    assert _plan(found).count("from_json(") == 1
    assert found.count() == 1


def test_activities_of_a_column(spark):
    rows = spark.createDataFrame([(0, "cat a.md && pytest -q tests | tail -n 5"), (1, ""), (2, None), (3, "cat a.md && pytest -q tests | tail -n 5")], "i int, line string")
    made = rows.select("i", F.inline_outer(udf.activities(F.col("line")))).where("ordinal IS NOT NULL")
    told = udf.decompose(rows.where("line IS NOT NULL")).drop("line")
    assert sorted(map(str, made.collect())) == sorted(map(str, told.collect()))
    assert {r.i for r in made.collect()} >= {0, 3} and made.where("i = 2").isEmpty()


def test_files_and_templates_keep_nulls(spark):
    rows = spark.createDataFrame([(["/p/a.py", None], "/p", ["cat", "x"]), (None, "/p", None), ([], None, [])], "files array<string>, folder string, tokens array<string>")
    made = rows.select(udf.normalise_paths(F.col("files"), F.col("folder"), "/home/u").alias("f"), udf.template(F.col("tokens")).alias("t")).collect()
    assert [r.f for r in made] == [["a.py"], [], []]
    assert made[1].t is None and made[2].t == ""
