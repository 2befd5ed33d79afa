import json

import pytest
from pyspark.sql import functions as F

from stepweave.plans import documents
from stepweave.plans import graph as g
from stepweave.sources.adapter import event_sequences, event_steps


@pytest.fixture(scope="module")
def bodies(spark, sf):
    steps = event_steps(spark, sf)
    made = g.moves(steps, event_sequences(spark, sf))
    notes = spark.createDataFrame([("Start -> Search/p1", "begin with a search", "agent"), ("Gone -> Gone", "lost", "agent")], "edge_key string, text string, author string").withColumn("written_at", F.timestamp_seconds(F.lit(1)))
    nodes = documents.node_bodies(g.nodes(steps), g.top_templates(steps), "class/program")
    edges = documents.edge_bodies(g.edges(made), g.modal_conditions(made), g.failure_prone(made), g.repetition_loops(steps), g.supporting_steps(made), notes)
    return nodes.unionByName(edges).cache(), made, steps


def test_edges_come_back_as_they_were(spark, bodies):
    written, made, _ = bodies
    good, bad = documents.rehydrate_edges(written)
    assert bad.count() == 0
    got = {r.edge_key: r for r in good.collect()}
    wanted = {f"{r.source} -> {r.target}": r for r in g.edges(made).collect()}
    assert set(got) == set(wanted)
    for key, r in wanted.items():
        assert (got[key].support, got[key].weight, got[key].last_seen, got[key].failures, got[key].successes) == (r.support, r.weight, r.last_seen, r.failures, r.successes)
        assert got[key].neutrals == r.observations - r.failures - r.successes
    assert {(r.source, r.target): r.steps for r in g.supporting_steps(made).collect()} == {(r.source, r.target): r.supporting_steps for r in got.values()}
    noted = got["Start -> Search/p1"]
    assert [(n.text, n.author) for n in noted.annotations] == [("begin with a search", "agent")] and noted.pitfalls == [] and noted.same_file is None
    prone = {(r.source, r.target): (r.evidence, r.failure_rate) for r in g.failure_prone(made).collect()}
    assert {(r.source, r.target): (p.evidence, p.failure_rate) for r in got.values() for p in r.pitfalls if p.kind == "failure_prone"} == prone and prone


def test_nodes_come_back_as_they_were(spark, bodies):
    written, _, steps = bodies
    good, bad = documents.rehydrate_nodes(written)
    assert bad.count() == 0
    wanted = {r.key: (r.support, r.last_seen, r.n_failure) for r in g.nodes(steps).collect()}
    got = {r.key: r for r in good.collect()}
    assert {k: (r.support, r.last_seen, r.n_failure) for k, r in got.items()} == wanted
    assert got["Start"].templates == [] and got["Start"].is_a == [] and got["Search/p1"].is_a == ["Search/p1", "Search"][1:]
    assert len(got["Search/p1"].templates) == 5


def test_a_bad_body_is_named_and_the_others_are_read(spark, bodies):
    body = json.loads(bodies[0].where("key = 'Start -> Search/p1'").first().body)

    def but(**changes):
        out = json.loads(json.dumps(body))
        for path, value in changes.items():
            *owner, name = path.split("__")
            at = out
            for o in owner:
                at = at[o]
            if value is KeyError:
                del at[name]
            else:
                at[name] = value
        return json.dumps(out)

    cases = {
        "whole": (but(), None), "torn": ('{"source": ', "not JSON"), "text": ('"x"', "source is missing"), "none": (None, "not JSON"),
        "support": (but(support="many"), "support is of another kind"), "no_support": (but(support=KeyError), "support is missing"), "null_support": (but(support=None), "support is null"),
        "type": (but(condition__process_type="Party"), "condition.process_type is out of bounds"), "outcome": (but(condition__previous_outcome="maybe"), "condition.previous_outcome is out of bounds"),
        "no_outcome": (but(condition__previous_outcome=KeyError), "condition.previous_outcome is missing"), "null_outcome": (but(condition__previous_outcome=None), None), "same": (but(condition__same_file_as_previous="yes"), "condition.same_file_as_previous is of another kind"),
        "seen": (but(last_seen="yesterday"), "last_seen is of another kind"), "steps": (but(supporting_steps=[1, "x"]), "supporting_steps is"), "kind": (but(pitfalls=[{"kind": "odd", "evidence": "e", "support": 1, "failure_rate": 0.5}]), "pitfalls is out of bounds"),
        "counts": (but(outcome_counts={"failure": 1}), "outcome_counts is out of bounds"), "note": (but(annotations=[{"text": "t"}]), "annotations is out of bounds"), "extra": (but(more=1), None),
    }
    rows = spark.createDataFrame([("edge", k, v) for k, (v, _) in cases.items()], "kind string, key string, body string")
    good, bad = documents.rehydrate_edges(rows)
    named = {r.key: r.reason for r in bad.collect()}
    assert good.count() == sum(reason is None for _, reason in cases.values())
    for key, (_, reason) in cases.items():
        assert (key not in named) if reason is None else named[key].startswith(reason), (key, named.get(key))
    assert documents.rehydrate_edges(rows.limit(0))[0].count() == 0
