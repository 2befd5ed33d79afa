"""Streams against the batch forms: lifecycle with restarts and idle time, the growing graph with replays and failures."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from stepweave.plans import snapshot
from stepweave.schema import KEY
from stepweave.sources.adapter import event_sequences, event_steps
from stepweave.streaming import grow as G
from stepweave.streaming import lifecycle as L

EVENT = "conversation_id string, prompt_id string, agent_id string, kind string, outcome string, at timestamp, arrival long"
BEGIN = datetime(2025, 1, 1)


def told(df):
    return sorted((r.conversation_id, r.session_epoch, r.prompt_id, r.agent_id, r.status, r.steps, r.failed, r.started_at) for r in df.collect())


def test_lifecycle_with_restarts(spark, tmp_path):
    rng = random.Random(9)
    kinds = [L.STEP] * 8 + [L.STOP, L.ROTATE, L.START]
    rows = [(f"c{rng.randrange(4)}", f"p{rng.randrange(3)}", rng.choice(["", "a"]), rng.choice(kinds), rng.choice(["failure", "neutral"]), BEGIN + timedelta(seconds=i), i) for i in range(300)]
    events = spark.createDataFrame(rows, EVENT)
    folder = f"file://{tmp_path}"
    for low, high in ((0, 90), (90, 91), (91, 300)):
        events.where(f"arrival >= {low} AND arrival < {high}").coalesce(1).write.mode("append").parquet(f"{folder}/in")
        L.follow(spark.readStream.schema(events.schema).parquet(f"{folder}/in"), f"{folder}/out", f"{folder}/state")
    assert told(L.current_sequences(spark.read.parquet(f"{folder}/out"))) == told(L.lifecycle(events))
    assert {r[4] for r in told(L.lifecycle(events))} == {"open", "closed"}


def test_idle_sequences_are_left(spark, tmp_path):
    rows = [("c", "p", "", L.STEP, "neutral", BEGIN, 0), ("d", "p", "", L.STEP, "neutral", BEGIN, 1), ("d", "p", "", L.STOP, "neutral", BEGIN, 2), ("e", "p", "", L.STEP, "neutral", BEGIN + timedelta(days=2), 3)]
    folder = f"file://{tmp_path}"
    for i, row in enumerate([*rows, ("f", "p", "", L.STEP, "neutral", BEGIN + timedelta(days=2), 4)]):
        spark.createDataFrame([row], EVENT).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        L.follow(spark.readStream.schema(spark.createDataFrame([], EVENT).schema).parquet(f"{folder}/in"), f"{folder}/out", f"{folder}/state", idle_ms=3_600_000)
    last = {r.conversation_id: r.status for r in L.current_sequences(spark.read.parquet(f"{folder}/out")).collect()}
    assert last == {"c": "incomplete", "d": "closed", "e": "open", "f": "open"}


def test_state_comes_with_the_rows(spark, tmp_path):
    stream = spark.readStream.schema(spark.createDataFrame([], EVENT).schema).parquet(f"file://{tmp_path}")
    plan = L.changes(stream)._jdf.queryExecution().logical().toString()
    assert "FlatMapGroupsInPandasWithState" in plan and "TransformWithState" not in plan  # no call to the state store for each value


@pytest.fixture(scope="module")
def steps(spark, sf):
    own = event_steps(spark, sf).join(event_sequences(spark, sf).select(*KEY, "project_dir_key", "process_type"), list(KEY))
    return own.withColumn("dedup_key", F.concat("tool_call_id", F.lit("#0"))).cache()


def plain(state):
    rows = lambda df: sorted(map(str, (tuple(sorted(r.asDict(recursive=True).items())) for r in df.collect())))
    return [rows(df) for df in (snapshot.edges(state), snapshot.conditions(state), snapshot.pitfalls(state), snapshot.supporting(state), snapshot.nodes(state), snapshot.templates(state), state.loops.where("loops > 0"))]


def test_graph_grows_as_it_would_be_rebuilt(spark, steps, tmp_path):
    path = f"file://{tmp_path}/store"
    parts = [steps.where(f"step_id <= {a} AND step_id > {b}") for a, b in ((300, 0), (700, 300), (10**9, 600))]
    for n, part in enumerate(parts):
        G.add_batch(part, n, path, G.closed_by_later_epochs, buckets=4)
        G.add_batch(part, n, path, G.closed_by_later_epochs, buckets=4)  # a batch that is run again changes nothing
    batch, state = G.latest(spark, path)
    stored = G.stored_steps(spark, path)
    assert batch == 2 and stored.count() == steps.count() == stored.select("dedup_key").distinct().count()
    whole = steps.drop("project_dir_key", "process_type")
    assert plain(state) == plain(snapshot.fold(whole, G.closed_by_later_epochs(steps)))


def test_a_batch_that_failed_between_steps_and_graph(spark, steps, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/store"
    G.add_batch(steps.where("step_id <= 400"), 0, path, G.closed_by_later_epochs, buckets=4)
    with monkeypatch.context() as m:
        m.setattr(snapshot.State, "write", lambda *a: (_ for _ in ()).throw(OSError("disk")))
        with pytest.raises(OSError):
            G.add_batch(steps.where("step_id > 400"), 1, path, G.closed_by_later_epochs, buckets=4)
    assert G.latest(spark, path)[0] == 0 and G.stored_steps(spark, path).count() == steps.count()
    G.add_batch(steps.where("step_id > 400"), 1, path, G.closed_by_later_epochs, buckets=4)
    assert plain(G.latest(spark, path)[1]) == plain(snapshot.fold(steps.drop("project_dir_key", "process_type"), G.closed_by_later_epochs(steps)))


def test_a_batch_reads_its_buckets_alone(spark, steps, tmp_path):
    path = f"file://{tmp_path}/store"
    G.add_batch(steps, 0, path, G.closed_by_later_epochs, buckets=8)
    one = steps.select(G.bucket(F.col("conversation_id"), 8)).first()[0]
    read = lambda df: {r[0] for r in df.select(F.input_file_name()).distinct().collect()}
    assert 0 < len(read(G.stored_steps(spark, path, [one]))) < len(read(G.stored_steps(spark, path)))
    plan = G.stored_steps(spark, path, [one])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan


def test_an_unreadable_store_is_an_error(spark, tmp_path):
    assert G.read_or_none(spark, f"file://{tmp_path}/none") is None
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "part-0.parquet").write_text("no parquet")
    with pytest.raises(Exception, match="(?i)parquet|footer|FAILED_READ"):
        G.read_or_none(spark, f"file://{tmp_path}/bad")
