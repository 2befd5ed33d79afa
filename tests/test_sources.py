import json
import random

from pyspark.sql import functions as F

from stepweave.functions import scalars as fn
from stepweave.plans import queries
from stepweave.sources import transcript
from stepweave.streaming.ingest import repetition_latch


def record(kind, uuid, content, at="2026-01-05T09:30:00Z", **more):
    return json.dumps({"type": kind, "uuid": uuid, "sessionId": "s", "cwd": "/w", "timestamp": at, "message": {"role": kind, "content": content}} | more)


def use(call, name="Bash"):
    return [{"type": "tool_use", "id": call, "name": name, "input": {"command": "ls"}}]


def result(call, content="1 failed, 2 passed"):
    return [{"type": "tool_result", "tool_use_id": call, "content": content}]


def test_transcript(spark, tmp_path):
    lines = [
        record("user", "u1", "do it"),
        record("assistant", "a1", use("t1")),
        record("user", "m1", "meta", isMeta=True),
        record("user", "r1", result("t1")),
        record("assistant", "a2", use("t2", "Read")),
        record("user", "r2", result("t2", [{"type": "text", "text": "a"}, {"type": "text", "text": "b"}])),
        record("user", "r3", result("nobody")),
        "{not json",
        json.dumps({"type": "strange"}),
        record("assistant", "a3", use("t3")),
        record("user", "r4", result("t3"), at="2026-01-05T09:30:00"),
    ]
    (tmp_path / "s.jsonl").write_text("\n".join(lines) + "\n")
    events, skipped = transcript.events(transcript.parsed(transcript.records(spark, str(tmp_path / "s.jsonl"))))
    found = {r.tool_call_id: r for r in events.collect()}
    assert set(found) == {"t1", "t2"} and {r.prompt_id for r in found.values()} == {"u1"}
    assert found["t1"].record_ref.endswith("#1") and found["t2"].tool_call_result == "ab"
    assert sorted((r.ordinal, r.category) for r in skipped.collect()) == [(6, "orphan result"), (7, "not JSON"), (8, "unknown type"), (10, "naive timestamp")]


def test_records_are_parsed_once(spark, tmp_path):
    lines = [record("user", "u1", "go"), record("assistant", "a1", use("t")), record("user", "r1", result("t")), record("user", "r2", result("t")), record("assistant", "a2", use("t")), record("user", "r3", result("t")), "torn {"]
    (tmp_path / "s.jsonl").write_text("\n".join(lines))
    good, skipped = transcript.events(transcript.parsed(transcript.records(spark, str(tmp_path / "s.jsonl"))))
    assert sorted((r.record, r.record_ref[-1]) for r in good.collect()) == [(2, "1"), (5, "4")]  # a call id that comes again is answered again
    assert sorted((r.ordinal, r.category) for r in skipped.collect()) == [(3, "orphan result"), (6, "not JSON")]
    for frame in (good, skipped.groupBy("category").count()):
        plan = frame._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("from_json(StructField(type,StringType,true), StructField(uuid") == 1 and plan.count("try_parse_json") <= 1 and plan.count("Relation") == 1


def test_hook_payloads(spark):
    rows = [{"hook_event_name": "PostToolUse", "session_id": "s", "prompt_id": "p", "tool_name": "Read", "tool_input": {"file_path": "a"}}, {"hook_event_name": "PostToolUse", "prompt_id": "p", "tool_name": "Read"}, {"hook_event_name": "Stop", "session_id": "s"}]
    good, bad = transcript.hook_events(spark.createDataFrame([(json.dumps(r),) for r in rows], "value string"))
    assert (good.count(), bad.count()) == (1, 1) and good.first().tool_call_arguments == '{"file_path":"a"}'


def test_scalars(spark):
    texts = ["1 failed, 3 passed", "3 passed", "All checks passed!", "[main 0a1b2c3d] fix", "whatever", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.o for r in df.select(fn.outcome(F.col("t")).alias("o")).collect()] == ["failure", "success", "success", "success", "neutral", "neutral"]
    secrets = {"aws_access_key_id": "AKIA" + "A" * 16, "github_token": "ghp_" + "a" * 36, "openai_api_key": "sk-" + "a" * 20, "slack_token": "xoxb-1", "private_key": "-----BEGIN RSA PRIVATE KEY-----", "bearer_token": "Bearer abcdefghijklmnop", "secret_assignment": "password = hunter2hunter2", "base64_run": "Q" * 41}
    df = spark.createDataFrame(list(secrets.items()), "name string, t string")
    assert all(r.name == r.c for r in df.select("name", fn.credential(F.col("t")).alias("c")).collect())
    df = spark.createDataFrame([("/work/secret/a",), ("/work/open",)], "p string")
    assert [r.e for r in df.select(fn.excluded(F.col("p"), ["# no", "", "/work/secret*"]).alias("e")).collect()] == [True, False]
    df = spark.createDataFrame([("a\nb\nc", "b"), ("a\na", "a"), ("a", "x"), ("a", " ")], "d string, w string")
    assert [r.n for r in df.select(fn.line_of(F.col("d"), F.col("w")).alias("n")).collect()] == [2, None, None, None]


def test_latch_fires_once(spark, tmp_path):
    rows = [("c", i, "A" if i != 4 else "B") for i in range(12)]
    spark.createDataFrame(rows, "conversation_id string, step_id long, node string").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("conversation_id string, step_id long, node string").parquet(f"{tmp_path}/in")
    query = repetition_latch(stream).writeStream.format("memory").queryName("latched").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    assert [(r.step_id, r.node) for r in spark.table("latched").collect()] == [(2, "A")]


def test_credentials_are_found_as_the_patterns_alone_find_them(spark):
    """Texts put together from pieces of credentials, whole ones and near misses, at borders and inside runs."""
    rng = random.Random(3)
    pieces = ["AKIA", "A" * 16, "ghp_", "ghx_", "a" * 36, "sk-", "b" * 20, "xoxb-1", "xox", "-----BEGIN ", "RSA ", "PRIVATE KEY-----", "Bearer ", "c" * 16, "TOKEN", "password", "=", ": ", "hunter2hunter2", "Q" * 39, "Q" * 41, "/", "+", "=", " ", "\n", "é", "-"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 6))) for _ in range(1500)] + ["", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(fn.credential(F.col("t")).alias("got"), fn.first_match(F.col("t"), [(p, n) for n, p in fn.CREDENTIALS]).alias("want"))
    found = df.collect()
    assert all(r.got == r.want for r in found) and {r.want for r in found} == {n for n, _ in fn.CREDENTIALS} | {None}


def test_leaks_of_long_and_short_items(spark, tmp_path):
    """Items cut inside words, items of one word, repeated items, and the way without a broadcast."""
    docs = [(1, "xx one two three four five six yy"), (2, "one two"), (3, "a two three four b"), (4, None), (5, ""), (6, "zzone two three four fivezz"), (7, "one two three four five")]
    items = [(1, "one two three four five"), (2, "one two three four five"), (3, "wo"), (4, "two three four"), (5, None), (6, "nowhere to be found in here")]
    wanted = sorted((d, i) for d, t in docs for i, w in items if t is not None and w is not None and w in t)
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for n, some in enumerate((items, [i for i in items if i[0] not in (3, 4)])):
        spark.createDataFrame(some, "item_id long, text string").write.mode("overwrite").parquet(f"{tmp_path}/benchmark.parquet")
        for most in (100, 1):
            kept, queries.LEAK_ITEMS = queries.LEAK_ITEMS, most
            try:
                got = sorted(map(tuple, queries.leak_containment(spark, str(tmp_path)).collect()))
            finally:
                queries.LEAK_ITEMS = kept
            assert got == (wanted if n == 0 else [w for w in wanted if w[1] not in (3, 4)]), (n, most)
