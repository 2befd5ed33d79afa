import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from stepweave.config import load
from stepweave.plans import evaluate as ev
from stepweave.plans import reports, tools
from stepweave.sources import store

STEP = "conversation_id string, session_epoch long, prompt_id string, agent_id string, position long, step_id long, activity_class string, program string, file_ext string, files array<string>, outcome string, occurred_at timestamp, tool_call_id string"
SEQ = "conversation_id string, session_epoch long, prompt_id string, agent_id string, project_dir_key string, process_type string, status string, started_at timestamp, derived_outcome string"


def chains(count):
    rng = random.Random(3)
    made = {}
    for c in range(count):
        made[f"c{c}"] = [(rng.choice("ABC"), rng.choice("xy"), rng.choice(["success", *["neutral"] * 18, "failure"]), [rng.choice("fgh")]) for _ in range(rng.randint(1, 12))]
    return made


def tables(spark, made):
    steps, sequences, number = [], [], 0
    for c, chain in made.items():
        for i, (cls, program, outcome, files) in enumerate(chain):
            number += 1
            steps.append((c, 0, "p", "", i, number, cls, program, "py", files, outcome, None, f"call{number}"))
        if c != "c1":  # a sequence that nobody opened
            sequences.append((c, 0, "p", "", "0", "BugFix", "closed" if c[-1] in "02468" else "open", None, None))
    return spark.createDataFrame(steps, STEP), spark.createDataFrame(sequences, SEQ)


def told(contexts, targets, least):
    """The longest context seen often enough, else what is most frequent; ties by name."""
    for context in reversed(contexts):
        if context is not None and sum(targets.get(context, {}).values()) >= (least if context else 1):
            return [t for t, _ in sorted(targets[context].items(), key=lambda x: (-x[1], x[0]))[:3]]
    return []


def test_evaluation_is_what_a_loop_gives(spark):
    made = chains(80)
    steps, sequences = tables(spark, made)
    test = F.substring("conversation_id", -1, 1).isin("3", "4", "7")
    got = {(r.level, r.way): r for r in ev.evaluate(ev.samples(steps, sequences, test), ev.variants()).collect()}
    for level, width in (("class", 1), ("class/program", 2)):
        samples = []
        for c, chain in made.items():
            keys = ["/".join(s[:width]) for s in chain]
            clean = c[-1] in "02468" and all(s[2] != "failure" for s in chain)
            for i in range(1, len(chain)):
                same = i > 1 and bool(set(chain[i - 1][3]) & set(chain[i - 2][3]))
                triple = [(), keys[i - 1 : i], keys[i - 2 : i] if i > 1 else None, keys[i - 3 : i] if i > 2 else None]
                samples.append((c[-1] in "347", clean, keys[i], same, [None if k is None else "|".join(k) for k in triple]))
        ways = {
            "pair": (lambda s: s[4][:2], lambda s: 1, lambda s: True, 1), "same_file": (lambda s: ["", f"{s[4][1]}|{'same' if s[3] else 'other'}"], lambda s: 1, lambda s: True, 1),
            "only_clean": (lambda s: s[4][:2], lambda s: int(s[1]), lambda s: s[1], 1), "weighted_on_clean": (lambda s: s[4][:2], lambda s: 4 if s[1] else 1, lambda s: s[1], 1), "backoff_3": (lambda s: s[4], lambda s: 1, lambda s: True, 2),
        }
        for way, (contexts, weight, asked, least) in ways.items():
            learnt = {}
            for s in samples:
                if not s[0] and weight(s):
                    for x in contexts(s):
                        if x is not None:
                            learnt.setdefault(x, Counter())[s[2]] += weight(s)
            said = [(told(contexts(s), learnt, least), told([""], learnt, 1), s[2]) for s in samples if s[0] and asked(s)]
            r = got[level, way]
            want = (len(said), sum(a[:1] == [t] for a, _, t in said), sum(t in a for a, _, t in said), sum(b[:1] == [t] for _, b, t in said), sum(t in b for _, b, t in said), sum(learnt[""].values()), len(learnt) - 1)
            assert (r.tested, r.top1, r.top3, r.base_top1, r.base_top3, r.trained, r.contexts) == want, (level, way)


def test_evaluation_without_training_or_test_rows(spark):
    steps, sequences = tables(spark, chains(4))
    assert ev.evaluate(ev.samples(steps, sequences, F.lit(False)), ev.conditionings()).count() == 0
    untaught = ev.evaluate(ev.samples(steps, sequences, F.lit(True)), ev.conditionings()).collect()
    assert untaught and all((r.trained, r.contexts, r.top1, r.top3, r.base_top1) == (0, 0, 0, 0, 0) and r.tested > 0 for r in untaught)
    assert ev.evaluate(ev.samples(steps.limit(0), sequences.limit(0)), ev.variants()).count() == 0


def test_prompts_that_nobody_wrote(spark):
    texts = ["<task-notification> please mend the parser", "short one", " \n<b>mend the parser</b>\t", "<b>mend it</b>", None, "", "x <command-NAME>", "a < b and then some more", "[system notification] and more words"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "prompt_id int, text string")
    labels = spark.createDataFrame([(2, "BugFix", 0.9), (0, "BugFix", 0.9)], "prompt_id int, process_type string, confidence double")
    got = {r.prompt_id: (r.process_type, r.confidence) for r in ev.typed_prompts(rows, labels).collect()}
    automated = ("Automated", 1.0)
    assert got == {0: automated, 1: automated, 2: ("BugFix", 0.9), 3: automated, 4: automated, 5: automated, 6: automated, 7: ("Unknown", 0.0), 8: automated}
    assert ev.typed_prompts(rows).where("process_type = 'Unknown'").count() == 2


def test_projections_say_nothing_of_what_is_missing(spark):
    rows = [("c", 0, "p1", "", 0, 1, "Inspection", "cat", "py", ["/a/b.py", "/a"], "neutral", None, ""), ("c", 0, "p1", "", 1, 2, "ArtifactEvaluation", None, "--", None, "failure", None, None), ("d", 0, "", "", 0, 3, "Checkin", "", "--", [], None, None, "x")]
    steps = spark.createDataFrame(rows, STEP).withColumn("result", F.when(F.col("step_id") == 3, "[main (root-commit) abcdef12] done"))
    sequences = spark.createDataFrame([("c", 0, "p1", "", "0", "BugFix", "open", None, None)], SEQ)
    got = sorted((r.subject, r.predicate, r.object) for r in ev.projections(steps, sequences).collect())
    assert got == sorted([
        ("step:1", "uses", "Software Resource:cat"), ("step:1", "uses", "File:/a/b.py"), ("step:1", "uses", "Directory:/a"), ("step:1", "has outcome", "Information Item:outcome=neutral"), ("Prompt:c/p1", "composed of", "step:1"), ("Prompt:c/p1", "caused by", "Intended Process:BugFix"),
        ("step:2", "has outcome", "Information Item:outcome=failure"), ("step:2", "creates", "Evaluation Report:step:2 failure"), ("step:2/nc", "creates", "Noncompliance Register:"), ("step:2/nc", "depends on", "step:2"), ("Prompt:c/p1", "composed of", "step:2"), ("step:2", "depends on", "step:1"),
        ("step:3", "creates", "Version:abcdef12"),
    ])


def test_projections_are_dealt_out_by_the_number_of_steps(spark):
    """One task holds its share of the steps, also where Spark would join small shuffles; counts by types are those of the rows."""
    steps, sequences = tables(spark, chains(200))
    steps = steps.withColumn("tool_call_id", F.concat(F.lit("call"), F.floor(F.col("step_id") / 2).cast("string")))
    rows = [tuple(r) for r in ev.projections(steps, sequences).collect()]
    dealt = ev.projections(steps, sequences, tasks=10)
    assert sorted(map(str, dealt.drop("bucket").collect())) == sorted(str(r) for r in ev.projections(steps, sequences).collect())
    held = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
    assert len(held) > 5 and max(held) < len(rows) / 3
    by = {}
    for _, subject, subject_type, predicate, object_, object_type in rows:
        by.setdefault((subject_type, predicate, object_type), []).append((subject, object_))
    want = {k: (len(v), len({s for s, _ in v}), len({o for _, o in v}), min(o for _, o in v), max(o for _, o in v)) for k, v in by.items()}
    for tasks in (1, 10):
        made = ev.projection_types(steps, sequences, tasks)
        assert {(r.subject_type, r.predicate, r.object_type): (r.n, r.subjects, r.objects, r.least, r.most) for r in made.collect()} == want
    assert ev.projection_types(steps.limit(0), sequences, 3).count() == 0
    assert ("Prompt", "caused by", "Intended Process") in want and sum(want["Prompt", "caused by", "Intended Process"][:1]) == 199  # nobody opened c1


def test_marks_find_their_sequence(spark):
    at = F.timestamp_seconds
    rows = [("a", 0, "p1", "", "0", "BugFix", "closed", 1, "success"), ("b", 0, "p1", "", "0", "BugFix", "closed", 2, "failure"), ("c", 0, "p2", "", "0", "BugFix", "open", 3, "neutral"), ("d", 0, "p3", "", "0", "BugFix", "closed", 9, "neutral")]
    sequences = spark.createDataFrame(rows, SEQ.replace("timestamp", "long")).withColumn("started_at", at("started_at"))
    marks = spark.createDataFrame([(1, "p1", "failure", 1), (2, "p1", "success", 2), (3, None, "success", 1), (4, "gone", "success", 1)], "mark_id int, prompt_id string, outcome string, declared_at int")
    got = {r.mark_id: r for r in reports.mark_outcomes(sequences, marks).collect()}
    assert [(got[i].conversation_id, got[i].state, got[i].reason) for i in (1, 2, 3, 4)] == [("b", "confirmed", None), ("b", "overridden", None), ("c", "overridden", None), (None, None, reports.NO_PROMPT)]
    none = reports.mark_outcomes(sequences.where("status = 'closed'"), marks.where("prompt_id IS NULL")).first()
    assert (none.stored, none.reason) == (False, reports.NONE_OPEN)
    declared = tools.declare(sequences, reports.mark_outcomes(sequences, marks).where("stored")).collect()
    assert {r.conversation_id: r.declared_outcome for r in declared} == {"a": None, "b": "success", "c": "success", "d": None}


def test_a_dry_run_counts_what_a_real_one_stores(spark):
    rng = random.Random(5)
    arriving = spark.createDataFrame([(i, f"k{rng.randrange(60)}") for i in range(100)], "step_id long, dedup_key string")
    stored = spark.createDataFrame([(i, f"k{i}") for i in range(0, 80, 3)], "step_id long, dedup_key string")
    for there in (None, stored, stored.limit(0)):
        real = store.new_steps(arriving, there).count()
        assert [tuple(r) for r in reports.dry_run(arriving, there).collect()] == [(real, 100 - real)]
    assert [tuple(r) for r in reports.dry_run(arriving.limit(0), stored).collect()] == [(0, 0)]


def test_first_difference_names_what_differs(spark):
    kind = "source string, target string, support long, weight double"
    left = spark.createDataFrame([("a", "b", 2, 2.0), ("b", "c", 1, 4.0), ("c", "d", 1, None), ("e", "f", 1, 1.0)], kind)
    right = spark.createDataFrame([("a", "b", 2, 2.0), ("b", "c", 1, 1.0), ("c", "d", 1, None), ("d", "e", None, None)], kind)
    assert [(r.source, r.side, r.differs) for r in reports.changes(left, right).orderBy("source").collect()] == [("b", "both", ["weight"]), ("d", "right", []), ("e", "left", ["support", "weight"])]
    assert [(r.source, r.left_weight, r.right_weight) for r in reports.first_difference(left, right).collect()] == [("b", 4.0, 1.0)]
    assert reports.first_difference(left, left).count() == 0


def test_reports_of_settings_and_counters(spark):
    config, origin = load(environment={"STEPWEAVE_K": "5"})
    lines = [r.line for r in reports.show_config(spark, config, origin).collect()]
    assert "k 5 env" in lines and "enforce False default" in lines
    log = spark.createDataFrame([("one", "steps_recorded", 3)], "run string, name string, n long")
    assert "steps_recorded 3" in [r.line for r in reports.show_counters(store.totals(log)).collect()]


@pytest.mark.parametrize("project,lines", [("0", ["b/1/q  process=BugFix  steps=2  status=open  derived=failure  declared=none", "a/0  process=none  steps=1  status=closed  derived=neutral  declared=success"]), ("9", [])])
def test_sequences_newest_first(spark, project, lines):
    rows = [("a", 0, "", "", "0", None, "closed", 1, None), ("b", 1, "q", "", "0", "BugFix", "open", 2, None), ("c", 0, "p", "", "1", "BugFix", "open", 3, None)]
    sequences = spark.createDataFrame(rows, SEQ.replace("timestamp", "long")).withColumn("started_at", F.timestamp_seconds("started_at")).withColumn("declared_outcome", F.when(F.col("conversation_id") == "a", "success"))
    counted = sequences.select("conversation_id", "session_epoch", "prompt_id", "agent_id", F.when(F.col("conversation_id") == "b", "failure").otherwise("neutral").alias("derived_outcome"), F.when(F.col("conversation_id") == "b", 2).otherwise(1).alias("step_count"))
    assert [r.line for r in reports.show_sequences(sequences, counted, project).collect()] == lines
