"""Held-out evaluation of next-step predictors: all levels and all predictors in one pass over the steps.

A predictor (Way) names contexts from the nearest to the longest. Every sample gives one row for each of its contexts, all
predictors are one aggregation of those rows, and a test row takes the longest context that was seen often enough, else
the most frequent targets of all.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stepweave.plans.graph import key_at
from stepweave.plans.sequences import held_out
from stepweave.schema import CLEAN_WEIGHT, KEY, LEVELS, MIN_SUPPORT
from stepweave.sources.arrival import written

#: What stands for the step before the first.
NONE_BEFORE = "<start>"


@dataclass(frozen=True)
class Way:
    """A predictor: contexts from the nearest to the longest (null: history too short), the weight of a training row (0: none), which test rows it is asked, and the weight a context needs."""

    contexts: tuple[Column, ...]
    weight: Column | None = None
    asked: Column | None = None
    least: int = 1


def samples(steps: DataFrame, sequences: DataFrame, test: Column | None = None) -> DataFrame:
    """For every level and every step after the first of its sequence: its key as target, the three keys before it and what else a predictor may know.

    test: whether a row is held out, by default a quarter of the prompts, each as a whole. One shuffle by sequence. Steps without a
    sequence row are Unknown and unclean.
    """
    chain, whole = W.partitionBy(*KEY).orderBy("position"), W.partitionBy(*KEY)
    held = held_out(F.concat_ws("|", "conversation_id", "session_epoch")) if test is None else test
    named = steps.drop("process_type", "status").withColumns({"keys": F.array(*[key_at(level) for level in LEVELS]), "test": held})
    placed = named.withColumns({f"k{i}": F.lag("keys", i).over(chain) for i in (1, 2, 3)} | {
        "f1": F.lag("files", 1).over(chain), "f2": F.lag("files", 2).over(chain), "previous_outcome": F.lag("outcome").over(chain),
        "well": F.min((F.col("outcome") != "failure").cast("int")).over(whole) == 1,
    }).where("k1 IS NOT NULL")
    told = placed.join(sequences.select(*KEY, "process_type", "status"), list(KEY), "left")
    told = told.withColumns({"process_type": F.coalesce("process_type", F.lit("Unknown")), "clean": F.coalesce((F.col("status") == "closed") & F.col("well"), F.lit(False)), "same_file": F.coalesce(F.arrays_overlap("f1", "f2"), F.lit(False))})
    by_level = [F.struct(F.lit(level).alias("level"), F.col("keys")[i].alias("target"), *[F.col(f"k{n}")[i].alias(name) for n, name in ((1, "node"), (2, "before"), (3, "further"))]) for i, level in enumerate(LEVELS)]
    return told.select("test", "clean", "previous_outcome", "process_type", "same_file", F.inline(F.array(*by_level)))


def _with(*parts: str | Column) -> Column:
    return F.concat_ws("|", *[F.col(p) if isinstance(p, str) else p for p in parts])


def conditionings() -> dict[str, Way]:
    """The node alone, and with the outcome before, the process type, or the node before it."""
    return {
        "node": Way((F.col("node"),)), "outcome": Way((_with("node", "previous_outcome"),)), "process": Way((_with("node", "process_type"),)),
        "previous": Way((_with("node", F.coalesce("before", F.lit(NONE_BEFORE))),)),
    }


def variants() -> dict[str, Way]:
    """Pairs plain and told whether files stay; clean sequences weighted or alone, asked about all or clean ones; back-off of two and three keys."""
    pair, clean = (F.col("node"),), F.col("clean")
    weight = F.when(clean, int(CLEAN_WEIGHT)).otherwise(1)
    triple = (F.col("node"), F.when(F.col("before").isNotNull(), _with("before", "node")))
    return {
        "pair": Way(pair), "same_file": Way((_with("node", F.when(F.col("same_file"), "same").otherwise("other")),)),
        "pair_on_clean": Way(pair, asked=clean), "weighted": Way(pair, weight), "weighted_on_clean": Way(pair, weight, clean), "only_clean": Way(pair, clean.cast("int"), clean),
        "backoff_2": Way(triple, least=MIN_SUPPORT), "backoff_3": Way((*triple, F.when(F.col("further").isNotNull(), _with("further", "before", "node"))), least=MIN_SUPPORT),
    }


def evaluate(made: DataFrame, ways: Mapping[str, Way], top: int = 3) -> DataFrame:
    """For each level and way: the weight of the training rows, the contexts seen, rows tested, and how many have their target first and among the first `top`, beside the same for the most frequent targets of all.

    Ties go to the smaller key. What no context knows is answered with the most frequent targets. A way that was asked nothing has no row;
    one without training rows names nothing. Test rows are counted before they meet contexts; contexts have at most `top` targets.
    """
    one, always = F.lit(1), F.lit(True)
    told = [F.struct(F.lit(name).alias("way"), F.array(F.lit(""), *w.contexts).alias("contexts"), (one if w.weight is None else w.weight).cast("long").alias("weight"), (always if w.asked is None else w.asked).alias("asked")) for name, w in ways.items()]
    rows = made.select("level", "test", "target", F.inline(F.array(*told)))
    learnt = rows.where("NOT test AND weight > 0").select("level", "way", "target", "weight", F.posexplode("contexts").alias("ord", "context")).where("context IS NOT NULL")
    own = W.partitionBy("level", "way", "ord", "context")
    ranked = learnt.groupBy("level", "way", "ord", "context", "target").agg(F.sum("weight").alias("n")).withColumns({"total": F.sum("n").over(own), "rank": F.row_number().over(own.orderBy(F.desc("n"), "target"))})
    best = F.transform(F.array_sort(F.collect_list(F.when(F.col("rank") <= top, F.struct("rank", "target")))), lambda t: t["target"])
    known = written(ranked.groupBy("level", "way", "ord", "context").agg(F.first("total").alias("total"), best.alias("targets")))  # read twice below
    seen = known.where("ord > 0").groupBy("level", "way").agg(F.count("*").alias("contexts_seen"))
    base = known.where("ord = 0").select("level", "way", F.col("total").alias("trained"), F.col("targets").alias("base"))  # a row for each level and way
    least = F.element_at(F.create_map(*[F.lit(v) for name, w in ways.items() for v in (name, w.least)]), F.col("way"))
    asked = rows.where("test AND asked").groupBy("level", "way", "contexts", "target").agg(F.count("*").alias("n"))
    deep = asked.select("*", F.posexplode_outer(F.slice("contexts", 2, len(max((w.contexts for w in ways.values()), key=len)))).alias("at", "context")).withColumn("ord", F.col("at") + 1)
    usable = known.where((F.col("ord") > 0) & (F.col("total") >= least)).select("level", "way", "ord", "context", "targets")
    met = deep.join(usable, ["level", "way", "ord", "context"], "left")
    longest = met.groupBy("level", "way", "contexts", "target", "n").agg(F.max(F.when(F.col("targets").isNotNull(), F.struct("ord", "targets"))).alias("found"))
    said = longest.join(F.broadcast(base), ["level", "way"], "left").withColumn("said", F.coalesce("found.targets", "base"))

    def hits(of: str, first: bool) -> Column:
        good = F.get(F.col(of), 0) == F.col("target") if first else F.array_contains(of, F.col("target"))
        return F.sum(F.when(good, F.col("n")).otherwise(0))

    scored = said.groupBy("level", "way").agg(F.first("trained").alias("trained"), F.sum("n").alias("tested"), hits("said", True).alias("top1"), hits("said", False).alias("top3"), hits("base", True).alias("base_top1"), hits("base", False).alias("base_top3"))
    return scored.join(F.broadcast(seen), ["level", "way"], "left").select("level", "way", F.coalesce("trained", F.lit(0)).alias("trained"), F.coalesce("contexts_seen", F.lit(0)).alias("contexts"), "tested", "top1", "top3", "base_top1", "base_top3")


def graph_size(made: DataFrame) -> DataFrame:
    """For each level: how many nodes and edges the training rows hold."""
    pairs = made.where("NOT test").select("level", "node", "target").distinct()
    nodes = pairs.select("level", F.explode(F.array("node", "target")).alias("key")).distinct().groupBy("level").agg(F.count("*").alias("nodes"))
    return pairs.groupBy("level").agg(F.count("*").alias("edges")).join(nodes, "level").select("level", "nodes", "edges")


# Marks of prompts that no person wrote.
AUTOMATED = r"(?i)<task-notification>|<system-reminder>|<command-name>|\[SYSTEM NOTIFICATION"
SHORTEST = 12


def human_text(text: Column) -> Column:
    """A prompt without its tags (at most 60 signs each) and outer white space; null if no person wrote it: a mark of the harness stands in it, or less than SHORTEST signs are left."""
    plain = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "<[^>]{1,60}>", " "), r"^[\t-\r ]+|[\t-\r ]+$", "")
    return F.when(~F.coalesce(text, F.lit("")).rlike(AUTOMATED) & (F.char_length(plain) >= SHORTEST), plain)


def typed_prompts(prompts: DataFrame, labels: DataFrame | None = None, by: tuple[str, ...] = ("prompt_id",)) -> DataFrame:
    """Prompts (by, text) with process_type and confidence: Automated where no person wrote them, else what `labels` (by, process_type, confidence) says, else Unknown.

    labels: the answers of any classifier of human prompts, one for each key; what it says of automated prompts does not count.
    """
    told = prompts.drop("process_type", "confidence").withColumn("_human", human_text(F.col("text")).isNotNull())
    if labels is None:
        told = told.withColumns({"_type": F.lit(None).cast("string"), "_sure": F.lit(None).cast("double")})
    else:
        told = told.join(labels.select(*by, F.col("process_type").alias("_type"), F.col("confidence").cast("double").alias("_sure")), list(by), "left")
    kind = F.when(~F.col("_human"), "Automated").otherwise(F.coalesce("_type", F.lit("Unknown")))
    sure = F.when(~F.col("_human"), F.lit(1.0)).otherwise(F.coalesce("_sure", F.lit(0.0)))
    return told.withColumns({"process_type": kind, "confidence": sure}).drop("_human", "_type", "_sure")


#: The hash in what a commit prints.
COMMIT = r"\[[A-Za-z0-9_./-]+ (?:\(root-commit\) )?([0-9a-f]{7,})\]"


#: Steps that one task of projection_types() holds, on average, and the groups of sequences that a task takes.
STEPS_EACH, GROUPS_EACH = 25_000, 16
_TYPES = ("subject_type", "predicate", "object_type")


def projections(steps: DataFrame, sequences: DataFrame, tasks: int | None = None) -> DataFrame:
    """All that steps say as subject, predicate and object with their types, one pass over the steps.

    Rows with one tool_call_id are parts of an action, in order of position. Used where steps have them: model, sidechain, result (text), ended_at, intended,
    verb (what is done to files; else `uses`). A null or empty value says nothing. Sequences give the process type of a prompt that has one: they go as rows
    before their steps. With tasks, sequences are dealt out in groups (column bucket) over so many tasks, whatever Spark would make of small shuffles.
    """
    has = set(steps.columns)
    column = lambda name, kind: F.col(name) if name in has else F.lit(None).cast(kind)
    opened = sequences.dropna(subset=list(KEY)).select(*KEY, F.col("process_type").alias("_opened"), F.lit(False).alias("_step"))
    rows, group = steps.drop("process_type").withColumn("_step", F.lit(True)).unionByName(opened, allowMissingColumns=True), []
    if tasks:
        rows, group = rows.withColumn("bucket", F.pmod(F.xxhash64(*KEY), F.lit(GROUPS_EACH * tasks))).repartition(tasks, "bucket"), ["bucket"]
    chain = W.partitionBy(*group, *KEY).orderBy("_step", "position")
    action = W.partitionBy(*group, *KEY, "tool_call_id")
    me = F.concat(F.lit("step:"), "step_id")
    placed = rows.withColumns({
        "_me": me, "_last": F.lag(me).over(chain), "_last_class": F.lag("activity_class").over(chain), "_process": F.first("_opened").over(chain),
        "_parts": F.when(F.length("tool_call_id") > 0, F.count("*").over(action)).otherwise(1), "_part_before": F.lag(me).over(action.orderBy("position")), "_part_class": F.lag("activity_class").over(action.orderBy("position")),
        "_whole_class": F.first("activity_class").over(action.orderBy("position")), "_result": column("result", "string"), "_verb": F.coalesce(column("verb", "string"), F.lit("uses")),
    })
    placed = placed.where("_step")

    def said(when: Column, subject: Column, subject_type: str | Column, predicate: str | Column, object_: Column, object_type: str | Column) -> Column:
        text = lambda v: F.lit(v) if isinstance(v, str) else v
        row = F.struct(subject.alias("subject"), text(subject_type).alias("subject_type"), text(predicate).alias("predicate"), object_.alias("object"), text(object_type).alias("object_type"))
        return F.when(when, row)

    own, kind = F.col("_me"), F.col("activity_class")
    named = lambda prefix, *parts: F.concat(F.lit(prefix), *parts)
    is_test, failed = kind == "ArtifactEvaluation", F.col("outcome") == "failure"
    compound, register = F.col("_parts") > 1, F.concat(own, F.lit("/nc"))
    prompt = named("Prompt:", "conversation_id", F.lit("/"), F.substring("prompt_id", 1, 8))
    model, intended, ended = column("model", "string"), column("intended", "string"), column("ended_at", "timestamp")
    side = F.when(F.coalesce(column("sidechain", "boolean"), F.lit(False)), "/subagent").otherwise("")
    took = (F.unix_micros(ended) - F.unix_micros("occurred_at")) / 1000
    commit = F.regexp_extract(F.coalesce("_result", F.lit("")), COMMIT, 1)
    single = F.array(
        said(compound, named("action:", "tool_call_id"), F.col("_whole_class"), "composed of", own, kind),
        said(compound & F.col("_part_before").isNotNull(), own, kind, "depends on", F.col("_part_before"), F.col("_part_class")),
        said(F.length("program") > 0, own, kind, "uses", named("Software Resource:", "program"), "Software Resource"),
        said(F.col("outcome").isNotNull(), own, kind, "has outcome", named("Information Item:outcome=", "outcome"), "Information Item"),
        said(is_test, own, kind, "creates", named("Evaluation Report:", own, F.lit(" "), "outcome"), "Evaluation Report"),
        said(is_test & failed, register, "Noncompliance Identification", "creates", named("Noncompliance Register:", F.substring(F.coalesce("_result", F.lit("")), 1, 120)), "Noncompliance Register"),
        said(is_test & failed, register, "Noncompliance Identification", "depends on", own, kind),
        said((kind == "Checkin") & (commit != ""), own, kind, "creates", named("Version:", commit), "Version"),
        said(F.length(model) > 0, named("Stakeholder:", model, side), "Stakeholder", "is in charge of", own, kind),
        said(F.length("prompt_id") > 0, prompt, "Prompt", "composed of", own, kind),
        said((F.length("prompt_id") > 0) & F.col("_last").isNull() & F.col("_process").isNotNull(), prompt, "Prompt", "caused by", named("Intended Process:", "_process"), "Intended Process"),
        said(F.length(intended) > 0, own, kind, "caused by", named("Intended Activity:", intended), "Intended Activity"),
        said(ended.isNotNull(), own, kind, "framed by", named("Time Interval:", F.date_format("occurred_at", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("/"), F.floor(took).cast("string"), F.lit("ms")), "Time Interval"),
        said((F.length("prompt_id") > 0) & F.col("_last").isNotNull(), own, kind, "depends on", F.col("_last"), F.col("_last_class")),
    )
    suffix = lambda path: F.regexp_extract(path, r"[^/]\.[^./]+$", 0) != ""
    files = F.transform(F.coalesce("files", F.array().cast("array<string>")), lambda path: F.struct(
        own.alias("subject"), kind.alias("subject_type"), F.col("_verb").alias("predicate"), F.concat(F.when(suffix(path), "File:").otherwise("Directory:"), path).alias("object"), F.when(suffix(path), "File").otherwise("Directory").alias("object_type"),
    ))
    return placed.select("step_id", *group, F.inline(F.concat(F.filter(single, lambda t: t.isNotNull()), files)))


def projection_types(steps: DataFrame, sequences: DataFrame, tasks: int) -> DataFrame:
    """Triplets counted by their types, with the numbers of different subjects and objects, the least object and the greatest.

    What differs is counted once in each group of sequences, where no row moves, and once more where equal names meet; both
    take `tasks` tasks, so that a number in proportion to the steps bounds what each one holds.
    """
    sides = F.array(F.struct(F.lit(False).alias("is_object"), F.col("subject").alias("name")), F.struct(F.lit(True).alias("is_object"), F.col("object").alias("name")))
    named = projections(steps, sequences, tasks).select("bucket", *_TYPES, F.inline(sides))
    local = named.groupBy("bucket", *_TYPES, "is_object", "name").agg(F.count("*").alias("n"))
    met = local.repartition(tasks, *_TYPES, "is_object", "name").groupBy(*_TYPES, "is_object", "name").agg(F.sum("n").alias("n"))
    object_ = F.when(F.col("is_object"), F.col("name"))
    return met.groupBy(*_TYPES).agg(
        F.sum(F.when(F.col("is_object"), F.col("n"))).alias("n"), F.count_if(~F.col("is_object") & F.col("name").isNotNull()).alias("subjects"),
        F.count(object_).alias("objects"), F.min(object_).alias("least"), F.max(object_).alias("most"),
    )
