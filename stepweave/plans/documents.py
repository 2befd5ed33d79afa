"""A graph as served documents, one JSON body for each node and edge, and the way back to typed rows.

A body that is not what was written (no JSON, a field missing, of another kind or outside its vocabulary) is refused by
itself and named with the first field at fault; the other bodies are read all the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepweave.plans.graph import edge_key, is_bookend
from stepweave.plans.tools import is_a
from stepweave.schema import ACTIVITY_CLASSES, OUTCOMES, PROCESS_TYPES

PITFALL_KINDS = ("failure_prone", "repetition_loop")
TIME = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"
COUNTS = "struct<failure:long,neutral:long,success:long>"
NODE = f"level string, is_a array<string>, templates array<struct<text:string,count:long>>, support long, outcome_counts {COUNTS}, last_seen string"
EDGE = (
    "source string, target string, condition struct<process_type:string,same_file_as_previous:boolean,previous_outcome:string,intended_activity:string>, "
    "pitfalls array<struct<kind:string,evidence:string,support:long,failure_rate:double>>, annotations array<struct<edge_key:string,text:string,author:string,written_at:string>>, "
    f"support long, weight double, last_seen string, outcome_counts {COUNTS}, supporting_steps array<long>, supporting_step_count long"
)


def _iso(at: Column) -> Column:
    return F.date_format(at, TIME)


def _json(**fields: Column) -> Column:
    return F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]), {"ignoreNullFields": "false"})


def node_bodies(nodes: DataFrame, templates: DataFrame, level: str) -> DataFrame:
    """kind, key and body of nodes (graph.nodes) with their top templates (graph.top_templates)."""
    listed = templates.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "template", "n"))), lambda t: F.struct(t["template"].alias("text"), t["n"].cast("long").alias("count"))).alias("templates"))
    parts = F.split("key", "/")
    own = nodes.join(listed, "key", "left").withColumns({"activity_class": parts[0], "program": F.get(parts, 1), "synthetic": F.col("key").isin("Start", "End")})
    above = F.when(F.col("synthetic"), F.array().cast("array<string>")).otherwise(is_a(level))
    counts = F.struct(F.col("n_failure").alias("failure"), F.col("n_neutral").alias("neutral"), F.col("n_success").alias("success"))
    none = F.array().cast("array<struct<text:string,count:long>>")
    body = _json(level=F.lit(level), is_a=above, templates=F.coalesce("templates", none), support=F.col("support"), outcome_counts=counts, last_seen=_iso(F.col("last_seen")))
    return own.select(F.lit("node").alias("kind"), "key", body.alias("body"))


def edge_bodies(edges: DataFrame, conditions: DataFrame, prone: DataFrame, loops: DataFrame, supporting: DataFrame, notes: DataFrame | None = None) -> DataFrame:
    """kind, key and body of edges (graph.edges) with what the other folds of graph.py say of them.

    notes: edge_key, text, author, written_at. Pitfalls come failure_prone first; moves from Start or to End have none.
    """
    on = ["source", "target"]
    kind = "struct<kind:string,evidence:string,support:long,failure_rate:double>"
    pitfall = lambda name, evidence, support, rate: F.struct(F.lit(name).alias("kind"), evidence.alias("evidence"), support.cast("long").alias("support"), rate.cast("double").alias("failure_rate")).cast(kind)
    failing = prone.select(*on, pitfall("failure_prone", F.col("evidence"), F.col("support"), F.col("failure_rate")).alias("p1"))
    looping = loops.select(F.col("node").alias("source"), F.col("node").alias("target"), pitfall("repetition_loop", F.col("node"), F.col("loops"), F.lit(0.0)).alias("p2"))
    told = conditions.select(*on, F.struct("process_type", F.col("same_file").alias("same_file_as_previous"), "previous_outcome", "intended_activity").alias("condition"))
    whole = edges.withColumn("edge_key", edge_key(F.col("source"), F.col("target"))).join(told, on, "left").join(failing, on, "left").join(looping, on, "left").join(supporting.select(*on, "steps"), on, "left")
    note = "array<struct<edge_key:string,text:string,author:string,written_at:string>>"
    if notes is None:
        whole = whole.withColumn("annotations", F.array().cast(note))
    else:
        listed = notes.groupBy("edge_key").agg(F.array_sort(F.collect_list(F.struct("edge_key", "text", "author", _iso(F.col("written_at")).alias("written_at")))).alias("annotations"))
        whole = whole.join(listed, "edge_key", "left").withColumn("annotations", F.coalesce("annotations", F.array().cast(note)))
    pitfalls = F.when(is_bookend(), F.array().cast(f"array<{kind}>")).otherwise(F.filter(F.array("p1", "p2"), lambda p: p.isNotNull()))
    counts = F.struct(F.col("failures").alias("failure"), (F.col("observations") - F.col("failures") - F.col("successes")).alias("neutral"), F.col("successes").alias("success"))
    body = _json(
        source=F.col("source"), target=F.col("target"), condition=F.col("condition"), guidance=F.array().cast("array<string>"), pitfalls=pitfalls, annotations=F.col("annotations"), support=F.col("support"),
        weight=F.col("weight"), last_seen=_iso(F.col("last_seen")), outcome_counts=counts, supporting_steps=F.coalesce("steps", F.array().cast("array<bigint>")), supporting_step_count=F.col("support"),
    )
    return whole.select(F.lit("edge").alias("kind"), F.col("edge_key").alias("key"), body.alias("body"))


def _found(read: DataFrame, required: dict[str, Column], nullable: dict[str, Column], rules: dict[str, Column]) -> Column:
    """The first field at fault of a body: missing, of another kind, or against its rule; null if it is whole.

    required and nullable: the typed value of each path; rules: what must hold of a value that is there.
    """
    reasons = []
    for path, typed in (required | nullable).items():
        raw = F.get_json_object("body", f"$.{path}")
        owner, name = ("$." + path).rsplit(".", 1)
        there = F.array_contains(F.json_object_keys(F.col("body") if owner == "$" else F.get_json_object("body", owner)), name)
        reasons.append(F.when(~F.coalesce(there, F.lit(False)), f"{path} is missing"))
        if path in required:
            reasons.append(F.when(raw.isNull(), f"{path} is null"))
        reasons.append(F.when(raw.isNotNull() & typed.isNull(), f"{path} is of another kind"))
        if path in rules:
            reasons.append(F.when(raw.isNotNull() & ~F.coalesce(rules[path], F.lit(False)), f"{path} is out of bounds"))
    return F.when(F.try_parse_json("body").isNull(), "not JSON").otherwise(F.coalesce(*reasons))


def _whole_counts(c: Column) -> Column:
    return c["failure"].isNotNull() & c["neutral"].isNotNull() & c["success"].isNotNull()


def rehydrate_edges(bodies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Typed edges of the bodies of kind edge, and those refused (kind, key, reason). The key is made from the two ends again."""
    read = bodies.where("kind = 'edge'").withColumn("b", F.from_json("body", EDGE)).withColumn("at", F.try_to_timestamp("b.last_seen"))
    b = lambda name: F.col(f"b.{name}")
    required = {n: b(n) for n in ("source", "target", "condition", "condition.process_type", "pitfalls", "annotations", "support", "weight", "outcome_counts", "supporting_steps")} | {"last_seen": F.col("at")}
    nullable = {f"condition.{n}": b(f"condition.{n}") for n in ("same_file_as_previous", "previous_outcome", "intended_activity")}
    whole_pitfall = lambda p: p["kind"].isin(*PITFALL_KINDS) & p["evidence"].isNotNull() & p["support"].isNotNull() & p["failure_rate"].isNotNull()
    whole_note = lambda n: n["edge_key"].isNotNull() & n["text"].isNotNull() & n["author"].isNotNull() & F.try_to_timestamp(n["written_at"]).isNotNull()
    rules = {
        "condition.process_type": b("condition.process_type").isin(*PROCESS_TYPES), "condition.previous_outcome": b("condition.previous_outcome").isin(*OUTCOMES), "condition.intended_activity": b("condition.intended_activity").isin(*ACTIVITY_CLASSES),
        "pitfalls": F.forall(b("pitfalls"), lambda p: F.coalesce(whole_pitfall(p), F.lit(False))), "annotations": F.forall(b("annotations"), lambda n: F.coalesce(whole_note(n), F.lit(False))),
        "outcome_counts": _whole_counts(b("outcome_counts")), "supporting_steps": F.forall(b("supporting_steps"), lambda s: s.isNotNull()),
    }
    judged = read.withColumn("reason", _found(read, required, nullable, rules))
    good = judged.where("reason IS NULL").select(
        edge_key(b("source"), b("target")).alias("edge_key"), b("source"), b("target"), b("condition.process_type"), b("condition.same_file_as_previous").alias("same_file"), b("condition.previous_outcome"), b("condition.intended_activity"),
        b("support"), b("weight"), F.col("at").alias("last_seen"), b("outcome_counts.failure").alias("failures"), b("outcome_counts.neutral").alias("neutrals"), b("outcome_counts.success").alias("successes"), b("supporting_steps"), b("pitfalls"), b("annotations"),
    )
    return good, judged.where("reason IS NOT NULL").select("kind", "key", "reason")


def rehydrate_nodes(bodies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Typed nodes of the bodies of kind node, and those refused (kind, key, reason)."""
    read = bodies.where("kind = 'node'").withColumn("b", F.from_json("body", NODE)).withColumn("at", F.try_to_timestamp("b.last_seen"))
    b = lambda name: F.col(f"b.{name}")
    required = {n: b(n) for n in ("level", "is_a", "templates", "support", "outcome_counts")} | {"last_seen": F.col("at")}
    rules = {"templates": F.forall(b("templates"), lambda t: F.coalesce(t["text"].isNotNull() & t["count"].isNotNull(), F.lit(False))), "outcome_counts": _whole_counts(b("outcome_counts")), "is_a": F.forall(b("is_a"), lambda s: s.isNotNull())}
    judged = read.withColumn("reason", _found(read, required, {}, rules))
    good = judged.where("reason IS NULL").select("key", b("level"), b("is_a"), b("templates"), b("support"), F.col("at").alias("last_seen"), b("outcome_counts.failure").alias("n_failure"), b("outcome_counts.neutral").alias("n_neutral"), b("outcome_counts.success").alias("n_success"))
    return good, judged.where("reason IS NOT NULL").select("kind", "key", "reason")
