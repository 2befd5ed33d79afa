"""The transition graph: moves of ordered chains, folded into nodes and edges.

One window over (sequence, position) gives every move, so nodes, edges, conditions, pitfalls and loops share a single
shuffle by sequence; all folds are partial aggregations on their own keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stepweave.schema import CLEAN_WEIGHT, END, KEY, LOOP_LENGTH, MIN_SUPPORT, START, SUPPORTING_KEPT, TOP_TEMPLATES
from stepweave.sources.arrival import written


def key_at(level: str) -> Column:
    """The node key of a step at a level of the taxonomy."""
    parts = ["activity_class"] if level == "class" else ["activity_class", "program"] if level == "class/program" else ["activity_class", "program", F.coalesce(F.nullif(F.col("file_ext"), F.lit("")), F.lit("--"))]
    return F.concat_ws("/", *parts)


def class_of(key: Column) -> Column:
    return F.substring_index(key, "/", 1)


def edge_key(source: Column, target: Column) -> Column:
    return F.concat(source, F.lit(" -> "), target)


def clean_sequences(steps: DataFrame, sequences: DataFrame) -> DataFrame:
    """Sequences that are closed and in which no step failed."""
    well = steps.groupBy(*KEY).agg(F.bool_and(F.col("outcome") != "failure").alias("well"))
    return sequences.join(well, list(KEY)).withColumn("clean", (F.col("status") == "closed") & F.col("well"))


def moves(steps: DataFrame, sequences: DataFrame, level: str = "class/program") -> DataFrame:
    """Start -> first, each pair, last -> End: a row for each, with the context of the move and its supporting step.

    Steps without a sequence row count as Unknown and unclean.
    """
    chain = W.partitionBy(*KEY).orderBy("position")
    whole = W.partitionBy(*KEY)
    label = F.col("rationale_label") if "rationale_label" in steps.columns else F.lit(None).cast("string")
    placed = steps.drop("project_dir_key", "process_type", "status").withColumn("node", key_at(level)).withColumn("label", label).withColumns({
        "pnode": F.lag("node").over(chain), "pfiles": F.lag("files").over(chain), "pout": F.lag("outcome").over(chain), "nnode": F.lead("node").over(chain),
        "well": F.min((F.col("outcome") != "failure").cast("int")).over(whole) == 1,
    })
    own = sequences.select(*KEY, "project_dir_key", "process_type", "status")
    known = placed.join(own, list(KEY), "left")
    known = known.withColumns({"process_type": F.coalesce("process_type", F.lit("Unknown")), "clean": F.coalesce((F.col("status") == "closed") & F.col("well"), F.lit(False))})
    step = F.struct(F.coalesce("pnode", F.lit(START)).alias("source"), F.col("node").alias("target"), F.when(F.col("pnode").isNotNull(), F.coalesce(F.arrays_overlap("pfiles", "files"), F.lit(False))).alias("same_file"), F.col("pout").alias("previous_outcome"), F.col("label").alias("intended_activity"))
    last = F.struct(F.col("node").alias("source"), F.lit(END).alias("target"), F.lit(None).cast("boolean").alias("same_file"), F.col("outcome").alias("previous_outcome"), F.col("label").alias("intended_activity"))
    made = known.withColumn("move", F.explode(F.when(F.col("nnode").isNull(), F.array(step, last)).otherwise(F.array(step))))
    carried = [c for c in ("template",) if c in steps.columns]
    return made.select(*KEY, "project_dir_key", "position", "move.*", "step_id", "outcome", "process_type", "clean", "occurred_at", *carried)


def nodes(steps: DataFrame, level: str = "class/program") -> DataFrame:
    """Support, last_seen and outcome counts of every key, with the synthetic Start and End."""
    outcome = lambda o: F.count_if(F.col("outcome") == o)
    own = steps.groupBy(key_at(level).alias("key")).agg(F.count("*").alias("support"), F.max("occurred_at").alias("last_seen"), outcome("failure").alias("n_failure"), outcome("neutral").alias("n_neutral"), outcome("success").alias("n_success"))
    ends = steps.groupBy(*KEY).agg(F.min_by("occurred_at", "position").alias("first"), F.max_by("occurred_at", "position").alias("last"))
    zero = [F.lit(0).cast("long").alias(f"n_{o}") for o in ("failure", "neutral", "success")]
    synthetic = ends.select(F.explode(F.array(F.struct(F.lit(START).alias("key"), F.col("first").alias("at")), F.struct(F.lit(END).alias("key"), F.col("last").alias("at")))).alias("e")).groupBy("e.key").agg(F.count("*").alias("support"), F.max("e.at").alias("last_seen")).select("key", "support", "last_seen", *zero)
    return own.unionByName(synthetic)


def top_templates(steps: DataFrame, level: str = "class/program", most: int = TOP_TEMPLATES) -> DataFrame:
    """The most frequent templates of each key, ties by text."""
    counted = steps.groupBy(key_at(level).alias("key"), "template").agg(F.count("*").alias("n"))
    return counted.withColumn("rank", F.row_number().over(W.partitionBy("key").orderBy(F.desc("n"), "template"))).where(F.col("rank") <= most)


def is_bookend() -> Column:
    return F.col("source").isin(START, END) | F.col("target").isin(START, END)


def edges(made: DataFrame, clean_weight: float = CLEAN_WEIGHT, scope: tuple[str, ...] = (), repeated: bool = False) -> DataFrame:
    """Support (distinct steps), observations, failures, weight and last_seen of every edge, for each value of scope.

    A step supports an edge once, so a count is enough, and one partial aggregation; repeated: steps may come several times.
    """
    weight = F.when(F.col("clean"), F.lit(float(clean_weight))).otherwise(F.lit(1.0))
    return made.groupBy(*scope, "source", "target").agg(
        (F.count_distinct("step_id") if repeated else F.count("step_id")).alias("support"), F.count("*").alias("observations"), F.count_if(F.col("outcome") == "failure").alias("failures"),
        F.count_if(F.col("outcome") == "success").alias("successes"), F.sum(weight).alias("weight"), F.max("occurred_at").alias("last_seen"),
    )


def supporting_steps(made: DataFrame, most: int = SUPPORTING_KEPT) -> DataFrame:
    """The largest distinct step ids of each edge, ascending."""
    distinct = made.select("source", "target", "step_id").distinct()
    latest = distinct.withColumn("rank", F.row_number().over(W.partitionBy("source", "target").orderBy(F.desc("step_id")))).where(F.col("rank") <= most)
    return latest.groupBy("source", "target").agg(F.array_sort(F.collect_list("step_id")).alias("steps"))


def modal_conditions(made: DataFrame, scope: tuple[str, ...] = ()) -> DataFrame:
    """The most frequent context of each edge, for each value of scope; ties as the fixed order of contexts says."""
    context = ("process_type", "same_file", "previous_outcome", "intended_activity")
    return modal_of(made.groupBy(*scope, "source", "target", *context).agg(F.count("*").alias("n")), scope)


def modal_of(counted: DataFrame, scope: tuple[str, ...] = ()) -> DataFrame:
    """The most frequent context of each edge, from counts of contexts."""
    file_rank = F.when(F.col("same_file").isNull(), 1).when(F.col("same_file"), 2).otherwise(0)
    order = (F.desc("n"), "process_type", file_rank, F.asc_nulls_last("previous_outcome"), F.asc_nulls_last("intended_activity"))
    return counted.withColumn("rank", F.row_number().over(W.partitionBy(*scope, "source", "target").orderBy(*order))).where("rank = 1").drop("rank")


def base_failure_rate(made: DataFrame) -> DataFrame:
    """One row: failures over observations of all moves between steps."""
    rate = F.when(F.count("*") > 0, F.count_if(F.col("outcome") == "failure") / F.count("*")).otherwise(F.lit(0.0))
    return made.where(~is_bookend()).agg(rate.alias("base_rate"))


def failure_prone(made: DataFrame, steps: DataFrame | None = None, min_support: int = MIN_SUPPORT) -> DataFrame:
    """Edges that fail more often than the whole graph, with the template that fails most.

    One aggregation by edge and template gives support, failures and evidence, and in sum the base rate. Moves without a
    template take it from `steps`.
    """
    inner = made.where(~is_bookend())
    if "template" not in made.columns:
        inner = inner.join(steps.select("step_id", "template"), "step_id")
    return prone_of(inner.groupBy("source", "target", "template").agg(F.count("*").alias("n"), F.count_if(F.col("outcome") == "failure").alias("failures")), min_support)


def prone_of(by_template: DataFrame, min_support: int = MIN_SUPPORT) -> DataFrame:
    """Failure-prone edges, from the counts of moves (n) and failures by edge and template."""
    worst = F.min(F.when(F.col("failures") > 0, F.struct((-F.col("failures")).alias("less"), "template")))
    rated = by_template.groupBy("source", "target").agg(F.sum("n").alias("support"), F.sum("failures").alias("failures"), worst.alias("worst"))
    base = rated.agg((F.sum("failures") / F.sum("support")).alias("base_rate"))
    prone = rated.where(F.col("support") >= min_support).withColumn("failure_rate", F.col("failures") / F.col("support")).join(F.broadcast(base)).where("failure_rate > base_rate")
    return prone.select("source", "target", "support", "failure_rate", F.col("worst.template").alias("evidence"))


def runs(steps: DataFrame, level: str = "class/program") -> DataFrame:
    """Maximal runs of one key within a sequence: key, first position and length."""
    by_key = W.partitionBy(*KEY, "node").orderBy("position")
    island = steps.withColumn("node", key_at(level)).withColumn("island", F.col("position") - F.row_number().over(by_key))
    return island.groupBy(*KEY, "node", "island").agg(F.min("position").alias("begins"), F.max("position").alias("ends"), F.count("*").alias("length"))


def repetition_loops(steps: DataFrame, level: str = "class/program", k: int = LOOP_LENGTH) -> DataFrame:
    """How many runs of each key are at least k long; a run counts once."""
    return runs(steps, level).where(F.col("length") >= k).groupBy("node").agg(F.count("*").alias("loops"))


def sequence_outcomes(steps: DataFrame) -> DataFrame:
    failed, done = F.bool_or(F.col("outcome") == "failure"), F.bool_or(F.col("outcome") == "success")
    return steps.groupBy(*KEY).agg(F.when(failed, "failure").when(done, "success").otherwise("neutral").alias("derived_outcome"), F.count("*").alias("step_count"))


def merge(existing: DataFrame, delta: DataFrame) -> DataFrame:
    """Totals of two edge folds added; a fold of a delta onto a stored one."""
    totals = ("support", "observations", "failures", "successes", "weight")
    names = ["source", "target", *totals, "last_seen"]
    return existing.select(*names).unionByName(delta.select(*names)).groupBy("source", "target").agg(*[F.sum(c).alias(c) for c in totals], F.max("last_seen").alias("last_seen"))


def assembled_pitfalls(found: DataFrame, prone: DataFrame, loops: DataFrame) -> DataFrame:
    """Edges with their pitfalls, failure_prone before repetition_loop; bookends have none."""
    failing = prone.select("source", "target", F.lit("failure_prone").alias("p1"))
    looping = loops.select(F.col("node").alias("source"), F.col("node").alias("target"), F.lit("repetition_loop").alias("p2"))
    both = found.join(failing, ["source", "target"], "left").join(looping, ["source", "target"], "left")
    named = F.filter(F.array("p1", "p2"), lambda p: p.isNotNull())
    return both.withColumn("pitfalls", F.when(is_bookend(), F.array().cast("array<string>")).otherwise(named)).drop("p1", "p2")


def generated_at(steps: DataFrame) -> DataFrame:
    """One row: when the newest step happened, else the beginning of 1970."""
    return steps.agg(F.coalesce(F.max("occurred_at"), F.timestamp_seconds(F.lit(0))).alias("generated_at"))


def merge_supporting(existing: DataFrame, delta: DataFrame, most: int = SUPPORTING_KEPT) -> DataFrame:
    """The union of two tables of supporting steps (source, target, steps): the largest ids, ascending."""
    both = existing.unionByName(delta).groupBy("source", "target").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("steps")))).alias("steps"))
    return both.withColumn("steps", F.slice("steps", F.greatest(F.size("steps") - most + 1, F.lit(1)), most))


def merge_templates(existing: DataFrame, delta: DataFrame, most: int = TOP_TEMPLATES) -> DataFrame:
    """Two tables of top templates (key, template, n) summed and ranked again."""
    summed = existing.select("key", "template", "n").unionByName(delta.select("key", "template", "n")).groupBy("key", "template").agg(F.sum("n").alias("n"))
    return summed.withColumn("rank", F.row_number().over(W.partitionBy("key").orderBy(F.desc("n"), "template"))).where(F.col("rank") <= most)


def diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """Edges whose support differs between two graphs, or that only one of them has."""
    a, b = (d.select("source", "target", F.col("support").alias(n)) for d, n in ((left, "left_support"), (right, "right_support")))
    return a.join(b, ["source", "target"], "full_outer").where(~F.col("left_support").eqNullSafe(F.col("right_support")))


def refresh(existing: DataFrame, steps: DataFrame, sequences: DataFrame, since: int, level: str = "class/program", before: DataFrame | None = None) -> DataFrame:
    """The edges after steps beyond `since` arrived and sequences changed, equal to a rebuild.

    before: the sequences as `existing` saw them; those whose status or process type is another now count as touched, as
    do those with new steps. Only touched sequences are folded: what they gave before is taken off, what they give now is added.
    """
    told = ("status", "process_type", "project_dir_key")
    touched = steps.where(F.col("step_id") > since).select(*KEY)
    if before is not None:
        then = before.select(*KEY, *[F.col(c).alias(f"{c}_then") for c in told], F.lit(True).alias("known"))
        same = [F.col(c).eqNullSafe(F.col(f"{c}_then")) for c in told]
        touched = touched.union(sequences.join(then, list(KEY), "full_outer").where(~(F.coalesce("known", F.lit(False)) & same[0] & same[1] & same[2])).select(*KEY))
    touched = touched.distinct()
    own = steps.join(touched, list(KEY), "left_semi")
    less = edges(moves(own.where(F.col("step_id") <= since), sequences if before is None else before, level))
    more = edges(moves(own, sequences, level))
    totals = ("support", "observations", "failures", "successes", "weight")
    signed = [existing.select("source", "target", *totals, F.col("last_seen").alias("was"), F.lit(None).cast("timestamp").alias("left"), F.lit(None).cast("timestamp").alias("new"))]
    none = F.lit(None).cast("timestamp")
    signed.append(less.select("source", "target", *[(-F.col(c)).alias(c) for c in totals], none.alias("was"), F.col("last_seen").alias("left"), none.alias("new")))
    signed.append(more.select("source", "target", *totals, none.alias("was"), none.alias("left"), F.col("last_seen").alias("new")))
    summed = signed[0].unionByName(signed[1]).unionByName(signed[2]).groupBy("source", "target").agg(*[F.sum(c).alias(c) for c in totals], *[F.max(c).alias(c) for c in ("was", "left", "new")])
    summed = written(summed.where("observations > 0").withColumn("last_seen", F.greatest("was", "new")))  # a row for each edge, read twice
    # an edge whose latest move was taken off is dated anew, from all moves of its own; there are few, if any
    doubtful = summed.where("left = was AND (new IS NULL OR new < was)").select("source", "target")
    names = ("source", "target", *totals, "last_seen")
    if doubtful.isEmpty():
        return summed.select(*names)
    dated = moves(steps, sequences, level).join(doubtful, ["source", "target"], "left_semi").groupBy("source", "target").agg(F.max("occurred_at").alias("dated"))
    return summed.join(dated, ["source", "target"], "left").withColumn("last_seen", F.coalesce("dated", "last_seen")).select(*names)
