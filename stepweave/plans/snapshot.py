"""A graph that grows by batches: mergeable state, from which nodes, edges, conditions and pitfalls follow.

`facts` counts the moves by edge, context, template and outcome; it is a sum, so batches add to it and changed sequences are taken off
and added anew. Three small tables hold what a sum cannot: the last move of each sequence (`tails`), the largest supporting steps of
edges between steps, which are never taken back (`kept`), and long runs (`loops`). All are far smaller than the steps.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stepweave.plans import graph as g
from stepweave.schema import CLEAN_WEIGHT, END, KEY, LOOP_LENGTH, MIN_SUPPORT, START, SUPPORTING_KEPT, TOP_TEMPLATES
from stepweave.sources.arrival import written

CONTEXT = ("process_type", "same_file", "previous_outcome", "intended_activity")
FACTS = ("source", "target", *CONTEXT, "template", "outcome", "clean")


@dataclass(frozen=True)
class State:
    """The tables of a graph's state."""

    facts: DataFrame
    tails: DataFrame
    kept: DataFrame
    loops: DataFrame

    def write(self, path: str) -> None:
        for f in fields(self):
            getattr(self, f.name).write.parquet(f"{path}/{f.name}")


def read_state(spark: SparkSession, path: str) -> State:
    return State(*(spark.read.parquet(f"{path}/{f.name}") for f in fields(State)))


def _facts(made: DataFrame, sign: int = 1) -> DataFrame:
    return made.groupBy(*FACTS).agg((F.count("*") * sign).alias("n"), F.max(F.when(F.lit(sign) > 0, F.col("occurred_at"))).alias("last_seen"))


def _moves(steps: DataFrame, sequences: DataFrame, level: str) -> DataFrame:
    """Moves without what no table of the state holds."""
    return g.moves(steps, sequences, level).select(*KEY, *FACTS, "step_id", "occurred_at")


def _tails(made: DataFrame) -> DataFrame:
    return made.where(F.col("target") == END).select(*KEY, "source", "step_id", "occurred_at")


def _loops(steps: DataFrame, level: str, sign: int = 1) -> DataFrame:
    return g.repetition_loops(steps, level, LOOP_LENGTH).withColumn("loops", F.col("loops") * sign)


def fold(steps: DataFrame, sequences: DataFrame, level: str = "class/program") -> State:
    """The state of whole tables."""
    made = written(_moves(steps, sequences, level))  # read three times
    return State(_facts(made), _tails(made), g.supporting_steps(made.where(F.col("target") != END)), _loops(steps, level))


def advance(state: State, then: tuple[DataFrame, DataFrame], now: tuple[DataFrame, DataFrame], level: str = "class/program") -> State:
    """The state after some sequences changed: then and now are all steps of those sequences, and their sequence rows, before and after."""
    before, after = _moves(*then, level), written(_moves(*now, level))  # the latter are read three times
    facts = state.facts.unionByName(_facts(before, -1)).unionByName(_facts(after)).groupBy(*FACTS).agg(F.sum("n").alias("n"), F.max("last_seen").alias("last_seen")).where("n > 0")
    touched = now[0].select(*KEY).distinct()
    tails = state.tails.join(touched, list(KEY), "left_anti").unionByName(_tails(after))
    kept = g.merge_supporting(state.kept, g.supporting_steps(after.where(F.col("target") != END)), SUPPORTING_KEPT)
    loops = state.loops.unionByName(_loops(then[0], level, -1)).unionByName(_loops(now[0], level)).groupBy("node").agg(F.sum("loops").alias("loops")).where("loops > 0")
    return State(facts, tails, kept, loops)


def edges(state: State, clean_weight: float = CLEAN_WEIGHT) -> DataFrame:
    """Totals of every edge; when an edge to End was last seen is told by the sequences that end so now."""
    weight = F.when(F.col("clean"), F.lit(float(clean_weight))).otherwise(F.lit(1.0)) * F.col("n")
    n = lambda outcome: F.sum(F.when(F.col("outcome") == outcome, F.col("n")).otherwise(0))
    totals = state.facts.groupBy("source", "target").agg(F.sum("n").alias("support"), F.sum("n").alias("observations"), n("failure").alias("failures"), n("success").alias("successes"), F.sum(weight).alias("weight"), F.max("last_seen").alias("seen"))
    ends = state.tails.groupBy("source").agg(F.max("occurred_at").alias("ended")).withColumn("target", F.lit(END))
    return totals.join(ends, ["source", "target"], "left").withColumn("last_seen", F.coalesce("ended", "seen")).drop("seen", "ended")


def conditions(state: State) -> DataFrame:
    """The modal condition of every edge."""
    return g.modal_of(state.facts.groupBy("source", "target", *CONTEXT).agg(F.sum("n").alias("n")))


def pitfalls(state: State, min_support: int = MIN_SUPPORT) -> DataFrame:
    """Edges that fail more often than the whole graph, as graph.failure_prone gives them."""
    inner = state.facts.where(~g.is_bookend())
    return g.prone_of(inner.groupBy("source", "target", "template").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("outcome") == "failure", F.col("n")).otherwise(0)).alias("failures")), min_support)


def supporting(state: State) -> DataFrame:
    """The largest supporting steps of every edge."""
    latest = state.tails.withColumn("rank", F.row_number().over(W.partitionBy("source").orderBy(F.desc("step_id")))).where(F.col("rank") <= SUPPORTING_KEPT)
    ends = latest.groupBy("source").agg(F.array_sort(F.collect_list("step_id")).alias("steps")).withColumn("target", F.lit(END))
    return state.kept.unionByName(ends)


def nodes(state: State) -> DataFrame:
    """Support, last_seen and outcome counts of every key, with Start and End: a step is the target of one move."""
    count = lambda o: F.sum(F.when(F.col("outcome") == o, F.col("n")).otherwise(0))
    own = state.facts.where(F.col("target") != END).groupBy(F.col("target").alias("key")).agg(F.sum("n").alias("support"), F.max("last_seen").alias("last_seen"), count("failure").alias("n_failure"), count("neutral").alias("n_neutral"), count("success").alias("n_success"))
    zero = [F.lit(0).cast("long").alias(f"n_{o}") for o in ("failure", "neutral", "success")]
    first = state.facts.where(F.col("source") == START).agg(F.lit(START).alias("key"), F.sum("n").alias("support"), F.max("last_seen").alias("last_seen"))
    last = state.tails.agg(F.lit(END).alias("key"), F.count("*").alias("support"), F.max("occurred_at").alias("last_seen"))
    return own.unionByName(first.unionByName(last).where("support > 0").select("key", "support", "last_seen", *zero))


def templates(state: State, most: int = TOP_TEMPLATES) -> DataFrame:
    """The most frequent templates of each key, ties by text."""
    counted = state.facts.where(F.col("target") != END).groupBy(F.col("target").alias("key"), "template").agg(F.sum("n").alias("n"))
    return counted.withColumn("rank", F.row_number().over(W.partitionBy("key").orderBy(F.desc("n"), "template"))).where(F.col("rank") <= most)
