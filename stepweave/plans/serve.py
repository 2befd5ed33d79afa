"""Guidance: fusion of ranked edges, triggers, rendering within a budget, and the lookups behind the tools."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stepweave.plans.graph import class_of, edge_key, key_at
from stepweave.schema import BUDGET_CHARS, KEY, LOOP_LENGTH, MIN_SUPPORT, NOTE_CHARS, RRF_K, START


def rrf(rank: Column) -> Column:
    """Reciprocal-rank score of a rank from 0."""
    return F.lit(1.0) / (F.lit(float(RRF_K)) + rank + F.lit(1.0))


def fuse(project: DataFrame, everywhere: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Union of two edge lists (source, target, support): summed scores, project edges first, then by score and edge key."""
    def scored(edges: DataFrame, scope: str) -> DataFrame:
        named = edges.withColumn("edge_key", edge_key(F.col("source"), F.col("target")))
        rank = F.row_number().over(W.partitionBy(*(by or [F.lit(0)])).orderBy(F.desc("support"), "edge_key")) - 1
        return named.select(*by, "edge_key", "support", rrf(rank).alias("score"), F.lit(scope).alias("scope"))

    both = scored(project, "project").unionByName(scored(everywhere, "global"))
    own = F.max(F.col("scope") == "project")
    support = F.coalesce(F.max(F.when(F.col("scope") == "project", F.col("support"))), F.max("support"))
    merged = both.groupBy(*by, "edge_key").agg(F.sum("score").alias("score"), F.when(own, "project").otherwise("global").alias("scope"), support.alias("support"))
    order = W.partitionBy(*(by or [F.lit(0)])).orderBy(F.col("scope") == "global", F.desc("score"), "edge_key")
    return merged.withColumn("place", F.row_number().over(order))


def locate(steps: DataFrame, level: str = "class/program") -> DataFrame:
    """Where each sequence stands: the key of its last step."""
    return steps.groupBy(*KEY).agg(F.max_by(key_at(level), "position").alias("node"))


def likeliest(edges: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The best supported edge out of each node, ties by target."""
    return edges.withColumn("rank", F.row_number().over(W.partitionBy(*by, "source").orderBy(F.desc("support"), "target"))).where("rank = 1").drop("rank")


def repetition_firings(steps: DataFrame, edges: DataFrame, level: str = "class/program", k: int = LOOP_LENGTH) -> DataFrame:
    """First position of each (sequence, node) whose trailing run reaches k, where the node has an edge to itself."""
    named = steps.withColumn("node", key_at(level))
    island = named.withColumn("island", F.col("position") - F.row_number().over(W.partitionBy(*KEY, "node").orderBy("position")))
    counted = island.withColumn("length", F.row_number().over(W.partitionBy(*KEY, "node", "island").orderBy("position")))
    first = counted.where(F.col("length") == k).groupBy(*KEY, "node").agg(F.min("position").alias("position"))
    loops = edges.where("source = target").select(F.col("source").alias("node"))
    return first.join(loops, "node", "left_semi")


def after_write_firings(edges: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Nodes that change something and whose likeliest successor verifies."""
    return likeliest(edges, by).where((class_of(F.col("source")) == "ChangeImplementation") & (class_of(F.col("target")) == "ArtifactEvaluation")).select(*by, "source", "target", "support")


def pitfall_firings(edges: DataFrame, pitfalls: DataFrame) -> DataFrame:
    """Nodes whose likeliest successor is failure-prone, with the evidence."""
    return likeliest(edges).select("source", "target").join(pitfalls, ["source", "target"]).select("source", "target", "support", "evidence")


def fire(repetition: Column, pitfall: Column, after_write: Column, floor: int = MIN_SUPPORT) -> Column:
    """Which trigger speaks, from the supports of their edges (null: it does not fire): repetition over pitfall over after_write.

    The one chosen stays silent below the floor; the next does not take its place. struct<trigger, support, below_support>.
    """
    chosen = F.when(repetition.isNotNull(), "repetition").when(pitfall.isNotNull(), "pitfall").when(after_write.isNotNull(), "after_write")
    support = F.coalesce(repetition, pitfall, after_write)
    return F.struct(F.when(support >= floor, chosen).alias("trigger"), support.alias("support"), F.coalesce(support < floor, F.lit(False)).alias("below_support"))


def prompt_start(edges: DataFrame, floor: int = MIN_SUPPORT) -> DataFrame:
    """What a prompt without steps is told: every supplied edge out of Start that reaches the floor."""
    return edges.where((F.col("source") == START) & (F.col("support") >= floor))


def remember(arriving: DataFrame, edges: DataFrame, credential: Column) -> tuple[DataFrame, DataFrame]:
    """Notes (edge_key, text) that are accepted, each with an id of its own to be appended, and the others with the reason."""
    known = edges.select(edge_key(F.col("source"), F.col("target")).alias("edge_key")).distinct().withColumn("exists", F.lit(True))
    judged = arriving.join(known, "edge_key", "left").withColumn("reason", note_rejection(F.col("text"), F.col("exists").isNotNull(), credential)).drop("exists")
    return judged.where("reason IS NULL").drop("reason").withColumn("note_id", F.expr("uuid()")), judged.where("reason IS NOT NULL")


def within_budget(statements: DataFrame, by: tuple[str, ...], text: str = "text", support: str = "support", order: str = "edge_key", budget: int = BUDGET_CHARS) -> DataFrame:
    """The strongest statements whose lines, joined by newlines, fit the budget; the weakest go first, later ones before earlier."""
    strongest = W.partitionBy(*by).orderBy(F.desc(support), order)
    held = F.sum(F.char_length(text)).over(strongest.rowsBetween(W.unboundedPreceding, 0)) + F.row_number().over(strongest) - 1
    return statements.withColumn("held", held).where(F.col("held") <= budget).drop("held")


def line(text: Column, support: Column, note: Column | None = None) -> Column:
    prefix = F.lit("- ") if note is None else F.when(note, "- note: ").otherwise("- ")
    return F.concat(prefix, text, F.lit(" ("), support, F.lit(" episodes)"))


def claim(source: Column, target: Column) -> Column:
    opening = F.format_string("a prompt like this usually starts with %s", target)
    return F.when(source == START, opening).otherwise(F.format_string("after %s the work usually goes to %s", source, target))


def recall(steps: DataFrame, edges: DataFrame, min_support: int = MIN_SUPPORT) -> DataFrame:
    """For every sequence: the successors of where it stands, above the floor, rendered as lines within the budget."""
    spoken = edges.where(F.col("support") >= min_support).select("source", "target", "support", edge_key(F.col("source"), F.col("target")).alias("edge_key"), line(claim(F.col("source"), F.col("target")), F.col("support")).alias("text"))
    by_node = within_budget(spoken, ("source",))
    return locate(steps).join(by_node, F.col("node") == F.col("source")).select(*KEY, "node", "target", "support", "text")


def enforce(intended: DataFrame, project: DataFrame, everywhere: DataFrame) -> DataFrame:
    """Whether a failure-prone edge stands in the way of (source, target): project pitfalls first, then those of everywhere."""
    ranked = project.select("source", "target", "evidence", F.lit(0).alias("rank")).unionByName(everywhere.select("source", "target", "evidence", F.lit(1).alias("rank")))
    best = ranked.groupBy("source", "target").agg(F.min(F.struct("rank", "evidence")).alias("b"))
    return intended.join(best, ["source", "target"]).select(*intended.columns, F.when(F.col("b.rank") == 0, "project").otherwise("global").alias("scope"), F.format_string("%s is known to fail after %s", F.col("b.evidence"), F.col("source")).alias("reason"))


def reattach(edges: DataFrame, notes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges with their notes (edge_key, text), and the notes whose edge is gone."""
    keyed = edges.withColumn("edge_key", edge_key(F.col("source"), F.col("target")))
    grouped = notes.groupBy("edge_key").agg(F.array_sort(F.collect_list("text")).alias("notes"))
    return keyed.join(grouped, "edge_key", "left"), notes.join(keyed.select("edge_key"), "edge_key", "left_anti")


def note_rejection(text: Column, edge_exists: Column, credential: Column) -> Column:
    """Why an annotation is refused; the first reason that holds, null if it is accepted."""
    size = F.char_length(F.btrim(text))
    return F.when(~edge_exists, "no_such_edge").when((size < 1) | (size > NOTE_CHARS), "too_long").when(credential.isNotNull(), "credential")


def latest(sequences: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """The open sequence of each group that started last, ties by the key."""
    order = (F.desc("started_at"), *KEY)
    return sequences.where("status <> 'closed'").withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where("rank = 1").drop("rank")
