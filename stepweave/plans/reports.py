"""What somebody who looks at a store is told: reports by line, outcomes declared by prompt, dry runs, and what differs between graphs."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import asdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stepweave.config import Config
from stepweave.plans.graph import edge_key
from stepweave.schema import KEY

NO_PROMPT = "no sequence was opened for this prompt"
NONE_OPEN = "no sequence is open"


def mark_outcomes(sequences: DataFrame, marks: DataFrame) -> DataFrame:
    """Each mark (mark_id, prompt_id, outcome, declared_at) with the sequence it names: the one of its prompt that started last, or without a prompt_id the open one that started last.

    stored says whether there is one, else reason says why not; state compares with derived_outcome. Ties go to the larger key. Sequences of a
    prompt are reduced by partial aggregation, the open one is one row. The result goes on to tools.declare().
    """
    newest = lambda: F.max(F.struct("started_at", *KEY, "derived_outcome"))
    by_prompt = sequences.where("prompt_id IS NOT NULL").groupBy(F.col("prompt_id").alias("_asked")).agg(newest().alias("_own"))
    open_ = sequences.where("status <> 'closed'").agg(newest().alias("_open"))
    asked = marks.withColumnRenamed("prompt_id", "_asked").join(by_prompt, "_asked", "left").join(F.broadcast(open_))
    found = asked.withColumn("_found", F.when(F.col("_asked").isNull(), F.col("_open")).otherwise(F.col("_own")))
    stored = F.col("_found").isNotNull()
    state = F.when(stored, F.when(F.col("outcome") == F.col("_found.derived_outcome"), "confirmed").otherwise("overridden"))
    reason = F.when(~stored, F.when(F.col("_asked").isNull(), NONE_OPEN).otherwise(NO_PROMPT))
    return found.select(
        "mark_id", F.coalesce("_found.prompt_id", "_asked").alias("prompt_id"), *[F.col(f"_found.{k}").alias(k) for k in KEY if k != "prompt_id"], stored.alias("stored"),
        F.when(stored, F.col("outcome")).alias("declared_outcome"), F.col("_found.derived_outcome").alias("derived_outcome"), state.alias("state"), reason.alias("reason"), "declared_at",
    )


def dry_run(arriving: DataFrame, stored: DataFrame | None, by: tuple[str, ...] = ()) -> DataFrame:
    """How many steps a real run would record and how many it would find stored or repeated, for each value of `by` (of a key's first arrival); nothing is written."""
    here = arriving.select("dedup_key", F.struct("step_id", *by).alias("at"), F.lit(1).alias("n"))
    both = here if stored is None else here.unionByName(stored.select("dedup_key"), allowMissingColumns=True)
    keys = both.groupBy("dedup_key").agg(F.min("at").alias("at"), F.count("n").alias("arrived"), F.count_if(F.col("n").isNull()).alias("there")).where("arrived > 0")
    new = F.count_if(F.col("there") == 0)
    return keys.select("arrived", "there", *[F.col(f"at.{c}").alias(c) for c in by]).groupBy(*by).agg(new.alias("recorded"), (F.coalesce(F.sum("arrived"), F.lit(0)) - new).alias("duplicates"))


def changes(left: DataFrame, right: DataFrame, columns: tuple[str, ...] = ("support", "weight"), by: tuple[str, ...] = ("source", "target")) -> DataFrame:
    """Rows of two graphs that only one has or that differ in any of the columns: both values of each, the names that differ, and which side has the row."""
    a = left.select(*by, *[F.col(c).alias(f"left_{c}") for c in columns], F.lit(True).alias("_a"))
    b = right.select(*by, *[F.col(c).alias(f"right_{c}") for c in columns], F.lit(True).alias("_b"))
    both = a.join(b, list(by), "full_outer")
    names = F.filter(F.array(*[F.when(~F.col(f"left_{c}").eqNullSafe(F.col(f"right_{c}")), c) for c in columns]), lambda n: n.isNotNull())
    side = F.when(F.col("_b").isNull(), "left").when(F.col("_a").isNull(), "right").otherwise("both")
    told = both.withColumns({"differs": names, "side": side}).where("side <> 'both' OR size(differs) > 0")
    return told.select(*by, "side", "differs", *[f"{s}_{c}" for c in columns for s in ("left", "right")])


def first_difference(left: DataFrame, right: DataFrame, columns: tuple[str, ...] = ("support", "weight"), by: tuple[str, ...] = ("source", "target")) -> DataFrame:
    """The first row of changes() in order of the key; no row if the graphs agree."""
    return changes(left, right, columns, by).orderBy(*by).limit(1)


# ---- reports: lines, with the columns that put them in order ----


def show_counters(totals: DataFrame) -> DataFrame:
    """Every counter and its count, by name; (name, n) as store.totals() gives them."""
    return totals.select("name", F.concat_ws(" ", "name", F.col("n").cast("string")).alias("line")).orderBy("name")


def show_config(spark: SparkSession, config: Config, origin: Mapping[str, str]) -> DataFrame:
    """Every setting, its value and where it comes from."""
    rows = [(i, name, f"{name} {value} {origin[name]}") for i, (name, value) in enumerate(asdict(config).items())]
    return spark.createDataFrame(rows, "place int, name string, line string").orderBy("place")


def _named(name: str, value: str | Column) -> Column:
    return F.concat(F.lit(f"{name}="), F.coalesce(F.col(value).cast("string") if isinstance(value, str) else value, F.lit("none")))


def show_graph(nodes: DataFrame, edges: DataFrame, conditions: DataFrame, notes: DataFrame | None = None) -> DataFrame:
    """Lines of a graph (part, key, line): how much there is of it, each node with its counts, each edge with its support, its condition and its notes (edge_key, text).

    part puts shape before nodes before edges; order by (part, key).
    """
    shape = nodes.agg(F.count("*").alias("n")).select(F.lit("0 shape").alias("part"), F.lit("nodes").alias("key"), F.concat(F.lit("nodes "), F.col("n").cast("string")).alias("line"))
    shape = shape.unionByName(edges.agg(F.count("*").alias("n")).select(F.lit("0 shape").alias("part"), F.lit("edges").alias("key"), F.concat(F.lit("edges "), F.col("n").cast("string")).alias("line")))
    node = nodes.select(F.lit("1 node").alias("part"), "key", F.concat_ws("  ", "key", *[_named(c, c) for c in ("support", "n_failure", "n_neutral", "n_success")]).alias("line"))
    told = edges.select("source", "target", "support").join(conditions.select("source", "target", "process_type", "same_file", "previous_outcome"), ["source", "target"], "left").withColumn("key", edge_key(F.col("source"), F.col("target")))
    if notes is not None:
        told = told.join(notes.groupBy(F.col("edge_key").alias("key")).agg(F.array_join(F.array_sort(F.collect_list("text")), "; ").alias("_notes")), "key", "left")
    said = F.when(F.col("_notes").isNotNull(), F.concat(F.lit("notes: "), "_notes")) if notes is not None else F.lit(None).cast("string")
    condition = F.concat_ws(" ", *[_named(c, c) for c in ("process_type", "same_file", "previous_outcome")])
    edge = told.select(F.lit("2 edge").alias("part"), "key", F.concat_ws("  ", "key", _named("support", "support"), condition, said).alias("line"))
    return shape.unionByName(node).unionByName(edge)


def show_sequences(sequences: DataFrame, counted: DataFrame, project: str | None = None) -> DataFrame:
    """A line for each sequence (with derived_outcome and step_count from `counted`; declared_outcome if sequences have it) of a project or of all, newest first by started_at: its shape, none of its texts."""
    own = sequences if project is None else sequences.where(F.col("project_dir_key") == project)
    own = own.drop("derived_outcome", "step_count").join(counted.select(*KEY, "derived_outcome", "step_count"), list(KEY))
    declared = F.col("declared_outcome") if "declared_outcome" in own.columns else F.lit(None).cast("string")
    parts = F.array(*[F.col(k).cast("string") for k in KEY])
    identity = F.array_join(F.filter(parts, lambda p: F.length(p) > 0), "/")
    line = F.concat_ws("  ", identity, _named("process", "process_type"), _named("steps", "step_count"), _named("status", "status"), _named("derived", "derived_outcome"), _named("declared", declared))
    return own.select("project_dir_key", "started_at", line.alias("line")).orderBy(F.desc("started_at"), "line")
