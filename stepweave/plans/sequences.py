"""Ordered analytics on chains: n-grams, back-off ranks, runs, look-ahead, touch chains and hold-out evaluation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stepweave.plans.graph import class_of, key_at
from stepweave.schema import BACKOFF_ORDER, KEY, MIN_SUPPORT
from stepweave.sources.arrival import numbered

#: Touches that one task puts in order at a time.
PORTION = 65_536
SAME, OTHER = "@same-file", "@other-file"


def contexts(steps: DataFrame, level: str = "class/program", orders: int = BACKOFF_ORDER, same_file: bool = True) -> DataFrame:
    """For every step and order that its position allows: the preceding keys, their marker and the step's key as target."""
    chain = W.partitionBy(*KEY).orderBy("position")
    named = steps.withColumn("node", key_at(level))
    lags = {f"l{i}": F.lag("node", i).over(chain) for i in range(1, orders + 1)} | {"f1": F.lag("files", 1).over(chain), "f2": F.lag("files", 2).over(chain)}
    placed = named.withColumns(lags)
    share = F.coalesce(F.arrays_overlap("f1", "f2"), F.lit(False))

    def context(n: int) -> Column:
        marker = F.when(share, SAME).otherwise(OTHER) if n > 1 else F.lit(OTHER)
        return F.struct(F.lit(n).alias("ord"), F.concat_ws("|", *[F.col(f"l{i}") for i in range(n, 0, -1)]).alias("ctx"), (marker if same_file else F.lit("")).alias("marker"))

    made = placed.withColumn("c", F.explode(F.slice(F.array(*[context(n) for n in range(1, orders + 1)]), 1, F.least(F.col("position"), F.lit(orders)).cast("int"))))
    return made.select(*KEY, "position", "step_id", "c.*", F.col("node").alias("target"))


def ngrams(made: DataFrame) -> DataFrame:
    return made.groupBy("ord", "ctx", "marker", "target").agg(F.count("*").alias("support"))


def ranked(counted: DataFrame) -> DataFrame:
    """Targets of each context by support, ties by key, with the context's total."""
    own = W.partitionBy("ord", "ctx", "marker")
    return counted.withColumns({"total": F.sum("support").over(own), "rank": F.row_number().over(own.orderBy(F.desc("support"), "target"))})


def backoff(asked: DataFrame, counted: DataFrame, min_support: int = MIN_SUPPORT, top: int | None = None) -> DataFrame:
    """For each asked step, the ranked targets (the first `top`, if given) of its longest context with enough support; asked has a row for each order.

    A context is one row with its targets in order, so a step meets one row an order and keeps the longest.
    """
    good = ranked(counted).where(F.col("total") >= min_support)
    good = good if top is None else good.where(F.col("rank") <= top)
    lists = good.groupBy("ord", "ctx", "marker").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("target").alias("predicted"), "support"))).alias("said"))
    longest = asked.join(lists, ["ord", "ctx", "marker"]).groupBy("step_id").agg(F.max(F.struct("ord", "target", "said")).alias("best"))
    return longest.select("step_id", "best.ord", "best.target", F.inline("best.said")).select("step_id", "ord", "target", "predicted", "support", "rank")


def trailing_runs(runs: DataFrame) -> DataFrame:
    """The last run of every sequence."""
    return runs.groupBy(*KEY).agg(F.max(F.struct("ends", "node", "length")).alias("r")).select(*KEY, "r.node", "r.length")


def verify_rate(steps: DataFrame, ahead: int = 5) -> DataFrame:
    """By extension: changes, and those that an evaluation follows within `ahead` steps of the sequence."""
    look = W.partitionBy(*KEY).orderBy("position").rowsBetween(1, ahead)
    seen = steps.withColumn("verified", F.coalesce(F.max((F.col("activity_class") == "ArtifactEvaluation").cast("int")).over(look), F.lit(0)))
    return seen.where("activity_class = 'ChangeImplementation' AND size(files) > 0").groupBy("file_ext").agg(F.count("*").alias("changes"), F.sum("verified").alias("verified"))


def touch_chains(steps: DataFrame, level: str = "class", files: int = 8, kept: int = 12, portion: int = PORTION) -> DataFrame:
    """For the most touched files: the ordered keys that touched them, equal neighbours as `key xN`, the first few kept.

    Touches are numbered in order of (file, time, step) and cut into portions. A portion gives its runs, one more than are
    kept at most: what is cut off lies behind more runs than anybody asks for. Runs that meet at a border are joined, so a
    task holds a portion, or one file's few runs of each portion.
    """
    touched = steps.select(F.explode("files").alias("file"), "occurred_at", "step_id", key_at(level).alias("node"))
    busiest = touched.groupBy("file").agg(F.count("*").alias("touches")).orderBy(F.desc("touches"), "file").limit(files)
    own = numbered(touched.join(F.broadcast(busiest), "file"), ("file", "occurred_at", "step_id"), "at")  # `files` rows
    whole = ("file", "touches")
    runs = _joined(own.select(*whole, "node", "at", F.lit(1).cast("long").alias("n"), F.floor(F.col("at") / portion).alias("_portion")), (*whole, "_portion"), kept + 1)
    first = _joined(runs, whole, kept)
    text = F.when(F.col("n") > 1, F.concat("node", F.lit(" x"), "n")).otherwise(F.col("node"))
    return first.groupBy(*whole).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", text.alias("text")))), lambda x: x["text"]), " > ").alias("chain"))


def _joined(runs: DataFrame, by: tuple[str, ...], kept: int) -> DataFrame:
    """Runs (node, at, n) of each group with equal neighbours made one, the first few of them."""
    chain = W.partitionBy(*by).orderBy("at")
    new = runs.withColumn("_new", (~F.lag("node").over(chain).eqNullSafe(F.col("node")) | (F.row_number().over(chain) == 1)).cast("int"))
    told = new.withColumn("_run", F.sum("_new").over(chain.rowsBetween(W.unboundedPreceding, 0))).where(F.col("_run") <= kept)
    return told.groupBy(*by, "_run").agg(F.first("node").alias("node"), F.min("at").alias("at"), F.sum("n").alias("n")).drop("_run")


def held_out(value: Column) -> Column:
    """The test quarter: the first hex digit of sha1 is 0 to 3."""
    return F.substring(F.sha1(value.cast("binary")), 1, 1).isin("0", "1", "2", "3")


def accuracy(train: DataFrame, test: DataFrame, on: list[str], target: str = "target", top: int = 3) -> DataFrame:
    """One row: moves tested, and how many have their target ranked first and among the first `top` of the trained context."""
    rank = F.row_number().over(W.partitionBy(*on).orderBy(F.desc("n"), target))
    table = train.groupBy(*on, target).agg(F.count("*").alias("n")).withColumn("rank", rank).where(F.col("rank") <= top).drop("n")
    hit = test.join(table, [*on, target], "left")
    return hit.agg(F.count("*").alias("tested"), F.count_if(F.col("rank") == 1).alias("top1"), F.count_if(F.col("rank").isNotNull()).alias("top3"))


def majority(train: DataFrame, test: DataFrame, target: str = "target", top: int = 3) -> DataFrame:
    """accuracy() of always naming the most frequent targets."""
    return accuracy(train.withColumn("all", F.lit(1)), test.withColumn("all", F.lit(1)), ["all"], target, top)


def triplets(steps: DataFrame, sequences: DataFrame) -> DataFrame:
    """Subject, predicate and object of what steps say about sequences, files and outcomes."""
    name = F.concat_ws(":", *KEY)
    step = F.concat(F.lit("step:"), "step_id")
    parts = [
        steps.select(name.alias("subject"), F.lit("composed of").alias("predicate"), step.alias("object")),
        steps.select(step.alias("subject"), F.lit("is a").alias("predicate"), class_of(key_at("class/program")).alias("object")),
        steps.select(step.alias("subject"), F.lit("has outcome").alias("predicate"), F.col("outcome").alias("object")),
        steps.select(step.alias("subject"), F.lit("uses").alias("predicate"), F.explode("files").alias("object")),
        sequences.select(name.alias("subject"), F.lit("has type").alias("predicate"), F.col("process_type").alias("object")),
    ]
    return reduce(DataFrame.unionByName, parts)
