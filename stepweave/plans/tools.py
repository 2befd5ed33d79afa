"""What the serving tools answer: inspection, declared outcomes, edit attribution and the rendered report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stepweave.functions import symbols
from stepweave.schema import KEY


def is_a(level: str) -> Column:
    """Ancestors of a step's key, coarsest last."""
    full = [F.concat_ws("/", "activity_class", "program"), F.col("activity_class")]
    return F.array(*full[{"class": 2, "class/program": 1, "class/program/ext": 0}[level] :]) if level != "class" else F.array().cast("array<string>")


def between(steps: DataFrame, since: Column | None = None, until: Column | None = None) -> DataFrame:
    """Steps from `since` on and before `until`. Filters stay above the window that gave the positions, which need the whole sequence."""
    if since is not None:
        steps = steps.where(F.col("occurred_at") >= since)
    return steps if until is None else steps.where(F.col("occurred_at") < until)


def inspect_edges(edges: DataFrame) -> DataFrame:
    """Counts only: what leaves the store when somebody looks."""
    return edges.select("source", "target", "support", "weight")


def served_document(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One JSON body for each node and edge, as a snapshot serves them."""
    node = nodes.select(F.lit("node").alias("kind"), F.col("key"), F.to_json(F.struct("support", "last_seen", F.struct("n_failure", "n_neutral", "n_success").alias("outcome_counts"))).alias("body"))
    edge = edges.select(F.lit("edge").alias("kind"), F.concat("source", F.lit(" -> "), "target").alias("key"), F.to_json(F.struct("source", "target", "support", "weight")).alias("body"))
    return node.unionByName(edge)


def declare(sequences: DataFrame, declared: DataFrame) -> DataFrame:
    """Sequences with the outcome that was declared last beside the derived one, and how they compare."""
    last = declared.withColumn("rank", F.row_number().over(W.partitionBy(*KEY).orderBy(F.desc("declared_at")))).where("rank = 1").select(*KEY, "declared_outcome")
    state = F.when(F.col("declared_outcome") == F.col("derived_outcome"), "confirmed").when(F.col("declared_outcome").isNotNull(), "overridden")
    return sequences.join(last, list(KEY), "left").withColumn("state", state)


def symbols_of(sources: DataFrame) -> DataFrame:
    """file, symbol, begins and ends of the symbols of sources (file, extension, text)."""
    kind = T.ArrayType(T.StructType([T.StructField("symbol", T.StringType()), T.StructField("begins", T.IntegerType()), T.StructField("ends", T.IntegerType())]))
    parsed = F.udf(lambda text, extension: symbols.parse(text or "", extension or "")[0], kind)
    return sources.select("file", F.inline(parsed("text", "extension")))


def _blocks(begins: str, ends: str) -> Column:
    """The aligned blocks of 2^level lines that make up begins to ends, two a level at most; null where it ends before it begins.

    At each level the block at the left stands alone if its number is odd, the one at the right if its number is even.
    """
    left, right = f"shiftright({begins} + shiftleft(1L, k) - 1, k)", f"shiftright({ends} + 1L, k)"
    block = "named_struct('level', k, 'block', {}, 'taken', {} < {} AND ({} & 1L) = 1L)".format
    levels = f"sequence(0, CAST(floor(log2({ends} - {begins} + 1)) AS INT))"
    return F.expr(f"filter(flatten(transform({levels}, k -> array({block(left, left, right, left)}, {block(right + ' - 1', left, right, right)}))), b -> b.taken)")


def attribute_edits(edits: DataFrame, found: DataFrame) -> DataFrame:
    """Each edit (edit_id, file, line) with the narrowest symbol of its file that encloses the line and where that begins, null if none does.

    Of equally narrow ones the first to begin, then the first by name. Symbols (file, symbol, begins, ends) may cross one
    another. A symbol is cut into blocks of 2^level lines, each block keeps its narrowest symbol, and a line asks the one
    block of each level that it lies in: as many rows as there are levels, however many symbols enclose it.
    """
    wide = found.select("file", "symbol", F.col("begins").cast("long").alias("_b"), F.col("ends").cast("long").alias("_e"), F.struct((F.col("ends") - F.col("begins")).alias("size"), "begins", "symbol").alias("s"))
    cut = wide.select("file", "s", F.explode(_blocks("_b", "_e")).alias("k")).select("file", "k.level", "k.block", "s")
    narrow = cut.groupBy("file", "level", "block").agg(F.min("s").alias("s"))
    levels = narrow.agg(F.expr("bit_or(shiftleft(1L, level))").alias("levels"))  # one row
    asked = edits.select("edit_id", "file", F.col("line").cast("long").alias("line")).join(F.broadcast(levels))
    asked = asked.withColumn("level", F.explode(F.expr("filter(sequence(0, 62), k -> (levels & shiftleft(1L, k)) <> 0)"))).withColumn("block", F.expr("shiftright(line, level)"))
    best = asked.join(narrow, ["file", "level", "block"]).groupBy("edit_id").agg(F.min("s").alias("s"))
    return edits.join(best, "edit_id", "left").select(*edits.columns, F.col("s.symbol").alias("symbol"), F.col("s.begins").alias("symbol_begins"))


def prefixes(steps: DataFrame, node: Column) -> DataFrame:
    """Every prefix of every sequence: its length, its last key and how many different keys it holds; for replaying a log live."""
    so_far = W.partitionBy(*KEY).orderBy("position").rowsBetween(W.unboundedPreceding, 0)
    named = steps.withColumn("node", node)
    new = (F.row_number().over(W.partitionBy(*KEY, "node").orderBy("position")) == 1).cast("long")
    return named.withColumn("new", new).select(*KEY, "position", "node", F.count("*").over(so_far).alias("length"), F.sum("new").over(so_far).alias("seen"))
