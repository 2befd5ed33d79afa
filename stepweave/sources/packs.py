"""Dimension packs: a harness's tool vocabulary and concept hierarchies, as small tables to broadcast."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stepweave.schema import ACTIVITY_CLASSES

VOCABULARY = "version int, harness string, tools map<string, struct<class:string,program:string,decompose:string>>"
CONCEPTS = "version int, concepts array<struct<label:string,definition:string,parent:string>>, relations array<struct<label:string,definition:string,domain:string,range:string>>"

# Classes of the tools of the usual harness; a null class goes through the command grammar.
TOOLS = (("Read", "Inspection"), ("Grep", "Search"), ("Edit", "ChangeImplementation"), ("Write", "ChangeImplementation"), ("Task", "Delegation"), ("Bash", None))


#: Tools that may be broadcast; a harness has some dozens.
FEW_TOOLS = 100_000


class PackError(ValueError):
    """A pack is refused as a whole."""


def default_tools(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(pa.table({"tool_name": [t for t, _ in TOOLS], "tool_class": [c for _, c in TOOLS]}))


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """tool_name, tool_class and decompose of a vocabulary file; refused if a tool has neither a known class nor a grammar."""
    rows = spark.read.schema(VOCABULARY).json(path, multiLine=True).select(F.explode("tools").alias("tool_name", "e")).select("tool_name", F.col("e.class").alias("tool_class"), F.col("e.decompose").alias("decompose"))
    bad = rows.where((F.col("tool_class").isNull() & ~F.coalesce(F.col("decompose") == "shell", F.lit(False))) | (F.col("tool_class").isNotNull() & ~F.col("tool_class").isin(*ACTIVITY_CLASSES)))
    if names := [r.tool_name for r in bad.limit(5).collect()]:
        raise PackError(f"tools without a class or grammar: {names}")
    return rows


def concepts(spark: SparkSession, path: str, required: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Concepts and relations of a pack; refused if a label repeats, a parent is missing or a required label is absent."""
    pack = spark.read.schema(CONCEPTS).json(path, multiLine=True)
    own, relations = pack.select(F.inline("concepts")), pack.select(F.inline("relations"))
    if r := own.groupBy("label").count().where("count > 1").first():
        raise PackError(f"label {r.label} is defined twice")
    needed = own.where("parent IS NOT NULL").select(F.col("parent").alias("label")).unionByName(spark.createDataFrame([(x,) for x in required], "label string"))
    if r := needed.join(own, "label", "left_anti").first():
        raise PackError(f"label {r.label} is not defined")
    return own, relations


def ancestors(own: DataFrame, depth: int = 4) -> DataFrame:
    """label, ancestor and distance of every concept, up to `depth` levels."""
    parents = own.where("parent IS NOT NULL").select("label", F.col("parent").alias("ancestor"))
    level, out = parents.withColumn("distance", F.lit(1)), None
    for d in range(1, depth + 1):
        out = level if out is None else out.unionByName(level)
        up = parents.select(F.col("label").alias("ancestor"), F.col("ancestor").alias("next"))
        level = level.join(up, "ancestor").select("label", F.col("next").alias("ancestor"), F.lit(d + 1).alias("distance"))
    return out


def classify_tools(events: DataFrame, tools: DataFrame, tool: str = "tool_name") -> DataFrame:
    """Adds activity_class: the vocabulary's class of the tool, Unknown for tools that it does not know."""
    dim = tools.select(F.col("tool_name").alias(tool), "tool_class", F.lit(True).alias("known"))
    few = tools.limit(FEW_TOOLS + 1).count() <= FEW_TOOLS
    joined = events.join(F.broadcast(dim) if few else dim, tool, "left")
    return joined.withColumn("activity_class", F.when(F.col("known"), F.col("tool_class")).otherwise("Unknown")).drop("tool_class", "known")


def tool_path(arguments: Column) -> Column:
    """The file that a tool acts on, from its JSON arguments."""
    return F.coalesce(*[F.nullif(F.get_json_object(arguments, f"$.{n}"), F.lit("")) for n in ("file_path", "notebook_path", "path")])


def tool_tokens(name: Column, arguments: Column) -> Column:
    """A tool's tokens: its name and the sorted names of its arguments, never their values."""
    return F.concat(F.array(name), F.array_sort(F.coalesce(F.json_object_keys(arguments), F.array().cast("array<string>"))))
