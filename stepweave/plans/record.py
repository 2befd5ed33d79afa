"""From completed tool calls to steps and sequences: vocabulary or shell grammar, template, files, outcome, key and position.

The input is what the readers in sources/transcript.py give. One join with the (broadcast) vocabulary deals the calls to
the shell grammar or to a single step; all else is built-in functions. Steps are numbered as they arrive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stepweave.functions import scalars as fn
from stepweave.functions import udf
from stepweave.schema import KEY
from stepweave.sources.arrival import high_water, numbered
from stepweave.sources.packs import classify_tools, tool_path, tool_tokens


def procedure_suffix(files: Column) -> Column:
    """The suffix of the first file, lower-cased and without its point; -- where there is no file or no suffix (.profile has none)."""
    name = F.regexp_extract(F.coalesce(F.get(files, 0), F.lit("")), "([^/]*)/*$", 1)
    return F.coalesce(F.nullif(F.lower(F.regexp_extract(name, r"^.+\.([^.]+)$", 1)), F.lit("")), F.lit("--"))


#: Where an event stands in its log; readers add these.
ARRIVAL = ("file", "record", "part")


def steps_of(events: DataFrame, tools: DataFrame, home: str, stored: DataFrame | None = None, order: tuple[str, ...] = ARRIVAL) -> DataFrame:
    """Steps of events (conversation_id, prompt_id, agent_id, project_dir, tool_name, tool_call_id, tool_call_arguments, tool_call_result, occurred_at; session_epoch if they have one).

    A tool that the vocabulary gives no class goes through the shell grammar and may be several steps; outcomes come from
    the result's text. Each key (call id and ordinal within the action, else a digest) is one step, the first to arrive.
    step_id are dense numbers in order of arrival: the columns `order`, then the ordinal. With `stored`, steps of an earlier
    call, only steps whose keys are new come, with ids after the largest stored one and positions after those of their sequence.
    """
    epoch = F.col("session_epoch").cast("long") if "session_epoch" in events.columns else F.lit(0).cast("long")
    named = {c: F.coalesce(c, F.lit("")) for c in ("conversation_id", "prompt_id", "agent_id")}  # a key has no nulls, so that sequences join
    told = classify_tools(events.withColumns({"session_epoch": epoch, **named}), tools)
    shell = F.col("activity_class").isNull()
    path = tool_path(F.col("tool_call_arguments"))
    single = F.struct(
        F.lit(0).alias("ordinal"), "activity_class", F.col("tool_name").alias("program"), tool_tokens(F.col("tool_name"), F.col("tool_call_arguments")).alias("tokens"),
        F.when(path.isNull(), F.array().cast("array<string>")).otherwise(F.array(path)).alias("files"),
    )
    # one pass over the events for both kinds; a line without an activity gives a row without an ordinal
    decomposed = told.withColumn("_shell", udf.activities(F.when(shell, F.coalesce(F.get_json_object("tool_call_arguments", "$.command"), F.lit("")))))
    both = decomposed.select(*[c for c in told.columns if c != "activity_class"], F.inline_outer(F.when(shell, F.col("_shell")).otherwise(F.array(single)))).where("ordinal IS NOT NULL")
    # Python looks at the rows before they are shuffled: the numbering reads what comes after twice
    both = both.withColumns({"files": udf.normalise_paths(F.col("files"), F.col("project_dir"), home), "template": udf.template(F.col("tokens"))}).drop("tokens").withColumn("dedup_key", fn.event_key(F.col("session_epoch")))
    arrival = (*order, "ordinal")
    first = both.withColumn("_rank", F.row_number().over(W.partitionBy("dedup_key").orderBy(*arrival))).where("_rank = 1").drop("_rank")
    if stored is not None:
        first = first.join(stored.select("dedup_key"), "dedup_key", "left_anti")
    made = first.select(
        *order, "ordinal", "conversation_id", "session_epoch", "prompt_id", "agent_id", "activity_class", "program", procedure_suffix(F.col("files")).alias("file_ext"),
        "template", "files", fn.outcome(F.col("tool_call_result")).alias("outcome"), "occurred_at", "tool_call_id", "dedup_key", "project_dir",
    )
    counted = numbered(made, arrival, "step_id", 0 if stored is None else high_water(stored)).drop(*arrival)
    placed = counted.withColumn("position", (F.row_number().over(W.partitionBy(*KEY).orderBy("step_id")) - 1).cast("long"))
    if stored is not None:
        before = stored.groupBy(*KEY).agg(F.count("*").alias("_before"))
        placed = placed.join(before, list(KEY), "left").withColumn("position", F.col("position") + F.coalesce("_before", F.lit(0))).drop("_before")
    return placed.select("step_id", *[c for c in placed.columns if c != "step_id"])


def open_sequences(steps: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Sequences with those that steps open added: insert if absent; new ones are open and of Unknown type."""
    first = steps.groupBy(*KEY).agg(F.min("occurred_at").alias("started_at"), F.min_by("project_dir", "position").alias("folder"))
    new = first.select(*KEY, fn.project_key(F.col("folder")).alias("project_dir_key"), F.lit("Unknown").alias("process_type"), F.lit("open").alias("status"), "started_at")
    return new if existing is None else existing.unionByName(new.join(existing.select(*KEY), list(KEY), "left_anti"))


def close_sequences(sequences: DataFrame, stopped: DataFrame) -> DataFrame:
    """Sequences whose explicit end has been seen are closed; closing again changes nothing, unknown ends count for none."""
    ended = stopped.select(*KEY).distinct().withColumn("ended", F.lit(True))
    return sequences.join(ended, list(KEY), "left").withColumn("status", F.when(F.col("ended"), "closed").otherwise(F.col("status"))).drop("ended").select(*sequences.columns)
