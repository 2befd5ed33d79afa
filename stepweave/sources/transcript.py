"""Readers of raw logs: JSONL transcripts and hook payloads, as event rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stepweave.functions.scalars import cut

RECORD = "type string, uuid string, sessionId string, cwd string, timestamp string, isMeta boolean, isSidechain boolean, message struct<role:string,content:string>"
BLOCKS = "array<struct<type:string,text:string,id:string,name:string,input:string,tool_use_id:string,content:string,is_error:boolean>>"
PAYLOAD = "hook_event_name string, session_id string, prompt_id string, cwd string, tool_use_id string, tool_name string, tool_input string, tool_result string, agent_id string, source string, transcript_path string"


def records(spark: SparkSession, path: str) -> DataFrame:
    """file, ordinal (from 0) and raw line of every record; whole files, so that ordinals are exact."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    return files.select("file", F.posexplode(F.split("value", "\n")).alias("ordinal", "line")).where(F.btrim("line") != "")


def parsed(lines: DataFrame) -> DataFrame:
    """Typed records with skip_category: why a record gives no event, null if it may.

    What is read from JSON goes through inline(), since plain columns would be parsed anew by every expression that uses them.
    """
    typed = lines.select("file", "ordinal", "line", F.inline(F.array(F.from_json("line", RECORD))))
    zoned = F.col("timestamp").rlike("(Z|[+-][0-9]{2}:?[0-9]{2})$")
    content = F.col("message.content")
    blocks = F.when(content.startswith("["), F.from_json(content, BLOCKS))
    known = F.col("type").isin("user", "assistant", "summary", "system")
    is_json = F.try_parse_json("line").isNotNull()
    skip = F.when(~is_json, "not JSON").when(~F.coalesce(known, F.lit(False)), "unknown type").when(F.col("type").isin("user", "assistant") & content.isNull(), "content is no list")
    at = F.when(zoned, F.try_to_timestamp("timestamp"))
    return typed.select("*", F.inline(F.array(F.struct(blocks.alias("blocks"), at.alias("at"), skip.alias("skip_category")))))


def events(read: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Completed tool calls, and the records skipped (file, ordinal, category).

    A result belongs to the latest call before it with its id; the first result of a call counts. Conversation, project,
    prompt and place come from the call, the time from the result. The prompt is the last real user turn before it.
    file, record and part tell where the result stands, that is when the event arrived.
    """
    turn = (F.col("type") == "user") & F.col("message.content").isNotNull() & ~F.col("message.content").startswith("[") & ~F.coalesce("isMeta", F.lit(False)) & ~F.coalesce("isSidechain", F.lit(False))
    so_far = W.partitionBy("file").orderBy("ordinal").rowsBetween(W.unboundedPreceding, 0)
    said = read.select("file", "ordinal", "sessionId", "cwd", "at", "blocks", "skip_category", F.when(turn, F.col("uuid")).alias("turn"))
    placed = said.withColumn("prompt_id", F.last("turn", ignorenulls=True).over(so_far)).drop("turn")
    found = _answers(placed.where("skip_category IS NULL"))
    good = found.where("category IS NULL").select(
        F.col("call.sessionId").alias("conversation_id"), F.col("call.prompt_id").alias("prompt_id"), F.lit("").alias("agent_id"), F.col("call.cwd").alias("project_dir"), F.col("call.tool_name").alias("tool_name"), F.col("call_id").alias("tool_call_id"),
        F.col("call.arguments").alias("tool_call_arguments"), cut(F.col("result")).alias("tool_call_result"), F.concat("file", F.lit("#"), "call.ordinal").alias("record_ref"), F.col("at").alias("occurred_at"), F.lit("backfill").alias("source_kind"),
        "file", F.col("ordinal").cast("long").alias("record"), "part",
    )
    return good, _answers(placed).where("category IS NOT NULL").select("file", "ordinal", "category")


def _answers(placed: DataFrame) -> DataFrame:
    """Results with their calls in one pass, and why one gives no event; a record that is skipped stays one row with its own reason."""
    none = F.array(F.lit(None).cast(BLOCKS.removeprefix("array<").removesuffix(">")))
    blocks = placed.select("file", "ordinal", "sessionId", "cwd", "prompt_id", "at", "skip_category", F.posexplode_outer(F.when(F.col("skip_category").isNull(), F.col("blocks")).otherwise(none)).alias("part", "b"))
    flat = F.coalesce(F.array_join(F.transform(F.from_json("b.content", "array<struct<text:string>>"), lambda x: F.coalesce(x["text"], F.lit(""))), ""), F.lit(""))
    text = F.when(F.col("b.content").startswith("["), flat).otherwise(F.coalesce("b.content", F.lit("")))
    is_call = F.col("b.type") == "tool_use"
    told = blocks.where("skip_category IS NOT NULL OR b.type IN ('tool_use', 'tool_result')").select(
        "file", "ordinal", "part", "at", "skip_category", is_call.alias("is_call"), F.when(is_call, F.col("b.id")).otherwise(F.col("b.tool_use_id")).alias("call_id"), F.when(~is_call, text).alias("result"),
        F.when(is_call, F.struct("ordinal", "sessionId", "cwd", "prompt_id", F.col("b.name").alias("tool_name"), F.col("b.input").alias("arguments"))).alias("own"),
    )
    order = W.partitionBy("file", "call_id").orderBy("ordinal", "part")
    matched = told.withColumn("call", F.last("own", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0)))
    # calls before a result only grow, so a call has been answered if the last result before has it too
    answered = F.last(F.when(~F.col("is_call"), F.col("call.ordinal")), ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1))
    first = matched.withColumn("answered", answered).where("skip_category IS NOT NULL OR NOT is_call")
    orphan = F.col("call").isNull() | F.coalesce(F.col("answered") == F.col("call.ordinal"), F.lit(False))
    return first.withColumn("category", F.coalesce("skip_category", F.when(orphan, "orphan result").when(F.col("at").isNull(), "naive timestamp")))


def hook_events(payloads: DataFrame, event_name: str = "PostToolUse") -> tuple[DataFrame, DataFrame]:
    """Events of JSON payloads (column value) of one kind, and those without session, prompt or tool; other columns pass, as those of arrival."""
    others = [c for c in payloads.columns if c != "value"]
    # behind inline(), since filters on plain columns would parse a payload anew for each column that they ask
    typed = payloads.select(*others, F.inline(F.array(F.from_json("value", PAYLOAD)))).where(F.col("hook_event_name") == event_name)
    whole = (F.length(F.coalesce("session_id", F.lit(""))) > 0) & (F.length(F.coalesce("prompt_id", F.lit(""))) > 0) & (F.length(F.coalesce("tool_name", F.lit(""))) > 0)
    made = typed.withColumn("routable", whole)
    columns = (F.col("session_id").alias("conversation_id"), "prompt_id", F.coalesce("agent_id", F.lit("")).alias("agent_id"), F.col("cwd").alias("project_dir"), "tool_name", F.col("tool_use_id").alias("tool_call_id"), F.col("tool_input").alias("tool_call_arguments"), cut(F.coalesce("tool_result", F.lit(""))).alias("tool_call_result"))
    return made.where("routable").select(*columns, *others), made.where("NOT routable").drop("routable")
