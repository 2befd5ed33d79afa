"""More queries: command decoding, templates and paths, which SQL does not express (tests check them), symbols and the streaming ingest."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stepweave.functions import scalars as fn
from stepweave.functions import udf
from stepweave.plans import record, tools
from stepweave.sources.adapter import table
from stepweave.sources.arrival import shared_folder
from stepweave.streaming.ingest import ingest


def shell_decompose(spark: SparkSession, d: str) -> DataFrame:
    """Every turn of the conversations read as a command line."""
    lines = table(spark, d, "conversations").select("conv_id", "turn", F.col("text").alias("line"))
    return udf.decompose(lines).select("conv_id", "turn", "ordinal", "activity_class", "program", F.size("tokens").alias("n_tokens"), F.size("files").alias("n_files"))


def template_abstract(spark: SparkSession, d: str) -> DataFrame:
    """Templates of the words of all turns, by how often they occur."""
    words = table(spark, d, "conversations").select(F.split("text", "[ \\t\\n]+").alias("tokens"))
    return words.select(udf.template(F.col("tokens")).alias("template")).groupBy("template").agg(F.count("*").alias("n"))


def normalise_path(spark: SparkSession, d: str) -> DataFrame:
    """Paths of the pages' addresses against a project folder made of their host."""
    pages = table(spark, d, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host"), F.regexp_extract("url", "^[a-z]+://[^/]+(/.*)?$", 1).alias("path"))
    return pages.select("page_id", udf.normalise_path(F.concat(F.lit("/srv/"), "host", "path"), F.concat(F.lit("/srv/"), "host"), "/home/user").alias("path"))


def symbol_attribution(spark: SparkSession, d: str) -> DataFrame:
    """The narrowest element of a page that a link stands in, by attribute_edits().

    Opening and closing tags of one name are paired by their depth, so nested elements of a name keep their own ends.
    """
    lines = table(spark, d, "pages").select("page_id", F.posexplode(F.split("html", "<")).alias("at", "tag"))
    tags = lines.where(F.col("tag").rlike("^/?(body|nav|ul|li|article|section|div|p|h[1-6])[ >]")).select("page_id", "at", F.regexp_extract("tag", "^/?([a-z0-9]+)", 1).alias("symbol"), F.when(F.startswith("tag", F.lit("/")), -1).otherwise(1).alias("way"))
    name = W.partitionBy("page_id", "symbol").orderBy("at")
    deep = tags.withColumn("level", F.sum("way").over(name.rowsBetween(W.unboundedPreceding, 0)) + F.when(F.col("way") < 0, 1).otherwise(0))
    level = W.partitionBy("page_id", "symbol", "level").orderBy("at")
    paired = deep.withColumns({"ends": F.lead("at").over(level), "next_way": F.lead("way").over(level)})
    spans = paired.where("way = 1 AND next_way = -1").select("page_id", "symbol", F.col("at").alias("begins"), "ends")
    links = lines.where(F.col("tag").rlike("^a[ >]")).select("page_id", "at")
    edits = links.select(F.struct("page_id", "at").alias("edit_id"), F.col("page_id").alias("file"), F.col("at").alias("line"))
    held = tools.attribute_edits(edits, spans.withColumnRenamed("page_id", "file")).where("symbol IS NOT NULL")
    return held.select("edit_id.page_id", "edit_id.at", "symbol", F.col("symbol_begins").alias("begins"))


def procedure_suffix(spark: SparkSession, d: str) -> DataFrame:
    """The suffix of the file that each page's address names."""
    return table(spark, d, "pages").select("page_id", record.procedure_suffix(F.array("url")).alias("suffix"))


def stream_ingest(spark: SparkSession, d: str) -> DataFrame:
    """Events as a stream into a table of steps, each key once: the table afterwards."""
    folder = f"{shared_folder(spark)}/ingest-{uuid.uuid4().hex}"
    schema = table(spark, d, "events").schema
    raw = spark.readStream.schema(schema).parquet(f"{d}/events.parquet*")
    keyed = raw.select((F.col("event_id") + 1).alias("step_id"), F.col("user_id").cast("string").alias("conversation_id"), "event_type", F.col("ts").cast("timestamp").alias("occurred_at"), F.concat(F.lit("call"), "event_id").alias("tool_call_id"))
    twice = keyed.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
    ingest(twice.withColumn("dedup_key", fn.dedup_key(F.col("tool_call_id"), F.lit(0), F.col("conversation_id"))).drop("copy"), f"{folder}/steps", f"{folder}/state")
    return spark.read.parquet(f"{folder}/steps").select("step_id", "conversation_id", "event_type", F.unix_micros("occurred_at").alias("at"), "dedup_key")


QUERIES = {f.__name__: f for f in (shell_decompose, template_abstract, normalise_path, symbol_attribution, procedure_suffix, stream_ingest)}
ORACLE = {
    "stream_ingest": "SELECT event_id + 1 AS step_id, CAST(user_id AS VARCHAR) AS conversation_id, event_type, epoch_us(ts) AS at, 'call' || event_id || '#0' AS dedup_key FROM events",
    "procedure_suffix": r"SELECT page_id, CASE WHEN regexp_matches(name, '^.+\.[^.]+$') THEN lower(regexp_extract(name, '\.([^.]+)$', 1)) ELSE '--' END AS suffix FROM (SELECT page_id, regexp_extract(coalesce(url, ''), '([^/]*)/*$', 1) AS name FROM pages)",
    "symbol_attribution": r"""
WITH cut AS (SELECT page_id, string_split(html, '<') AS parts FROM pages),
lines AS (SELECT page_id, unnest(range(len(parts))) AS "at", unnest(parts) AS tag FROM cut),
tags AS (SELECT page_id, "at", regexp_extract(tag, '^/?([a-z0-9]+)', 1) AS symbol, CASE WHEN starts_with(tag, '/') THEN -1 ELSE 1 END AS way FROM lines WHERE regexp_matches(tag, '^/?(body|nav|ul|li|article|section|div|p|h[1-6])[ >]')),
deep AS (SELECT *, SUM(way) OVER (PARTITION BY page_id, symbol ORDER BY "at" ROWS UNBOUNDED PRECEDING) + CASE WHEN way < 0 THEN 1 ELSE 0 END AS level FROM tags),
paired AS (SELECT *, LEAD("at") OVER w AS ends, LEAD(way) OVER w AS next_way FROM deep WINDOW w AS (PARTITION BY page_id, symbol, level ORDER BY "at")),
held AS (SELECT l.page_id, l."at", p.symbol, p."at" AS begins, p.ends - p."at" AS size FROM lines l JOIN paired p ON l.page_id = p.page_id AND l."at" BETWEEN p."at" AND p.ends WHERE regexp_matches(l.tag, '^a[ >]') AND p.way = 1 AND p.next_way = -1)
SELECT page_id, CAST("at" AS INT) AS "at", symbol, CAST(begins AS INT) AS begins FROM held QUALIFY ROW_NUMBER() OVER (PARTITION BY page_id, "at" ORDER BY size, begins, symbol) = 1""",
}
