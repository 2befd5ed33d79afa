"""What a submitted prompt is told: its sequence is opened, and the usual first moves are served, as one plan for many prompts.

Guidance depends on the project alone, so it is fused, noted, cut to its budget and rendered once a project and then joined
to the prompts. Every prompt gets a row: a text, or the reason for silence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stepweave.functions.scalars import excluded
from stepweave.plans.serve import claim, fuse, line, within_budget
from stepweave.schema import BUDGET_CHARS, KEY, MIN_SUPPORT, START

EXCLUDED, UNSUPPORTED = "excluded", "no move reaches the support that is asked for"
OVER = "no line fits the budget"
NOTHING = f"no move out of {START} has been recorded, here or in any other project"
#: First moves of all projects that may be broadcast; there are as many as programs that ever came first.
FEW_MOVES = 100_000

#: What is counted of the answers, by counter.
COUNTED = {
    "capture_excluded": f"reason = '{EXCLUDED}'",
    "guidance_served": "text IS NOT NULL",
    "guidance_silent": f"text IS NULL AND reason <> '{EXCLUDED}'",
    "guidance_below_support": f"reason = '{UNSUPPORTED}'",
    "guidance_fallback_global": "scope = 'global'",
    "guidance_over_budget": "dropped > 0",
}


def openings(asked: DataFrame, project: DataFrame, everywhere: DataFrame, notes: DataFrame, process_type: str | None = "Unknown", floor: int = MIN_SUPPORT, budget: int = BUDGET_CHARS) -> DataFrame:
    """The guidance of each project asked for (project_dir_key): text, scope, reason, lines and how many were dropped.

    project: edges with project_dir_key, everywhere: edges of all projects; both with source, target, support and their modal
    process_type, of which only moves under the given one count (None: all). notes: edge_key and text; a note is said
    with its move's support, after it. Lines are in order of fusion; what is over the budget goes, weakest first.
    """
    by = ("project_dir_key",)
    first = lambda edges: edges.where((F.col("source") == START) & (F.lit(True) if process_type is None else F.col("process_type") == process_type))
    asked = asked.select(*by).distinct()
    wide = first(everywhere).select("source", "target", "support")
    few = wide.limit(FEW_MOVES + 1).count() <= FEW_MOVES
    own = first(project).join(asked, list(by), "left_semi").select(*by, "source", "target", "support")
    fused = fuse(own, asked.join(F.broadcast(wide) if few else wide), by)
    strong = fused.where(F.col("support") >= floor).withColumn("target", F.expr(f"substring(edge_key, {len(START) + 5})"))
    claims = strong.select(*by, "place", F.lit(0).alias("n"), "support", line(claim(F.lit(START), F.col("target")), F.col("support")).alias("text"))
    numbered = notes.select("edge_key", "text", F.row_number().over(W.partitionBy("edge_key").orderBy("text")).alias("n"))
    noted = strong.select(*by, "edge_key", "place", "support").join(numbered, "edge_key").select(*by, "place", "n", "support", line(F.col("text"), F.col("support"), F.lit(True)).alias("text"))
    lines = claims.unionByName(noted).withColumn("at", F.row_number().over(W.partitionBy(*by).orderBy("place", "n")))
    kept = within_budget(lines, by, order="at", budget=budget)
    every = lines.groupBy(*by).agg(F.count("*").alias("all"))
    said = kept.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]), "\n").alias("text"), F.count("*").alias("lines"))
    seen = fused.groupBy(*by).agg(F.when(F.max(F.col("scope") == "project"), "project").otherwise("global").alias("scope"))
    reason = F.when(F.col("scope").isNull(), NOTHING).when(F.col("all").isNull(), UNSUPPORTED).when(F.col("text").isNull(), OVER)
    whole = asked.join(seen, list(by), "left").join(every, list(by), "left").join(said, list(by), "left")
    return whole.select(*by, "text", "scope", reason.alias("reason"), F.coalesce("lines", F.lit(0)).alias("lines"), (F.coalesce("all", F.lit(0)) - F.coalesce("lines", F.lit(0))).alias("dropped"))


def denied(prompts: DataFrame, deny: list[str]) -> Column:
    return F.coalesce(excluded(F.col("project_dir"), deny), F.lit(False))


def opened(prompts: DataFrame, existing: DataFrame, deny: list[str]) -> DataFrame:
    """The sequences that prompts (the key's columns, project_dir, project_dir_key, at) open: those not there yet and not denied, of type Unknown.

    A prompt that is submitted again opens nothing more.
    """
    new = prompts.where(~denied(prompts, deny)).groupBy(*KEY).agg(F.min(F.struct("at", "project_dir_key")).alias("f"))
    made = new.select(*KEY, "f.project_dir_key", F.lit("Unknown").alias("process_type"), F.lit("open").alias("status"), F.col("f.at").alias("started_at"))
    return made.join(existing.select(*KEY), list(KEY), "left_anti")


def answered(prompts: DataFrame, guidance: DataFrame, deny: list[str]) -> DataFrame:
    """Each prompt with its text, scope, reason, lines and dropped; a denied one gets the reason alone."""
    off = denied(prompts, deny)
    told = prompts.withColumn("_off", off).join(guidance, "project_dir_key", "left")
    shown = {n: F.when(~F.col("_off"), F.col(n)) for n in ("text", "scope", "lines", "dropped")}
    return told.withColumns(shown | {"reason": F.when(F.col("_off"), EXCLUDED).otherwise(F.when(F.col("text").isNull(), F.coalesce("reason", F.lit(NOTHING))))}).drop("_off")
