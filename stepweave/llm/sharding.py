"""Sharding along a Hilbert curve.

The metadata dimensions size, language and source are quantised to 64 steps each, in the order of their values and so that
the steps hold like numbers of texts where they can; the position on the Hilbert curve through that grid orders the
documents, and equal cuts of the order are the shards. So a shard covers a small box of the grid, and a reader prunes
shards by minimum and maximum of any of the dimensions. Source comes first: the curve crosses the middle of its first
dimension once, so that a source lies in one half of the shards. Equal texts share one position (that of their smallest doc_id)
and stand side by side.

The law is `rows`: the counts of any two shards differ by one at most. Ranks come from a range-partitioned sort; only
the number of rows of each partition reaches the driver.

Defined results: a null text has size 1 and crc32 0, and is one group with empty texts; null lang or source counts as
''. Repeated rows are separate rows and all get slots. Other columns are not read. An empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stepweave.llm.common import checkpoint, documents

BITS = 6
STEPS = 1 << BITS
DIMENSIONS = ("size", "lang", "source")


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Index on the Hilbert curve of each row of `points` (n by d, values below 2 ** bits)."""
    x = points.astype(np.int64).T.copy()
    d = len(x)
    at = 1 << (bits - 1)
    while at > 1:  # undo the excess rotations, from the coarsest bit down
        low = at - 1
        for i in range(d):
            flip = (x[i] & at) != 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(flip, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        at >>= 1
    for i in range(1, d):  # Gray code
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    at = 1 << (bits - 1)
    while at > 1:
        turn ^= np.where((x[d - 1] & at) != 0, at - 1, 0)
        at >>= 1
    x ^= turn
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


@F.pandas_udf(T.LongType())
def _curve(source: pd.Series, lang: pd.Series, size: pd.Series) -> pd.Series:
    return pd.Series(hilbert(np.stack([source, lang, size], axis=1)))


def _steps(column: str, cuts: list[float]) -> F.Column:
    """The number of cuts below the value."""
    cuts = sorted(set(cuts))[: STEPS - 1]
    return F.aggregate(F.array(*[F.lit(float(c)) for c in cuts]), F.lit(0), lambda n, c: n + (F.col(column) > c).cast("int")) if cuts else F.lit(0)


def _with_steps(rows: DataFrame, column: str) -> DataFrame:
    """Adds the step of a string column: steps ascend with its values.

    Up to STEPS different values are placed by the numbers of rows before them; more are dealt by ranges, one for each step.
    """
    counts = rows.groupBy(column).count()
    few = sorted(counts.limit(STEPS + 1).collect())
    if len(few) <= STEPS:
        total, before, codes = sum(n for _, n in few), 0, []
        for value, n in few:
            codes += [F.lit(value), F.lit(int(STEPS * (before + n / 2) / total))]
            before += n
        return rows.withColumn(f"{column}_step", F.create_map(*codes)[F.col(column)] if codes else F.lit(0))
    dealt = checkpoint(counts.select(column).repartitionByRange(STEPS, column).withColumn(f"{column}_step", F.spark_partition_id() % STEPS))
    return rows.join(dealt, column)


def curve_order(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, digest and curve, the position of the row's group of equal texts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32"), F.sha2(text, 256).alias("digest"),
        F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"),
    )
    rows = checkpoint(rows)
    first = checkpoint(rows.groupBy("digest").agg(F.min(F.struct("doc_id", "size", "lang", "source")).alias("g")).select("digest", "g.size", "g.lang", "g.source"))
    cuts = first.agg(F.percentile_approx("size", [i / STEPS for i in range(1, STEPS)], 1000).alias("size")).first()["size"]
    placed = _with_steps(_with_steps(first, "lang"), "source")
    curve = placed.select("digest", _curve(F.col("source_step").cast("int"), F.col("lang_step").cast("int"), _steps("size", cuts or [])).alias("curve"))
    return rows.select("doc_id", "size", "text_crc32", "digest", "lang", "source").join(curve, "digest")


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, curve, shard and slot."""
    order = ("curve", "digest", "doc_id")
    ranked = curve_order(docs).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    ranked = checkpoint(ranked)
    counts = ranked.groupBy(F.shiftright("at", 33).alias("part")).count().orderBy("part").collect()
    before, total = {}, 0
    for part, n in counts:  # one number for each partition
        before[part] = total
        total += n
    starts = docs.sparkSession.createDataFrame(list(before.items()) or [(0, 0)], "part long, before long")
    small, extra = divmod(total, shards)
    rank = F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1)
    head = extra * (small + 1)
    shard = F.when(F.col("rank") < head, F.floor(F.col("rank") / (small + 1))).otherwise(extra + F.floor((F.col("rank") - head) / max(small, 1)))
    start = F.col("shard") * small + F.least(F.col("shard"), F.lit(extra))
    placed = ranked.withColumn("part", F.shiftright("at", 33)).join(F.broadcast(starts), "part").withColumn("rank", rank).withColumn("shard", shard.cast("int"))
    return placed.select("doc_id", "size", "text_crc32", "lang", "source", "curve", "shard", (F.col("rank") - start).cast("long").alias("slot"))


def prune(bounds: DataFrame, **wanted) -> DataFrame:
    """Shards of shard_bounds() whose range of every named dimension may hold the wanted value."""
    for name, value in wanted.items():
        bounds = bounds.where((F.col(f"{name}_min") <= F.lit(value)) & (F.col(f"{name}_max") >= F.lit(value)))
    return bounds


def shard_bounds(placed: DataFrame) -> DataFrame:
    return placed.groupBy("shard").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"), *[f(c).alias(f"{c}_{n}") for c in ("size", "lang", "source", "curve") for n, f in (("min", F.min), ("max", F.max))])


def op8_hilbert(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_documents(documents(spark, sf_dir))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")
