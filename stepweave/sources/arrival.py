"""Dense ids in order of arrival, and tables written to the folder that all executors share."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder for written intermediate tables that all executors share; only a local session may do without the setting."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        import tempfile

        found = tempfile.mkdtemp(prefix="spark-checkpoints-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder, so that loops neither grow a lineage nor lose rows with an executor."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def spread(df: DataFrame, *by: str) -> DataFrame:
    """df dealt out by columns for work that is more than its bytes tell: several tasks a core at least, which adaptive plans do not join."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), *by)


def numbered(df: DataFrame, order: tuple[str, ...], name: str, after: Column | int = 0) -> DataFrame:
    """Adds ids after + 1, after + 2, ... in the given order, without a window over all rows.

    Rows are dealt out by ranges of the order and written once with their place in their range; the ranges' sizes, one
    number each, give every range its first id. A lost executor changes no id, since places are read and not computed again.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_range": F.spark_partition_id(), "_place": F.monotonically_increasing_id()})
    rows = written(placed)
    sizes = rows.groupBy("_range").agg(F.count("*").alias("n"), F.min("_place").alias("_least")).orderBy("_range").collect()
    starts, total = [], 0
    for r in sizes:
        starts.append((r["_range"], total - r["_least"]))
        total += r["n"]
    ranges, shifts = ([s[i] for s in starts] for i in (0, 1))
    shifts = df.sparkSession.createDataFrame(pa.table({"_range": pa.array(ranges, pa.int32()), "_shift": pa.array(shifts, pa.int64())}))
    first = after if isinstance(after, Column) else F.lit(after)
    return rows.join(F.broadcast(shifts), "_range").withColumn(name, (first + F.col("_place") + F.col("_shift") + 1).cast("long")).drop("_range", "_place", "_shift")


def high_water(steps: DataFrame, name: str = "step_id") -> int:
    """The largest id, 0 of an empty table."""
    return steps.agg(F.coalesce(F.max(name), F.lit(0))).first()[0]
