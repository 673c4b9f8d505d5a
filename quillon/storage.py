"""Tables in the folder that the driver and all executors share, and what needs them: numbering rows without one task for a group."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which all executors share. Where that is unset a local run takes a folder of its own; on a cluster that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: set it to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="checkpoint-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def stored(df: DataFrame, folder: str | None = None) -> DataFrame:
    """Write the table to the shared folder and read it back: its lineage ends there, and lost executors cost nothing."""
    path = f"{folder or shared_folder(df.sparkSession)}/table"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, folder: str) -> None:
    """Delete a folder of stored tables that nothing reads any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def numbered(rows: DataFrame, group: list[str], order: list[Column | str], out: str) -> DataFrame:
    """rows with `out`: the place of each, from 1, in its group by a total order.

    Rows are dealt by range of group and order, so that a hot group is many tasks; only a count for each task
    and group meets in the second step. Nulls in the group's columns are a group.
    """
    n = max(1, rows.rdd.getNumPartitions())
    ranged = stored(rows.repartitionByRange(n, *[F.col(g) for g in group], *order).withColumn("_task", F.spark_partition_id()))
    counts = ranged.groupBy(*group, "_task").agg(F.count(F.lit(1)).alias("_n"))
    ahead = Window.partitionBy(*group).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*[F.col(g).alias(f"_of{i}") for i, g in enumerate(group)], F.col("_task").alias("_at"), F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_before"))
    same = F.col("_task") == F.col("_at")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_of{i}"))
    here = F.row_number().over(Window.partitionBy(*group, "_task").orderBy(*order))
    return ranged.withColumn("_here", here).join(offsets, same).withColumn(out, F.col("_here") + F.col("_before")).select(*rows.columns, out)


def running(rows: DataFrame, group: list[str], order: list[Column | str], value: str, before: str, total: str) -> DataFrame:
    """rows with `before`: the sum of `value` over the rows of the group that come ahead by a total order, and `total`: the whole group's.

    Dealt as in numbered: a hot group is many tasks, of which only a sum each meets in the second step.
    """
    n = max(1, rows.rdd.getNumPartitions())
    ranged = stored(rows.repartitionByRange(n, *[F.col(g) for g in group], *order).withColumn("_task", F.spark_partition_id()))
    sums = ranged.groupBy(*group, "_task").agg(F.sum(value).alias("_n"))
    whole = Window.partitionBy(*group)
    ahead = whole.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    names = [F.col(g).alias(f"_of{i}") for i, g in enumerate(group)]
    offsets = sums.select(*names, F.col("_task").alias("_at"), F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_ahead"), F.sum("_n").over(whole).alias(total))
    same = F.col("_task") == F.col("_at")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_of{i}"))
    here = Window.partitionBy(*group, "_task").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = ranged.withColumn("_here", F.sum(value).over(here) - F.col(value)).join(offsets, same)
    return summed.withColumn(before, F.col("_here") + F.col("_ahead")).select(*rows.columns, before, total)
