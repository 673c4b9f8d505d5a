"""What the operators share: session settings, tables in the shared folder, prefix sums, ranges."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quillon.storage import discard, shared_folder, stored  # noqa: F401

ROOT = str(Path(__file__).resolve().parents[2])
#: Rows of an Arrow batch sent to Python: with long texts a batch stays in the tens of MB.
BATCH_ROWS = 500
WORD = r"[^\x20\x09-\x0D]+"


def ready(spark: SparkSession) -> SparkSession:
    """Make this package importable on Python workers and keep Arrow batches small."""
    paths = spark.sparkContext.environment.get("PYTHONPATH", "")
    if ROOT not in paths.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(p for p in (ROOT, paths) if p)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def lean() -> None:
    """Free what a Python worker keeps for encoding tokens, before work of another kind: workers are used again, and their memory is not the JVM's to reclaim."""
    import sys

    tokens = sys.modules.get("quillon.llm.tokens")
    if tokens is not None:
        tokens._LOADED.clear()


def spare() -> None:
    """Give back to the machine what this Python worker has freed; its allocators would keep it while the worker stands idle beside the JVM."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def tidied(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run for mapInArrow, after which the worker holds no more than before."""

    def tidy(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            spare()

    return tidy


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/documents.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """The name, lengthened until no column of df has it, whatever the case."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


SALTS = 8


def salted(many: DataFrame, few: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """many (a stored table, so that its rows are numbered alike when read again) joined with few, which has a key once; a hot key is SALTS tasks."""
    salts = F.explode(F.array(*[F.lit(i) for i in range(SALTS)])).alias("_salt")
    dealt = many.withColumn("_salt", (F.monotonically_increasing_id() % SALTS).cast("int"))
    return dealt.join(few.select("*", salts), [on, "_salt"], how).drop("_salt")


def prefix_sums(df: DataFrame, group: str, order: list[str], value: str, out: str) -> DataFrame:
    """`out`: the sum of `value` over the rows of the same `group` that come before, by `order`.

    Rows are dealt by range of (group, order), so that a hot group is many tasks; only one row
    for each task and group meets in the second step. Rows equal in group and order need to be
    one row. Nulls in `group` are a group.
    """
    n = max(1, df.rdd.getNumPartitions())
    ranged = stored(df.repartitionByRange(n, group, *order).withColumn("_part", F.spark_partition_id()))
    inner = Window.partitionBy(group, "_part").orderBy(*order)
    totals = ranged.groupBy(group, "_part").agg(F.sum(value).alias("_sum"))
    outer = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(F.col(group).alias("_group"), F.col("_part").alias("_at"), F.coalesce(F.sum("_sum").over(outer), F.lit(0)).alias("_offset"))
    summed = ranged.withColumn("_within", F.sum(value).over(inner.rowsBetween(Window.unboundedPreceding, 0)) - F.col(value))
    joined = summed.join(offsets, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_part") == F.col("_at")), "left")
    return joined.withColumn(out, (F.col("_within") + F.col("_offset")).cast("long")).drop("_group", "_at", "_offset", "_within", "_part")


def in_ranges(docs: DataFrame) -> DataFrame:
    """doc_id, text dealt by ranges over as many tasks as there are partitions, and sorted by both, null ids first. An id of very many rows is divided by its texts' beginnings."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n = max(1, docs.rdd.getNumPartitions())
    return d.repartitionByRange(n, F.col("doc_id"), F.substring("text", 1, 32)).sortWithinPartitions("doc_id", "text")


def schema_of(df: DataFrame, **more: T.DataType) -> T.StructType:
    return T.StructType([*df.schema.fields, *[T.StructField(k, v) for k, v in more.items()]])


FILTER_BITS = 1 << 24


def key_words(keys: DataFrame, column: str) -> DataFrame:
    """word, bits: a bit table of at most FILTER_BITS / 32 rows in which every value of a long column has its bit."""
    word, bit = key_bit(F.col(column))
    return keys.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits"))


def key_bit(key: Column) -> tuple[Column, Column]:
    """The word of a long in the bit table of key_words, and its bit there."""
    slot = F.pmod(key, F.lit(FILTER_BITS))
    return F.floor(slot / 32).cast("int"), F.call_function("shiftleft", F.lit(1).cast("long"), (slot % 32).cast("int"))


def key_filter(keys: DataFrame, column: str) -> object:
    """A broadcast bit table of fixed size (2 MB) in which every value of a long column has its bit.

    Values that are not there may pass too, the more the fuller it is; a join then settles it.
    """
    import numpy as np

    filled = key_words(keys, column).toPandas()
    table = np.zeros(FILTER_BITS // 32, dtype=np.uint32)
    table[filled["word"].to_numpy(dtype=np.int64)] = filled["bits"].to_numpy(dtype=np.int64).astype(np.uint32)
    return keys.sparkSession.sparkContext.broadcast(table)


def passing(table: object, keys: object) -> object:
    """Which of an Arrow column of longs have their bit in a key_filter's table."""
    import numpy as np

    at = np.mod(keys.to_numpy(zero_copy_only=False).astype(np.int64), FILTER_BITS)
    return ((table.value[at // 32] >> (at % 32).astype(np.uint32)) & np.uint32(1)).astype(bool)
