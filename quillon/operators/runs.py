"""Runs that call something dear for each row: kept in small committed steps, and never called twice for the same input."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillon.storage import numbered

Batches = Iterator[pd.DataFrame]


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def kept_run(items: DataFrame, key: str, answer: Callable[[Batches], Batches], schema: str, folder: str, every: int = 10, failed: Column | None = None) -> DataFrame:
    """The answers to items, one row of `schema` for each, kept in folder every `every` of them; schema has the key.

    Items that the folder has not met are queued in files of at most `every` rows, and a stream takes a file at a time: its answers are
    committed with the place in the queue, both or neither. A run that breaks off goes on, when it is called again, with the file that it was
    at, and repeats no row of those before; its result is that of an unbroken run. With `failed`, a condition on answers, items
    whose last answer was one are queued again; of several answers to an item the last counts. Keys are not null, and one row of items each.
    """
    spark = items.sparkSession
    queue, done = f"{folder}/queue", f"{folder}/answers"
    names = items.columns
    fresh = items.withColumn("_turn", F.lit(0))
    if _exists(spark, queue):
        met = spark.read.parquet(queue).groupBy(key).agg(F.max("_turn").alias("_met"))
        fresh = items.join(met, key, "left").withColumn("_turn", F.coalesce(F.col("_met") + 1, F.lit(0)))
        again = F.col("_met").isNull()
        if failed is not None and _exists(spark, done):
            bad = _last(spark.read.parquet(done), key).where(failed).select(F.col(key).alias("_bad"), F.col("_turn").alias("_of"))
            fresh = fresh.join(bad, (F.col(key) == F.col("_bad")) & (F.col("_met") == F.col("_of")), "left")
            again = again | F.col("_bad").isNotNull()
        fresh = fresh.where(again).select(*names, "_turn")
    placed = numbered(fresh, [], [F.col(key)], "_nth")
    lots = placed.withColumn("_lot", F.floor((F.col("_nth") - 1) / every)).drop("_nth")
    count = lots.agg(F.max("_lot")).first()[0]
    if count is not None:
        lots.repartition(int(count) + 1, "_lot").sortWithinPartitions("_lot", key).drop("_lot").write.mode("append").option("maxRecordsPerFile", every).parquet(queue)
    out = f"{schema}, _turn int"

    def run(batches: Batches) -> Batches:
        for b in batches:
            if len(b):
                turns = dict(zip(b[key], b["_turn"], strict=True))
                for found in answer(iter([b.drop(columns="_turn")])):
                    yield found.assign(_turn=[turns[k] for k in found[key]])

    if not _exists(spark, queue):
        return spark.createDataFrame([], schema)
    taken = spark.readStream.schema(StructType([*items.schema.fields, *spark.createDataFrame([], "_turn int").schema.fields])).option("maxFilesPerTrigger", 1).parquet(queue)
    stream = taken.mapInPandas(run, out).writeStream.format("parquet").option("path", done).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
    stream.awaitTermination()
    return _last(spark.read.schema(out).parquet(done), key).drop("_turn")


def _last(answers: DataFrame, key: str) -> DataFrame:
    names = [c for c in answers.columns if c != key]
    return answers.groupBy(key).agg(F.max_by(F.struct(*names), "_turn").alias("_x")).select(key, "_x.*")


def judgment_key(kind: str, model: str, prompt: Column, given: Column) -> Column:
    """The SHA-1 of all that a judgment depends on; null counts as empty."""
    parts = [F.lit(kind), F.lit(model), *[F.coalesce(c.cast("string"), F.lit("")) for c in (prompt, given)]]
    return F.sha1(F.to_json(F.array(*parts)))


def judged_once(rows: DataFrame, prompt: Column, given: Column, judge: Callable[[Batches], Batches], kind: str, model: str, folder: str) -> DataFrame:
    """rows with verdict (string), by a judge that gets batches of (key, prompt, given) and gives (key, verdict); folder keeps its verdicts.

    A verdict is looked up by the SHA-1 of kind, model, prompt and input. Of what is not there each distinct input goes to the judge
    once, and its verdicts are added in one commit; null verdicts are failures, which are not kept and go to it again in the next run.
    """
    spark, store = rows.sparkSession, f"{folder}/verdicts"
    keyed = rows.withColumn("_key", judgment_key(kind, model, prompt, given)).withColumn("_prompt", prompt.cast("string")).withColumn("_given", given.cast("string"))
    need = keyed.groupBy("_key").agg(F.first("_prompt").alias("prompt"), F.first("_given").alias("given")).withColumnRenamed("_key", "key")
    if _exists(spark, store):
        need = need.join(spark.read.schema("key string, verdict string").parquet(store).select("key"), "key", "left_anti")
    made = need.mapInPandas(judge, "key string, verdict string").where("verdict is not null")
    made.write.mode("append").parquet(store)
    known = spark.read.schema("key string, verdict string").parquet(store).groupBy("key").agg(F.min("verdict").alias("verdict"))
    return keyed.join(known.withColumnRenamed("key", "_key"), "_key", "left").select(*rows.columns, "verdict")
