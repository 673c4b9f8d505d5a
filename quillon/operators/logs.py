"""The request log: appended rows, ratings, and the report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.operators.quantiles import beside, percentiles

SCHEMA = """id string, created_at timestamp, mode string, question string, history_turns int, status string, answer string, refused boolean, elapsed_ms double,
llm_calls int, tool_calls int, input_tokens long, output_tokens long, cost_yuan double, finish_reason string, model_name string,
sources string, cited string, fabricated string, numbers_checked int, number_issues int, repaired string, error string"""
FEEDBACK = "id string, rating int, comment string, rated_at timestamp"


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.replace("\n", " ").split(",")]


def record(rows: DataFrame) -> DataFrame:
    """rows in the log's schema: lists, structs and maps as JSON, columns that are missing as null."""
    kinds, have = dict(rows.dtypes), {c.lower(): c for c in rows.columns}

    def one(field: str) -> Column:
        name, kind = field.split()
        if name not in have:
            return F.lit(None).cast(kind).alias(name)
        nested = kinds[have[name]].startswith(("array", "struct", "map"))
        return (F.to_json(F.col(have[name])) if nested else F.col(have[name])).cast(kind).alias(name)

    return rows.select(*[one(" ".join(f.split())) for f in SCHEMA.replace("\n", " ").split(",")])


def append(rows: DataFrame, folder: str) -> None:
    """Add rows to the log below folder, which is made with the first of them. Fit for foreachBatch."""
    record(rows).write.mode("append").parquet(f"{folder}/requests")


def new_ids(rows: DataFrame) -> DataFrame:
    """rows with an id (32 hexadecimal digits) and the time."""
    return rows.withColumn("id", F.replace(F.uuid(), F.lit("-"), F.lit(""))).withColumn("created_at", F.current_timestamp())


def rate(feedback: DataFrame, folder: str) -> None:
    """Add ratings (id, rating, comment, rated_at): the last of an id counts; null takes it back, with its comment."""
    feedback.select(*_names(FEEDBACK)).write.mode("append").parquet(f"{folder}/feedback")


def read(spark: SparkSession, folder: str, since: str | None = None) -> DataFrame:
    """The log with its ratings; with `since`, rows from that time on."""
    rows = spark.read.schema(SCHEMA).parquet(f"{folder}/requests")
    try:
        given = spark.read.schema(FEEDBACK).parquet(f"{folder}/feedback")
    except Exception as e:  # no rating yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        given = spark.createDataFrame([], FEEDBACK)
    out = rated(rows, given)
    return out.where(F.col("created_at") >= F.lit(since).cast("timestamp")) if since else out


def rated(rows: DataFrame, feedback: DataFrame) -> DataFrame:
    """rows with rating, comment and rated_at of each id's last rating; a rating taken back leaves no comment."""
    w = Window.partitionBy("id").orderBy(F.desc("rated_at"), F.desc_nulls_last("rating"), F.desc_nulls_last("comment"))
    last = feedback.withColumn("_n", F.row_number().over(w)).where(F.col("_n") == 1)
    comment = F.when(F.col("rating").isNotNull(), F.nullif(F.trim("comment"), F.lit("")))
    return rows.join(last.select("id", "rating", comment.alias("comment"), "rated_at"), "id", "left")


def matched(feedback: DataFrame, rows: DataFrame) -> DataFrame:
    """feedback with matched: whether the log has the id."""
    return feedback.join(rows.select("id").distinct().withColumn("_m", F.lit(True)), "id", "left").withColumn("matched", F.coalesce("_m", F.lit(False))).drop("_m")


def summary(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One row (for each `by`): requests, statuses, refusals, P50 and P95 of the time, costs, number checks, repairs, ratings."""
    done = F.col("status") == "done"
    count = lambda c: F.count(F.when(c, 1))
    checked = done & (F.coalesce("numbers_checked", F.lit(0)) > 0)
    paid = F.when(done, F.col("cost_yuan"))
    repaired = checked & (F.coalesce("repaired", F.lit("")) != "")
    columns = [
        F.count(F.lit(1)).alias("requests"), F.min("created_at").alias("first"), F.max("created_at").alias("last"), count(done).alias("done"), count(F.col("status") == "rejected").alias("rejected"),
        count(F.col("status") == "error").alias("errors"), count(F.col("status") == "aborted").alias("aborted"), count(done & F.coalesce("refused", F.lit(False))).alias("refused"),
        F.round(F.sum(paid), 6).alias("cost"), F.round(F.avg(paid), 8).alias("cost_mean"), count(checked).alias("checked"),
        count(checked & (F.coalesce("number_issues", F.lit(0)) > 0)).alias("with_issues"), count(repaired).alias("repairs"), count(repaired & (F.col("repaired") == "repaired")).alias("repaired"),
        count(F.col("rating").isNotNull()).alias("rated"), count(F.col("rating") == 1).alias("up"), count(F.col("rating").isNotNull() & (F.col("rating") != 1)).alias("down"),
    ]
    by = by or []
    all_ = rows.groupBy(*by).agg(*columns) if by else rows.agg(*columns)
    return beside(all_, percentiles(rows, by, "elapsed_ms", {"p50_ms": 0.5, "p95_ms": 0.95}, done), by)


def last_down(rows: DataFrame, most: int = 10) -> DataFrame:
    """The last rows that were rated down, oldest first."""
    last = rows.where(F.col("rating") == -1).orderBy(F.desc("created_at"), F.desc("id")).limit(most)
    return last.orderBy("created_at", "id")


def latencies(rows: DataFrame, stages: list[str], total: str) -> DataFrame:
    """stage, n, p50, p90, p95, mean, most and share of the total time, of one column for each stage."""
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(s).alias("stage"), F.col(s).cast("double").alias("ms")) for s in stages])).alias("x"), F.col(total).cast("double").alias("_all")).select("x.*", "_all").where(F.col("ms").isNotNull())
    a = long.groupBy("stage").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("ms"), 6).alias("mean"), F.max("ms").alias("most"), F.round(F.try_divide(F.sum("ms"), F.sum("_all")), 6).alias("share"))
    parts = percentiles(long, ["stage"], "ms", {"p50": 0.5, "p90": 0.9, "p95": 0.95})
    return beside(a, parts, ["stage"]).select("stage", "n", "p50", "p90", "p95", "mean", "most", "share")
