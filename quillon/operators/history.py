"""Conversations and request logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.functions.text import without_citations


def trimmed(turns: DataFrame, conv: str, turn: str, role: str, text: str, users: int = 3, width: int = 600) -> DataFrame:
    """The last `users` user turns and what follows each; assistants' citations go and long answers are cut."""
    back = Window.partitionBy(conv).orderBy(F.desc(turn)).rowsBetween(Window.unboundedPreceding, 0)
    ahead = F.sum((F.col(role) == "user").cast("int")).over(back)
    own = (F.col(role) == "user").cast("int")
    kept = turns.withColumn("_u", ahead - own).where((F.col("_u") < users) & (F.col(role) != "system")).drop("_u")
    plain = F.when(F.col(role) == "assistant", without_citations(F.col(text))).otherwise(F.col(text))
    return kept.withColumn(text, F.when((F.col(role) == "assistant") & (F.length(plain) > width), F.concat(F.substring(plain, 1, width), F.lit("……"))).otherwise(plain))


def folded(events: DataFrame, request: str, seq: str, kind: str, value: str) -> DataFrame:
    """One row a request: its events, first and last time, sum of values, last kind; the last event wins."""
    last = F.max_by(F.col(kind), F.struct(seq, "event_id"))
    return events.groupBy(request).agg(F.count(F.lit(1)).alias("events"), F.min(seq).alias("began"), F.max(seq).alias("ended"), F.round(F.sum(value), 4).alias("total"), last.alias("status"))


def latest(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key by `order`."""
    w = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") == 1).drop("_n")
