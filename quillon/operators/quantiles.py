"""Exact percentiles of groups of any size, by selection over ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.storage import running


def percentiles(rows: DataFrame, by: list[str], value: str, shares: dict[str, float], where: Column | None = None) -> DataFrame:
    """by and a column for each of shares (name: share): the percentile with linear interpolation between the two values beside it, six digits.

    Equal values are counted first, and only counts are shuffled; they are dealt by ranges of group and value, so that a large
    group is many tasks, of which one sum each meets. The rows that hold the two ranks give their values. Nulls, and rows that
    `where` leaves out, don't count; a group without values has no row. Null is a group.
    """
    kept = F.col("_v").isNotNull() if where is None else F.col("_v").isNotNull() & F.coalesce(where, F.lit(False))
    counts = rows.withColumn("_v", F.col(value).cast("double")).where(kept).groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_c"))
    placed = running(counts, by, ["_v"], "_c", "_from", "_all")
    out = []
    for name, share in shares.items():
        rank = F.lit(float(share)) * (F.col("_all") - 1)
        at = lambda r: F.max(F.when((F.col("_from") <= r) & (r < F.col("_from") + F.col("_c")), F.col("_v")))
        low, high, part = at(F.floor(rank)), at(F.ceil(rank)), F.max(rank - F.floor(rank))
        out.append(F.round(low + (high - low) * part, 6).alias(name))
    return placed.groupBy(*by).agg(*out) if by else placed.agg(*out)


def beside(summary: DataFrame, parts: DataFrame, by: list[str]) -> DataFrame:
    """A summary with the percentiles of its groups, null where a group has none."""
    if not by:
        return summary.crossJoin(F.broadcast(parts))  # a row on either side
    same = F.lit(True)
    for i, b in enumerate(by):
        parts = parts.withColumnRenamed(b, f"_by{i}")
        same = same & F.col(b).eqNullSafe(F.col(f"_by{i}"))
    return summary.join(parts, same, "left").drop(*[f"_by{i}" for i in range(len(by))])
