"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(links: DataFrame) -> DataFrame:
    """node, component (the component's least node) from links (a, b) of longs.

    Labels fall to the least among neighbours and then to their label's label, so long chains take
    a logarithm of rounds; each round is stored, nothing is collected. Only sums pre-aggregated by
    node are shuffled, so a node of very many links is no hot key.
    """
    both = stored(links.select("a", "b").union(links.select("b", "a")).distinct())
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("component")))
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("near"))
        low = labels.join(near, labels["node"] == near["a"]).select("node", F.least("component", "near").alias("low"), F.col("component").alias("was"))
        low = stored(low)
        jump = low.select(F.col("node").alias("at"), F.col("low").alias("next"))
        after = stored(low.join(jump, F.col("low") == F.col("at")).select("node", F.col("next").alias("component"), "was"))
        labels = after.select("node", "component")
        if not after.where(F.col("component") != F.col("was")).limit(1).count():
            return labels
