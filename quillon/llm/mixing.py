"""Mixing sources to target weights.

Every document gets a hash-random key (md5 of its id); within each source the documents
are range-sorted by key, distributed prefix sums of their word counts are taken, and the
order is cut at the source's exact budget. A budget above the source's size repeats it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, documents, fresh, prefix_sums, stored

WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
_OWN = ("size", "source_size", "target", "taken")


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size, weight, target from rows (source, size).

    Sources ordered by code point (null last) weigh `weights`, repeating. They divide `share` of
    all sizes by weight; no target exceeds `most` times its source's size, and what lies above is
    divided again among the others. Only three sums a round reach the driver. An empty table has no
    sources; sources of size 0 get 0.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = per.withColumn("one", F.lit(1).cast("long")).withColumn("all", F.lit(0)).withColumn("void", F.col("source").isNull())
    ranked = prefix_sums(stored(per), "all", ["void", "source"], "one", "nth")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("nth") % len(weights) + 1).cast("int"))
    per = stored(ranked.select("source", "source_size", weight.alias("weight"), (F.lit(float(most)) * F.col("source_size")).alias("_cap")))
    first = per.agg(F.sum("source_size").alias("s"), F.sum("weight").alias("w"), F.sum("_cap").alias("c")).first()
    total, level = share * (first.s or 0), None
    if first.w and total < first.c:
        level = total / first.w
        while True:  # the level only rises; each round fills one source at least
            full = F.col("_cap") <= F.lit(level) * F.col("weight")
            r = per.agg(F.sum(F.when(full, F.col("_cap"))).alias("c"), F.sum(F.when(~full, F.col("weight"))).alias("w")).first()
            higher = (total - (r.c or 0.0)) / r.w if r.w else level
            if higher == level:
                break
            level = higher
    target = F.col("_cap") if level is None else F.least(F.col("_cap"), F.lit(level) * F.col("weight"))
    return per.select("source", "source_size", "weight", target.alias("target"))


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """docs with size, source_size, target and taken: the words that the mix takes, repeats counted.

    Very long texts are counted whole; an empty table gives no rows.

    A document's size is its number of words (null or empty text: 0, never taken). A source takes each
    of its documents floor(target / source_size) times, then in key order up to its exact budget; the
    document at the cut is taken in part. Null sources are one source; null ids share one key. Rows
    equal in source, id and size share what falls to them, rounded down. Columns of docs that carry
    one of the new names are replaced. The cut of each source is one row, joined back by Spark, so no
    text moves unless the sources are too many to broadcast under Spark's own limit.
    """
    kept = [c for c in docs.columns if c.lower() not in _OWN]
    place = {c.lower(): i for i, c in enumerate(docs.columns)}
    base = docs.toDF(*[f"column{i}" for i in range(len(docs.columns))])  # so that no name of theirs is one of those below
    source, text, doc = (F.col(f"column{place[c]}") for c in ("source", "text", "doc_id"))
    base = base.withColumn("size", F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")).withColumn("source", source)
    base = base.withColumn("id", F.coalesce(doc.cast("string"), F.lit(""))).withColumn("key", F.md5("id"))
    sized = stored(base.groupBy("source", "key", "id", "size").agg(F.count(F.lit(1)).alias("rows")))
    words = sized.withColumn("words", F.col("size") * F.col("rows"))
    targets = stored(source_targets(words.select("source", F.col("words").alias("size")), weights, share, most))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = targets.select(
        F.col("source").alias("of"), "source_size", "target", whole.alias("whole"),
        F.floor(F.col("target") - whole * F.col("source_size")).cast("long").alias("rest"),
    )
    summed = prefix_sums(words, "source", ["key", "id", "size"], "words", "before")
    cut = summed.join(plan, F.col("source").eqNullSafe(F.col("of")))
    cut = cut.where((F.col("before") < F.col("rest")) & (F.col("rest") <= F.col("before") + F.col("words")))
    part = F.floor((F.col("rest") - F.col("before")) / F.col("rows")).cast("long")
    here = F.struct("key", "id", "size")
    cut = cut.select(F.col("of").alias("cut_of"), here.alias("cut"), part.alias("part"))
    plan = stored(plan.join(cut, F.col("of").eqNullSafe(F.col("cut_of")), "left").drop("cut_of"))
    more = F.when(F.col("cut").isNull(), 0).when(here < F.col("cut"), F.col("size")).when(here == F.col("cut"), F.col("part")).otherwise(0)
    joined = base.join(plan, F.col("source").eqNullSafe(F.col("of")), "left")
    taken = (F.col("whole") * F.col("size") + more).cast("long").alias("taken")
    return joined.select(*[F.col(f"column{place[c.lower()]}").alias(c) for c in kept], "size", "source_size", "target", taken)


def mixed_rows(docs: DataFrame, **options: object) -> DataFrame:
    """The mix as rows with the columns of docs: a row for each repeat, the last one cut to its first words.

    Documents of which nothing is taken go, null and empty texts among them; n_chars follows the text. Nulls elsewhere, ties of keys and repeated rows
    are as in mix; very long texts are cut by whole words; an empty table gives no rows; columns of any name are kept.
    """
    m = mix(docs, **options)
    nth = fresh(m, "nth")
    copies = F.when(F.col("size") > 0, F.ceil(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    m = m.withColumn(nth, F.explode(F.sequence(F.lit(1), F.greatest(copies, F.lit(1))))).where(F.col("taken") > 0)
    left = F.least(F.col("size"), F.col("taken") - (F.col(nth) - 1) * F.col("size"))
    head = F.concat(F.lit(r"^(?>(?>[\x20\x09-\x0D]*)[^\x20\x09-\x0D]++){"), left.cast("string"), F.lit("}+"))
    text = F.when(left == F.col("size"), F.col("text")).otherwise(F.regexp_substr("text", head))
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    return m.select(*[new[c.lower()].alias(c) if c.lower() in new else F.col(f"`{c}`") for c in docs.columns if c.lower() not in _OWN])


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents; nulls, empty and long texts, ties and repeated rows as in mix."""
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH d AS (SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS k, coalesce(CAST(doc_id AS VARCHAR), '') AS i,
                  CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
p AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST([5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS DOUBLE) AS weight, 2.0::DOUBLE * source_size AS cap FROM p),
o AS (SELECT *, row_number() OVER (ORDER BY cap / weight, source) AS n, sum(cap) OVER () AS caps, sum(weight) OVER () AS weights, sum(source_size) OVER () AS total FROM w),
f AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below,
             coalesce(sum(weight) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS weigh FROM o),
l AS (SELECT arg_min((CAST(1.5 AS DOUBLE) * CAST(total AS DOUBLE) - below) / (weights - weigh), n) AS level FROM f
      WHERE (CAST(1.5 AS DOUBLE) * CAST(total AS DOUBLE) - below) / (weights - weigh) < cap / weight),
t AS (SELECT source, source_size, least(cap, weight * level) AS target FROM w, l),
b AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
r AS (SELECT *, CAST(floor(target - whole * source_size) AS BIGINT) AS rest FROM b),
s AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY k, i, size) - size AS before FROM d)
SELECT s.doc_id, s.size, r.source_size, r.target,
       CAST(r.whole * s.size + greatest(0, least(s.size, r.rest - s.before)) AS BIGINT) AS taken
FROM s JOIN r ON s.source IS NOT DISTINCT FROM r.source
"""
