"""Evaluation: intervals, agreement, splits, quotas, comparisons, cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.storage import numbered, stored

Z = 1.96


def wilson(k: Column, n: Column) -> tuple[Column, Column]:
    """The 95 % interval of k of n, clipped to 0 and 1; null for n = 0."""
    z2 = Z * Z
    p = k.cast("double") / F.nullif(n, F.lit(0))
    centre, wide = p + z2 / (2 * n), F.lit(Z) * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))
    scale = 1 + z2 / n
    return F.round(F.greatest(F.lit(0.0), (centre - wide) / scale), 6), F.round(F.least(F.lit(1.0), (centre + wide) / scale), 6)


def kappa(rows: DataFrame, a: str, b: str) -> DataFrame:
    """n, agreement and Cohen's kappa (null where chance agreement is 1) of two 0/1 labels, in one aggregation."""
    s = rows.agg(F.count(F.lit(1)).alias("n"), F.sum((F.col(a) == F.col(b)).cast("long")).alias("same"), F.sum(F.col(a).cast("long")).alias("ka"), F.sum(F.col(b).cast("long")).alias("kb"))
    n = F.col("n").cast("double")
    po, pa, pb = F.col("same") / n, F.col("ka") / n, F.col("kb") / n
    pe = pa * pb + (1 - pa) * (1 - pb)
    return s.select("n", F.round(po, 6).alias("agreement"), F.when(pe < 1, F.round((po - pe) / (1 - pe), 6)).alias("kappa"))


def confusion(rows: DataFrame, a: str, b: str) -> DataFrame:
    """a, b, n: the pairs of two labels; kappa of any labels follows from it."""
    return rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).agg(F.count(F.lit(1)).alias("n"))


def kappa_of(pairs: DataFrame) -> DataFrame:
    """n, agreement and kappa of a confusion table; null without pairs, and where chance agreement is 1."""
    total = pairs.agg(F.sum("n").cast("double").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n"))).cast("double").alias("same"))
    side = lambda c: pairs.groupBy(F.col(c).alias("label")).agg(F.sum("n").cast("double").alias(f"n{c}"))
    chance = side("a").join(side("b"), "label").agg(F.coalesce(F.sum(F.col("na") * F.col("nb")), F.lit(0.0)).alias("both"))
    po, pe = F.coalesce("same", F.lit(0.0)) / F.col("n"), F.col("both") / (F.col("n") * F.col("n"))
    return total.crossJoin(F.broadcast(chance)).select(F.col("n").cast("long").alias("n"), F.round(po, 6).alias("agreement"), F.when(pe < 1, F.round((po - pe) / (1 - pe), 6)).alias("kappa"))  # one row


def alternating_split(rows: DataFrame, stratum: str, key: str, existing: DataFrame | None = None) -> DataFrame:
    """rows with split: dev, test, dev ... within each stratum in the order of sha1(key).

    Keys that `existing` (key, split) holds keep theirs; new ones first make up for the side that has fewer of their stratum.
    """
    if existing is None:
        d = numbered(rows.withColumn("_hash", F.sha1(F.col(key).cast("string"))), [stratum], ["_hash", key], "_k")
        return d.withColumn("split", F.when(F.col("_k") % 2 == 1, "dev").otherwise("test")).drop("_k", "_hash")
    d = rows.join(existing.select(key, F.col("split").alias("_old")), key, "left")
    have = d.groupBy(F.col(stratum).alias("_of")).agg((F.count_if(F.col("_old") == "dev") - F.count_if(F.col("_old") == "test")).alias("_lead"))
    d = d.withColumn("_new", F.col("_old").isNull()).withColumn("_hash", F.sha1(F.col(key).cast("string")))
    d = numbered(d, [stratum, "_new"], ["_hash", key], "_k")
    d = d.join(have, F.col(stratum).eqNullSafe(F.col("_of"))).drop("_of")
    lead = F.abs("_lead")
    short = F.when(F.col("_lead") > 0, "test").otherwise("dev")
    new = F.when(F.col("_k") <= lead, short).when((F.col("_k") - lead) % 2 == 1, "dev").otherwise("test")
    return d.withColumn("split", F.coalesce("_old", new)).drop("_old", "_lead", "_k", "_new", "_hash")


def split_table(rows: DataFrame, by: str) -> DataFrame:
    """by, dev, test, total with a row for all (by null)."""
    of = lambda s: F.count_if(F.col("split") == s)
    return rows.rollup(by).agg(of("dev").alias("dev"), of("test").alias("test"), F.count(F.lit(1)).alias("total"))


def strays(split: DataFrame, items: DataFrame, key: str) -> DataFrame:
    """Split entries that have no item."""
    return split.join(items.select(key), key, "left_anti")


def calibration_sample(rows: DataFrame, key: str, flagged: Column, overlap: str, total: int) -> DataFrame:
    """All flagged rows; of the others half of what is left of `total` by least overlap, the rest by sha1(key)."""
    marked = rows.withColumn("_f", F.coalesce(flagged, F.lit(False)))
    must, rest = marked.where("_f"), marked.where(~F.col("_f"))
    left = must.agg(F.greatest(F.lit(total) - F.count(F.lit(1)), F.lit(0)).alias("_left"))
    low = rest.orderBy(F.col(overlap).asc_nulls_last(), key).limit(total // 2)
    low = low.withColumn("_n", F.row_number().over(Window.orderBy(F.col(overlap).asc_nulls_last(), key))).crossJoin(F.broadcast(left)).where(F.col("_n") <= F.floor(F.col("_left") / 2)).drop("_n", "_left")  # at most total / 2 rows
    other = rest.join(low.select(key), key, "left_anti").orderBy(F.sha1(F.col(key).cast("string")), key).limit(total)
    other = other.withColumn("_n", F.row_number().over(Window.orderBy(F.sha1(F.col(key).cast("string")), key))).crossJoin(F.broadcast(left)).where(F.col("_n") <= F.ceil(F.col("_left") / 2)).drop("_n", "_left")  # at most total rows
    tagged = lambda d, why: d.drop("_f").withColumn("why", F.lit(why))
    return tagged(must, "flagged").unionByName(tagged(low, "low_overlap")).unionByName(tagged(other, "random"))


def rates(rows: DataFrame, by: list[str], hit: Column) -> DataFrame:
    """by, k, n, rate: how often a probe was noticed."""
    return rows.groupBy(*by).agg(F.count_if(hit).alias("k"), F.count(F.lit(1)).alias("n")).withColumn("rate", F.round(F.col("k") / F.col("n"), 6))


def attack_table(rows: DataFrame, attack: str, guard: str, success: str) -> DataFrame:
    """attack, off, on, n: successes with the guard off and on."""
    hit = lambda g: F.count_if(F.col(success) & (F.col(guard) == g))
    return rows.groupBy(attack).agg(hit(False).alias("off"), hit(True).alias("on"), F.count(F.lit(1)).alias("n"))


def fingerprint(rows: DataFrame, key: str, text: str) -> DataFrame:
    """rows, fingerprint: 16 hexadecimal digits that change with any id or text, whatever the order or partitions; nothing is collected."""
    one = F.conv(F.substring(F.sha1(F.concat_ws("\x1f", F.col(key).cast("string"), F.coalesce(F.col(text), F.lit("")))), 1, 14), 16, 10).cast("decimal(20,0)")
    s = rows.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(one), F.lit(0)).alias("_s"))
    return s.select("rows", F.substring(F.sha1(F.concat_ws(":", F.col("rows").cast("string"), F.col("_s").cast("decimal(38,0)").cast("string"))), 1, 16).alias("fingerprint"))


def json_diff(old: DataFrame, new: DataFrame, json: str, keys: list[str] | None = None) -> DataFrame:
    """keys, path, old, new, missing of every difference between two JSON columns, row by row of `keys` (without any: one row on each side).

    Objects are compared key by key to any depth, all else as a whole: lists in their order, numbers by value, texts without regard to
    spacing or the order of keys within. path joins keys by dots and is empty where the values themselves differ; old and new are JSON text, null where
    `missing` says that the side has no such key (or no such row). A null column counts as no row. What is no JSON is compared as text.
    """
    keys = keys or []
    side = lambda d, name: d.where(F.col(json).isNotNull()).select(*keys, F.col(json).alias(name))
    a, b = side(old, "old"), side(new, "new")
    both = a.join(b, keys, "full_outer") if keys else a.join(b, F.lit(True), "full_outer")
    at, done = stored(both.select(*keys, F.lit("").alias("path"), "old", "new")), None
    read = lambda c: F.try_parse_json(F.col(c))
    while True:  # a round for each level of the deepest objects
        both = at.withColumn("_o", F.expr("try_cast(try_parse_json(old) as map<string, variant>)")).withColumn("_n", F.expr("try_cast(try_parse_json(new) as map<string, variant>)"))
        objects = F.col("_o").isNotNull() & F.col("_n").isNotNull()
        plain = lambda c: F.coalesce(F.to_json(read(c)), F.when(F.col(c).isNotNull(), F.concat(F.lit("text "), c)))
        ends = both.where(~objects).select(*keys, "path", "old", "new", plain("old").alias("_a"), plain("new").alias("_b"))
        ends = ends.where(~F.col("_a").eqNullSafe(F.col("_b"))).drop("_a", "_b")
        done = ends if done is None else done.unionByName(ends)
        inner = both.where(objects).select("*", F.explode(F.array_union(F.map_keys("_o"), F.map_keys("_n"))).alias("_k"))
        path = F.concat_ws(".", F.nullif(F.col("path"), F.lit("")), "_k")
        at = stored(inner.select(*keys, path.alias("path"), F.expr("to_json(try_element_at(_o, _k))").alias("old"), F.expr("to_json(try_element_at(_n, _k))").alias("new")))
        if at.isEmpty():
            break
    missing = F.when(F.col("old").isNull(), "old").when(F.col("new").isNull(), "new")
    return done.select(*keys, "path", "old", "new", missing.alias("missing"))


def line_diff(a: DataFrame, b: DataFrame, text: str) -> DataFrame:
    """side, line: the lines that only one of two texts has, for checks that prompts differ where they should."""
    lines = lambda d: d.select(F.explode(F.split(text, "\n")).alias("line"))
    only = lambda x, y, name: lines(x).exceptAll(lines(y)).select(F.lit(name).alias("side"), "line")
    return only(a, b, "first").union(only(b, a, "second"))


def resumed(items: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Items that have no answer yet: what a run that was broken off still has to do."""
    return items.join(done.select(key).distinct(), key, "left_anti")


def ordered_gate(a: DataFrame, b: DataFrame, position: str, key: str) -> DataFrame:
    """position, first, second: places at which two ordered lists differ."""
    both = a.select(position, F.col(key).alias("first")).join(b.select(position, F.col(key).alias("second")), position, "full_outer")
    return both.where(~F.col("first").eqNullSafe(F.col("second")))


def difficulty(chunk_type: Column, text: Column, neighbours: Column) -> Column:
    """hard: a table of over 30 % digits; medium: there are neighbours; easy."""
    from quillon.functions.text import digit_share

    return F.when((chunk_type == "table") & (digit_share(text) > 0.3), "hard").when(F.size(neighbours) > 0, "medium").otherwise("easy")


def overridden(rows: DataFrame, key: str, dropped: DataFrame, changes: DataFrame, value: str) -> DataFrame:
    """rows without the dropped keys, `value` replaced where changes (key, value) has one."""
    kept = rows.join(dropped.select(key), key, "left_anti")
    return kept.join(changes.select(key, F.col(value).alias("_new")), key, "left").withColumn(value, F.coalesce("_new", value)).drop("_new")


def compared_runs(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, a, b, delta and points (delta of a share, in hundredths, with sign) for the keys that both runs have."""
    both = a.select(*keys, F.col(value).alias("a")).join(b.select(*keys, F.col(value).alias("b")), keys)
    both = both.withColumn("delta", F.round(F.col("b") - F.col("a"), 6))
    return both.withColumn("points", F.format_string("%+.1f", 100 * F.col("delta")))


def preferred_chunk(heading: Column, size: Column) -> Column:
    """What samples take first: chunks of 100 to 500 characters below a heading."""
    return (F.coalesce(heading, F.lit("")) != "") & size.between(100, 500)


def quotas(counts: DataFrame, stratum: str, total: int, floor: int = 0) -> DataFrame:
    """stratum, quota of rows (stratum, c): `floor` for each that has rows, and the rest of `total` by largest remainders of what the strata have above it.

    Ties of remainders go to the smaller stratum, null first. Where the floors alone pass the total they stay. Remainders are
    ranked by ranges, so that strata may be very many.
    """
    held = stored(counts.where(F.col("c") > 0).select(stratum, F.least(F.lit(floor), F.col("c")).cast("long").alias("least"), F.greatest(F.col("c") - floor, F.lit(0)).alias("more")))
    n = held.agg(F.sum("least").alias("least"), F.sum("more").alias("more")).first()
    rest = max(0, total - (n.least or 0))
    if not rest or not n.more:
        return held.select(stratum, F.col("least").alias("quota"))
    exact = F.lit(rest) * F.col("more") / F.lit(n.more)
    q = stored(held.where("more > 0").select(stratum, "least", F.floor(exact).alias("base"), F.round(exact - F.floor(exact), 9).alias("left")))
    short = rest - q.agg(F.sum("base")).first()[0]
    q = numbered(q, [], [F.desc("left"), F.col(stratum)], "nth").select(stratum, (F.col("least") + F.col("base") + (F.col("nth") <= short).cast("int")).alias("quota"))
    return q.unionByName(held.where("more = 0").select(stratum, F.col("least").alias("quota")))


def quota_sample(rows: DataFrame, stratum: str, key: str, total: int, preferred: Column, covered: str | None = None, floor: int = 0) -> DataFrame:
    """A sample by quotas of the strata; preferred rows first, then by sha1(key).

    With `floor`, each stratum has so many at least. With `covered`, the first row of each of its values comes before all others of the stratum, as long as the quota lasts.
    """
    q = quotas(rows.groupBy(stratum).agg(F.count(F.lit(1)).alias("c")), stratum, total, floor)
    total = max(total, floor)
    if covered:
        first = Window.partitionBy(stratum, covered).orderBy(F.desc(F.coalesce(preferred, F.lit(False)).cast("int")), F.sha1(F.col(key).cast("string")), key)
        rows = rows.withColumn("_first", (F.row_number().over(first) == 1).cast("int"))
        order = Window.partitionBy(stratum).orderBy(F.desc("_first"), F.desc(F.coalesce(preferred, F.lit(False)).cast("int")), F.sha1(F.col(key).cast("string")), key)
        return rows.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= total).join(q, stratum).where(F.col("nth") <= F.col("quota")).drop("quota", "_first")
    order = Window.partitionBy(stratum).orderBy(F.desc(F.coalesce(preferred, F.lit(False)).cast("int")), F.sha1(F.col(key).cast("string")), key)
    first = rows.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= total)  # each task keeps so many of a stratum
    return first.join(q, stratum).where(F.col("nth") <= F.col("quota")).drop("quota")


def fabricated(cited: Column, retrieved: Column) -> Column:
    return F.array_except(cited, retrieved)


def compared(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """key, a, b, delta of two runs over the keys they share."""
    x, y = a.select(key, F.col(value).alias("a")), b.select(key, F.col(value).alias("b"))
    return x.join(y, key).withColumn("delta", F.round(F.col("b") - F.col("a"), 6))


def cost(prompt: Column, cached: Column, output: Column, price_in: float, price_cached: float, price_out: float) -> Column:
    """Per million tokens; what isn't cached is at least 0."""
    fresh = F.greatest(prompt - cached, F.lit(0))
    return F.round((fresh * F.lit(float(price_in)) + cached * F.lit(float(price_cached)) + output * F.lit(float(price_out))) / F.lit(1e6), 9)


def set_gate(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """side, n: keys that only one side has and keys that repeat on the first."""
    x, y = a.select(key), b.select(key)
    side = lambda d, name: d.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("side"), "n")
    repeated = x.groupBy(key).count().where("count > 1")
    return side(x.distinct().exceptAll(y.distinct()), "only_first").union(side(y.distinct().exceptAll(x.distinct()), "only_second")).union(side(repeated, "repeated"))
