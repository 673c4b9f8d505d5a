"""What is dealt by ranges: heading stacks and percentiles, against plain loops."""

import random

import numpy as np
from pyspark.sql import functions as F

from quillon.operators import answers, ingest, logs
from quillon.operators.quantiles import percentiles


def stacks(rows):
    out, held = {}, {}
    for doc, i, level, title in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1])):
        stack = held.setdefault(doc, [])
        if level is not None and level > 0:
            while stack and stack[-1][0] >= level:
                stack.pop()
            stack.append((level, title))
        out[doc, i] = " > ".join(t for _, t in stack if t is not None) or None
    return out


def test_heading_paths_of_any_depth(spark):
    rng = random.Random(4)
    rows = [(doc, i, rng.choice([None, None, 0, 1, 2, 3, 5, 8, 8, 9, 12]), f"t{i % 17}") for doc in ("a", "b", "huge", None) for i in range(30 if doc != "huge" else 3000)]
    rows += [("c", 0, None, "x"), ("c", 1, 8, None), ("c", 2, 9, "deep"), ("d", 0, 8, "only")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc string, i long, lv int, t string, task string").repartition(13)
    got = ingest.heading_paths(df, "doc", "i", "lv", "t")
    assert got.columns == [*df.columns, "heading_path"]
    assert {(r.doc, r.i): r.heading_path for r in got.collect()} == stacks(rows)
    assert ingest.heading_paths(df.limit(0), "doc", "i", "lv", "t").count() == 0


def test_headings_of_one_document_over_many_tasks(spark):
    rows = [(1, i, 1 + i % 7 if i % 50 == 0 else None, f"h{i}") for i in range(4000)]
    df = spark.createDataFrame(rows, "doc long, i long, lv int, t string").repartition(11)
    got = {(r.doc, r.i): r.heading_path for r in ingest.heading_paths(df, "doc", "i", "lv", "t").collect()}
    assert got == stacks(rows)


def test_percentiles_equal_numpy(spark):
    rng = np.random.default_rng(2)
    rows = [("big", float(x)) for x in rng.integers(0, 40, 5000)] + [("real", float(x)) for x in rng.normal(size=501)] + [("one", 7.5), ("two", 1.0), ("two", 2.0), (None, 3.0), (None, 5.0), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(9)
    shares = {"least": 0.0, "p10": 0.1, "median": 0.5, "p95": 0.95, "most": 1.0}
    got = {r.g: tuple(r[c] for c in shares) for r in percentiles(df, ["g"], "v", shares).collect()}
    held = {g: [v for h, v in rows if h == g and v is not None] for g in {g for g, _ in rows}}
    want = {g: tuple(round(float(np.percentile(v, 100 * q)), 6) for q in shares.values()) for g, v in held.items() if v}
    assert got.keys() == want.keys() and all(np.allclose(got[g], want[g], atol=2e-6) for g in want)
    assert percentiles(df, [], "v", {"m": 0.5}).first().m == round(float(np.percentile([v for _, v in rows if v is not None], 50)), 6)
    assert percentiles(df, ["g"], "v", {"m": 0.5}, F.col("v") > 10**6).count() == 0
    assert percentiles(df.limit(0), [], "v", {"m": 0.5}).first().m is None


def test_summaries_of_groups_without_values(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", None), (None, 4.0)], "lang string, n double")
    got = {r.lang: (r.n, r.median) for r in ingest.length_summary(df, "lang", "n").select("lang", F.col("n"), "median").collect()}
    assert got == {"a": (2, 1.5), "b": (1, None), None: (1, 4.0)}
    assert answers.separation(df, 1.0, [], "n").first().asDict() == {"n": 3, "least": 1.0, "median": 2.0, "most": 4.0, "within": 1}
    assert logs.latencies(df.select(F.col("n").alias("s1"), F.col("n").alias("all")), ["s1"], "all").first().p50 == 2.0
