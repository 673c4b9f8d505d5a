"""Places of matches in very long texts, the trigram index over several calls, contexts beside very long words."""

import re

from pyspark.sql import functions as F

from quillon.llm import pii, secrets
from quillon.llm.spans import found, masked_text


def test_many_matches(spark):
    texts = [" ".join(f"n{i}é" for i in range(n)) for n in (0, 1, 255, 256, 257, 3000)] + ["12", "", None, "x 1 y"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, text string")
    got = {r.i: r for r in df.select("i", found(F.col("text"), "[0-9]+", "x", 0).alias("s"), masked_text(F.col("text"), found(F.col("text"), "[0-9]+", "x", 0), "#").alias("m")).collect()}
    for i, t in enumerate(texts):
        assert [(s.start, s.end, s.match) for s in got[i].s] == [(m.start(), m.end(), m[0]) for m in re.finditer("[0-9]+", t or "")]
        assert got[i].m == (None if t is None else re.sub("[0-9]+", "#", t))


def test_overlapping_spans_are_masked_once(spark):
    spans = [(0, 3), (2, 5), (5, 6), (9, 12), (10, 11)] + [(20 + i, 22 + i) for i in range(0, 900, 1)] + [(2000, 2001)]
    text = "".join(chr(97 + i % 26) for i in range(2100))
    row = spark.createDataFrame([(text, spans)], "text string, s array<struct<start:int,end:int>>").select(masked_text(F.col("text"), F.col("s"), "*").alias("m")).first()
    assert row.m == "*" + text[6:9] + "*" + text[12:20] + "*" + text[921:2000] + "*" + text[2001:]


def test_index_grows_with_the_rules(spark, tmp_path):
    texts = [(1, "password = abcdefghijkl"), (2, "AKIA" + "A1" * 8), (3, "xoxb-" + "a1b2" * 6), (4, "nothing"), (5, None), (None, "token: 'zzzzzzzzzzzz9'"), (2, "AKIA" + "A1" * 8)]
    docs = spark.createDataFrame([(*t, "clash", 1) for t in texts], "doc_id long, text string, gram string, rules int")
    spans = lambda d: sorted((str(r.doc_id), sorted((s.kind, s.start, s.end) for s in r.spans)) for r in d.collect())
    folder = str(tmp_path / "index")
    secrets.scan(docs, secrets.RULES[:2], folder).collect()
    early = spark.read.parquet(f"{folder}/grams").count()
    before = sorted(p.stat().st_mtime_ns for p in (tmp_path / "index" / "postings").rglob("*.parquet"))
    assert spans(secrets.scan(docs, secrets.RULES, folder)) == spans(secrets.scan(docs))
    grams = {g for r in secrets.RULES for a in secrets.trigram_query(r.pattern) or [] for g in a}
    after = sorted(p.stat().st_mtime_ns for p in (tmp_path / "index" / "postings").rglob("*.parquet"))
    assert early < spark.read.parquet(f"{folder}/grams").distinct().count() == spark.read.parquet(f"{folder}/grams").count() == len(grams)
    assert after[: len(before)] == before  # what was there was not written again
    secrets.scan(docs, secrets.RULES, folder).collect()
    assert sorted(p.stat().st_mtime_ns for p in (tmp_path / "index" / "postings").rglob("*.parquet")) == after


def test_contexts_have_whole_words(spark):
    long = "w" * 200
    texts = [f"call the office 12345 at noon {long} 67890 {long} " + "x " * 700 + "call the office 55555 at", "1234 first", f"{'y' * 1500} is 98765", "tail 43210"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").select(pii._instances(F.col("text"), pii.base_spans(F.col("text"))).alias("i"))
    got = {s.token: s.patterns for r in df.collect() for s in r.i}
    assert got["12345"] == ["before:the office", "around:office _ at", "shape:office 0"] == got["55555"]
    assert got["67890"] == [] and got["1234"] == [] and got["98765"] == ["shape:is 0"] and got["43210"] == ["shape:tail 0"]
