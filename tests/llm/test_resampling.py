"""Importance resampling against plain Python and against its SQL."""

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import pytest

from quillon.llm import resampling
from quillon.llm.resampling import importance, resample

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORDS = "pump valve seal drive shaft oil Über naïve ÉTÉ 3 bar 泵 x".split()
TEXTS = [(i, " ".join(WORDS[(i * k + k * k) % len(WORDS)] for k in range(5 + i * 3))) for i in range(30)]
TEXTS += [(100, None), (101, ""), (102, " .,\x00- "), (103, "one"), (None, " ".join(WORDS * 3)), (5, "valve " * 25), (5, "valve " * 25), (104, "a\x00b pump\n" * 4000)]
TARGET = ["The pump and the valve. Pump valve seal!", None, "", "oil pressure 3 bar"]


def features(text, order):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return len(words), [" ".join(words[i : i + n]) for n in range(1, order + 1) for i in range(len(words) - n + 1)]


def plain(texts, target, order, buckets, least, percent, seed):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    own = [features(t, order) for _, t in texts]
    s, t = Counter(bucket(f) for _, fs in own for f in fs), Counter(bucket(f) for x in target for f in features(x, order)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    rows = []
    for (i, _), (n, fs) in zip(texts, own, strict=True):
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets)))) for b in map(bucket, fs))
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((n, i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[0] >= least), key=lambda r: (-r[4], r[1] is None, r[1] or 0))
    drawn = len(able) * percent // 100
    out = [(*r[1:], k if k <= drawn else None) for k, r in enumerate(able, 1)] + [(*r[1:], None) for r in rows if r[0] < least]
    return sorted(out, key=str)


@pytest.mark.parametrize(("order", "buckets", "percent"), [(1, 10_000, 10), (3, 64, 50), (2, 1, 100)])
def test_importance_equals_plain_python(spark, monkeypatch, order, buckets, percent):
    monkeypatch.setattr(resampling, "CHARS", 300)
    docs = spark.createDataFrame([(*r, 1, "clash") for r in TEXTS], "doc_id long, text string, place int, score string").repartition(3)
    target = spark.createDataFrame([(t, 1) for t in TARGET], "text string, id int")
    got = importance(docs, target, order, buckets, 20, percent, 7)
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(TEXTS, TARGET, order, buckets, 20, percent, 7)
    drawn = resample(docs, target, order=order, buckets=buckets, percent=percent, seed=7)
    ids = {r[0] for r in plain(TEXTS, TARGET, order, buckets, 20, percent, 7) if r[4] is not None and r[0] is not None}
    assert drawn.columns == docs.columns and {r.doc_id for r in drawn.collect()} == ids


def test_empty_tables(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    assert importance(docs.limit(0), docs).count() == 0
    got = importance(docs, docs.limit(0))
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(TEXTS, [], 1, 10_000, 20, 10, 2024)


def test_query_equals_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(f"select doc_id, n_features, weight, score, rank from ({resampling.SQL})").fetchall()
    got = [tuple(r) for r in resampling.op11_resampling(spark, SF).select("doc_id", "n_features", "weight", "score", "rank").collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
