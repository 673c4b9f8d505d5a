"""Kept runs, judgments made once, and requests folded on a stream."""

import json
import random
import uuid

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillon.operators import evaluate
from quillon.operators.runs import judged_once, kept_run
from quillon.streaming import events


def answering(log, breaks_at=None, bad=()):
    """An answering function that notes each call, and fails once it comes to an item."""

    def answer(batches):
        import pathlib

        for b in batches:
            for i in b["id"]:
                if i == breaks_at:
                    raise RuntimeError("broken off")
            pathlib.Path(log, uuid.uuid4().hex).write_text("\n".join(map(str, b["id"])))
            yield pd.DataFrame({"id": b["id"], "answer": [None if i in bad else f"a{i}:{t}" for i, t in zip(b["id"], b["text"], strict=True)]})

    return answer


def calls(log):
    return sorted(int(i) for f in log.iterdir() for i in f.read_text().split())


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture
def items(spark):
    return spark.createDataFrame([(i, f"t{i}", "clash") for i in range(47)], "id long, text string, batch string").repartition(3)


def test_a_broken_run_goes_on(spark, items, tmp_path):
    log, whole = tmp_path / "log", tmp_path / "whole"
    log.mkdir()
    whole.mkdir()
    want = rows(kept_run(items, "id", answering(str(whole)), "id long, answer string", str(tmp_path / "unbroken")))
    assert len(want) == 47
    folder = str(tmp_path / "run")
    with pytest.raises(Exception, match="broken off"):
        kept_run(items, "id", answering(str(log), breaks_at=25), "id long, answer string", folder)
    before = calls(log)
    assert 0 < len(before) < 47 and len(before) % 10 == 0
    assert rows(spark.read.parquet(f"{folder}/answers").select("id", "answer")) == [r for r in want if r[0] in before]
    assert rows(kept_run(items, "id", answering(str(log)), "id long, answer string", folder)) == want
    assert calls(log) == list(range(47))  # none twice


def test_more_items_and_failures_come_again(spark, items, tmp_path):
    log, folder = tmp_path / "log", str(tmp_path / "run")
    log.mkdir()
    failed = F.col("answer").isNull()
    first = kept_run(items.where("id < 15"), "id", answering(str(log), bad=(3, 4)), "id long, answer string", folder, failed=failed)
    assert first.where(failed).count() == 2
    again = kept_run(items, "id", answering(str(log)), "id long, answer string", folder, failed=failed)
    assert rows(again) == [(i, f"a{i}:t{i}") for i in range(47)] and calls(log) == sorted([*range(47), 3, 4])
    assert again.count() == kept_run(items, "id", answering(str(log)), "id long, answer string", folder, failed=failed).count() and len(calls(log)) == 49
    assert kept_run(items.limit(0), "id", answering(str(log)), "id long, answer string", str(tmp_path / "none")).count() == 0


def test_each_input_is_judged_once(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()

    def judge(batches):
        import pathlib

        for b in batches:
            if len(b):
                pathlib.Path(log, uuid.uuid4().hex).write_text("\n".join(b["key"]))
            yield pd.DataFrame({"key": b["key"], "verdict": [None if g == "fails" else f"{p}/{g}" for p, g in zip(b["prompt"], b["given"], strict=True)]})

    made = lambda: [k for f in log.iterdir() for k in f.read_text().split()]
    df = spark.createDataFrame([(1, "p", "x"), (2, "p", "x"), (3, "q", "x"), (4, "p", None), (5, "p", "fails")], "id long, prompt string, verdict_in string")
    once = lambda d, model="m": judged_once(d, F.col("prompt"), F.col("verdict_in"), judge, "support", model, str(tmp_path / "s"))
    want = {1: "p/x", 2: "p/x", 3: "q/x", 4: "p/None", 5: None}
    assert {r.id: r.verdict for r in once(df).collect()} == want and len(made()) == 4 == len(set(made()))
    assert {r.id: r.verdict for r in once(df).collect()} == want and len(made()) == 5  # the failed one alone
    assert once(df.where("id < 5")).count() == 4 and len(made()) == 5
    once(df.where("id = 1"), "another").collect()
    assert len(made()) == 6


def test_rounds_on_a_stream_equal_the_batch(spark, tmp_path):
    """Events shuffled within bounds, sent again and late: each request's last row is the batch's."""
    rng = random.Random(8)
    rows_ = []
    for r in range(25):
        kinds = rng.choices(["token", "token", "token", "thought", "step", "retrieval"], k=rng.randint(1, 30))
        kinds += rng.choice([["done"], ["error"], ["rejected"], [], ["done", "token"]])
        for seq, kind in enumerate(kinds):
            data = {"done": rng.choice(["{}", '{"answer": " told "}', None]), "retrieval": json.dumps(rng.sample("abcdef", 2)), "step": "x"}.get(kind, f" w{seq} ")
            rows_.append((f"r{r}", seq, seq // 5, kind, data, 10**6 + r * 20 + seq * 0.25))
    sent = sorted([(t[5] + rng.uniform(0, 60), t) for t in rows_] + [(t[5] + rng.uniform(0, 200), t) for t in rows_ if rng.random() < 0.3])
    sent = [t for _, t in sent]
    schema, parts = "request_id string, seq long, round long, event string, data string, t double", 5
    (tmp_path / "in").mkdir()
    for n in range(parts):
        one = sent[n * len(sent) // parts : (n + 1) * len(sent) // parts]
        spark.createDataFrame(one, schema).withColumn("ts", F.timestamp_seconds("t")).drop("t").coalesce(1).write.parquet(str(tmp_path / f"p{n}"))
        next((tmp_path / f"p{n}").glob("*.parquet")).rename(tmp_path / "in" / f"{n}.parquet")
    close = spark.createDataFrame([("end", 0, 0, "token", "z", 2.0 * 10**6)], schema).withColumn("ts", F.timestamp_seconds("t")).drop("t")
    for n in range(2):
        close.withColumn("request_id", F.lit(f"end{n}")).coalesce(1).write.parquet(str(tmp_path / f"q{n}"))
        next((tmp_path / f"q{n}").glob("*.parquet")).rename(tmp_path / "in" / f"{parts + n}.parquet")

    def keep(df, n):
        df.withColumn("n", F.lit(n)).write.mode("append").parquet(str(tmp_path / "out"))

    source = spark.readStream.schema(close.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = events.round_stream(source).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(240)
    out = spark.read.parquet(str(tmp_path / "out"))
    last = out.groupBy("request_id").agg(F.max_by(F.struct(*[c for c in out.columns if c not in ("request_id", "n")]), "n").alias("x")).select("request_id", "x.*")
    got = {r.request_id: r.asDict() for r in last.collect() if not r.request_id.startswith("end")}
    assert not any(r.pop("open") for r in got.values())  # all were closed by the watermark
    every = spark.createDataFrame(sent, schema).withColumn("ts", F.timestamp_seconds("t")).drop("t")
    assert got == {r.request_id: r.asDict() for r in events.round_rows(every).collect()}
    assert out.where("open").count() > len(got)  # rows came anew


def test_quotas_with_a_least_share(spark):
    df = lambda *counts: spark.createDataFrame([(f"s{n}", f"{n}-{i}") for n, c in enumerate(counts) for i in range(c)], "s string, k string")
    take = lambda d, total, floor: {r.s: r["count"] for r in evaluate.quota_sample(d, "s", "k", total, F.lit(True), floor=floor).groupBy("s").count().collect()}
    assert take(df(97, 1, 1, 1), 10, 0) == {"s0": 10} and take(df(97, 1, 1, 1), 10, 1) == {"s0": 7, "s1": 1, "s2": 1, "s3": 1}
    assert take(df(1, 1, 1), 5, 1) == {"s0": 1, "s1": 1, "s2": 1} and take(df(5, 4, 3), 2, 1) == {"s0": 1, "s1": 1, "s2": 1}
    rng = random.Random(1)
    for _ in range(3):
        counts, total = [rng.randint(1, 30) for _ in range(7)], rng.randint(8, 30)
        rest = total - 7
        exact = [rest * (c - 1) / sum(c - 1 for c in counts) for c in counts]
        more = [int(x) for x in exact]
        for i in sorted(range(7), key=lambda i: (-round(exact[i] - more[i], 9), i))[: rest - sum(more)]:
            more[i] += 1
        assert take(df(*counts), total, 1) == {f"s{i}": min(c, 1 + more[i]) for i, c in enumerate(counts)}
