"""Words of texts, the learned dictionary, and the inverted index against plain Python."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quillon.functions.text import terms
from quillon.operators import lexical, segment
from quillon.operators.lexical import Index, bm25_index, bm25_search, bm25_topk


def test_terms_of_any_script(spark):
    rows = [("für die Straße Ñandú x_1", ["für", "die", "Straße", "Ñandú", "x_1"]), ("泵的压力 3bar阀", ["泵的", "的压", "压力", "3bar", "阀"]), (" -. ", []), ("été", ["été"]), ("насос Ωμ", ["насос", "Ωμ"]), (None, None)]
    got = spark.createDataFrame(rows, "t string, want array<string>").select("want", terms(F.col("t")).alias("got")).collect()
    assert all(r.got == r.want for r in got)


WORDS = "压力 水泵 阀门 电动机 密封 轴承 的 在 了 是 检查 更换 开 关 温度计".split()


def runs(n=400, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(WORDS) for _ in range(rng.randint(2, 8))) for _ in range(n)]


def best_path(run, counts):
    total = sum(counts.values())
    cost = lambda w: math.log(counts[w] / total) if counts.get(w) else math.log(0.5 / total) if len(w) == 1 else None
    best = {len(run): (0.0, [])}
    for i in range(len(run) - 1, -1, -1):
        best[i] = max((cost(run[i:j]) + best[j][0], j - i, [run[i:j], *best[j][1]]) for j in range(i + 1, min(len(run), i + 6) + 1) if cost(run[i:j]) is not None)
        best[i] = best[i][0], best[i][2]
    return best[0][1]


def test_dictionary_is_learned_as_plainly_counted(spark):
    texts = [f"x {a}。{b}, {a} y" for a, b in zip(runs(), runs(seed=2), strict=True)] + [None, "no such letters"]
    found = [r for t in texts if t for r in re.findall("[一-鿿]+", t)]
    count, left, right = Counter(), defaultdict(list), defaultdict(list)
    for r in found:
        for i in range(len(r)):
            for k in (1, 2, 3, 4):
                if i + k <= len(r):
                    w = r[i : i + k]
                    count[w] += 1
                    left[w].append(r[i - 1] if i else None)
                    right[w].append(r[i + k] if i + k < len(r) else None)
    kinds = lambda x: len({c for c in x if c}) + x.count(None)
    chance = lambda w: min(count[w] * sum(map(len, found)) / (count[w[:k]] * count[w[k:]]) for k in range(1, len(w)))
    words = {w: n for w, n in count.items() if len(w) > 1 and n >= 5 and min(kinds(left[w]), kinds(right[w])) >= 3 and chance(w) >= 8} | Counter("".join(found))
    for _ in range(segment.ROUNDS):
        words = Counter(w for r in found for w in best_path(r, words))
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(3)
    got = segment.learned(df, "t")
    assert {r["word"]: r["count"] for r in got.collect()} == words
    cut = segment.cutter(got)
    for r in df.select("t", terms(F.col("t"), cut).alias("got")).collect():
        want = None if r.t is None else [w for run in re.findall(r"[一-鿿]+|[a-z]+", r.t) for w in (best_path(run, words) if run[0] > "z" else [run])]
        assert r.got == want
    assert segment.learned(df.limit(0), "t").count() == 0


def test_true_words_are_found(spark):
    df = spark.createDataFrame([(t,) for t in runs(3000, 7)], "t string")
    words = segment.Words({r["word"]: r["count"] for r in segment.learned(df, "t").collect()})
    rng, right, cuts = random.Random(9), 0, 0
    for _ in range(200):
        true = [rng.choice(WORDS) for _ in range(6)]
        ends = lambda ws: {sum(map(len, ws[: k + 1])) for k in range(len(ws))}
        right, cuts = right + len(ends(true) & ends(words.cut("".join(true)))), cuts + len(ends(true))
    assert right / cuts > 0.9


def plain_bm25(docs, questions, k, tags=None):
    lists = {key: re.findall(r"\w+", t or "") for key, t in docs}
    df = Counter(w for ws in lists.values() for w in set(ws))
    raw = {w: math.log(len(lists) - n + 0.5) - math.log(n + 0.5) for w, n in df.items()}
    mean = sum(raw.values()) / max(1, len(raw))
    idf = {w: 0.25 * mean if x < 0 else x for w, x in raw.items()}
    avgdl = sum(map(len, lists.values())) / len(lists)
    out = []
    for q_id, text, *tag in questions:
        scores = []
        for key, ws in lists.items():
            if tags is None or tag[0] is None or tags.get(key) == tag[0]:
                tf = Counter(ws)
                s = sum(idf[w] * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(ws) / avgdl)) for w in re.findall(r"\w+", text or "") if tf[w])
                scores.append((-round(s, 6), -key))
        out += [(q_id, -key, -s + 0.0, n) for n, (s, key) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


def corpus(seed, n=160):
    rng = random.Random(seed)
    word = lambda: f"w{int(rng.paretovariate(0.7)) % 60}"
    docs = [(i * 7 - 300, " ".join(word() for _ in range(rng.choice([0, 1, 3, 8, 40])))) for i in range(n)] + [(9999, None), (10000, "Straße für Straße")]
    questions = [(i, " ".join(word() for _ in range(rng.choice([0, 1, 2, 5])))) for i in range(40)] + [(98, None), (99, "für unknown Straße")]
    return docs, questions


@pytest.mark.parametrize(("slice_", "first"), [(9, 1), (40, 2), (2048, 1)])
def test_index_gives_the_hits_of_a_full_scan(spark, monkeypatch, tmp_path, slice_, first):
    monkeypatch.setattr(lexical, "SLICE", slice_)
    monkeypatch.setattr(lexical, "FIRST", first)
    monkeypatch.setattr(lexical, "BLOCK", 2)
    docs, questions = corpus(slice_)
    d, q = spark.createDataFrame(docs, "k long, t string"), spark.createDataFrame(questions, "q_id long, q_text string")
    index = bm25_index(d.repartition(4), "k", "t")
    hits, reads = bm25_search(index, q, 5)
    assert sorted((r.q_id, r.key, r.score, r["rank"]) for r in hits.collect()) == plain_bm25(docs, questions, 5)
    r = reads.first()
    assert 0 < r["read"] <= r["blocks"] and (slice_ != 9 or r["read"] < r["blocks"])
    kept = Index.read(spark, (index.write(f"{tmp_path}/i") and f"{tmp_path}/i"))
    assert sorted((r.q_id, r.key, r.score, r["rank"]) for r in bm25_topk(kept, q, 200).collect()) == plain_bm25(docs, questions, 200)


def test_index_with_tags(spark, monkeypatch):
    monkeypatch.setattr(lexical, "SLICE", 13)
    docs, questions = corpus(4)
    tags = {key: [None, "a", "b", "c"][n % 4] for n, (key, _) in enumerate(docs)}
    asked = [(*q, [None, "a", "b", "never"][q[0] % 4]) for q in questions]
    index = bm25_index(spark.createDataFrame(docs, "k long, t string"), "k", "t")
    got = bm25_topk(index, spark.createDataFrame(asked, "q_id long, q_text string, tag string"), 6, spark.createDataFrame(list(tags.items()), "key long, tag string"))
    assert sorted((r.q_id, r.key, r.score, r["rank"]) for r in got.collect()) == plain_bm25(docs, asked, 6, tags)


def test_index_of_nothing(spark):
    q = spark.createDataFrame([(1, "a")], "q_id long, q_text string")
    docs = spark.createDataFrame([(5, None), (6, " ")], "k long, t string")
    assert sorted((r.key, r["rank"]) for r in bm25_topk(bm25_index(docs, "k", "t"), q, 5).collect()) == [(5, 2), (6, 1)]
    assert bm25_topk(bm25_index(docs.limit(0), "k", "t"), q, 5).count() == 0
    assert bm25_topk(bm25_index(docs, "k", "t"), q.limit(0), 5).count() == 0


def test_han_words_in_search(spark):
    texts = runs(300, 3)
    df = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    index = bm25_index(df, "k", "t", segment.learned(df, "t"))
    top = bm25_topk(index, spark.createDataFrame([(1, "温度计")], "q_id long, q_text string"), 10).collect()
    assert all("温度计" in texts[r.key] for r in top if r.score > 0) and any(r.score > 0 for r in top)
