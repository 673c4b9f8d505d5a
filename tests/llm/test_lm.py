"""Language-model scores against plain Python: counts in dictionaries, probabilities by recursion."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from quillon.llm import lm
from quillon.llm.lm import backing_off, narrowed, packed, score, unpacked, widened

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, order):
    """doc -> held_out, n_tokens, n_known, train_tokens, base, score."""
    texts = [(i, zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0, ["<s>", *re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)), "</s>"]) for i, t in rows]
    grams = [Counter() for _ in range(order + 1)]
    for _, held, s in texts:
        if not held:
            grams[1]["<s>",] += 1
            for i in range(1, len(s)):
                for n in range(1, min(order, i + 1) + 1):
                    grams[n][tuple(s[i - n + 1 : i + 1])] += 1
    n_all, types = sum(grams[1].values()) - grams[1]["<s>",], sum(k != ("<s>",) for k in grams[1])
    m = []
    for n in range(2, order + 1):
        sizes, sums = np.zeros(lm.EIGHTHS + 1), np.zeros(lm.EIGHTHS + 1)
        for c in grams[n - 1].values():
            if c:
                sizes[int(8 * math.log2(c))] += 1
                sums[int(8 * math.log2(c))] += c
        m.append(backing_off(sum(c == 1 for c in grams[n].values()), sizes, sums))

    def p(context, w):
        if not context:
            return (grams[1][w,] + 0.1) / (n_all + 0.1 * (types + 1))
        n, c = len(context) + 1, grams[len(context)][context]
        return (grams[n][*context, w] + m[n - 2] * p(context[1:], w)) / (c + m[n - 2]) if c else p(context[1:], w)

    out = []
    for i, held, s in texts:
        base = sum(math.log10(p((), w)) for w in s[1:])
        own = sum(math.log10(p(tuple(s[max(0, k - order + 1) : k]), s[k])) for k in range(1, len(s)))
        out.append((i, held, len(s) - 1, sum(grams[1][w,] > 0 for w in s[1:]), n_all, base, own))
    return out, p


def same(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[6])
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5:] for r in got], [r[5:] for r in want], rtol=1e-9, atol=1e-9)


TEXTS = [(i, t) for i, t in enumerate(["the cat sat", "The CAT sat on the mat", "", None, " \n", "a", "the the the the the", "été cat Été", "zz yy xx", "on the mat the cat"] * 4)]
TEXTS += [(None, "the cat"), (3, "the dog"), (3, "the dog"), (10**15, " ".join(f"w{i * i % 37}" for i in range(900)))]


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_equal_plain_python(spark, monkeypatch, order):
    monkeypatch.setattr(lm, "SHARD", 50)
    monkeypatch.setattr(lm, "CHUNK", 60)
    monkeypatch.setattr(lm, "PIECE", 40)
    monkeypatch.setattr(lm, "STRETCH", 7)
    docs = spark.createDataFrame([(*r, "clash", 1) for r in TEXTS], "doc_id long, text string, chunk string, score int").repartition(3)
    same(score(docs, order).collect(), plain(TEXTS, order)[0])


def test_short_pieces_keep_their_context(spark, monkeypatch):
    monkeypatch.setattr(lm, "PIECE", 1)
    monkeypatch.setattr(lm, "BYTES", 3)
    same(score(spark.createDataFrame(TEXTS, "doc_id long, text string"), 3).collect(), plain(TEXTS, 3)[0])


def test_probabilities_add_up():
    _, p = plain(TEXTS, 3)
    trained = {w for (i, t) in TEXTS if i is not None and zlib.crc32(str(i).encode()) % 10 for w in (t or "").translate(LOWER).split()}
    for context in [("the",), ("on", "the"), ("<s>",), ("never",)]:
        total = sum(p(context, w) for w in [*trained, "</s>", "an unknown word"])
        assert abs(total - 1) < 1e-9


def test_query_and_small_tables(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    same(lm.op12_lm(spark, SF).collect(), plain(rows, lm.ORDER)[0])
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    assert score(docs.limit(0)).count() == 0
    alone = [r for r in TEXTS if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 10 == 0]
    same(score(spark.createDataFrame(alone, "doc_id long, text string")).collect(), plain(alone, lm.ORDER)[0])


def test_numbers_packed_and_back():
    rng = np.random.default_rng(5)
    for x in (np.zeros(0, np.int64), np.array([0, 127, 128, 2**40]), rng.integers(0, 100000, 5000)):
        assert (unpacked(packed(x)) == x).all()
    for n in (1, 2, 1000):
        keys = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2))
        assert (widened(narrowed(keys)) == keys).all()
