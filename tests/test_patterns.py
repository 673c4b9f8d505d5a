"""Patterns in texts against the plain test of each pair."""

import builtins
import random

import pytest

from quillon.operators import answers, quotes
from quillon.operators.patterns import Automaton, matches


def corpus(seed):
    rng = random.Random(seed)
    some = lambda n: "".join(rng.choice("abcé泵") for _ in range(n))
    texts = [(i, some(rng.choice([0, 1, 5, 60, 400]))) for i in range(80)] + [(900, None), (901, ""), (7, "abc"), (7, "abc")]
    return texts, [some(rng.choice([1, 2, 3, 6])) for _ in range(60)] + [None, "", "never here", "abc", "abc"]


@pytest.mark.parametrize("chars", [1_000_000, 20])
def test_matches_equal_contains(spark, chars):
    texts, wanted = corpus(chars)
    t = spark.createDataFrame(texts, "k long, t string").repartition(3)
    got = matches(t, "k", "t", spark.createDataFrame([(p,) for p in wanted], "p string"), "p", chars)
    want = sorted((k, p) for k, x in texts if x is not None for p in {p for p in wanted if p} if p in x)
    assert got.columns == ["k", "p"] and sorted((r.k, r.p) for r in got.collect()) == want
    assert matches(t, "k", "t", spark.createDataFrame([], "p string"), "p").count() == matches(t.limit(0), "k", "t", spark.createDataFrame([("a",)], "p string"), "p").count() == 0


def test_without_the_library(monkeypatch):
    real = builtins.__import__

    def missing(name, *args, **kwargs):
        if name == "ahocorasick":
            raise ImportError(name)
        return real(name, *args, **kwargs)

    texts, wanted = corpus(2)
    held = [(p, i) for i, p in enumerate(sorted({p for p in wanted if p}))]
    fast = Automaton(held)
    monkeypatch.setattr(builtins, "__import__", missing)
    plain = Automaton(held)
    assert plain.machine is None and fast.machine is not None
    for _, x in texts:
        assert plain.found(x or "") == fast.found(x or "") == {i for p, i in held if p in (x or "")}
    assert Automaton([]).found("abc") == set()


def test_evidence_by_document(spark):
    chunks = spark.createDataFrame([("c1", "A", "the  VALVE is shut"), ("c2", "B", "valve is shut"), ("c3", "A", None), ("c4", None, "Is shut")], "chunk_id string, doc_id string, text string")
    items = spark.createDataFrame([(1, 1, "A", ["Valve is"]), (1, 2, None, ["is shut", "zz"]), (2, 1, "B", ["nothing", ""]), (3, 1, "A", [])], "id long, n int, doc string, quotes array<string>")
    got = {(r.id, r.n): r.ids for r in answers.evidence(items, chunks).collect()}
    assert got == {(1, 1): ["c1"], (1, 2): ["c1", "c2", "c4"], (2, 1): [], (3, 1): []}


def test_plans_pair_nothing(spark):
    """No nested loop and no cartesian product."""
    texts, wanted = corpus(3)
    t, p = spark.createDataFrame(texts, "k long, t string"), spark.createDataFrame([(i, x) for i, x in enumerate(wanted)], "id long, term string")
    chunks = t.selectExpr("cast(k as string) chunk_id", "'d' doc_id", "t text")
    for df in (matches(t, "k", "t", p, "term"), answers.absent_found(p, chunks), quotes.contained(t, "k", "t", p, "id", "term")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "CartesianProduct" not in plan
    got = {(r.id, r.chunk_id) for r in answers.absent_found(p, chunks).collect()}
    assert got == {(i, str(k)) for i, x in enumerate(wanted) if x for k, y in texts if y and x.replace(" ", "") in y}


def test_long_and_short_quotes(spark):
    long = "the valve is to be opened slowly by hand before the pump is started"
    texts = [(1, f"x {long} y {long}."), (2, long[:40]), (3, "pump"), (4, None), (5, long + " " + long.replace("valve", "cock"))]
    wanted = [(10, long), (11, "PUMP"), (12, long.replace("valve", "cock")), (13, ""), (14, None), (15, long)]
    got = quotes.contained(spark.createDataFrame(texts, "k long, t string"), "k", "t", spark.createDataFrame(wanted, "q long, w string"), "q", "w")
    assert sorted(map(tuple, got.collect())) == [(1, 10), (1, 11), (1, 15), (3, 11), (5, 10), (5, 11), (5, 12), (5, 15)]
