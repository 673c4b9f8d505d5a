import re

import pytest
from pyspark.sql import functions as F

from quillon.operators import facts
from quillon.streaming import events


@pytest.mark.parametrize(
    ("pattern", "yes", "no"),
    [
        ("{n:0.1}{mm}", ["0.1mm", "0.10毫米"], ["10.1mm", "0.15mm"]),
        ("{n:2000}", ["2,000", "2000.0"], ["12000", "2000.5"]),
        ("{n:1,450}{to}{n:1500}", ["1450~1500", "1,450至1,500"], ["1450.1500"]),
        ("{n:1/16}{in}", ['1/16"'], ['11/16"', '1/160"']),
        ("{n:0.20}", ["0.2", "0.200"], ["0.21"]),
        ("a{2}{C}", ["aa°C", "AA度"], ["a2°c"]),
    ],
)
def test_expansion_in_both_engines(spark, pattern, yes, no):
    rx = facts.expanded(pattern)
    assert all(re.search(rx, t) for t in yes) and not any(re.search(rx, t) for t in no)
    got = spark.createDataFrame([(t,) for t in yes + no], "t string").select("t", facts.matches(F.col("t"), F.array(F.lit(rx))).alias("m")).collect()
    assert {r.t for r in got if r.m} == set(yes)


def test_declared_numbers_in_evidence(spark):
    assert facts.declared("{n:3}{to}{n:1/3}{mm}") == ["3", "1/3"]
    d = spark.createDataFrame([("3,000 and 1/3", [["3000", "1/3"]]), ("2", [["3"], ["2"]]), ("2", [["3"]]), (None, [["3"]]), ("2", [])], "e string, n array<array<string>>")
    assert [r.y for r in d.select(facts.numbers_grounded(F.col("e"), F.col("n")).alias("y")).collect()] == [True, True, False, False, False]
    assert not spark.range(1).select(facts.matches(F.lit(None).cast("string"), F.array(F.lit("x"))).alias("y")).first().y


def test_answers_by_round(spark):
    e = [("a", 1, 1, "token", "let me"), ("a", 2, 1, "thought", ""), ("a", 3, 2, "token", "x"), ("a", 4, 2, "token", "y"), ("a", 5, 2, "done", "{}")]
    e += [("b", 1, 1, "token", "p"), ("b", 2, 1, "done", '{"answer": "q"}'), ("c", 1, 1, "step", "")]
    got = {r.request_id: r.answer for r in events.round_answers(spark.createDataFrame(e, "request_id string, seq long, round int, event string, data string")).collect()}
    assert got == {"a": "xy", "b": "q", "c": None}
