import pytest
from pyspark.sql import functions as F

from quillon.operators import grounding as G
from quillon.operators import units


def read(spark, text, f):
    return spark.createDataFrame([(text,)], "x string").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("49–82 °C and 5 to 7", [("49", "°C"), ("82", "°C"), ("5", None), ("7", None)]),
        ("0.2 m³/h, 1,450 r/min", [("0.2", "m3/h"), ("1450", "r/min")]),
        ("$85^{\\circ}\\mathrm{C}$", [("85", "°C")]),
        ("grade 3 C, 5 mins, 2 daN · m", [("3", None), ("5", None), ("2", "daN·m")]),
        ("1.2.3", []), ("", []), (None, []),
    ],
)
def test_quantities(spark, text, want):
    assert [(q.num, q.unit) for q in read(spark, text, G.quantities)] == want


def test_lenient_numbers(spark):
    assert set(read(spark, "2. 5 and 3,000", G.lenient_numbers)) == {2.0, 5.0, 2.5, 3000.0, 3.0}
    assert set(read(spark, "kg/cm²100", G.lenient_numbers)) == {2.0, 100.0} and set(read(spark, "$8 5$", G.lenient_numbers)) == {85.0}


def checked(spark, answer, *sources):
    rows = spark.createDataFrame([(1, answer, [{"kind": k, "text": t} for k, t in sources])], "id int, answer string, sources array<struct<kind:string,text:string>>")
    r = G.checked(rows, "id", "answer", "sources").first()
    return r.n, [(i.quantity, i.status) for i in r.issues]


def test_grounding(spark):
    assert checked(spark, "It is 85 °C.", ("doc", "at most 85℃")) == (1, [])
    assert checked(spark, "It is 85 °F.", ("doc", "at most 85 °C")) == (1, [("85 °F", "unit_mismatch")])
    assert checked(spark, "It is 90 °C.", ("doc", "at most 85 °C"), ("doc", None)) == (1, [("90 °C", "no_source")])
    assert checked(spark, "About 3.33 L/min.", ("calc", "3.3333333 L/min")) == (1, [])
    assert checked(spark, "36 daN·m", ("doc", "moment [daN] | Mz | 36 | 49")) == (1, [])
    assert checked(spark, "36 kgf·m", ("doc", "moment [daN] | Mz | 36 | 49")) == (1, [("36 kgf·m", "unit_mismatch")])
    assert checked(spark, "1. Use 3 bolts [d_c0012]；第 52 页", ("doc", "x")) == (0, [])
    assert checked(spark, "85 °F", ("doc", "85 °C"), ("doc", "85 °F")) == (1, []) and checked(spark, None) == (0, [])


def test_display_trace_and_arithmetic(spark):
    shown = [read(spark, x, lambda c: units.shown(c.cast("double"))) for x in ("0", "3.33333", "1234.56", "0.000123456", "85.0", "-12.3456")]
    assert shown == ["0", "3.333", "1234.6", "0.0001235", "85", "-12.35"]
    assert read(spark, "3.33 and 7 [d_c0001]", lambda c: G.untraced(c, F.array(F.lit(3.3333)))) == ["7"]
    assert [G.calculated_value(x) for x in ("2 × (3 + 1) ** 2", "-6 / 4", "1 / 0", "abs(1)", None, "")] == [32.0, -1.5, None, None, None, None]
    assert read(spark, "6÷4", G.calculated) == 1.5
