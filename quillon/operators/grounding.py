"""Quantities in text, and whether the numbers of an answer are found in its sources.

All of it is column expressions: an answer and its sources stay in one row, nothing is
exploded or shuffled, however many answers there are.
"""

from __future__ import annotations

import ast
import json
import operator
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from quillon.functions.text import without_citations
from quillon.operators.units import UNITS, ZERO, unit_key

# Spellings met in text only, and what they stand for.
IN_TEXT = {
    "立方米每小时": "m3/h", "立方米/h": "m3/h", "升每分钟": "l/min", "升/min": "l/min", "米每秒": "m/s", "转每分钟": "r/min", "转每分": "r/min",
    "min-1": "r/min", "1/min": "r/min", "r.p.m": "rpm", "kgf/cm2g": "kgf/cm2", "公斤/厘米2": "kgf/cm2",
}
# Spellings that mean nothing after a number, and those that mean nothing in free text.
NOT_AFTER_NUMBER = {"c", "f", "k", "开", "d"}
NOT_IN_PROSE = {"in", "ps", "pa", "mil", "thou", "开尔文", "kelvin", "celsius", "fahrenheit"}
# Marks of lists, ordinals and years, whose numbers aren't checked; sentence ends.
LIST_MARK = r"(?m)^\s*(?:[-*+>]\s*)?(?:[0-9]+(?:[.、](?![0-9])|[)）])|[（(][0-9]+[)）])\s*"
ORDINAL = r"第\s*[0-9]+\s*[页章节条步项点次行列级部轮]|[0-9]{4}\s*年"
SENTENCE = r"(?<=[。！？；!?;])|\n"

#: spelling -> identity (dimension, factor and zero), equal for spellings of one unit.
IDENTITY = {s: f"{d}:{f:.9g}:{ZERO.get(s, 0):.6g}" for d, us in UNITS.items() for s, f in us.items()}
IDENTITY |= {s: IDENTITY[t] for s, t in IN_TEXT.items()}
_WIDE = "".join(chr(0xFF01 + i) for i in range(94))
_NARROW = "".join(chr(0x21 + i) for i in range(94))


def _either(spellings: set[str]) -> str:
    """The longest first; a spelling that ends in a letter isn't the beginning of a longer word."""
    return "|".join(re.escape(s) + ("(?![A-Za-z])" if s[-1].isascii() and s[-1].isalpha() else "") for s in sorted(spellings, key=lambda s: (-len(s), s)))


# A number alone, and what joins a range.
NUMBER = r"(?<![0-9.])[0-9]+(?:\.[0-9]+)?(?![0-9]|\.[0-9])"
TO = r"\s*[~–—至到-]\s*"
QUANTITY = rf"(?i){NUMBER}(?: ?(?:{_either(set(IDENTITY) - NOT_AFTER_NUMBER)}))?(?:{TO}(?=[0-9]))?"
MENTION = rf"(?i)(?<![A-Za-z])(?:{_either({s for s in IDENTITY if len(s) > 1} - NOT_IN_PROSE)})"


def _identity(unit: Column) -> Column:
    return F.try_element_at(F.from_json(F.lit(json.dumps(IDENTITY)), "map<string,string>"), unit_key(unit))


def identity_of(unit: Column) -> Column:
    """The identity of a unit's spelling; null if it isn't known."""
    return _identity(unit)


def _dimension(identity: Column) -> Column:
    return F.substring_index(identity, ":", 1)


def folded(c: Column) -> Column:
    """Wide forms, superscripts and unit signs as plain characters (the part of NFKC that numbers and units need)."""
    out = F.translate(F.coalesce(c, F.lit("")), _WIDE + "¹²³µ　\u00a0", _NARROW + "123μ  ")
    return F.replace(F.replace(out, F.lit("℃"), F.lit("°C")), F.lit("℉"), F.lit("°F"))


def plain(c: Column, join_decimals: bool = False) -> Column:
    """Text for reading quantities: no formula marks, thousands commas or spaces within units; `2. 5` as 2.5 on demand."""
    out = folded(c)
    # fixed values: marks of formulas and what they stand for
    for pattern, by in (
        (r"\^?\{?\\(?:circ|degree)\}?", "°"), (r"\\cdot", "·"), (r"\\times", "×"), (r"\\(?:mathrm|text|textrm|operatorname|mathbf|mbox|rm)\s*", ""),
        (r"\\[,!]", ""), (r"[${}\\]", ""), (r"(?<=[0-9]),(?=[0-9]{3}(?![0-9]))", ""),
    ):
        out = F.regexp_replace(out, pattern, by)
    if join_decimals:
        out = F.regexp_replace(out, r"(?<=[0-9])\.\s+(?=[0-9])", ".")
    return F.regexp_replace(out, r"\s*([·/-])\s*(?=[^0-9\s])", "$1")


def lenient_numbers(c: Column) -> Column:
    """Every number that a text may be read to hold: spaced decimals joined or not, a comma as thousands or as decimal sign."""
    detached = F.regexp_replace(F.coalesce(c, F.lit("")), "([²³])", "^$1 ")
    formulas = F.split(F.replace(detached, F.lit("$$"), F.lit("$")), r"\$")
    joined = F.transform(formulas, lambda x, i: F.when(i % 2 == 1, F.regexp_replace(x, r"(?<=[0-9]) (?=[0-9.])|(?<=\.) (?=[0-9])", "")).otherwise(x))
    text = F.regexp_replace(F.regexp_replace(folded(F.array_join(joined, "$")), r"\\", ""), r"</?[A-Za-z][^<>]*>", " ")
    thousands = F.regexp_replace(text, r"(?<=[0-9]),(?=[0-9]{3}(?![0-9]))", "")
    readings = [thousands, F.regexp_replace(thousands, r"(?<=[0-9])\.\s+(?=[0-9])", "."), F.regexp_replace(text, r"(?<=[0-9]),(?=[0-9])", ".")]
    found = F.flatten(F.array(*[F.regexp_extract_all(r, F.lit(NUMBER), F.lit(0)) for r in readings]))
    return F.array_distinct(F.transform(found, lambda x: F.round(x.cast("double"), 6)))


def quantities(c: Column, join_decimals: bool = False) -> Column:
    """array<struct<num, value, unit, id>> in order; of a range the first number takes the unit of the second."""
    found = F.regexp_extract_all(plain(c, join_decimals), F.lit(QUANTITY), F.lit(0))

    def read(m: Column) -> Column:
        num = F.regexp_extract(m, "^[0-9.]+", 0)
        unit = F.nullif(F.regexp_replace(F.regexp_replace(m, "^[0-9.]+ ?", ""), f"{TO}$", ""), F.lit(""))
        return F.struct(num.alias("num"), unit.alias("unit"), _identity(unit).alias("id"), m.rlike(f"{TO}$").alias("opens"))

    parts = F.transform(found, read)

    def with_unit(p: Column, following: Column) -> Column:
        lends = p["opens"] & p["id"].isNull()
        unit, identity = F.when(lends, following["unit"]).otherwise(p["unit"]), F.when(lends, following["id"]).otherwise(p["id"])
        return F.struct(p["num"].alias("num"), p["num"].cast("double").alias("value"), unit.alias("unit"), identity.alias("id"))

    paired = F.zip_with(parts, F.slice(parts, 2, F.size(parts) + 1), lambda p, q: F.when(p["num"].isNotNull(), with_unit(p, q)))
    return F.filter(paired, lambda p: p.isNotNull())


def mentioned_units(c: Column) -> Column:
    """array<struct<id, unit>> of the units that a text names, with a number or without."""
    free = F.transform(F.regexp_extract_all(plain(c), F.lit(MENTION), F.lit(0)), lambda m: F.struct(_identity(m).alias("id"), unit_key(m).alias("unit")))
    bound = F.transform(quantities(c, True), lambda q: F.struct(q["id"].alias("id"), unit_key(q["unit"]).alias("unit")))
    return F.array_distinct(F.filter(F.concat(free, bound), lambda u: u["id"].isNotNull()))


def rounds_evenly(num: Column, value: Column, exact: Column) -> Column:
    """Whether rounding exact, halves to the even digit, to the decimals of num gives value; the form for answers' numbers."""
    places = F.length(F.regexp_extract(num, r"\.([0-9]+)$", 1))
    scale = F.pow(F.lit(10.0), places)
    return F.abs(F.rint(exact * scale) / scale - value) < F.lit(1e-9)


def rounds_to(num: Column, value: Column, exact: Column) -> Column:
    """Whether value, written as num, is exact rounded to as many decimals."""
    places = F.length(F.regexp_extract(num, r"\.([0-9]+)$", 1))
    return F.abs(exact - value) <= F.lit(0.5) * F.pow(F.lit(10.0), -places) + F.lit(1e-9)


def source(kind: Column, text: Column) -> Column:
    """What grounding needs of a source: kind (`calc`: a tool's result, of which roundings count), numbers, quantities, units, table rows."""
    t = F.regexp_replace(without_citations(F.coalesce(text, F.lit(""))), r"</?manual_text[^<>]*>", " ")
    lines = F.filter(F.split(t, "\n"), lambda x: F.contains(x, F.lit("|")))
    rows = F.transform(lines, lambda x: F.struct(lenient_numbers(x).alias("numbers"), mentioned_units(x).alias("units")))
    return F.struct(kind.alias("kind"), lenient_numbers(t).alias("numbers"), quantities(t, True).alias("found"), mentioned_units(t).alias("units"), rows.alias("rows"))


def _supports(q: Column, s: Column) -> Column:
    """True: the source bears the quantity out; false: it has the number with another unit; null: it says nothing."""
    value, dim = F.round(q["value"], 6), _dimension(q["id"])
    equal = lambda c: F.abs(c["value"] - q["value"]) < 1e-9
    computed = F.exists(s["found"], lambda c: (equal(c) | rounds_evenly(q["num"], q["value"], c["value"])) & F.coalesce(c["id"] == q["id"], F.lit(True)))
    alike = F.filter(s["found"], lambda c: equal(c) & F.coalesce(_dimension(c["id"]) == dim, F.lit(False)))
    row_units = F.flatten(F.transform(F.filter(s["rows"], lambda r: F.array_contains(r["numbers"], value)), lambda r: r["units"]))
    pieces = F.split(unit_key(q["unit"]), r"[·/.\-]")
    named = F.filter(s["units"], lambda u: _dimension(u["id"]) == dim)
    by_row = F.exists(row_units, lambda u: (u["id"] == q["id"]) | F.array_contains(pieces, u["unit"]))
    by_name = (F.size(named) == 0) | F.exists(named, lambda u: u["id"] == q["id"])
    by_number = F.exists(alike, lambda c: c["id"] == q["id"])
    unit_fits = F.when(F.size(alike) > 0, by_number).when(F.size(row_units) > 0, by_row).otherwise(by_name)
    return F.when((s["kind"] == "calc") & computed, True).when(F.array_contains(s["numbers"], value), q["id"].isNull() | unit_fits)


def ground(q: Column, sources: Column) -> Column:
    """ok, unit_mismatch or no_source: one source that bears it out suffices."""
    opinions = F.transform(sources, lambda s: _supports(q, s))
    return F.when(F.array_contains(F.array_compact(opinions), True), "ok").when(F.array_contains(F.array_compact(opinions), False), "unit_mismatch").otherwise("no_source")


def checked(answers: DataFrame, key: str, answer: str, sources: str) -> DataFrame:
    """key, n (quantities checked) and issues (sentence, quantity, status); sources is array<struct<kind, text>>.

    Citations, list marks, ordinals, years and whole numbers below 10 without a unit aren't checked. Null
    answers have none; without sources every quantity lacks one.
    """
    text = F.regexp_replace(F.regexp_replace(without_citations(F.coalesce(F.col(answer), F.lit(""))), LIST_MARK, ""), ORDINAL, " ")
    counted = lambda q: q["id"].isNotNull() | F.contains(q["num"], F.lit(".")) | (q["value"] >= 10)
    sentences = F.filter(F.transform(F.split(text, SENTENCE), F.trim), lambda s: s != "")
    asked = F.flatten(F.transform(sentences, lambda s: F.transform(F.filter(quantities(s), counted), lambda q: F.struct(s.alias("sentence"), q.alias("q")))))
    none = F.array().cast("array<struct<kind:string,text:string>>")
    read = F.transform(F.coalesce(F.col(sources), none), lambda s: source(s["kind"], s["text"]))
    shown = lambda q: F.concat_ws(" ", q["num"], q["unit"])

    def findings(ready: Column) -> Column:
        return F.transform(asked, lambda a: F.struct(F.substring(a["sentence"], 1, 120).alias("sentence"), shown(a["q"]).alias("quantity"), ground(a["q"], ready).alias("status")))

    # a list of one, so that the sources are read once for all quantities
    found = answers.select(key, F.element_at(F.transform(F.array(read), findings), 1).alias("all"))
    return found.select(key, F.size("all").alias("n"), F.filter("all", lambda f: f["status"] != "ok").alias("issues"))


def untraced(answer: Column, pool: Column) -> Column:
    """Numbers of an answer (as written) that are not in the pool (array<double>); decimals may be roundings of its numbers."""
    nums = F.array_distinct(F.regexp_extract_all(plain(without_citations(answer)), F.lit(NUMBER), F.lit(0)))
    rounded = lambda n: F.contains(n, F.lit(".")) & F.exists(pool, lambda p: rounds_to(n, n.cast("double"), p))
    return F.filter(nums, lambda n: ~(F.array_contains(pool, F.round(n.cast("double"), 6)) | rounded(n)))


def answer_numbers(answer: Column) -> Column:
    """The distinct numbers of an answer as written, without citations and list marks."""
    return F.array_distinct(F.regexp_extract_all(plain(F.regexp_replace(without_citations(F.coalesce(answer, F.lit(""))), LIST_MARK, "")), F.lit(NUMBER), F.lit(0)))


_BINARY = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.Pow: operator.pow}


def calculated_value(text: str | None) -> float | None:
    """The value of numbers joined by + - * / ** and brackets; null for anything else, and for what has no finite value."""

    def value(n: ast.expr) -> float:
        if isinstance(n, ast.BinOp) and type(n.op) in _BINARY:
            return _BINARY[type(n.op)](value(n.left), value(n.right))
        if isinstance(n, ast.UnaryOp) and isinstance(n.op, ast.USub):
            return -value(n.operand)
        if isinstance(n, ast.Constant) and type(n.value) in (int, float):
            return float(n.value)
        raise ValueError(text)

    try:
        out = value(ast.parse((text or "").replace("×", "*").replace("÷", "/").strip(), mode="eval").body)
        return float(out) if isinstance(out, float) and abs(out) < float("inf") else None
    except (SyntaxError, ValueError, ArithmeticError, RecursionError):
        return None


@F.pandas_udf(DoubleType())
def calculated(s: pd.Series) -> pd.Series:
    return s.map(calculated_value).astype("float64")
