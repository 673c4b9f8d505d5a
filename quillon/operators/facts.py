"""Key facts of an evaluation set as patterns: macros are expanded on the driver, matching is columns."""

from __future__ import annotations

import re
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.operators.grounding import lenient_numbers

# What the macros without a number stand for.
MACROS = {"mm": "(?:mm|毫米)", "C": "(?:°c|摄氏度|度)", "F": "(?:°f|华氏度)", "in": '(?:英寸|")', "to": "(?:~|-|至|到)"}
MACRO = re.compile(r"\{(?:n:(?P<number>[0-9][0-9.,/]*)|(?P<name>mm|C|F|in|to))\}")


# The shape of a number alone, which decides what matches.
def number_pattern(number: str) -> str:
    """Matches the number alone: not within a longer one, with or without thousands commas and zeros at the end."""
    if "/" in number:
        return rf"(?<![0-9./]){re.escape(number)}(?![0-9/])"
    whole, _, rest = format(Decimal(number.replace(",", "")), "f").partition(".")
    rest = rest.rstrip("0")
    grouped = f"{int(whole):,}".replace(",", ",?")
    return rf"(?<![0-9.]){grouped}{rf'\.{rest}0*' if rest else r'(?:\.0+)?'}(?![0-9]|\.[0-9])"


def expanded(pattern: str) -> str:
    """The pattern as a regular expression that ignores case; other braces stay as they are."""
    return "(?i)" + MACRO.sub(lambda m: number_pattern(m["number"]) if m["number"] else MACROS[m["name"]], pattern)


def declared(pattern: str) -> list[str]:
    """The numbers that a pattern names."""
    return [m["number"] for m in MACRO.finditer(pattern) if m["number"]]


def matches(text: Column, patterns: Column) -> Column:
    """Whether any of the expanded patterns (array<string>) is found in text, which is normalised already; null text: no."""
    return F.coalesce(F.exists(patterns, lambda p: F.rlike(text, p)), F.lit(False))


def numbers_grounded(evidence: Column, numbers: Column) -> Column:
    """Whether all numbers of some pattern (array<array<string>>, as declared) are in the evidence; fractions by their text."""
    pool = lenient_numbers(evidence)
    value = lambda n: F.round(F.replace(n, F.lit(","), F.lit("")).try_cast("double"), 6)
    known = lambda n: F.when(F.contains(n, F.lit("/")), F.contains(evidence, n)).otherwise(F.array_contains(pool, F.coalesce(value(n), F.lit(-1.0))))
    return F.coalesce(F.exists(numbers, lambda ns: F.forall(ns, known)), F.lit(False))
