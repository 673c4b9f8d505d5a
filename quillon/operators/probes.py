"""Perturbed answers, by which it is tested what a check notices."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quillon.functions.text import CHUNK_ID
from quillon.operators.units import UNITS

# Fixed value: a number that may be changed: no part of a word, model or longer number, and no list's own.
LOOSE_NUMBER = re.compile(r"(?<![\d.A-Za-z_#])\d+(?:\.\d+)?(?![\d]|\.\d)(?!\s*[.)）、])")
#: Words and what they are swapped for, both ways.
ANTONYMS = (("顺时针", "逆时针"), ("打开", "关闭"), ("增大", "减小"), ("高于", "低于"), ("拧紧", "松开"), ("open", "close"), ("increase", "decrease"), ("above", "below"))
#: For each dimension, spellings that a unit is swapped for: the first that differs.
SWAPS = {d: list(us)[:1] + [u for u in us if u.isascii()][1:3] for d, us in UNITS.items() if d != "share"}


def _first(c: Column, pattern: str) -> tuple[Column, Column, Column]:
    """Text before the first match, the match, and the text behind it; the match is empty if there is none."""
    hit = F.regexp_extract(c, pattern, 0)
    at = F.when(hit == "", 0).otherwise(F.length(F.split(c, pattern, 2)[0]))
    return F.substring(c, F.lit(1), at), hit, F.substring(c, at + F.length(hit) + 1, F.length(c))


def changed_number(text: str, allowed: set[float]) -> str | None:
    """The text with its first number that can be changed into one that is not allowed: twice as large, 7 more, three times, 13 more or five times and 1, with as many decimals."""
    for m in LOOSE_NUMBER.finditer(text):
        old, places = float(m[0]), len(m[0].partition(".")[2])
        for value in (old * 2, old + 7, old * 3, old + 13, old * 5 + 1):
            new = f"{value:.{places}f}"
            if float(new) != old and round(float(new), 6) not in allowed:
                return text[: m.start()] + new + text[m.end() :]
    return None


@F.pandas_udf(StringType())
def number_changed(texts: pd.Series, allowed: pd.Series) -> pd.Series:
    """changed_number of each text (null: null); `allowed` are the numbers of the question and the evidence, null if there are none."""
    return pd.Series([None if t is None else changed_number(t, {round(float(x), 6) for x in (a if a is not None else ()) if x is not None}) for t, a in zip(texts, allowed, strict=True)], dtype="object")


def unit_swapped(c: Column) -> Column:
    """The first unit behind a number replaced by another of its dimension; null without any."""
    out = F.lit(None).cast("string")
    for others in SWAPS.values():
        for u in others:
            other = next((x for x in others if x != u), None)
            if other:
                before, hit, after = _first(c, rf"(?i)(?<=[0-9] ?)\Q{u}\E(?![A-Za-z0-9·/])")
                out = F.coalesce(out, F.when(hit != "", F.concat(before, F.lit(other), after)))
    return out


def antonym_swapped(c: Column) -> Column:
    """The first known word that occurs, by the list's order, replaced by its opposite; null without any."""
    out = F.lit(None).cast("string")
    for a, b in ANTONYMS:
        for x, y in ((a, b), (b, a)):
            before, hit, after = _first(c, rf"\Q{x}\E")
            out = F.coalesce(out, F.when(hit != "", F.concat(before, F.lit(y), after)))
    return out


def sentence_added(c: Column, sentence: str) -> Column:
    """A sentence that no source has, at the end and with the answer's last citation, if any."""
    last = F.try_element_at(F.regexp_extract_all(c, F.lit(CHUNK_ID), F.lit(0)), F.lit(-1))
    return F.concat(c, F.lit(sentence), F.coalesce(F.concat(F.lit("["), last, F.lit("]")), F.lit("")), F.lit("。"))


def perturbed(c: Column, sentence: str, allowed: Column | None = None) -> Column:
    """array<struct<kind, text>> of all perturbations that apply; a changed number is none of `allowed`."""
    known = F.array().cast("array<double>") if allowed is None else allowed
    made = {"number": number_changed(c, known), "unit": unit_swapped(c), "antonym": antonym_swapped(c), "fabricated": sentence_added(c, sentence)}
    return F.filter(F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("text")) for k, v in made.items()]), lambda p: p["text"].isNotNull())
