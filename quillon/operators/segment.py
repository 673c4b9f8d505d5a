"""Words of text without spaces: a dictionary learned from the corpus, and the best path through it.

Candidates are the short substrings of Han runs that are frequent, have varied neighbours on both sides and are seen more often than their parts would meet by chance. In each
round every run is cut along its most probable path, and the words that came out, counted, are
the next round's weights. Runs are counted once and only counts are shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import cached_property

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.text import HAN
from quillon.storage import stored

#: Letters of the longest word, least count, variety of neighbours and times that its parts meet more often than by chance, words of two letters or more that a dictionary holds at most (the most frequent), rounds.
LONGEST, LEAST, VARIETY, BOUND, MOST, ROUNDS = 4, 5, 3, 8, 200_000, 3


class Words:
    """A prefix dictionary: each word's log-probability, and each beginning of a word as None. Letters that are no word cost as if half seen."""

    def __init__(self, counts: dict[str, int]):
        self.counts = counts

    @cached_property
    def weights(self) -> dict[str, float | None]:
        total = sum(self.counts.values()) or 1
        out: dict[str, float | None] = {}
        for word, n in self.counts.items():
            for k in range(1, len(word)):
                out.setdefault(word[:k], None)
            out[word] = math.log(n / total)
        return out

    @cached_property
    def unseen(self) -> float:
        return math.log(0.5 / (sum(self.counts.values()) or 1))

    def __getstate__(self) -> dict:
        return {"counts": self.counts}

    def cut(self, run: str) -> list[str]:
        """The run's words on its most probable path; of equal ones, that which begins with the longer word."""
        weights, n = self.weights, len(run)
        best, step = [0.0] * (n + 1), [1] * n
        for i in range(n - 1, -1, -1):
            found = None
            for j in range(i + 1, n + 1):
                word = run[i:j]
                own = weights.get(word, self)
                if own is self and j > i + 1:
                    break
                if own is None or own is self:
                    own = self.unseen if j == i + 1 else None
                if own is not None and (found is None or own + best[j] >= found):
                    found, step[i] = own + best[j], j - i
            best[i] = found
        out, i = [], 0
        while i < n:
            out.append(run[i : i + step[i]])
            i += step[i]
        return out


def runs_of(texts: DataFrame, text: str) -> DataFrame:
    """run, n: the distinct Han runs of all texts and how often each stands there."""
    held = texts.where(F.col(text).rlike(HAN)).select(F.explode(F.regexp_extract_all(F.col(text), F.lit(HAN), F.lit(0))).alias("run"))
    return stored(held.groupBy("run").agg(F.count(F.lit(1)).alias("n")))


def candidates(runs: DataFrame, longest: int = LONGEST, least: int = LEAST, variety: int = VARIETY, bound: float = BOUND) -> DataFrame:
    """word, count: substrings of two to `longest` letters, seen `least` times, with `variety` kinds of neighbours on either side, and `bound` times as often as any two parts of it would meet by chance; a run's end counts as another kind each time."""
    at = runs.select("run", F.explode(F.sequence(F.lit(1), F.length("run"))).alias("i"), "n").withColumn("size", F.explode(F.array(*[F.lit(k) for k in range(1, longest + 1)])))
    at = at.where(F.col("i") + F.col("size") - 1 <= F.length("run"))
    left = F.when(F.col("i") > 1, F.substring("run", F.col("i") - 1, F.lit(1))).otherwise("")
    seen = at.groupBy(F.substring("run", F.col("i"), F.col("size")).alias("word"), left.alias("left"), F.substring("run", F.col("i") + F.col("size"), F.lit(1)).alias("right")).agg(F.sum("n").alias("n"))
    kinds = [(F.size(F.collect_set(F.nullif(F.col(c), F.lit("")))) + F.sum(F.when(F.col(c) == "", F.col("n")).otherwise(0))).alias(c) for c in ("left", "right")]
    counts = stored(seen.groupBy("word").agg(F.sum("n").alias("count"), *kinds).where(F.col("count") >= least))
    letters = runs.agg(F.sum(F.length("run") * F.col("n"))).first()[0] or 0
    cuts = counts.where((F.length("word") > 1) & (F.least("left", "right") >= variety)).select("word", "count", F.explode(F.sequence(F.lit(1), F.length("word") - 1)).alias("k"))
    cuts = cuts.select("word", "count", F.substring("word", F.lit(1), F.col("k")).alias("head"), F.substring("word", F.col("k") + 1, F.lit(longest)).alias("tail"))
    part = lambda c: counts.select(F.col("word").alias(c), F.col("count").alias(f"{c}s"))
    met = cuts.join(part("head"), "head").join(part("tail"), "tail")
    ratio = F.col("count") * F.lit(float(letters)) / (F.col("heads").cast("double") * F.col("tails"))
    return met.groupBy("word", "count").agg(F.min(ratio).alias("ratio")).where(F.col("ratio") >= bound).select("word", "count")


def learned(texts: DataFrame, text: str, longest: int = LONGEST, least: int = LEAST, variety: int = VARIETY, bound: float = BOUND, most: int = MOST, rounds: int = ROUNDS) -> DataFrame:
    """word, count: the dictionary of a column of texts (null: none); empty where no text has Han characters.

    Of the candidates the `most` frequent take part, ties by code point, beside every single letter. Each round leaves the words
    that the cuts used and their counts. The driver hands the dictionary, bounded by `most` and the letters that there are, to the tasks.
    """
    runs = runs_of(texts, text)
    letters = runs.select(F.explode(F.split("run", "")).alias("word"), "n").where("word <> ''").groupBy("word").agg(F.sum("n").alias("count"))
    words = stored(candidates(runs, longest, least, variety, bound).orderBy(F.desc("count"), "word").limit(most).unionByName(letters))
    for _ in range(rounds):
        held = Words({r.word: r["count"] for r in words.collect()})

        def cut(batches: Iterator[pd.DataFrame], held: Words = held) -> Iterator[pd.DataFrame]:
            for b in batches:
                found = [(w, n) for run, n in zip(b["run"], b["n"], strict=True) for w in held.cut(run)]
                yield pd.DataFrame(found, columns=["word", "n"])

        words = stored(runs.mapInPandas(cut, "word string, n long").groupBy("word").agg(F.sum("n").alias("count")))
    return words


def cutter(dictionary: DataFrame) -> Callable[[Column], Column]:
    """For terms: an array of runs of letters with each run of Han characters cut into its words by the dictionary (word, count); null for null."""
    held = Words({r["word"]: r["count"] for r in dictionary.collect()})

    @F.pandas_udf("array<string>")
    def cut(lists: pd.Series) -> pd.Series:
        return lists.map(lambda runs: [w for run in runs for w in (held.cut(run) if is_han(run[0]) else [run])], na_action="ignore")

    return cut


# Where Unicode has characters of the Han script.
HAN_RANGES = (
    (0x2E80, 0x2E99), (0x2E9B, 0x2EF3), (0x2F00, 0x2FD5), (0x3005, 0x3005), (0x3007, 0x3007), (0x3021, 0x3029), (0x3038, 0x303B),
    (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFA6D), (0xFA70, 0xFAD9), (0x16FE2, 0x16FE3), (0x16FF0, 0x16FF1), (0x20000, 0x323AF),
)


def is_han(c: str) -> bool:
    return any(a <= ord(c) <= b for a, b in HAN_RANGES)
