"""Which of many patterns stand in which texts, by automata of bounded size that each text passes once."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.storage import stored

#: Characters of the patterns that one automaton holds, unless one pattern is longer.
CHARS = 1_000_000


class Automaton:
    """found(text): the numbers of the patterns that a text holds, each once.

    The work is the pyahocorasick library's; where that is not installed, each length's stretches of the text are looked up instead.
    """

    def __init__(self, patterns: Iterable[tuple[str, int]]):
        try:
            import ahocorasick
        except ImportError:
            ahocorasick = None
        self.machine, self.by_length = None, {}
        held = list(patterns)
        if ahocorasick is None:
            for p, i in held:
                self.by_length.setdefault(len(p), {})[p] = i
        elif held:
            self.machine = ahocorasick.Automaton()
            for p, i in held:
                self.machine.add_word(p, i)
            self.machine.make_automaton()

    def found(self, text: str) -> set[int]:
        if self.machine is not None:
            return {i for _, i in self.machine.iter(text)}
        return {held[text[k : k + n]] for n, held in self.by_length.items() for k in range(len(text) - n + 1) if text[k : k + n] in held}


def matches(texts: DataFrame, key: str, text: str, patterns: DataFrame, pattern: str, chars: int = CHARS) -> DataFrame:
    """key and pattern, as they are named, of each text that holds a pattern as it stands, each once for a row of texts.

    Null texts hold nothing, null and empty patterns stand nowhere, repeated patterns are one. Patterns are dealt by hash into
    parts of about `chars` characters, so that no automaton and no broadcast grows with their number; each part goes over all texts, without
    a shuffle or a pair that is no hit.
    """
    p = stored(patterns.select(F.col(pattern).cast("string").alias("p")).where("p <> ''").distinct())
    parts = max(1, -(-(p.agg(F.sum(F.length("p"))).first()[0] or 0) // chars))
    p = p.withColumn("part", F.pmod(F.xxhash64("p"), F.lit(parts)))
    t = texts.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")).where("t is not null")
    kind, out = t.schema["k"].dataType.simpleString(), None
    context = texts.sparkSession.sparkContext
    for part in range(parts):
        shared = context.broadcast([r.p for r in p.where(F.col("part") == part).collect()])  # about `chars` characters

        def run(batches: Iterator[pa.RecordBatch], shared: object = shared) -> Iterator[pa.RecordBatch]:
            held = shared.value
            machine = Automaton(zip(held, range(len(held)), strict=True))
            for b in batches:
                rows, hits = [], []
                for i, x in enumerate(b["t"].to_pylist()):
                    found = sorted(machine.found(x))
                    rows += [i] * len(found)
                    hits += [held[j] for j in found]
                if rows:
                    yield pa.RecordBatch.from_arrays([b["k"].take(pa.array(rows)), pa.array(hits, pa.string())], names=["k", "p"])

        one = t.mapInArrow(run, f"k {kind}, p string")
        out = one if out is None else out.unionByName(one)
    return out.select(F.col("k").alias(key), F.col("p").alias(pattern))
