"""Which texts hold which quotes, without pairing every text with every quote."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions.text import match_text
from quillon.operators.patterns import matches
from quillon.storage import stored

#: Letters of a gram, and grams of a stretch: every quote of GRAM + STRETCH - 1 letters holds a stretch.
GRAM, STRETCH = 16, 16
#: Bits of the broadcast table of quotes' keys, whatever their number (2 MB).
BITS = 1 << 24


def stretch_keys(text: str) -> np.ndarray:
    """The least gram hash of each stretch of a text, in order."""
    c = np.frombuffer(text.encode("utf-32-le"), dtype="<u4").astype(np.uint64)
    n = len(c) - GRAM + 1
    if n < STRETCH:
        return np.zeros(0, dtype=np.uint64)
    h = np.zeros(n, dtype=np.uint64)
    for k in range(GRAM):
        h = h * np.uint64(0x9E3779B97F4A7C15) + c[k : k + n]
    h ^= h >> np.uint64(29)
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    width = 1
    while width < STRETCH:
        step = min(width, STRETCH - width)
        h = np.minimum(h[: len(h) - step], h[step:])
        width += step
    return h


def contained(texts: DataFrame, key: str, text: str, quotes: DataFrame, quote_key: str, quote: str) -> DataFrame:
    """key, quote_key of every text that holds a whole quote, both normalised (case, dashes, white space and tags aside).

    A quote's first stretch gives its key; a text that holds the quote has that stretch, and so the key. Texts are
    cut into stretches once and only keys that a fixed-size table of the quotes' keys lets pass are joined, without their texts; then each text
    meets, once, the quotes whose keys it shares. Quotes shorter than a stretch go through an automaton. Empty quotes are held by none.
    """
    t = texts.select(F.col(key).alias("key"), match_text(F.col(text)).alias("text")).where(F.col("text").isNotNull())
    q = quotes.select(F.col(quote_key).alias("quote_key"), match_text(F.col(quote)).alias("quote")).where(F.col("quote") != "")
    least = GRAM + STRETCH - 1

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [int(stretch_keys(x[:least])[0].astype(np.int64)) for x in b["quote"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["quote_key"], b["quote"], pa.array(made, pa.int64())], names=["quote_key", "quote", "stretch"])

    keyed = stored(q.where(F.length("quote") >= least).mapInArrow(first, f"quote_key {dict(q.dtypes)['quote_key']}, quote string, stretch long"))
    slot = F.pmod("stretch", F.lit(BITS))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (slot % 32).cast("int"))
    filled = keyed.groupBy(F.floor(slot / 32).cast("int").alias("word")).agg(F.bit_or(bit).alias("bits")).toPandas()  # at most BITS / 32 rows
    table = np.zeros(BITS // 32, dtype=np.uint32)
    table[filled["word"].to_numpy(dtype=np.int64)] = filled["bits"].to_numpy(dtype=np.int64).astype(np.uint32)
    shared = texts.sparkSession.sparkContext.broadcast(table)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, keys = [], []
            for i, x in enumerate(b["text"].to_pylist()):
                h = np.unique(stretch_keys(x)).view(np.int64)
                at = np.mod(h, BITS)
                h = h[((shared.value[at // 32] >> (at % 32).astype(np.uint32)) & np.uint32(1)).astype(bool)]
                rows.append(np.full(len(h), i))
                keys.append(h)
            if rows:
                yield pa.RecordBatch.from_arrays([b["key"].take(pa.array(np.concatenate(rows).astype(np.int64))), pa.array(np.concatenate(keys))], names=["key", "stretch"])

    kind = dict(t.dtypes)["key"]
    met = t.mapInArrow(cut, f"key {kind}, stretch long").join(keyed, "stretch").groupBy("key").agg(F.collect_set(F.struct("quote_key", "quote")).alias("q"))
    held = t.join(stored(met), "key").select("key", F.explode(F.filter("q", lambda x: F.contains(F.col("text"), x["quote"]))).alias("x")).select("key", "x.quote_key")
    small = q.where(F.length("quote") < least)
    short = matches(t, "key", "text", small, "quote").join(small, "quote").select("key", "quote_key")
    return held.union(short).distinct().select(F.col("key").alias(key), F.col("quote_key").alias(quote_key))
