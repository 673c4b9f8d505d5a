"""Packing documents into windows by Karmarkar-Karp multiway differencing.

A document's ids are cut every `window` ids: whole windows stand alone, the rest of each
document is cut into short pieces, which pack more evenly than long ones. Pieces are dealt to groups of bounded size by hash; in a group, the
two partial partitions with the largest spread are merged with opposing imbalances until
one is left, whose windows are nearly equal. Where one exceeds the capacity, the window
count rises and the group is merged anew.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, lean, ready, stored, tidied
from .records import END_ID, NULL_ID, vocabulary
from .tokens import encoder

WINDOW = 2048
#: The longest piece of what whole windows leave of a document.
PIECE = 512
#: Pieces that a group has on average.
GROUP = 1536
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def differencing(lengths: list[int], windows: int) -> np.ndarray:
    """The window (0 to windows - 1) of each length; the largest windows come first."""
    n = len(lengths)
    if windows <= 1 or n == 0:
        return np.zeros(n, dtype=np.int64)
    sums = [np.concatenate([[x], np.zeros(windows - 1, dtype=np.int64)]) for x in lengths]
    made: list[tuple[int, int, np.ndarray]] = []
    heap = [(-int(s[0]), i) for i, s in enumerate(sums)]
    heapq.heapify(heap)
    while len(heap) > 1:
        (_, a), (_, b) = heapq.heappop(heap), heapq.heappop(heap)
        joined = sums[a] + sums[b][::-1]
        order = np.argsort(-joined, kind="stable")
        joined = joined[order]
        sums[a] = sums[b] = None  # type: ignore[call-overload]
        made.append((a, b, order))
        sums.append(joined - joined[-1])
        heapq.heappush(heap, (-int(sums[-1][0]), n + len(made) - 1))
    # from the root down: `at[node][place]` is the window of what stands at that place
    at: dict[int, np.ndarray] = {n + len(made) - 1: np.arange(windows)} if made else {0: np.arange(windows)}
    for k in range(len(made) - 1, -1, -1):
        a, b, order = made[k]
        placed = np.empty(windows, dtype=np.int64)
        placed[order] = at.pop(n + k)
        at[a], at[b] = placed, placed[::-1]
    return np.array([at[i][0] for i in range(n)])


def packed(lengths: list[int], window: int) -> np.ndarray:
    """The window of each length, none above `window` in sum."""
    total = int(sum(lengths))
    windows = max(1, -(-total // window))
    while True:
        found = differencing(lengths, windows)
        if total <= window or np.bincount(found, weights=lengths, minlength=windows).max() <= window:
            return found
        windows += 1


def token_pieces(docs: DataFrame, window: int = WINDOW, piece: int = PIECE, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Each document's ids and the end id, cut every `window` ids and the rest every `piece`. Null text is empty: the end id alone."""
    path = tokenizer or vocabulary()
    ready(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            rows: list[tuple] = []
            for doc, ids in zip(batch["doc_id"].to_pylist(), encode.encode(batch["text"].to_pylist()), strict=True):
                wide = np.append(np.frombuffer(ids, dtype=encode.dtype).astype("<u4"), np.uint32(end_id))
                whole = len(wide) // window * window
                for s, e in [*((s, s + window) for s in range(0, whole, window)), *((s, s + piece) for s in range(whole, len(wide), piece))]:
                    own = wide[s:e]
                    rows.append((doc, s, len(own), zlib.crc32(own.tobytes()), len(wide)))
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidied(cut), PIECES)


def pack(docs: DataFrame, window: int = WINDOW, piece: int = PIECE, group: int = GROUP, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """A row for each piece of docs (doc_id, text) with its sequence and offset there.

    Null and empty texts have the end id alone, very long ones are cut; pieces of one length and id go by their checksum and row.
    Every document has one id at least (the end id); repeated rows are documents of their own; an
    empty table gives no rows; other columns are not read. Pieces are rows of a few numbers, stored
    once, so nothing is tokenised twice; groups are of about `group` pieces whatever the input's size
    or order, by a hash of the piece.
    """
    pieces = stored(token_pieces(docs, window, piece, tokenizer, end_id).withColumn("_row", F.monotonically_increasing_id()))
    count = pieces.where(F.col("length") < window).count()
    groups = max(1, round(count / group))
    here = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "_row"), F.lit(groups)).cast("long")
    rest = pieces.where(F.col("length") < window).withColumn("group", here)
    rest = rest.withColumn("doc_id", F.coalesce("doc_id", F.lit(NULL_ID)))  # pandas has no null among integers

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        lean()
        rows = rows.sort_values(["length", "doc_id", "start", "ids_crc32", "_row"], ascending=[False, True, True, True, True], ignore_index=True)
        rows["_window"] = packed(rows["length"].tolist(), window)
        rows = rows.sort_values(["_window"], kind="stable", ignore_index=True)
        rows["offset"] = rows.groupby("_window")["length"].cumsum() - rows["length"]
        rows["sequence_id"] = rows["group"] * (1 << 20) + rows["_window"]
        return rows[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]]

    schema = f"{PIECES}, sequence_id long, offset long"
    shared = rest.groupBy("group").applyInPandas(solve, schema)
    shared = shared.withColumn("doc_id", F.nullif("doc_id", F.lit(NULL_ID)))
    whole = pieces.where(F.col("length") == window)
    # whole windows: numbers of their own above those of the groups
    whole = whole.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.lit(1 << 62) + F.col("_row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return shared.unionByName(whole)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed; nulls, empty and long texts, ties and repeated rows as in pack."""
    return pack(documents(spark, sf_dir))
