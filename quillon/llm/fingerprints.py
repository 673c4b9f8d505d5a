"""Document fingerprints: a quartile bucket digest.

Byte triplets of a five-byte sliding window are hashed into 128 buckets and counted. Each
bucket's count is encoded as two bits by the quartile it falls in; the head holds the
length on a logarithmic scale and the ratios of the quartiles. Two digests differ by a
bounded score: bucket steps, plus the differences of the head.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import documents, in_ranges, ready, stored

BUCKETS = 128
#: Offsets of the triplets in the window, each hashed with a multiplier of its own.
TRIPLETS = ((0, 1, 2), (0, 1, 3), (0, 2, 3), (0, 2, 4), (0, 1, 4), (0, 3, 4))
_MULTIPLIERS = (2654435761, 2246822519, 3266489917, 668265263, 374761393, 2869860233)
#: The score at which two digests have nothing in common: about what unrelated texts of one kind reach.
FAR = 240.0
EMPTY = "0" * (2 * (2 + BUCKETS // 4))


def digest(data: bytes) -> str:
    """Hex: length step (8 bits), quartile ratios (4 + 4 bits), two bits a bucket. Under three bytes: by length and bytes alone.

    The empty text has the digest of zeros.
    """
    if not data:
        return EMPTY
    b = np.frombuffer(data if len(data) > 4 else data + bytes(5 - len(data)), dtype=np.uint8).astype(np.uint32)
    n = len(b) - 4
    counts = np.zeros(BUCKETS, dtype=np.int64)
    for (i, j, k), m in zip(TRIPLETS, _MULTIPLIERS, strict=True):
        code = b[i : i + n] | (b[j : j + n] << np.uint32(8)) | (b[k : k + n] << np.uint32(16))
        counts += np.bincount((code * np.uint32(m)) >> np.uint32(25), minlength=BUCKETS)
    q1, q2, q3 = np.sort(counts)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    codes = (counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)
    ratio = lambda a: int(a * 100 // q3) % 16 if q3 else 0
    step = min(255, int(np.log(len(data)) / np.log(1.1)))
    head = struct.pack("<BB", step, ratio(q1) << 4 | ratio(q2))
    four = codes.reshape(-1, 4)
    return (head + (four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6).astype(np.uint8).tobytes()).hex()


_STEPS = np.array([[abs((x >> s & 3) - (y >> s & 3)) for s in (0, 2, 4, 6)] for x in range(256) for y in range(256)], dtype=np.int64)
#: Cost of the bucket bytes: a step costs 1, two 2, three (from the lowest quarter to the highest) 6.
_COST = np.where(_STEPS == 3, 6, _STEPS).sum(axis=1)


def difference(a: str, b: str) -> int:
    """0 for equal digests; at most 6 a bucket, 24 for length and 12 for each ratio."""
    x, y = bytes.fromhex(a), bytes.fromhex(b)
    if (a == EMPTY) != (b == EMPTY):
        return 6 * BUCKETS + 48
    circle = lambda p, q: min((p - q) % 16, (q - p) % 16)
    head = min(24, abs(x[0] - y[0])) + min(12, circle(x[1] >> 4, y[1] >> 4)) + min(12, circle(x[1] & 15, y[1] & 15))
    rows = np.frombuffer(x[2:], dtype=np.uint8).astype(np.int64) * 256 + np.frombuffer(y[2:], dtype=np.uint8)
    return int(head + _COST[rows].sum())


def likeness(a: str, b: str) -> float:
    """1 for equal digests, falling with their difference to 0."""
    return max(0.0, 1.0 - difference(a, b) / FAR)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of every row of docs (doc_id, text); null text is empty, very long ones are read whole, repeated rows are rows; other columns, of any name, are not read. One pass, no shuffle."""
    ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [digest((t or "").encode()) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(made, pa.string())], names=["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fingerprint string")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint beside that of its edited text and of the next document.

    The edited text ends with the first floor(n/4) code points (or all) of the next document in
    place of its own last ones; after the last document comes the first, so a lone document is
    its own next. Documents are ordered by doc_id, null first, rows that share an id by text; null text is empty, very long texts
    are whole, repeated rows are documents of their own, an empty table gives no rows; other columns, of any name, are not read.

    Rows are dealt by ranges and sorted, texts moved once. A part's last document meets the next part's first
    in a second step, for which each part stores these two texts.
    """
    ready(docs.sparkSession)
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    edges, edge_types = ["part", "first_text", "last_text"], [pa.int32(), pa.string(), pa.string()]
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def beside(doc: int | None, text: str, own: str, following: str, its: str) -> tuple:
        k = len(text) // 4
        edited = (text[: len(text) - k] + following[:k]).encode()
        e = digest(edited)
        return (doc, len(text), hashlib.sha256(edited).hexdigest(), own, e, likeness(own, e), likeness(own, its))

    def made(rows: list[tuple], *edge: object) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
        fixed = [pa.array([x] * len(rows), t) for x, t in zip(edge or (None, None, None), edge_types, strict=True)]
        return pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(columns, types, strict=True)), *fixed], names=[*names, *edges])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first, held = None, None
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                own = digest(text.encode())
                if held is None:
                    first = text
                else:
                    rows.append(beside(*held, text, own))
                held = doc, text, own
            yield made(rows)
        if held is not None:
            doc, text, own = held
            yield made([(doc, len(text), None, own, None, None, None)], TaskContext.get().partitionId(), first, text)

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = zip(*(b[c].to_pylist() for c in ("doc_id", "last_text", "fingerprint", "following")), strict=True)
            columns = list(zip(*(beside(doc, text, own, f, digest(f.encode())) for doc, text, own, f in found), strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    d = in_ranges(docs.withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit(""))))
    done = stored(d.mapInArrow(run, f"{schema}, part int, first_text string, last_text string"))
    ends = done.where(F.col("part").isNotNull())
    every = Window.orderBy("part")  # a number for each part
    after = ends.select(F.col("part").alias("at"), F.coalesce(F.lead("part").over(every), F.min("part").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("then"))
    firsts = ends.select(F.col("part").alias("then"), F.col("first_text").alias("following"))
    last = ends.join(after, F.col("part") == F.col("at")).join(firsts, "then").select("doc_id", "last_text", "fingerprint", "following").mapInArrow(close, schema)
    return done.where(F.col("part").isNull()).select(*names).union(last)


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents; nulls, empty and long texts, ties and repeated rows as in edited_fingerprints."""
    return edited_fingerprints(documents(spark, sf_dir))
