"""Removal of long byte strings that occur more than once, by prefix-free parsing.

A rolling hash of 16 bytes triggers a phrase at the least value of any 128 in a row, so every
400-byte string holds its trigger, at a place that its own bytes alone decide. Each trigger's
dictionary entry is the 273 bytes after it (those that every 400-byte string of that trigger
holds); a string can recur only where its entry does. The strings of one trigger
are a range of starts. Where the whole stretch that they span recurs, all of them do. Where
one entry has several stretches, one of each is kept, and their suffixes are put in order:
the suffix array of the dictionary side sorts the bytes before the trigger from the trigger back,
that of the parse side the bytes that follow the entry, each with the longest common prefixes of
neighbours. A suffix that starts o bytes before its trigger is then ordered by its class among
the former (o bytes alike) and among the latter (127 - o alike); it recurs if another is of both classes.
Entries are dealt over tasks; the suffixes of one with very many stretches are each a row
instead, counted in parts. Only starts, hashes and the bytes beside triggers are shuffled; texts only of documents with
something to compare or remove.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import documents, key_filter, passing, ready, stored
from .shingles import mixed, powers

LENGTH, GRAM, SPREAD = 400, 16, 128
#: Triggers of a chunk, within which equal stretches meet before the shuffle, and rows whose suffixes are sorted at a time.
CHUNK, ROWS = 500_000, 20_000
#: An entry of more stretches has its suffixes counted one by one, over many tasks.
MOST, SALTS = 4096, 8
_BYTE = np.random.Generator(np.random.PCG64(20240301)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOW = np.uint64(0xFFFFFFFF)


class Hashes:
    """Polynomial hashes modulo 2^64 of any stretch of a text."""

    def __init__(self, data: bytes):
        b = np.frombuffer(data, dtype=np.uint8)
        up, self.down = powers(len(b) + 1)
        self.total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(_BYTE[b] * up[: len(b)], dtype=np.uint64)])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.total[end] - self.total[start]) * self.down[start])


def triggers(h: Hashes, n: int, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """place, first, last: the triggers and the starts of the strings (of `length`) that have each."""
    starts = n - length + 1
    if starts < 1:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    spread = min(SPREAD, length - GRAM + 1)
    at = np.arange(starts + spread - 1)
    low = (h.of(at, at + GRAM) & ~_LOW) | at.astype(np.uint64)  # equal hashes: the leftmost
    width = 1
    while width < spread:
        step = min(width, spread - width)
        low = np.minimum(low[: len(low) - step], low[step:])
        width += step
    place = (low & _LOW).astype(np.int64)
    edge = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    return place[edge], edge, np.append(edge[1:], starts) - 1


def _phrases(docs: DataFrame, length: int) -> DataFrame:
    """A row for each trigger. Of the equal stretches of a chunk the first has their number in `times`, the others 0 and an entry of their own."""
    names, types = ["entry", "stretch", "key", "first", "more", "back", "times"], [np.int64, np.int64, np.int64, np.int32, np.int16, np.int16, np.int32]

    def dealt(rows: list[list[np.ndarray]]) -> pa.RecordBatch:
        entry, stretch, key, first, more, back = (np.concatenate([np.zeros(0, np.int64), *c]) for c in rows)
        _, one, count = np.unique(stretch, return_index=True, return_counts=True)
        times = np.zeros(len(stretch), dtype=np.int32)
        times[one] = count
        entry = np.where(times > 0, entry, mixed(entry.view(np.uint64) + mixed(np.arange(len(entry)).astype(np.uint64) + key.view(np.uint64))).view(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(x.astype(t)) for x, t in zip((entry, stretch, key, first, more, back, times), types, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        core = core_of(length)
        rows, size = [[] for _ in range(6)], 0
        for batch in batches:
            for key, text in zip(batch["key"].to_pylist(), batch["text"].to_pylist(), strict=True):
                data = text.encode()
                if len(data) < length:
                    continue
                h = Hashes(data)
                place, first, last = triggers(h, len(data), length)
                shape = ((place - first) * 1024 + (last - first)).astype(np.uint64)
                for column, x in zip(rows, (h.of(place, place + core).view(np.int64), mixed(h.of(first, last + length) + shape).view(np.int64), np.full(len(place), key), first, last - first, place - first), strict=True):
                    column.append(x)
                size += len(place)
            if size > CHUNK:
                yield dealt(rows)
                rows, size = [[] for _ in range(6)], 0
        yield dealt(rows)

    return docs.mapInArrow(run, "entry long, stretch long, key long, first int, more short, back short, times int")


def core_of(length: int) -> int:
    """The length of a dictionary entry."""
    return length - min(SPREAD, length - GRAM + 1) + 1


def _classes(group: np.ndarray, strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A suffix array: the order of the strings within their groups, and the common prefix of each with the one before (-1: another group).

    UTF-8 has no byte 255, so that each byte grows by one and 0 stands for the end.
    """
    width = max(1, max(map(len, strings), default=1))
    sizes = np.array([len(x) for x in strings])
    grid = np.zeros((len(strings), width), dtype=np.uint8)
    grid[np.arange(width)[None, :] < sizes[:, None]] = np.frombuffer(b"".join(strings), dtype=np.uint8) + 1
    order = np.argsort(grid.reshape(-1).view(f"S{width}"), kind="stable")
    order = order[np.argsort(group[order], kind="stable")]
    at = grid[order]
    apart = (at[1:] != at[:-1]) | (at[1:] == 0)
    common = np.where(apart.any(axis=1), apart.argmax(axis=1), width)
    common[group[order][1:] != group[order][:-1]] = -1
    return order, np.concatenate([[-1], common])


def recurring(entry: np.ndarray, before: list[bytes], after: list[bytes], room: int) -> np.ndarray:
    """A row for each trigger and a column for each o (0 to room): whether the string from o bytes before it recurs among these rows of its entry.

    before: the bytes from the first start to the trigger; after: those from the entry's end to the last string's end.
    """
    m = len(entry)
    _, group = np.unique(entry, return_inverse=True)
    most = np.array([len(x) for x in before])
    least = room - np.array([len(x) for x in after])
    left, left_common = _classes(group, [x[::-1] for x in before])
    right, right_common = _classes(group, after)
    out = np.zeros((m, room + 1), dtype=bool)
    here, there = np.empty(m, dtype=np.int64), np.empty(m, dtype=np.int64)
    for o in range(room + 1):
        rows = np.flatnonzero((least <= o) & (o <= most))
        if len(rows) > 1:
            here[left] = np.cumsum(left_common < o)
            there[right] = np.cumsum(right_common < room - o)
            _, of, count = np.unique(here[rows] * (m + 1) + there[rows], return_inverse=True, return_counts=True)
            out[rows, o] = count[of] > 1
    return out


def repeated_starts(docs: DataFrame, length: int = LENGTH, most: int = MOST) -> DataFrame:
    """key, lo, hi: ranges of starts of strings that occur elsewhere too; docs has key and text (not null)."""
    core, room = core_of(length), length - core_of(length)
    counted = _phrases(docs, length).withColumn("all", F.sum("times").over(Window.partitionBy("entry")))
    again = stored(counted.where((F.col("all") > 1) | (F.col("times") == 0)).drop("all"))
    own = again.where(F.col("times") > 0)
    kinds = stored(own.groupBy("entry", "stretch").agg(F.sum("times").alias("times"), F.min(F.struct("key", "first", "more", "back")).alias("one")))
    whole = own.join(kinds.where(F.col("times") > 1).select("entry", "stretch"), ["entry", "stretch"], "left_semi").union(again.where(F.col("times") == 0))
    whole = whole.select("key", F.col("first").alias("lo"), (F.col("first") + F.col("more")).alias("hi"))
    several = kinds.groupBy("entry").agg(F.count(F.lit(1)).alias("kinds")).where(F.col("kinds") > 1)
    compared = kinds.join(several, "entry").select("entry", "one.*", (F.col("times") == 1).alias("open"), (F.col("kinds") > most).alias("hot"))
    compared = stored(compared.groupBy("key").agg(F.collect_list(F.struct("entry", "first", "more", "back", "open", "hot")).alias("ranges")))
    table = key_filter(compared, "key")

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(passing(table, batch["key"])))

    texts = docs.mapInArrow(chosen, docs.schema).dropDuplicates(["key"]).join(compared, "key")

    def beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, types = ["entry", "key", "first", "open", "before", "after", "strings"], [pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
        for batch in batches:
            rows = []
            for key, text, ranges in zip(batch["key"].to_pylist(), batch["text"].to_pylist(), batch["ranges"].to_pylist(), strict=True):
                data, h = text.encode(), None
                for r in ranges:
                    first, last, place = r["first"], r["first"] + r["more"], r["first"] + r["back"]
                    if r["hot"]:
                        h = h or Hashes(data)
                        at = np.arange(first, last + 1)
                        rows.append((r["entry"], key, first, r["open"], None, None, h.of(at, at + length).view(np.int64)))
                    else:
                        rows.append((r["entry"], key, first, r["open"], data[first:place], data[place + core : last + length], None))
            columns = zip(*rows, strict=True) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=names)

    rows = stored(texts.select("key", "text", "ranges").mapInArrow(beside, "entry long, key long, first int, open boolean, before binary, after binary, strings array<long>"))

    def ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solved(t: pa.Table) -> pa.RecordBatch:
            entry, before = t["entry"].to_numpy(), t["before"].to_pylist()
            hit = recurring(entry, before, t["after"].to_pylist(), room) & t["open"].to_numpy()[:, None]
            edge = np.diff(np.pad(hit, ((0, 0), (1, 1))).astype(np.int8), axis=1)
            (row, low), (_, high) = np.nonzero(edge == 1), np.nonzero(edge == -1)  # runs of o, both by row
            place = t["first"].to_numpy().astype(np.int64) + np.array([len(x) for x in before])
            return pa.RecordBatch.from_arrays([pa.array(t["key"].to_numpy()[row]), pa.array((place[row] - high + 1).astype(np.int32)), pa.array((place[row] - low).astype(np.int32))], names=["key", "lo", "hi"])

        held, size = [], 0
        for batch in batches:
            if batch.num_rows and size > ROWS:
                entry = batch["entry"].to_numpy()
                last = held[-1]["entry"][-1].as_py()
                cut = int((entry != last).argmax()) if entry[-1] != last else len(entry)
                if cut < len(entry):
                    yield solved(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                    held, size, batch = [], 0, batch.slice(cut)
            if batch.num_rows:
                held.append(batch)
                size += batch.num_rows
        if held:
            yield solved(pa.Table.from_batches(held))

    near = rows.where(F.col("before").isNotNull()).select("entry", "key", "first", "open", "before", "after").repartition(F.col("entry")).sortWithinPartitions("entry")
    near = near.mapInArrow(ordered, "key long, lo int, hi int")
    hot = stored(rows.where(F.col("strings").isNotNull()).select("entry", "key", "open", F.posexplode("strings").alias("nth", "string"), (F.col("first") + F.col("nth")).alias("at")).select("entry", "string", "key", "at", "open"))
    twice = hot.groupBy("entry", "string").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    twice = twice.select("entry", "string", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])).alias("salt"))
    hot = hot.where("open").withColumn("salt", (F.monotonically_increasing_id() % SALTS).cast("int")).join(twice, ["entry", "string", "salt"], "left_semi")
    return whole.union(near).union(hot.select("key", F.col("at").alias("lo"), F.col("at").alias("hi")))


def removed(data: bytes, ranges: list[tuple[int, int]], length: int = LENGTH) -> tuple[bytes, int, int]:
    """What is left, the number of bytes removed and of maximal runs, given ranges of starts."""
    if not ranges:
        return data, 0, 0
    change = np.zeros(len(data) + 1, dtype=np.int64)
    lo, hi = np.array(ranges, dtype=np.int64).T
    np.add.at(change, lo, 1)
    np.add.at(change, hi + length, -1)
    gone = np.cumsum(change)[:-1] > 0
    runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
    return np.frombuffer(data, dtype=np.uint8)[~gone].tobytes(), int(gone.sum()), runs


def remove_repeats(docs: DataFrame, length: int = LENGTH, most: int = MOST) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary: the remaining bytes) of every row of docs (doc_id, text).

    Null text is empty. Rows that repeat are documents of their own, each other's elsewhere; a null
    doc_id is one like any other. Very long texts are whole; there are no ties to break. Texts
    shorter than `length` bytes stay whole. An empty table gives no rows; other columns are not read.
    """
    ready(docs.sparkSession)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    d = d.withColumn("key", F.xxhash64("doc_id", "text"))
    ranges = repeated_starts(d.select("key", "text"), length, most).distinct()
    ranges = stored(ranges.groupBy("key").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges")))
    table = key_filter(ranges, "key")

    def split(hit: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(passing(table, batch["key"]) == hit))

        return run

    touched = d.mapInArrow(split(True), d.schema).join(ranges, "key", "left")
    names, types = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"], [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text, ranges in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), batch["ranges"].to_pylist(), strict=True):
                data = text.encode()
                left, n, runs = removed(data, [(r["lo"], r["hi"]) for r in ranges or []], length)
                rows.append((doc, len(data), n, runs, left))
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"
    part = touched.select("doc_id", "text", "ranges").mapInArrow(cut, schema)
    rest = d.mapInArrow(split(False), d.schema)
    zero = F.lit(0).cast("long")
    rest = rest.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.col("text").cast("binary").alias("kept"))
    return part.union(rest)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of every document without its 400-byte repeats; nulls, empty and long texts as in remove_repeats."""
    return remove_repeats(documents(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
