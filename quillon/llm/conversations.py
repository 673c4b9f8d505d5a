"""Repair of conversations whose structure was damaged, at least cost, by a lazily determinised automaton.

A weighted automaton reads a conversation's rows and allows the edits Keep, Rerole, Delete and Insert; its four
states say which role went out last. Read from the last row to the first, the least costs to finish from
each state are a vector; less its minimum it is a state of the determinised automaton, and a table
holds each state's successor and cost by kind of row, filled when first met. Scanning the rows through the table gives the
costs; a trace back against the scan takes, of the arcs that the least cost uses, the letter that comes first.

An ordinary conversation is one run of rows of a sorted stream. One of more than MOST_ROWS rows or
MOST_CHARS characters is dealt over many tasks by ranges of its rows: a segment becomes the matrix of its least
costs, the segments' matrices give the vector at each one's end, each segment then traces its rows from every
entry state, and the entries are chained. Only the SHA-256 of the repaired text, which no split can give, reads such a conversation in
one stream, row by row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.storage import numbered

from .common import lean, ready, stored

REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: A conversation beyond either is dealt over tasks, in segments of about so many rows.
MOST_ROWS, MOST_CHARS, SEGMENT = 50_000, 16_000_000, 200_000
SPACES = " \t\n\x0b\x0c\r"
NONE = 1 << 60
#: States: nothing out yet, a system row, a user row, an assistant row. Which role a state may put out next, and the state after it.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
FILLED = {q: next(t for r, t in to.items() if r != "s") for q, to in NEXT.items()}
ENDS = [0, NONE, NONE, 0]
NAMES = {USER: "user", ASSISTANT: "assistant"}
#: Kinds of rows: by initial and whether truncated; the last must go.
INITIALS, MUST_GO = ("s", "u", "a", ""), 8


def kind_of(role: str, must_go: bool, truncated: bool) -> int:
    return MUST_GO if must_go else 2 * (INITIALS.index(role[:1]) if role[:1] in INITIALS else 3) + truncated


def arcs(q: int, kind: int) -> Iterator[tuple[str, int, int]]:
    """letter, cost, next state of the edits that consume a row of this kind."""
    yield "D", DELETE, q
    if kind != MUST_GO:
        role, more = INITIALS[kind // 2], TRUNCATED * (kind % 2)
        if role in NEXT[q]:
            yield "K", more, NEXT[q][role]
        yield "R", REROLE + more, FILLED[q]


class Repairer:
    """The determinised automaton; its states and table grow as rows ask for them and stay for the task."""

    def __init__(self) -> None:
        self.number: dict[tuple[int, ...], int] = {}
        self.vectors: list[tuple[int, ...]] = []
        self.table: list[list[tuple[int, int, list[tuple[str, int]]] | None]] = []

    def state(self, costs: list[int]) -> tuple[int, int]:
        """The state of a vector of costs, with Inserts allowed, and what was subtracted from it."""
        for _ in range(3):  # no path uses more than three Inserts in a row
            costs = [min(c, INSERT + costs[FILLED[q]]) for q, c in enumerate(costs)]
        least = min(costs)
        vector = tuple(c - least if c < NONE else NONE for c in costs)
        if vector not in self.number:
            self.number[vector] = len(self.vectors)
            self.vectors.append(vector)
            self.table.append([None] * (MUST_GO + 1))
        return self.number[vector], least

    def _enter(self, after: int, kind: int) -> tuple[int, int, list[tuple[str, int]]]:
        """The table's entry: the state before a row of this kind, the cost added, and from each state the letters up to the row's own and where they lead."""
        v = self.vectors[after]
        own = [min(c + v[t] for _, c, t in arcs(q, kind)) for q in range(4)]
        before, added = self.state(own)
        closed = [x + added if x < NONE else NONE for x in self.vectors[before]]
        steps = []
        for q in range(4):
            letters, at = "", q
            while closed[at] < NONE:
                tight = [(a, t) for a, c, t in arcs(at, kind) if c + v[t] == closed[at]]
                if INSERT + closed[FILLED[at]] == closed[at]:
                    tight.append(("I", FILLED[at]))
                letter, to = min(tight)
                letters, at = letters + letter, to
                if letter != "I":
                    break
            steps.append((letters, at))
        self.table[after][kind] = before, added, steps
        return self.table[after][kind]

    def scan(self, kinds: Iterable[int], end: list[int]) -> tuple[list[list[tuple[str, int]]], list[int]]:
        """The steps of each row, first row first, and the cost from each state to the end's."""
        at, total = self.state(end)
        found = []
        for kind in reversed(kinds):
            at, added, steps = self.table[at][kind] or self._enter(at, kind)
            total += added
            found.append(steps)
        found.reverse()
        return found, [total + x if x < NONE else NONE for x in self.vectors[at]]

    @staticmethod
    def trace(steps: list[list[tuple[str, int]]], q: int) -> tuple[list[str], int]:
        """Each row's letters on the way from q, and where it ends."""
        out = []
        for s in steps:
            letters, q = s[q]
            out.append(letters)
        return out, q

    def tail(self, q: int) -> str:
        """The Inserts that follow the last row."""
        return {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}[q]


class Written:
    """The digest of the repaired rows, one after the other."""

    def __init__(self) -> None:
        self.q, self.sha, self.any = START, hashlib.sha256(), False

    def put(self, letters: str, role: str = "", text: str = "") -> None:
        for letter in letters:
            if letter == "D":
                continue
            self.q = NEXT[self.q][role[:1]] if letter == "K" else FILLED[self.q]
            name = role if letter == "K" else NAMES[self.q]
            self.sha.update(f"{chr(10) if self.any else ''}{name}:{'' if letter == 'I' else text}".encode())
            self.any = True


def illegal(initials: list[str]) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, kept, digest after the damage that crc32 of `conv_id:turn` modulo 20 decides: 0 drops the row (kept is false), 1 empties its text, 2 takes its `[.!?]` away, 3 repeats it, 4 makes its role user. Nulls count as one space there, and become one space in role and text."""
    blank = F.lit(" ")
    text, role = (F.coalesce(F.col(c).cast("string"), blank) for c in ("text", "role"))
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    at = F.crc32(key.cast("binary")) % 20
    text = F.when(at.isin(0, 1), F.lit("")).when(at == 2, F.translate(text, ".!?", "")).otherwise(text)
    role = F.when(at == 4, F.lit("user")).otherwise(role)
    times = F.array_repeat(at != 0, F.when(at == 3, 2).otherwise(1))
    made = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), role.alias("role"), text.alias("text"), F.explode(times).alias("kept"))
    return made.withColumn("digest", F.md5("text"))


_OUT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_ORDER = ["turn", "role", "digest"]


def _repaired(conv: int | None, turns: list[int | None], roles: list[str], texts: list[str], digests: list[str], machine: Repairer) -> tuple:
    """The output row of one conversation."""
    seen, kinds, faults = set(), bytearray(), [0, 0, 0]
    for role, text, digest in zip(roles, texts, digests, strict=True):
        own = text.rstrip(SPACES)
        repeat = (role, digest) in seen
        seen.add((role, digest))
        cut = bool(own) and not repeat and own[-1] not in ".!?"
        faults = [faults[0] + (not own), faults[1] + (bool(own) and repeat), faults[2] + cut]
        kinds.append(kind_of(role, not own or repeat, cut))
    steps, cost = machine.scan(kinds, ENDS)
    letters, q = machine.trace(steps, START)
    out = Written()
    for edit, role, text in zip(letters, roles, texts, strict=True):
        out.put(edit, role, text)
    out.put(machine.tail(q))
    known = [t for t in turns if t is not None]
    gaps = known[-1] - known[0] + 1 - len(set(known)) if known else 0
    return conv, gaps, *faults, illegal([r[:1] for r in roles]), cost[START], "".join(letters) + machine.tail(q), out.sha.hexdigest()


def _in_streams(rows: DataFrame) -> DataFrame:
    """Conversations of bounded size, each within one task's sorted stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        machine, open_, done = Repairer(), None, []

        def batch_of(found: list[tuple]) -> pa.RecordBatch:
            types = [pa.int64()] * 7 + [pa.string()] * 2
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], t) for i, t in enumerate(types)], names=[c.split()[0] for c in _OUT.split(", ")])

        for batch in batches:
            for conv, kept, *row in zip(*[batch[c].to_pylist() for c in ("conv_id", "kept", "turn", "role", "text", "digest")], strict=True):
                if open_ is None or open_[0] != conv:
                    if open_ is not None:
                        done.append(_repaired(*open_, machine))
                    open_ = (conv, [], [], [], [])
                if kept:
                    for column, x in zip(open_[1:], row, strict=True):
                        column.append(x)
            if done:
                yield batch_of(done)
                done = []
        if open_ is not None:
            yield batch_of([_repaired(*open_, machine)])

    dealt = rows.repartition(F.col("conv_id")).sortWithinPartitions("conv_id", *_ORDER)
    return dealt.mapInArrow(run, _OUT)


def _segments(ranged: DataFrame, repeats: DataFrame) -> DataFrame:
    """conv_id, part, kinds, initials: a row for each conversation of each range, its rows as one character each."""
    own = F.rtrim(F.col("text"), F.lit(SPACES))
    lean_rows = ranged.select("conv_id", "part", "at", "role", (own == "").alias("blank"), (~F.right(own, F.lit(1)).isin(".", "!", "?")).alias("cut"))
    flagged = lean_rows.join(repeats.select("at", F.lit(True).alias("repeat")), "at", "left")
    repeat = F.coalesce(F.col("repeat"), F.lit(False))
    initial = F.substring("role", 1, 1)
    place = F.when(F.col("blank") | repeat, F.lit(MUST_GO)).otherwise(
        2 * F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3) + F.col("cut").cast("int")
    )
    faults = [F.sum(c.cast("long")).alias(n) for n, c in (("blank", F.col("blank")), ("duplicate", repeat & ~F.col("blank")), ("truncated", F.col("cut") & ~F.col("blank") & ~repeat))]
    listed = F.array_sort(F.collect_list(F.struct("at", place.alias("kind"), F.when(initial.isin("s", "u", "a"), initial).otherwise(" ").alias("initial"))))
    flagged = flagged.withColumn("conv_id", F.col("conv_id").cast("string"))  # pandas would make whole numbers beside a null fractions
    made = flagged.groupBy("conv_id", "part").agg(listed.alias("rows"), *faults)
    line = lambda c: F.array_join(F.transform("rows", lambda r: r[c].cast("string")), "")
    return made.select("conv_id", "part", "blank", "duplicate", "truncated", line("kind").alias("kinds"), line("initial").alias("initials"))


def _by_ranges(rows: DataFrame, count: int) -> DataFrame:
    """Conversations of any size, each over as many tasks as it has segments."""
    spread = rows.where("kept").withColumn("tie", F.monotonically_increasing_id())
    keys = ["conv_id", *_ORDER, "tie"]
    ranged = spread.repartitionByRange(max(1, -(-count // SEGMENT)), *keys).sortWithinPartitions(*keys)
    ranged = stored(ranged.select("conv_id", "turn", "role", "text", "digest", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")))
    repeats = numbered(ranged.select("conv_id", "role", "digest", "at"), ["conv_id", "role", "digest"], ["at"], "nth").where(F.col("nth") > 1)
    segments = stored(_segments(ranged, repeats))

    def matrices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine = Repairer()
        for b in batches:
            costs = [[x for end in range(4) for x in machine.scan(bytes(map(int, k)), [0 if q == end else NONE for q in range(4)])[1]] for k in b["kinds"]]
            lines = [illegal(list(i)) for i in b["initials"]]
            yield pd.DataFrame({"conv_id": b["conv_id"], "part": b["part"], "costs": costs, "inner": lines, "first": b["initials"].str[0], "last": b["initials"].str[-1]})

    small = stored(segments.select("conv_id", "part", "kinds", "initials").mapInPandas(matrices, "conv_id string, part int, costs array<long>, inner long, first string, last string"))

    def ends(b: pd.DataFrame) -> pd.DataFrame:
        """The vector of least costs at each segment's end, from the matrices of those behind it."""
        b = b.sort_values("part")
        machine, after, found = Repairer(), list(ENDS), []
        closed, less = machine.state(after)
        after = [less + x for x in machine.vectors[closed]]
        for costs in reversed(b["costs"].tolist()):
            found.append(after)
            after = [min(min(costs[4 * end + q] + after[end], NONE) for end in range(4)) for q in range(4)]
        across = sum(illegal([x, y]) for x, y in zip(b["last"].tolist(), b["first"].tolist()[1:], strict=False))
        out = b[["conv_id", "part"]].assign(end=found[::-1])
        out["cost"], out["illegal"] = after[START], int(b["inner"].sum()) + across
        return out

    known = stored(small.groupBy("conv_id").applyInPandas(ends, "conv_id string, part int, end array<long>, cost long, illegal long"))
    same = F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("part") == F.col("of_part"))

    def beside(left: DataFrame, right: DataFrame) -> DataFrame:
        return left.join(right.withColumnsRenamed({"conv_id": "of", "part": "of_part"}), same).drop("of", "of_part")

    def ways(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """From each entry state: the letters and the state at the segment's end."""
        machine = Repairer()
        for b in batches:
            found = []
            for kinds, end in zip(b["kinds"], b["end"], strict=True):
                steps, _ = machine.scan(bytes(map(int, kinds)), [int(x) for x in end])
                found.append([machine.trace(steps, q) for q in range(4)])
            yield pd.DataFrame({"conv_id": b["conv_id"], "part": b["part"], "letters": [["".join(w[0]) for w in f] for f in found], "exits": [[w[1] for w in f] for f in found]})

    traced = stored(beside(segments.select("conv_id", "part", "kinds"), known.select("conv_id", "part", "end")).mapInPandas(ways, "conv_id string, part int, letters array<string>, exits array<int>"))

    def entries(b: pd.DataFrame) -> pd.DataFrame:
        b, q, found = b.sort_values("part"), START, []
        for exits in b["exits"].tolist():
            found.append(q)
            q = exits[q]
        tails = [""] * (len(b) - 1) + [Repairer().tail(q)]
        return b[["conv_id", "part"]].assign(entry=found, tail=tails)

    chained = traced.select("conv_id", "part", "exits").groupBy("conv_id").applyInPandas(entries, "conv_id string, part int, entry int, tail string")
    edits = beside(traced.select("conv_id", "part", "letters"), chained)
    edits = stored(edits.select("conv_id", "part", F.concat(F.get("letters", F.col("entry")), "tail").alias("letters"), "tail"))

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A conversation's rows in order, each segment's letters ahead of its rows."""
        def closed(conv: int | None, out: Written, rest: str) -> pa.RecordBatch:
            out.put(rest)
            return pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([out.sha.hexdigest()])], names=["conv_id", "repaired_sha256"])

        conv, out, letters, at = None, None, "", 0
        for batch in batches:
            for of, first, role, text in zip(*[batch[c].to_pylist() for c in ("conv_id", "first", "role", "text")], strict=True):
                if out is None or of != conv:
                    if out is not None:
                        yield closed(conv, out, letters[at:])
                    conv, out, letters, at = of, Written(), "", 0
                if first:
                    letters, at = letters[at:] + text, 0
                    continue
                end = at
                while letters[end] == "I":
                    end += 1
                out.put(letters[at : end + 1], role, text)
                at = end + 1
        if out is not None:
            yield closed(conv, out, letters[at:])

    lines = ranged.select("conv_id", "part", F.lit(False).alias("first"), "at", "role", "text")
    heads = edits.select(F.col("conv_id").cast("long"), "part", F.lit(True).alias("first"), F.lit(-1).cast("long").alias("at"), F.lit("").alias("role"), F.col("letters").alias("text"))
    stream = lines.unionByName(heads).repartition(F.col("conv_id")).sortWithinPartitions("conv_id", "part", F.desc("first"), "at")
    hashed = stream.select("conv_id", "first", "role", "text").mapInArrow(digests, "conv_id long, repaired_sha256 string")
    audit = edits.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "letters"))), lambda e: e["letters"]), "").alias("audit"))
    spans = ranged.groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1).alias("span"))
    turns = ranged.where("turn is not null").groupBy("conv_id", "turn").agg(F.lit(1).alias("one")).groupBy("conv_id").agg(F.count("one").alias("turns"))
    faults = segments.groupBy("conv_id").agg(*[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")])
    costs = known.groupBy("conv_id").agg(F.min("cost").alias("cost"), F.min("illegal").alias("illegal"))
    every = rows.select("conv_id").distinct()
    for n, more in enumerate((spans, turns, faults, costs, audit, hashed)):
        of = f"of{n}"
        more = more.withColumn("conv_id", F.col("conv_id").cast("long"))
        every = every.join(more.withColumnRenamed("conv_id", of), F.col("conv_id").eqNullSafe(F.col(of)), "left").drop(of)
    zero = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")]
    gaps = F.coalesce(F.col("span") - F.col("turns"), F.lit(0)).cast("long").alias("gaps")
    return every.select("conv_id", gaps, *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def repair(rows: DataFrame) -> DataFrame:
    """A row for each conv_id of `damaged` rows (null is one of them): gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Rows go by turn (null first), rows of one turn by role, then by the text's MD5; rows equal in all of them
    are in a row, all but the first duplicates. Rows of which `kept` is false only name their conversation; one without
    others has zeros, an empty audit and the empty string's hash, as has one whose rows are all deleted save for its counts. Empty tables give no rows. Other
    columns, of any name, are not read.
    """
    rows = rows.select("conv_id", "turn", "role", "text", "kept", "digest")
    sizes = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))
    large = stored(sizes.where((F.col("n") > MOST_ROWS) | (F.col("chars") > MOST_CHARS)).select(F.col("conv_id").alias("of"), "n"))
    count = large.agg(F.sum("n")).first()[0]
    if not count:
        return _in_streams(rows)
    same = F.col("conv_id").eqNullSafe(F.col("of"))
    return _in_streams(rows.join(large, same, "left_anti")).unionByName(_by_ranges(rows.join(large, same, "left_semi"), count))


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged and repaired; nulls, ties, empty and long texts, repeated rows and empty tables as in damaged and repair."""
    return repair(damaged(ready(spark).read.parquet(f"{sf_dir}/conversations.parquet")))


#: CRC-32 goes over half bytes, lower one first, by a table that its polynomial gives. A step of the recursion takes every conversation one row on: for each state the cheapest edits, the least letters of those, and the rows that they put out.
SQL = r"""
WITH RECURSIVE nibble(k, v) AS (SELECT k, list_reduce(list_prepend(k, [0, 0, 0, 0]), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)
                      FROM (SELECT CAST(unnest(range(16)) AS BIGINT) AS k)),
steps AS (SELECT list(v ORDER BY k) AS step FROM nibble),
source AS (SELECT dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS g, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                  coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
keys AS (SELECT k, hex(encode(k)) AS h FROM (SELECT DISTINCT k FROM source)),
halves AS (SELECT k, list_transform(range(CAST(len(h) AS BIGINT)), lambda i: CAST(instr('0123456789ABCDEF', h[CASE WHEN i % 2 = 0 THEN i + 2 ELSE i END]) - 1 AS BIGINT)) AS half FROM keys),
lots AS (SELECT k, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), half), lambda c, n: xor(c >> 4, step[1 + (xor(c, n) & 15)])), 4294967295) % 20 AS lot FROM halves, steps),
worn AS (SELECT g, conv_id, turn, CASE WHEN lot = 4 THEN 'user' ELSE role END AS role,
                CASE lot WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN lot = 3 THEN 2 ELSE 1 END)) AS copy
         FROM source JOIN lots USING (k) WHERE lot <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY turn NULLS FIRST, role, md5(text)) AS i, left(role, 1) AS initial, regexp_replace(text, '[\x20\x09-\x0D]+\z', '') AS own FROM worn),
seen AS (SELECT *, own = '' AS blank, row_number() OVER (PARTITION BY g, role, text ORDER BY i) > 1 AS again, lag(initial) OVER (PARTITION BY g ORDER BY i) AS former FROM placed),
faulty AS (SELECT *, NOT blank AND again AS duplicate, NOT blank AND NOT again AND right(own, 1) NOT IN ('.', '!', '?') AS cut FROM seen),
counts AS (SELECT g, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (cut) AS truncated,
                  count(*) FILTER (former IS NOT NULL AND former || initial NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM faulty GROUP BY g),
nexts(q, r, t) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
inserts(q, letters, fee, t, made) AS (VALUES (0, '', 0, 0, CAST([] AS VARCHAR[])), (0, 'I', 5, 2, ['user:']), (0, 'II', 10, 3, ['user:', 'assistant:']), (1, '', 0, 1, []), (1, 'I', 5, 2, ['user:']), (1, 'II', 10, 3, ['user:', 'assistant:']),
    (2, '', 0, 2, []), (2, 'I', 5, 3, ['assistant:']), (2, 'II', 10, 2, ['assistant:', 'user:']), (3, '', 0, 3, []), (3, 'I', 5, 2, ['user:']), (3, 'II', 10, 3, ['user:', 'assistant:'])),
edits AS (SELECT g, i, q, 'D' AS letter, 2 AS fee, q AS t, CAST([] AS VARCHAR[]) AS made FROM faulty, range(4) AS s(q)
    UNION ALL SELECT g, i, q, 'K', CASE WHEN cut THEN 5 ELSE 0 END, t, [role || ':' || text] FROM faulty JOIN nexts ON r = initial WHERE NOT blank AND NOT duplicate
    UNION ALL SELECT g, i, q, 'R', CASE WHEN cut THEN 6 ELSE 1 END, t, [CASE r WHEN 'u' THEN 'user' ELSE 'assistant' END || ':' || text] FROM faulty JOIN nexts ON r <> 's' WHERE NOT blank AND NOT duplicate),
moves AS (SELECT g, i, a.q, a.fee + e.fee AS fee, a.letters || e.letter AS letters, e.t, a.made || e.made AS made FROM edits e JOIN inserts a ON a.t = e.q),
walks(g, i, q, best) AS (
    SELECT g, CAST(0 AS BIGINT), CAST(0 AS BIGINT), {'cost': CAST(0 AS BIGINT), 'audit': '', 'made': CAST([] AS VARCHAR[])} FROM counts
    UNION ALL SELECT w.g, m.i, CAST(m.t AS BIGINT), min({'cost': CAST(w.best.cost + m.fee AS BIGINT), 'audit': w.best.audit || m.letters, 'made': w.best.made || m.made})
    FROM walks w JOIN moves m ON m.g = w.g AND m.i = w.i + 1 AND m.q = w.q GROUP BY w.g, m.i, m.t),
ends AS (SELECT w.g, min({'cost': w.best.cost + a.fee, 'audit': w.best.audit || a.letters, 'made': w.best.made || a.made}) AS best
         FROM walks w JOIN counts c ON c.g = w.g AND c.n = w.i JOIN inserts a ON a.q = w.q AND a.t IN (0, 3) GROUP BY w.g)
SELECT s.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(best.cost, 0) AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(array_to_string(best.made, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT g, conv_id FROM source) s LEFT JOIN counts USING (g) LEFT JOIN ends USING (g)
"""
