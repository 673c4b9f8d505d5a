"""Language-model scores of whole texts by a weighted backoff automaton.

Counts of all n-grams of the training documents make the model: an n-gram's probability is
(count + m * the shorter one's probability) / (count of its context + m), the shortest being the words' own with
0.1 added to each count. m is one number for each length, such that the contexts together leave to unseen words
the share that n-grams seen once take (Good and Turing's estimate).

No task holds the model. Documents are written as chunks of word numbers; each chunk asks for its distinct n-grams
by 64-bit hashes, bringing its own training counts along; shards of the hash range add up what all chunks brought and answer
with the totals. A chunk then builds the part of the automaton that its texts can reach: n-grams that have followers are states, each
longer n-gram is an arc to the state of its longest known end, and a failure arc leads from each state to the next shorter one,
at the weight of backing off. One traversal from left to right carries the state and adds up log-probabilities;
it takes all texts of a chunk a token at a time, long ones in stretches that read the few tokens before them first.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, lean, stored
from .shingles import mixed, word_hashes

ORDER, ADDED, FOLDS = 2, 0.1, 10
#: Tokens of a chunk and of a piece of a document, bytes hashed at a time, keys of a shard, tokens of a stretch.
CHUNK, PIECE, BYTES, SHARD, STRETCH = 1_250_000, 500_000, 4_000_000, 2_000_000, 2048
#: Bounds of m, and of the powers of 2 (in eighths) by which counts are told apart when it is found.
LEAST, MOST, EIGHTHS = 0.01, 1e6, 400
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_JOIN = np.uint64(0xA0761D6478BD642F)
#: Hashes of what stands before the first word and of the end.
BEGIN, END = (mixed(np.array([k], dtype=np.uint64))[0] for k in (0x1F3D5B79, 0x2E4C6A88))
FIELDS = ("doc", "doc_id", "no_id", "held", "lead", "counted")


def packed(x: np.ndarray) -> bytes:
    """Whole numbers, small ones in fewer bytes: their number, then seven bits of each, then of those that go on, and so forth."""
    x, out = np.asarray(x, dtype=np.uint64), [len(x).to_bytes(8, "little")]
    while len(x):
        more = x >= 128
        out.append(((x & np.uint64(127)) | (more.astype(np.uint64) << np.uint64(7))).astype(np.uint8).tobytes())
        x = x[more] >> np.uint64(7)
    return b"".join(out)


def unpacked(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    out, at, where, shift = np.zeros(n, dtype=np.int64), 8, np.arange(n), 0
    while len(where):
        plane = np.frombuffer(data, dtype=np.uint8, count=len(where), offset=at)
        at += len(where)
        out[where] |= (plane & 127).astype(np.int64) << shift
        where, shift = where[plane >= 128], shift + 7
    return out


def narrowed(keys: np.ndarray) -> bytes:
    """Sorted distinct keys: the first, and the steps between them in as many bytes as the largest needs, byte by byte."""
    steps = np.diff(keys)
    width = max(1, -(-int(steps.max(initial=np.uint64(1))).bit_length() // 8))
    return keys[:1].tobytes() + bytes([width]) + np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def widened(data: bytes) -> np.ndarray:
    width = data[8]
    planes = np.frombuffer(data, dtype=np.uint8, offset=9).reshape(width, -1)
    steps = np.zeros((planes.shape[1] + 1, 8), dtype=np.uint8)
    steps[1:, :width] = planes.T
    steps = steps.reshape(-1).view(np.uint64)
    steps[0] = np.frombuffer(data, dtype=np.uint64, count=1)[0]
    return np.cumsum(steps, dtype=np.uint64)


def tokens(text: str | None) -> np.ndarray:
    """The hashes of a text's words, A-Z as a-z, and of the end; a very long text is hashed a few MB at a time."""
    data, at, out = (text or "").encode(), 0, []
    while at < len(data):
        cut = _SPACE.search(data, at + BYTES)
        end = cut.start() if cut else len(data)
        out.append(word_hashes(data[at:end]))
        at = end
    return np.concatenate([*out, np.array([END])])


def held_out(doc_id: int | None) -> bool:
    """Whether a document is kept from training: crc32 of its id as text (null: the empty string) divisible by FOLDS."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS == 0


def _chunks(docs: DataFrame, order: int) -> DataFrame:
    """A row for each chunk: pieces of documents, the hashes of its words, frequent ones first, and its texts as numbers of words."""
    before = max(1, order - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        lean()
        base = TaskContext.get().partitionId() << 40
        made = doc = size = 0
        pieces: list[tuple[int, ...]] = []
        texts: list[np.ndarray] = []

        def row() -> pa.RecordBatch:
            words, ids, times = np.unique(np.concatenate(texts), return_inverse=True, return_counts=True)
            by_times = np.argsort(-times, kind="stable")
            rank = np.empty(len(words), dtype=np.int64)
            rank[by_times] = np.arange(len(words))
            about = np.array(pieces, dtype=np.int64)
            train = int(about[about[:, 3] == 0, 5].sum())
            columns = [base + made, train, int(about[:, 5].sum()), about.tobytes(), words[by_times].tobytes(), packed(rank[ids])]
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in columns], names=["chunk", "train", "size", "pieces", "words", "ids"])

        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                read = np.concatenate([np.array([BEGIN]), tokens(text)])
                for at in range(1, len(read), PIECE):
                    lead, end = min(at, before), min(at + PIECE, len(read))
                    pieces.append((base + doc, doc_id or 0, doc_id is None, held_out(doc_id), lead, end - at))
                    texts.append(read[at - lead : end])
                    size += end - at
                    if size >= CHUNK:
                        yield row()
                        made, size, pieces, texts = made + 1, 0, [], []
                doc += 1
        if pieces:
            yield row()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return stored(rows.mapInArrow(run, "chunk long, train long, size long, pieces binary, words binary, ids binary"))


class Chunk:
    """A chunk's pieces and, for each length of n-grams, its distinct ones in the order of their hashes."""

    def __init__(self, pieces: bytes, words: bytes, ids: bytes, order: int):
        about = np.frombuffer(pieces, dtype=np.int64).reshape(-1, len(FIELDS))
        self.about = dict(zip(FIELDS, about.T, strict=True))
        self.order, self.ids = order, unpacked(ids)
        lengths = self.about["lead"] + self.about["counted"]
        self.start = np.cumsum(lengths) - lengths
        self.first = self.start + self.about["lead"]
        self.end = self.start + lengths
        place = np.arange(len(self.ids)) - np.repeat(self.start, lengths)
        hashes = np.frombuffer(words, dtype=np.uint64)[self.ids]
        new = (place >= np.repeat(self.about["lead"], lengths)) | ((hashes == BEGIN) & (np.repeat(self.about["lead"], lengths) == 1))  # a document begins in one piece alone
        counts = (new & (np.repeat(self.about["held"], lengths) == 0)).astype(np.int64)
        self.keys, self.own, self.at, self.of = [], [], [], []
        h = hashes
        for n in range(1, order + 1):
            if n > 1:
                h = mixed(np.concatenate([h[:1], h[:-1]]) * _JOIN + hashes + np.uint64(n))
            real = np.flatnonzero(place >= n - 1)
            keys, at, inverse = np.unique(h[real], return_index=True, return_inverse=True)
            of = np.full(len(h), -1, dtype=np.int64)
            of[real] = inverse
            self.keys.append(keys)
            self.at.append(real[at])  # where each stands
            self.of.append(of)  # which ends at each place
            self.own.append(np.bincount(inverse, weights=counts[real], minlength=len(keys)).astype(np.int64))

    def requests(self, shards: int) -> Iterator[tuple[int, int, bytes, bytes]]:
        """n, shard, keys and their training counts here."""
        for n, (keys, own) in enumerate(zip(self.keys, self.own, strict=True), 1):
            shard = ((keys >> np.uint64(40)) * np.uint64(shards) >> np.uint64(24)).astype(np.int64)
            edge = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1], [True]])) if len(keys) else []
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                yield n, int(shard[a]), narrowed(keys[a:b]), packed(own[a:b])


def _totals(chunks: DataFrame, order: int, shards: int) -> DataFrame:
    """chunk, n, shard, totals: how often training has each n-gram that the chunk asks for; with a null chunk, each shard's statistics."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, *parts in zip(*[batch[c].to_pylist() for c in ("chunk", "pieces", "words", "ids")], strict=True):
                found = list(Chunk(*parts, order).requests(shards))
                columns = [pa.array([chunk] * len(found), pa.int64())] + [pa.array(x, t) for x, t in zip(zip(*found, strict=True), (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=["chunk", "n", "shard", "keys", "counts"])

    def answer(group: pa.Table) -> pa.Table:
        keys = [widened(k) for k in group["keys"].to_pylist()]
        sizes = [len(k) for k in keys]
        _, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        counts = np.concatenate([unpacked(c) for c in group["counts"].to_pylist()])
        total = np.bincount(inverse, weights=counts).astype(np.int64)
        cuts = np.split(total[inverse], np.cumsum(sizes)[:-1])
        seen = total[total > 0]
        by_size = np.bincount(np.minimum(np.floor(8 * np.log2(seen)).astype(np.int64), EIGHTHS), minlength=EIGHTHS + 1)
        sums = np.bincount(np.minimum(np.floor(8 * np.log2(seen)).astype(np.int64), EIGHTHS), weights=seen, minlength=EIGHTHS + 1).astype(np.int64)
        rows = len(keys) + 1
        n, shard = group["n"][0].as_py(), group["shard"][0].as_py()
        blobs = [packed(c) for c in cuts] + [packed(np.concatenate([[len(seen), (seen == 1).sum()], by_size, sums]))]
        chunk = group["chunk"].to_pylist() + [None]
        return pa.table({"chunk": pa.array(chunk, pa.int64()), "n": pa.array([n] * rows, pa.int32()), "shard": pa.array([shard] * rows, pa.int32()), "totals": pa.array(blobs, pa.binary())})

    asked = chunks.select("chunk", "pieces", "words", "ids").mapInArrow(ask, "chunk long, n int, shard int, keys binary, counts binary")
    asked = asked.repartition(order * shards, "n", "shard")  # tasks as many as shards, however Spark is set
    return stored(asked.groupBy("n", "shard").applyInArrow(answer, "chunk long, n int, shard int, totals binary"))


def backing_off(once: int, by_size: np.ndarray, sums: np.ndarray) -> float:
    """m for which the contexts' counts c, of which `sums` holds the sums of those alike, leave c * m / (c + m) to shorter n-grams, as many in all as were seen once."""
    held = by_size > 0
    size = sums[held] / by_size[held]
    low, high = math.log(LEAST), math.log(MOST)
    for _ in range(60):
        m = math.exp((low + high) / 2)
        low, high = (math.log(m), high) if float((sums[held] * m / (size + m)).sum()) < once else (low, math.log(m))
    return math.exp((low + high) / 2)


class Automaton:
    """The part of the model that a chunk can reach. State 0 knows no context; arcs are sorted by state and word."""

    def __init__(self, chunk: Chunk, totals: list[np.ndarray], tokens_: int, types: int, m: list[float]):
        self.chunk, self.words = chunk, len(totals[0])
        p = (totals[0] + ADDED) / (tokens_ + ADDED * (types + 1))
        self.base = np.log10(p)
        depth = chunk.order - 1  # of the longest context
        offset = 1 + np.cumsum([0, *map(len, totals)])
        states = [np.where(t > 0, offset[k] + np.arange(len(t)), 0) for k, t in enumerate(totals[:depth])]
        self.root_to = states[0] if depth else np.zeros(self.words, dtype=np.int64)
        self.failure = np.zeros(offset[depth], dtype=np.int64)
        self.backing = np.zeros(offset[depth])
        arcs, weights, to = [np.zeros(0, np.int64)], [np.zeros(0)], [np.zeros(0, np.int64)]
        for n in range(2, chunk.order + 1):
            at = chunk.at[n - 1]
            context, shorter, word = chunk.of[n - 2][at - 1], chunk.of[n - 2][at], chunk.of[0][at]
            p = (totals[n - 1] + m[n - 2] * p[shorter]) / (totals[n - 2][context] + m[n - 2])
            here = np.flatnonzero(totals[n - 1] > 0)
            arcs.append(states[n - 2][context[here]] * self.words + word[here])
            weights.append(np.log10(p[here]))
            to.append(states[n - 1][here] if n <= depth else states[n - 2][shorter[here]])
            if n <= depth:
                self.failure[offset[n - 1] : offset[n]] = states[n - 2][shorter]
            self.backing[offset[n - 2] : offset[n - 1]] = np.log10(m[n - 2] / (totals[n - 2] + m[n - 2]))
        code = np.concatenate(arcs)
        order = np.argsort(code)
        self.code, self.weight, self.to = code[order], np.concatenate(weights)[order], np.concatenate(to)[order]

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next states and the log-probabilities of reading a word from each state."""
        weight, to = np.zeros(len(state)), np.zeros(len(state), dtype=np.int64)
        left = np.arange(len(state))
        state = state.copy()
        while len(left):
            code = state[left] * self.words + word[left]
            at = np.searchsorted(self.code, code)
            hit = (state[left] > 0) & (self.code[np.minimum(at, len(self.code) - 1)] == code) if len(self.code) else np.zeros(len(left), dtype=bool)
            weight[left[hit]] += self.weight[at[hit]]
            to[left[hit]] = self.to[at[hit]]
            left = left[~hit]
            root = state[left] == 0
            weight[left[root]] += self.base[word[left[root]]]
            to[left[root]] = self.root_to[word[left[root]]]
            left = left[~root]
            weight[left] += self.backing[state[left]]
            state[left] = self.failure[state[left]]
        return to, weight

    def traverse(self) -> np.ndarray:
        """Each piece's log-probability."""
        c, word = self.chunk, self.chunk.of[0]
        parts = -(-(c.end - c.first) // STRETCH)
        piece = np.repeat(np.arange(len(parts)), parts)
        first = c.first[piece] + STRETCH * (np.arange(len(piece)) - np.repeat(np.cumsum(parts) - parts, parts))
        end = np.minimum(first + STRETCH, c.end[piece])
        at = np.maximum(first - max(1, c.order - 1), c.start[piece])
        longest = np.argsort(at - end, kind="stable")
        piece, first, end, at = piece[longest], first[longest], end[longest], at[longest]
        state, total = np.zeros(len(piece), dtype=np.int64), np.zeros(len(piece))
        n = len(piece)
        while n := int(np.searchsorted(at[:n] - end[:n], 0)):
            state[:n], weight = self.step(state[:n], word[at[:n]])
            total[:n] += np.where(at[:n] >= first[:n], weight, 0.0)
            at[:n] += 1
        return np.bincount(piece, weights=total, minlength=len(parts))


_PIECES = "doc long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def score(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of docs (doc_id, text); other columns, of any name, are not read.

    A text is its words, A-Z as a-z, then an end; a null, empty or blank one has the end alone. The model learns from all rows
    that are not held out, repeated ones as often as they stand there; a null id is held out. base_score takes words alone,
    score is the automaton's, with n-grams up to `order` words. Very long texts are scored in pieces and summed; ties don't arise. Without training rows
    every token has probability 1; an empty table gives no rows. N-grams are told apart by 64-bit hashes.
    """
    chunks = _chunks(docs, order)
    sums = chunks.agg(F.sum("train").alias("train"), F.sum("size").alias("size"), F.count("chunk").alias("n")).first()
    train, size, tasks = sums.train or 0, sums.size or 0, max(1, sums.n)
    shards = max(1, -(-size * order // SHARD))
    totals = _totals(chunks, order, shards)
    table = {n: np.zeros(2 * EIGHTHS + 4, dtype=np.int64) for n in range(1, order + 1)}
    stats = totals.where("chunk is null").mapInArrow(_summed, "n int, place int, value long").groupBy("n", "place").agg(F.sum("value").alias("value"))
    for r in stats.collect():
        table[r.n][r.place] = r.value
    m = [backing_off(int(table[n][1]), *np.split(table[n - 1][2:], 2)) for n in range(2, order + 1)]
    types = int(table[1][0]) - (train > 0)  # what stands before the first word is no token

    def scored(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        parts = [chunk[c][0].as_py() for c in ("pieces", "words", "ids")]
        c = Chunk(*parts, order)
        answers = answers.sort_by([("n", "ascending"), ("shard", "ascending")])
        lengths, blobs = answers["n"].to_numpy(), answers["totals"]
        found = [np.concatenate([unpacked(blobs[int(i)].as_py()) for i in np.flatnonzero(lengths == n)]) if (lengths == n).any() else np.zeros(0, np.int64) for n in range(1, order + 1)]
        machine = Automaton(c, found, train, types, m)
        cells = np.stack([c.first, c.end], axis=1).ravel()
        word = np.append(c.of[0], 0)
        known = np.add.reduceat((found[0] > 0)[word].astype(np.int64), cells)[::2]
        base = np.add.reduceat(machine.base[word], cells)[::2]
        about = c.about
        doc_id = pa.array(about["doc_id"], mask=about["no_id"].astype(bool))
        columns = [about["doc"], doc_id, about["held"].astype(bool), about["counted"], known, base, machine.traverse()]
        return pa.table(dict(zip([f.split()[0] for f in _PIECES.split(", ")], columns, strict=True)))

    asking, answers = chunks.select("chunk", "pieces", "words", "ids").repartition(tasks, "chunk"), totals.where("chunk is not null").repartition(tasks, "chunk")
    pieces = asking.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(scored, _PIECES)
    whole = [F.first("doc_id").alias("doc_id"), F.first("held_out").alias("held_out"), *[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")]]
    out = pieces.groupBy("doc").agg(*whole)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(train).cast("long").alias("train_tokens"), "base_score", "score")


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The statistics of a task's shards, added up."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for n, blob in zip(batch["n"].to_pylist(), batch["totals"].to_pylist(), strict=True):
            sums[n] = sums.get(n, 0) + unpacked(blob)
    for n, values in sums.items():
        place = np.flatnonzero(values)
        yield pa.RecordBatch.from_arrays([pa.array([n] * len(place), pa.int32()), pa.array(place, pa.int32()), pa.array(values[place], pa.int64())], names=["n", "place", "value"])


def op12_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, scored by the pairs of words in those of the training folds; nulls, ties, empty and long texts, repeated rows and tables as in score."""
    return score(documents(spark, sf_dir))
