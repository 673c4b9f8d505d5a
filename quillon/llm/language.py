"""Language identification: nearest centroid among several for each language.

A text is the TF-IDF vector of its hashed byte trigrams (lower case, runs of non-letters as
one space), of length 1. Document frequencies and centroids cover all training documents: their
trigram counts are stored once, and each round of spherical k-means is a pass over them in which
every task adds up its rows by cluster; a cluster is first cut across the direction in which its
rows, projected to few dimensions, are widest. A text whose best cosine is below the limit of its
language and length is rejected. Limits are learned from all training documents and their
beginnings, each judged by centroids without itself, and from random letters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, documents, key_filter, lean, passing, ready, shared_folder, stored, tidied

DIMENSIONS = 4096
#: Centroids of each language.
CENTROIDS = 3
#: No cluster falls below this share of its language's documents.
TINY = 0.06
#: Dimensions to which rows are projected to find where a cluster is widest, and the directions that are tried.
PROJECTED, AXES = 64, 3
#: Rounds of k-means after a cut at most; they end when no centroid's cosine with the one before is further from 1 than this.
ROUNDS, STILL = 6, 1e-4
#: Rows that are dense vectors at a time.
BLOCK = 64
#: A cluster is dropped as mislabelled if it is so near to another language, as a part of what that language's own rows are, and nearer than to the rest of its own.
OTHER = 0.75
#: The share of a language's training documents and beginnings that may lie below its limit (mislabelled ones).
BELOW = 0.002
#: A limit is this much of the highest cosine of random letters, where labelled documents are APART times as high, or else this part of their least.
ABOVE_NOISE, APART, REJECT = 1.25, 2, 0.9
#: A language's own limit needs so many texts of a length.
LEAST_TEXTS = 20
NONE = "und"
_MAP = np.full(256, 32, dtype=np.uint8)
_MAP[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_MAP[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
_MAP[128:] = np.arange(128, 256)


@dataclass
class Model:
    languages: list[str]
    of: np.ndarray  # the language of each centroid
    centroids: np.ndarray
    idf: np.ndarray
    limits: np.ndarray  # for each language and band of lengths


def trigram_counts(texts: list[str], dimensions: int = DIMENSIONS) -> np.ndarray:
    """A row of hashed trigram counts for each text, over all of it."""
    out = np.zeros((len(texts), dimensions), dtype=np.float32)
    for i, t in enumerate(texts):
        b = _MAP[np.frombuffer(f" {t} ".encode(), dtype=np.uint8)]
        keep = np.ones(len(b), dtype=bool)
        keep[1:] = (b[1:] != 32) | (b[:-1] != 32)
        b = b[keep].astype(np.uint32)
        if len(b) > 2:
            code = b[:-2] | (b[1:-1] << np.uint32(8)) | (b[2:] << np.uint32(16))
            out[i] = np.bincount((code * np.uint32(2654435761)) >> np.uint32(32 - int(np.log2(dimensions))), minlength=dimensions)
    return out


def bands(counts: np.ndarray) -> np.ndarray:
    """The band of lengths of each text: the binary digits of its number of different trigrams."""
    return np.frexp((counts > 0).sum(axis=1).astype(np.float64))[1]


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(counts) * idf
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    return np.divide(v, norm, out=np.zeros_like(v), where=norm > 0)


def _packed(counts: np.ndarray) -> list[bytes]:
    """Each row as a bit for each slot and the counts that are not 0, as bytes or, if one is above 255, as four each."""
    out = []
    for mask, row in zip(np.packbits(counts > 0, axis=1), counts, strict=True):
        have = row[row > 0]
        out.append(mask.tobytes() + have.astype(np.uint8 if have.max(initial=0) < 256 else "<u4").tobytes())
    return out


def _unpacked(rows: list[bytes], dimensions: int) -> np.ndarray:
    out = np.zeros((len(rows), dimensions), dtype=np.float32)
    for i, x in enumerate(rows):
        at = np.flatnonzero(np.unpackbits(np.frombuffer(x, dtype=np.uint8, count=dimensions // 8)))
        have = x[dimensions // 8 :]
        out[i, at] = np.frombuffer(have, dtype=np.uint8 if len(have) == len(at) else "<u4")
    return out


def _projection(dimensions: int) -> np.ndarray:
    return np.random.default_rng(0).choice(np.array([-1, 1], dtype=np.float32), (dimensions, PROJECTED)) / np.float32(PROJECTED**0.5)


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=-1, keepdims=True), 1e-12)


@dataclass
class Rule:
    """Which cluster of its language a row is of: that of the nearest centroid, of which one may be cut in two across a projected direction."""

    centroids: np.ndarray
    cut: tuple[int, np.ndarray, float] | None = None

    def of(self, v: np.ndarray, projection: np.ndarray) -> np.ndarray:
        near = (v @ self.centroids.T).argmax(axis=1)
        if self.cut:
            j, along, middle = self.cut
            near[(near == j) & (v @ projection @ along > middle)] = len(self.centroids)
        return near


@dataclass
class Part:
    """A cluster: its number of rows, their sum, and the sums of their projections and of these one's products."""

    n: int
    total: np.ndarray
    projected: np.ndarray
    products: np.ndarray


class Clusters:
    """A language's clusters: `parts` were made by `rule`; `next` is the rule of the pass to come, or None."""

    def __init__(self, rule: Rule, parts: list[Part], most: int):
        self.rule, self.parts, self.most, self.axis, self.rounds = rule, parts, most, 0, 0
        self.n = sum(x.n for x in parts)
        self.least = max(1, TINY * self.n)
        self.next = self.cut()

    def centroids(self) -> np.ndarray:
        return _unit(np.stack([x.total for x in self.parts])).astype(np.float32)

    def cut(self) -> Rule | None:
        """The largest cluster's next cut, if it is large enough and more clusters are wanted."""
        j = int(np.argmax([x.n for x in self.parts]))
        part = self.parts[j]
        if len(self.parts) >= self.most or part.n < 2 * self.least or self.axis == AXES:
            return None
        mean = part.projected / part.n
        along = np.linalg.eigh(part.products / part.n - np.outer(mean, mean))[1][:, -1 - self.axis]
        along = along * np.sign(along[np.abs(along).argmax()])
        return Rule(self.centroids(), (j, along.astype(np.float32), float(mean @ along)))

    def take(self, parts: dict[int, Part]) -> None:
        """The sums that the rule `next` gave."""
        was_cut, rule = self.next.cut is not None, self.next
        k = len(rule.centroids) + was_cut
        small = min(parts[j].n if j in parts else 0 for j in range(k)) < self.least
        if small and was_cut:
            self.axis += 1
            self.next = self.cut()
            return
        still = small
        if not small:
            before = self.centroids()
            self.rule, self.parts = rule, [parts[j] for j in range(k)]
            still = not was_cut and float((before * self.centroids()).sum(axis=1).min()) > 1 - STILL
        self.axis, self.rounds = 0, 0 if was_cut else self.rounds + 1
        self.next = self.cut() if still or self.rounds == ROUNDS else Rule(self.centroids())


def _sums(seen: DataFrame, idf: np.ndarray, rules: dict[str, Rule] | None) -> dict[str, dict[int, Part]]:
    """One pass over all rows (lang, counts) of the languages that have a rule; without rules every language is one cluster.

    A task gives a row for each cluster that it met, and the driver gets one for each cluster.
    """
    held = seen.sparkSession.sparkContext.broadcast((idf, rules))
    schema = "lang string, cluster int, task int, n long, total binary, projected binary, products binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        lean()
        idf, rules = held.value
        d, sums = len(idf), {}
        projection, one = _projection(d), Rule(np.zeros((1, d), dtype=np.float32))
        for batch in batches:
            langs, counts = np.array(batch["lang"].to_pylist(), dtype=object), batch["counts"]
            for lang in sorted(set(langs)):
                if rules is not None and lang not in rules:
                    continue
                rows = counts.take(pa.array(np.flatnonzero(langs == lang))).to_pylist()
                for k in range(0, len(rows), BLOCK):
                    v = vectors(_unpacked(rows[k : k + BLOCK], d), idf)
                    near, flat = (rules[lang] if rules is not None else one).of(v, projection), (v @ projection).astype(np.float64)
                    for j in np.unique(near):
                        s = sums.setdefault((lang, int(j)), [0, np.zeros(d), np.zeros(PROJECTED), np.zeros((PROJECTED, PROJECTED))])
                        inside = near == j
                        s[0] += int(inside.sum())
                        s[1] += v[inside].sum(axis=0, dtype=np.float64)
                        s[2] += flat[inside].sum(axis=0)
                        s[3] += flat[inside].T @ flat[inside]
        task = TaskContext.get().partitionId()
        for (lang, j), (n, *more) in sums.items():
            yield pa.RecordBatch.from_pylist([{"lang": lang, "cluster": j, "task": task, "n": n, "total": more[0].tobytes(), "projected": more[1].tobytes(), "products": more[2].tobytes()}], arrow)

    arrow = pa.schema([("lang", pa.string()), ("cluster", pa.int32()), ("task", pa.int32()), ("n", pa.int64()), ("total", pa.binary()), ("projected", pa.binary()), ("products", pa.binary())])

    def added(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("task")  # always added up in the same order
        one = rows.iloc[:1].copy()
        one["n"] = rows["n"].sum()
        for name in ("total", "projected", "products"):
            one[name] = [sum(np.frombuffer(x) for x in rows[name]).tobytes()]
        return one

    out: dict[str, dict[int, Part]] = {}
    for r in seen.mapInArrow(tidied(run), schema).groupBy("lang", "cluster").applyInPandas(added, schema).collect():
        total, projected, products = (np.frombuffer(x) for x in (r.total, r.projected, r.products))
        out.setdefault(r.lang, {})[r.cluster] = Part(r.n, total, projected, products.reshape(PROJECTED, PROJECTED))
    return out


def clusters(seen: DataFrame, idf: np.ndarray, most: int) -> dict[str, Clusters]:
    """Spherical k-means of each language's rows, all of them, by cuts of the largest cluster, without chance."""
    first = Rule(np.zeros((1, len(idf)), dtype=np.float32))
    out = {lang: Clusters(first, [parts[0]], most) for lang, parts in _sums(seen, idf, None).items()}
    while rules := {lang: c.next for lang, c in out.items() if c.next}:
        found = _sums(seen, idf, rules)
        for lang in rules:
            out[lang].take(found[lang])
    return out


def mislabelled(part: Part, own: Clusters, others: list[tuple[np.ndarray, float]]) -> bool:
    """If the rows of a cluster read as another language: nearer to its mean than to their own language's other rows.

    Others are the mean of each other language, of length 1, and its rows' mean cosine with it. A cluster of
    half its language's rows stays.
    """
    if 2 * part.n >= own.n:
        return False
    mean = part.total / part.n
    usual_here = float(mean @ _unit(sum(x.total for x in own.parts) - part.total))
    return any(float(mean @ m) > max(usual_here, OTHER * usual) for m, usual in others)


def _once(train: DataFrame) -> DataFrame:
    """Rows that repeat, with id, text and language, are one. Keys are shuffled, and only the texts of rows that may repeat."""
    keyed = train.withColumn("key", F.xxhash64("lang", "doc_id", "text"))
    again = stored(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"))
    if again.isEmpty():
        return train
    table = key_filter(again, "key")

    def split(hit: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(passing(table, batch["key"]) == hit))

        return run

    twice = keyed.mapInArrow(split(True), keyed.schema).dropDuplicates(["lang", "doc_id", "text"])
    return keyed.mapInArrow(split(False), keyed.schema).union(twice).drop("key")


def fit(train: DataFrame, centroids: int = CENTROIDS, dimensions: int = DIMENSIONS) -> Model:
    """From all rows (doc_id, text, lang), all with a language. Without any, the model knows no language.

    Null texts and texts without a letter teach nothing, very long ones are read whole, repeated rows are one,
    ties go to the cluster that comes first; other columns, of any name, are not read.
    """
    ready(train.sparkSession)
    train = _once(train.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string")).where(F.col("text").rlike(r"\p{L}")))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for batch in batches:
            counts = trigram_counts(batch["text"].to_pylist(), dimensions)
            yield pa.RecordBatch.from_arrays([batch["lang"], pa.array(_packed(counts), pa.binary())], names=["lang", "counts"])

    folder = shared_folder(train.sparkSession)
    seen = stored(train.select("lang", "text").mapInArrow(tidied(features), "lang string, counts binary"), folder)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(dimensions, dtype=np.int64), 0
        for batch in batches:
            for x in batch["counts"].to_pylist():
                df += np.unpackbits(np.frombuffer(x, dtype=np.uint8, count=dimensions // 8))
            n += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.append(np.arange(dimensions), -1)), pa.array(np.append(df, n))], names=["slot", "df"])

    counted = seen.mapInArrow(tidied(frequencies), "slot long, df long").groupBy("slot").agg(F.sum("df").alias("df"))
    df = {r.slot: r.df for r in counted.collect()}  # dimensions + 1 rows
    n = df.get(-1, 0)
    idf = np.array([np.log((1 + n) / (1 + df.get(i, 0))) + 0.05 for i in range(dimensions)], dtype=np.float32)
    found = clusters(seen, idf, centroids)
    discard(train.sparkSession, folder)
    languages = sorted(found)
    sums = {x: sum(p.total for p in found[x].parts) for x in languages}
    means = {x: (_unit(sums[x]), float(np.linalg.norm(sums[x])) / found[x].n) for x in languages}
    kept, homes = [], {}  # the clusters that stay, and the place of each of a language's among them
    for i, x in enumerate(languages):
        others = [m for y, m in means.items() if y != x]
        stays = [not mislabelled(p, found[x], others) for p in found[x].parts]
        homes[x] = found[x].rule, np.where(stays, len(kept) + np.cumsum(stays) - 1, -1)
        kept += [(i, p.total) for p, s in zip(found[x].parts, stays, strict=True) if s]
    totals = np.stack([t for _, t in kept]) if kept else np.zeros((0, dimensions))
    of = np.array([i for i, _ in kept], dtype=np.int64)
    model = Model(languages, of, _unit(totals).astype(np.float32), idf, np.zeros((len(languages), dimensions.bit_length() + 1)))
    if kept:
        model.limits = limits(train.select("lang", "text"), model, totals, homes)
    return model


def noise(model: Model, texts: int = 64) -> np.ndarray:
    """The highest cosine of texts of random letters, 2 to 65536 of them, in each band; always the same texts."""
    rng, high = np.random.default_rng(0), np.zeros(model.limits.shape[1])
    letters = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz      ", dtype=np.uint8)
    for k in range(1, 17):
        counts = trigram_counts([rng.choice(letters, 1 << k).tobytes().decode() for _ in range(texts)], len(model.idf))
        np.maximum.at(high, bands(counts), (vectors(counts, model.idf) @ model.centroids.T).max(axis=1))
    return high


def limits(train: DataFrame, model: Model, totals: np.ndarray, homes: dict[str, tuple[Rule, np.ndarray]]) -> np.ndarray:
    """The least cosine of a text that is kept, by the language that it is nearest to and its band.

    It lies somewhat above random letters if all but the share BELOW of all training texts and their beginnings are well
    beyond these. If not, as for short texts, it lies below every one of them in any language. Where a language has too few texts of a band, those of all
    languages decide, and where these are too few as well, those of the band below do. A text is judged as if it were not among
    the rows of its centroid: `totals` are the sums of each centroid's rows, `homes` the rule of each language's clusters and their centroids.
    """
    held, steps = train.sparkSession.sparkContext.broadcast((model, totals.astype(np.float32), (totals**2).sum(axis=1), homes)), 4096

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        lean()
        m, totals, squares, homes = held.value
        letter, projection = regex.compile(r"\p{L}"), _projection(len(m.idf))
        tally: dict[int, int] = {}
        high = m.limits.shape[1]
        for batch in batches:
            for lang, t in zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True):
                starts = {x for x in (t[: 1 << k] for k in range(2, 12)) if letter.search(x)} - {t}
                counts = trigram_counts([t, *sorted(starts)], len(m.idf))
                v = vectors(counts, m.idf)
                c = v @ m.centroids.T
                rule, places = homes[lang]
                home = places[rule.of(v[:1], projection)[0]]
                if home >= 0:  # the centroid without this text
                    left = squares[home] - 2 * float(v[0] @ totals[home]) + float(v[0] @ v[0])
                    c[:, home] = (v @ totals[home] - v @ v[0]) / np.sqrt(left) if left > 0.5 else 0
                step = np.floor(np.clip(c.max(axis=1), 0, 1) * steps).astype(np.int64)
                for x in ((m.of[c.argmax(axis=1)] * high + bands(counts)) * (steps + 1) + step).tolist():
                    tally[x] = tally.get(x, 0) + 1
        code = np.array(list(tally), dtype=np.int64)
        columns = code // (steps + 1) // high, code // (steps + 1) % high, code % (steps + 1), np.array(list(tally.values()), dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=["of", "band", "step", "n"])

    tallies = train.mapInArrow(tidied(scores), "of long, band long, step long, n long").groupBy("of", "band", "step")
    found = tallies.agg(F.sum("n").alias("n")).collect()  # bounded by languages, bands and steps
    seen = np.zeros((*model.limits.shape, steps + 1), dtype=np.int64)
    for r in found:
        seen[r.of, r.band, r.step] = r.n

    high, out = noise(model), np.zeros(model.limits.shape)
    for i in range(len(out)):
        low = least = 0.0
        for band in range(1, out.shape[1]):
            every = seen[:, band].sum(axis=0)
            own = seen[i, band] if seen[i, band].sum() >= LEAST_TEXTS else every
            if own.sum() >= LEAST_TEXTS:
                low, least = float((own.cumsum() > BELOW * own.sum()).argmax()) / steps, float((every > 0).argmax()) / steps
            out[i, band] = ABOVE_NOISE * high[band] if low >= APART * high[band] else min(REJECT * least, ABOVE_NOISE * high[band])
    return out


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score (cosine, 0 to 1) and rejected, by the text alone.

    Null text and text without a letter is `und`, score 0 and rejected, as is every text if the model
    knows no language. Ties go to the language that comes first. Very long texts are read whole, repeated rows
    judged alike, an empty table gives no rows; other columns, of any name, are not read. One pass, no shuffle.
    """
    return docs.select("doc_id", "text").mapInArrow(tidied(_predictor(docs.sparkSession, model, False)), "doc_id long, lang_pred string, score double, rejected boolean")


def _predictor(spark: SparkSession, model: Model, keep: bool):
    ready(spark)
    held = spark.sparkContext.broadcast(model)  # dimensions x centroids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        lean()
        m, letter = held.value, regex.compile(r"\p{L}")
        for batch in batches:
            texts = [t or "" for t in batch["text"].to_pylist()]
            known = np.array([bool(letter.search(t)) for t in texts], dtype=bool) & bool(len(m.of))
            best, score, limit = np.zeros(len(texts), dtype=np.int64), np.zeros(len(texts)), np.zeros(len(texts))
            for k in range(0, len(texts), 64):
                if len(m.of):
                    counts = trigram_counts(texts[k : k + 64], len(m.idf))
                    c = vectors(counts, m.idf) @ m.centroids.T
                    best[k : k + 64], score[k : k + 64] = m.of[c.argmax(axis=1)], c.max(axis=1)
                    limit[k : k + 64] = m.limits[best[k : k + 64], bands(counts)]
            score = np.where(known, np.clip(score, 0, 1), 0.0)
            rejected = ~known | (score < limit)
            if keep:
                yield batch.filter(pa.array(~rejected))
            else:
                names = [m.languages[b] if k else NONE for b, k in zip(best, known, strict=True)]
                yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(names, pa.string()), pa.array(score), pa.array(rejected)], names=["doc_id", "lang_pred", "score", "rejected"])

    return run


def held_out(column: str = "doc_id"):
    return F.crc32(F.col(column).cast("string")) % 4 == 2


def training_rows(docs: DataFrame) -> DataFrame:
    """Labelled rows that are not held out; a null id is none of the held-out ones."""
    return docs.where(F.col("lang").isNotNull() & ~F.coalesce(held_out(), F.lit(False)))


def known_language(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, as they are and with all their columns, of any name, that the model doesn't reject.

    Null texts and texts without a letter go, as in predict; repeated rows stay or go together, very long texts are read whole, an empty table stays empty.
    """
    return docs.mapInArrow(tidied(_predictor(docs.sparkSession, model, True)), docs.schema)


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents; nulls, empty and long texts, ties and repeated rows as in predict."""
    docs = documents(spark, sf_dir)
    p = predict(docs, fit(training_rows(docs)))
    return p.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")
