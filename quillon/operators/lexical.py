"""BM25 over a stored inverted index: postings in blocks with score bounds, read by term and pruned by the current k-th score.

Documents are dealt into slices by length, which keeps the bounds of a slice's terms tight. Each slice is inverted where it lies; a term's
postings are a block for each slice that has it, so that a frequent term is many blocks. A question's bound for a
slice is the weighted sum of its terms' block bounds. The slices of the highest bounds are scored first; of the others only those whose
bound reaches the k-th score found so far are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.functions.text import terms
from quillon.storage import stored

K1, B, EPSILON = 1.5, 0.75, 0.25
#: Documents and terms of a slice at most, questions of a block, slices of each question that are scored first.
SLICE, TERMS, BLOCK, FIRST = 1024, 4_000_000, 512, 1
#: Scores are rounded to six digits; what rounding may lift to the k-th score is read too.
ROUNDED = 2e-6
_POSTINGS = "slice long, term string, bound double, places array<int>, parts array<double>"


@dataclass
class Index:
    """postings (slice, h, term, bound, places, parts: what a posting adds to a score at weight 1), slices (slice, keys, most: its largest keys), idf (term, h, idf, df) and stats (n, avgdl, mean: of the vocabulary's raw idf)."""

    postings: DataFrame
    slices: DataFrame
    idf: DataFrame
    stats: DataFrame
    cut: Callable[[Column], Column] | None = None

    PARTS = ("postings", "slices", "idf", "stats")

    def write(self, folder: str) -> Index:
        """Overwrite the index's tables and read them back. Postings are sorted by term and slice, so that Parquet's statistics lead to a term's blocks."""
        for name in self.PARTS:
            df = getattr(self, name)
            if name == "postings":
                df = df.repartitionByRange(max(1, df.rdd.getNumPartitions()), "h", "slice").sortWithinPartitions("h", "slice")
            df.write.mode("overwrite").parquet(f"{folder}/{name}")
        return Index.read(self.idf.sparkSession, folder, self.cut)

    @staticmethod
    def read(spark: SparkSession, folder: str, cut: Callable[[Column], Column] | None = None) -> Index:
        return Index(*(spark.read.parquet(f"{folder}/{name}") for name in Index.PARTS), cut)


def _inverted(words: DataFrame, avgdl: float) -> DataFrame:
    """A row for each term of each slice, and for each slice one with a null term whose places are empty and parts unused; keys go with it."""

    def slice_of(number: int, keys: list[int], lists: list[pa.Array]) -> Iterator[pa.RecordBatch]:
        sizes = np.array([len(x) for x in lists], dtype=np.int64)
        most = sorted(keys, reverse=True)
        fields = [("slice", pa.int64()), ("term", pa.string()), ("bound", pa.float64()), ("places", pa.list_(pa.int32())), ("parts", pa.list_(pa.float64())), ("keys", pa.list_(pa.int64())), ("most", pa.list_(pa.int64()))]
        schema = pa.schema(fields)
        none = [pa.nulls(1, t) for t in (pa.string(), pa.float64(), pa.list_(pa.int32()), pa.list_(pa.float64()))]
        yield pa.RecordBatch.from_arrays([pa.array([number]), *none, pa.array([keys], pa.list_(pa.int64())), pa.array([most[:1000]], pa.list_(pa.int64()))], schema=schema)
        if not sizes.sum():
            return
        held = pc.dictionary_encode(pa.concat_arrays(lists))
        code = held.indices.to_numpy().astype(np.int64) * len(keys) + np.repeat(np.arange(len(keys)), sizes)
        code, times = np.unique(code, return_counts=True)
        place, term = code % len(keys), code // len(keys)
        part = times * (K1 + 1) / (times + K1 * (1 - B + B * sizes[place] / avgdl))
        start = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]]))
        offsets = pa.array(np.append(start, len(term)).astype(np.int32))
        columns = [pa.array(np.full(len(start), number)), held.dictionary.take(pa.array(term[start])), pa.array(np.maximum.reduceat(part, start))]
        columns += [pa.ListArray.from_arrays(offsets, pa.array(place.astype(np.int32))), pa.ListArray.from_arrays(offsets, pa.array(part))]
        columns += [pa.nulls(len(start), pa.list_(pa.int64()))] * 2
        yield pa.RecordBatch.from_arrays([c.cast(f[1]) for c, f in zip(columns, fields, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, keys, lists, size = TaskContext.get().partitionId() << 32, [], [], 0
        for batch in batches:
            column = batch["terms"]
            for i, key in enumerate(batch["key"].to_pylist()):
                keys.append(key)
                lists.append(column[i].values)
                size += len(lists[-1])
                if len(keys) == SLICE or size > TERMS:
                    yield from slice_of(number, keys, lists)
                    number, keys, lists, size = number + 1, [], [], 0
        if keys:
            yield from slice_of(number, keys, lists)

    return words.select("key", "terms").mapInArrow(run, _POSTINGS + ", keys array<long>, most array<long>")


def bm25_index(docs: DataFrame, key: str, text: str, dictionary: DataFrame | None = None) -> Index:
    """The index of docs: keys are longs, each once; a null text has no terms. `dictionary` (segment.learned) gives the words of runs of Han characters.

    Negative idf is raised to EPSILON times the vocabulary's mean. Terms are found once and stored; one shuffle deals
    documents by length, after which only counts by term are shuffled.
    """
    from quillon.operators.segment import cutter

    cut = cutter(dictionary) if dictionary is not None else None
    words = stored(docs.select(F.col(key).cast("long").alias("key"), terms(F.coalesce(F.col(text).cast("string"), F.lit("")), cut).alias("terms")).withColumn("dl", F.size("terms")))
    size = words.agg(F.count(F.lit(1)).alias("n"), F.sum("dl").alias("sum")).first()
    n, avgdl = size.n, (size.sum or 0) / max(1, size.n)
    ranged = words.repartitionByRange(max(1, -(-n // SLICE)), "dl", "key").sortWithinPartitions("dl", "key")
    inverted = stored(_inverted(ranged, avgdl or 1.0))
    postings = inverted.where("term is not null").select("slice", F.xxhash64("term").alias("h"), "term", "bound", "places", "parts")
    slices = inverted.where("term is null").select("slice", "keys", "most")
    df = postings.groupBy("term").agg(F.sum(F.size("places")).cast("double").alias("df"))
    d = lambda x: F.lit(float(x)).cast("double")
    raw = stored(df.select("term", "df", (F.log(d(n) - F.col("df") + d(0.5)) - F.log(F.col("df") + d(0.5))).alias("raw")))
    mean = raw.agg(F.avg("raw")).first()[0]
    low = d(EPSILON) * F.lit(mean).cast("double")
    idf = raw.select("term", F.xxhash64("term").alias("h"), F.when(F.col("raw") < 0, low).otherwise(F.col("raw")).alias("idf"), "df")
    stats = raw.sparkSession.createDataFrame([(float(n), float(avgdl), mean)], "n double, avgdl double, mean double")
    return Index(postings, slices, idf, stats, cut)


def _question_blocks(asked: DataFrame) -> DataFrame:
    """Blocks of questions as one row each: ids, sizes and binaries of their terms' hashes and weights."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                b = whole.slice(at, BLOCK)
                flat = [b[c].flatten().to_numpy(zero_copy_only=False).tobytes() for c in ("hs", "ws")]
                columns = [pa.array([b["q_id"].to_pylist()], pa.list_(pa.int64())), pa.array([b["hs"].value_lengths().to_pylist()], pa.list_(pa.int32())), *[pa.array([x], pa.binary()) for x in flat]]
                yield pa.RecordBatch.from_arrays(columns, names=["q_ids", "sizes", "hs", "ws"])

    return asked.select("q_id", "hs", "ws").mapInArrow(run, "q_ids array<long>, sizes array<int>, hs binary, ws binary")


def _bounds(index: Index, asked: DataFrame, wanted: DataFrame) -> DataFrame:
    """q_id, slice, ub: what a document of the slice can score at most, for each question that has a term in it. Blocks of questions meet each slice's bounds."""
    own = index.postings.select("slice", "h", "bound").join(wanted, "h")
    rows = own.groupBy("slice").agg(F.array_sort(F.collect_list(F.struct("h", "bound"))).alias("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                hs, ws = np.frombuffer(r["hs"], dtype=np.int64), np.frombuffer(r["ws"])
                known, bound = np.array(r["bh"], dtype=np.int64), np.array(r["bb"])
                at = np.minimum(np.searchsorted(known, hs), len(known) - 1)
                hit = known[at] == hs
                of = np.repeat(np.arange(len(r["q_ids"])), r["sizes"])
                ub = np.bincount(of[hit], weights=np.maximum(ws[hit], 0) * bound[at[hit]], minlength=len(r["q_ids"]))
                met = np.flatnonzero(np.bincount(of[hit], minlength=len(r["q_ids"])))
                yield pa.RecordBatch.from_arrays([pa.array(np.array(r["q_ids"], dtype=np.int64)[met]), pa.array(np.full(len(met), r["slice"], dtype=np.int64)), pa.array(ub[met].astype(np.float64))], names=["q_id", "slice", "ub"])

    sides = rows.select("slice", F.transform("b", lambda x: x["h"]).alias("bh"), F.transform("b", lambda x: x["bound"]).alias("bb"))
    return stored(sides.crossJoin(_question_blocks(asked)).mapInArrow(run, "q_id long, slice long, ub double"))


def _scored(index: Index, asked: DataFrame, pairs: DataFrame, slices: DataFrame, k: int, blocks: int) -> DataFrame:
    """q_id, key, score, slice: the k best documents of each pair of question and slice, those without a shared term at 0."""
    lot = F.pmod(F.xxhash64("q_id"), F.lit(blocks)).cast("int")
    left = pairs.select("q_id", "slice").join(asked, "q_id").withColumn("lot", lot)
    needed = left.select("slice", "lot", F.explode("hs").alias("h")).distinct()
    right = needed.join(index.postings.select("slice", "h", "places", "parts"), ["slice", "h"]).select("slice", "lot", "h", "places", "parts", F.lit(None).cast("array<long>").alias("keys"), F.lit(None).cast("array<long>").alias("tags"))
    heads = left.select("slice", "lot").distinct().join(slices, "slice")
    heads = heads.select("slice", "lot", F.lit(None).cast("long").alias("h"), F.lit(None).cast("array<int>").alias("places"), F.lit(None).cast("array<double>").alias("parts"), "keys", "tags")

    blocks_of = right.unionByName(heads).select(F.col("slice").alias("at_slice"), F.col("lot").alias("at_lot"), "h", "places", "parts", "keys", "tags")

    def run(questions: pa.Table, blocks: pa.Table) -> pa.Table:
        found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        keys = tags = None
        for r in range(blocks.num_rows):
            h = blocks["h"][r].as_py()
            if h is None:
                keys = blocks["keys"][r].values.to_numpy()
                tags = blocks["tags"][r].values
                tags = tags.fill_null(0).to_numpy() if tags is not None else None
            else:
                found[h] = blocks["places"][r].values.to_numpy(), blocks["parts"][r].values.to_numpy()
        out: list[tuple[np.ndarray, ...]] = []
        for q_id, q_tag, hs, ws in zip(*[questions[c].to_pylist() for c in ("q_id", "q_tag", "hs", "ws")], strict=True):
            score = np.zeros(len(keys))
            for h, w in zip(hs, ws, strict=True):
                if h in found:
                    place, part = found[h]
                    score[place] += w * part
            score = np.round(score, 6) + 0.0
            rows = np.arange(len(keys)) if q_tag is None or tags is None else np.flatnonzero(tags == q_tag)
            if len(rows) > k:
                rows = rows[score[rows] >= np.partition(score[rows], -k)[-k]]
            best = rows[np.lexsort((-keys[rows], -score[rows]))[:k]]
            out.append((np.full(len(best), q_id), keys[best], score[best]))
        q, key, score = (np.concatenate(c) for c in zip(*out, strict=True))
        return pa.table({"q_id": q.astype(np.int64), "key": key, "score": score, "slice": np.full(len(q), questions["slice"][0].as_py())})

    return stored(left.groupBy("slice", "lot").cogroup(blocks_of.groupBy("at_slice", "at_lot")).applyInArrow(run, "q_id long, key long, score double, slice long"))


def bm25_search(index: Index, questions: DataFrame, k: int = 20, tags: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The hits, as bm25_topk gives them, and reads (blocks, read): how many blocks the questions' terms have, and how many of them were read."""
    counts = questions.select("q_id", F.explode(terms(F.coalesce(F.col("q_text"), F.lit("")), index.cut)).alias("term")).groupBy("q_id", "term").agg(F.count(F.lit(1)).alias("times"))
    pairs = F.array_sort(F.collect_list(F.struct("h", (F.col("times") * F.col("idf")).alias("w"))))
    weights = counts.join(index.idf, "term").groupBy("q_id").agg(pairs.alias("p"))
    q_tag = F.when(F.col("tag").isNotNull(), F.xxhash64("tag")) if tags is not None else F.lit(None).cast("long")
    none = F.array().cast("array<struct<h:bigint,w:double>>")
    every = questions.select(F.col("q_id").cast("long").alias("q_id"), q_tag.alias("q_tag")).join(weights, "q_id", "left").withColumn("p", F.coalesce("p", none))
    asked = stored(every.select("q_id", "q_tag", F.transform("p", lambda x: x["h"]).alias("hs"), F.transform("p", lambda x: x["w"]).alias("ws")))
    blocks = max(1, -(-asked.count() // (8 * BLOCK)))
    slices = index.slices.select("slice", "keys", F.lit(None).cast("array<long>").alias("tags"))
    most = index.slices.select("slice", F.explode(F.slice("most", 1, k)).alias("key"), F.lit(None).cast("long").alias("tag"))
    if tags is not None:
        placed = index.slices.select("slice", F.posexplode("keys").alias("place", "key")).join(tags.select("key", F.when(F.col("tag").isNotNull(), F.xxhash64("tag")).alias("tag")), "key", "left")
        placed = stored(placed)
        own = placed.groupBy("slice").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "tag"))), lambda x: x["tag"]).alias("tags"))
        slices = index.slices.select("slice", "keys").join(own, "slice")
        best = Window.partitionBy("slice", "tag").orderBy(F.desc("key"))
        most = most.unionByName(placed.where("tag is not null").withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= k).select("slice", "key", "tag"))
    bounds = _bounds(index, asked, asked.select(F.explode("hs").alias("h")).distinct())
    order = Window.partitionBy("q_id").orderBy(F.desc("ub"), "slice")
    ranked = bounds.withColumn("nth", F.row_number().over(order))
    first = _scored(index, asked, ranked.where(F.col("nth") <= FIRST), slices, k, blocks)
    place = Window.partitionBy("q_id").orderBy(F.desc("score"), F.desc("key"))
    least = first.withColumn("nth", F.row_number().over(place)).where(F.col("nth") == k).select("q_id", F.col("score").alias("least"))
    left = stored(ranked.where(F.col("nth") > FIRST).join(least, "q_id", "left").where(F.coalesce(F.col("ub") >= F.col("least") - ROUNDED, F.lit(True))).select("q_id", "slice"))
    rest = _scored(index, asked, left, slices, k, blocks)
    # what shares no term scores 0: of the slices not scored, those with the largest keys have the largest keys of all
    met = bounds.select("q_id", "slice").distinct()
    hits = first.unionByName(rest).select("q_id", "key", "score")
    short = hits.where("score > 0").groupBy("q_id").agg(F.count(F.lit(1)).alias("n"))
    short = stored(asked.select("q_id", F.col("q_tag").alias("of")).join(short, "q_id", "left").where(F.coalesce("n", F.lit(0)) < k).select("q_id", "of"))
    mean = index.stats.first()["mean"]
    heads = most.groupBy("slice", "tag").agg(F.max("key").alias("top"))
    if mean is None or mean > 0:
        heads = heads.withColumn("nth", F.row_number().over(Window.partitionBy("tag").orderBy(F.desc("top")))).where(F.col("nth") <= 2 * k)
    fill = most.join(heads.select("slice", F.col("tag").alias("head")), "slice").where(F.col("tag").eqNullSafe(F.col("head"))).select("slice", "key", "tag")
    filled = short.join(fill, F.col("of").eqNullSafe(F.col("tag"))).join(met, ["q_id", "slice"], "left_anti").select("q_id", "key", F.lit(0.0).cast("double").alias("score"))
    out = hits.unionByName(filled).withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
    many = asked.select("q_id", F.explode("hs").alias("h"))
    all_blocks = many.join(index.postings.select("h", "slice"), "h")
    chosen = ranked.where(F.col("nth") <= FIRST).select("q_id", "slice").unionByName(left)
    reads = all_blocks.join(chosen.withColumn("chosen", F.lit(1)), ["q_id", "slice"], "left").agg(F.count(F.lit(1)).alias("blocks"), F.count("chosen").alias("read"))
    return out, reads


def bm25_topk(index: Index, questions: DataFrame, k: int = 20, tags: DataFrame | None = None) -> DataFrame:
    """q_id, key, score, rank: every question has min(k, documents) rows; documents without a shared term score 0.

    questions has q_id, each once, and q_text, ids and keys are longs. With tags (key, tag), questions have a tag too and only documents of it count
    (null: all); the weights stay those of all documents. Ties go to the larger key. k is at most 1000.
    """
    return bm25_search(index, questions, k, tags)[0]
