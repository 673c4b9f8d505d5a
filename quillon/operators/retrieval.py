"""Lexical and vector retrieval over batches of questions, their fusion, and search with filters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.functions.text import terms
from quillon.operators.lexical import Index, bm25_index, bm25_topk  # noqa: F401
from quillon.operators.vectors import PART, matrix
from quillon.storage import numbered, stored

PER_PATH, RRF_K = 20, 60


def hashed_vectors(rows: DataFrame, key: str, text: str, width: int = 64) -> DataFrame:
    """key, embedding (array<double> of length 1, or null without terms): counts of terms, in lower case, hashed to `width` places.

    A stand-in where no embedding model is at hand; built-in functions only.
    """
    place = F.conv(F.substring(F.md5("term"), 1, 8), 16, 10).cast("long") % width
    one = rows.select(F.col(key).alias("key"), F.explode_outer(terms(F.lower(F.coalesce(F.col(text), F.lit(""))))).alias("term"))
    counts = one.groupBy("key", place.alias("place")).agg(F.count("term").cast("double").alias("n"))
    held = counts.groupBy("key").agg(F.map_from_entries(F.collect_list(F.when(F.col("place").isNotNull(), F.struct("place", "n")))).alias("m"), F.sqrt(F.sum(F.when(F.col("place").isNotNull(), F.col("n") * F.col("n")))).alias("norm"))
    vector = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(width - 1).cast("long")), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)) / F.col("norm"))
    return held.select(F.col("key").alias(key), F.when(F.col("norm") > 0, vector).alias("embedding"))


def _blocks(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """Each Arrow batch as one row: ids and the matrix of its vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                flat = b["v"].flatten().to_numpy(zero_copy_only=False).astype("<f8").tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([b["k"].to_pylist()], pa.list_(pa.int64())), pa.array([flat], pa.binary())], names=["ids", "flat"])

    return rows.select(F.col(key).cast("long").alias("k"), F.col(vector).cast("array<double>").alias("v")).where(F.col("v").isNotNull()).mapInArrow(run, "ids array<long>, flat binary")


def cosine_topk(vectors: DataFrame, questions: DataFrame, key: str, vector: str, k: int = PER_PATH, tagged: str | None = None) -> DataFrame:
    """q_id, key, distance (1 - dot, six digits), rank by distance, then key; questions has q_id and q_vec, ids are longs.

    Blocks of questions meet blocks of vectors in matrix products; each pair of blocks gives its best,
    which are ranked. With `tagged`, a column of both sides, only vectors of the question's tag count (null: any).
    """
    def hits(q: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        dot = q @ v.T
        last = np.partition(dot, -k, axis=1)[:, -k] if dot.shape[1] > k else np.full(len(q), -np.inf)
        row, col = np.nonzero(dot >= last[:, None] - 2e-6)  # what rounding may make equal to the last
        return row, col, dot[row, col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for q_ids, q_flat, ids, flat in zip(*(b[c].to_pylist() for c in ("q_ids", "q_flat", "ids", "flat")), strict=True):
                row, col, dot = hits(*(np.frombuffer(f).reshape(len(i), -1) for f, i in ((q_flat, q_ids), (flat, ids))))
                yield pa.RecordBatch.from_arrays([pa.array(np.array(q_ids)[row]), pa.array(np.array(ids)[col]), pa.array(dot)], names=["q_id", "key", "dot"])

    free = questions if tagged is None else questions.where(F.col(tagged).isNull())
    found = _blocks(vectors, key, vector).crossJoin(_blocks(free, "q_id", "q_vec").toDF("q_ids", "q_flat")).mapInArrow(run, "q_id long, key long, dot double")
    if tagged is not None:
        # a tag's vectors are dealt into parts, to each of which its questions go, in lots
        plain = lambda d, i, v: d.where(F.col(tagged).isNotNull() & F.col(v).isNotNull()).select(F.col(tagged).alias("tag"), F.col(i).cast("long").alias("id"), F.col(v).cast("array<double>").alias("v"))
        rows, asked = plain(vectors, key, vector), plain(questions, "q_id", "q_vec")
        sizes = stored(rows.groupBy("tag").agg(F.ceil(F.count(F.lit(1)) / PART).alias("parts")).join(asked.groupBy("tag").agg(F.ceil(F.count(F.lit(1)) / PART).alias("lots")), "tag"))
        every = lambda n, c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1)).alias(c)
        own = lambda n, c: F.pmod(F.xxhash64("id"), F.col(n)).alias(c)
        left = asked.join(sizes, "tag").select("tag", own("lots", "lot"), every("parts", "part"), "id", "v")
        right = rows.join(sizes, "tag").select(F.col("tag").alias("of"), own("parts", "of_part"), every("lots", "of_lot"), "id", "v")

        def within(q: pa.Table, v: pa.Table) -> pa.Table:
            if not q.num_rows or not v.num_rows:
                return pa.table({c: pa.array([], t) for c, t in (("q_id", pa.int64()), ("key", pa.int64()), ("dot", pa.float64()))})
            row, col, dot = hits(matrix(q["v"]), matrix(v["v"]))
            return pa.table({"q_id": q["id"].to_numpy()[row], "key": v["id"].to_numpy()[col], "dot": dot})

        found = found.unionByName(left.groupBy("tag", "part", "lot").cogroup(right.groupBy("of", "of_part", "of_lot")).applyInArrow(within, "q_id long, key long, dot double"))
    order = Window.partitionBy("q_id").orderBy("distance", "key")
    near = found.select("q_id", "key", (F.round(F.lit(1.0) - F.col("dot"), 6) + F.lit(0.0)).alias("distance"))
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def rrf(first: DataFrame, second: DataFrame, k: int = 10, constant: int = RRF_K) -> DataFrame:
    """Reciprocal-rank fusion of two (q_id, key, rank): q_id, key, score, rank. On ties the first path's order, then the second's."""
    one = lambda c: F.lit(1.0).cast("double") / (F.lit(constant) + F.col(c))
    both = first.select("q_id", "key", F.col("rank").alias("r1")).join(second.select("q_id", "key", F.col("rank").alias("r2")), ["q_id", "key"], "full_outer")
    both = both.withColumn("score", F.round(F.coalesce(one("r1"), F.lit(0.0)) + F.coalesce(one("r2"), F.lit(0.0)), 9))
    order = Window.partitionBy("q_id").orderBy(F.desc("score"), F.col("r1").asc_nulls_last(), F.col("r2").asc_nulls_last())
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("q_id", "key", "score", "rank")


def search(index: Index, vectors: DataFrame, questions: DataFrame, key: str, vector: str, tau: float, k: int = 5, tagged: str | None = None) -> DataFrame:
    """The search tool: q_id, rank, key, score, distance, top1, low_confidence.

    questions has q_id, q_text, q_vec and, with `tagged`, the tag to which a question is confined (null: none): vectors are
    filtered before ranking, lexical hits after scoring, under the weights of all documents. What only the lexical
    path found gets its distance too; top1 is the nearest distance within the filter.
    """
    tags = None if tagged is None else vectors.select(F.col(key).alias("key"), F.col(tagged).alias("tag"))
    near = cosine_topk(vectors, questions, key, vector, tagged=tagged)
    fused = rrf(near, bm25_topk(index, questions if tagged is None else questions.withColumn("tag", F.col(tagged)), tags=tags), k)
    dot = F.aggregate(F.zip_with(F.col("_v").cast("array<double>"), F.col("q_vec").cast("array<double>"), lambda a, b: a * b), F.lit(0.0), lambda t, x: t + x)
    met = fused.join(vectors.select(F.col(key).alias("key"), F.col(vector).alias("_v")), "key", "left").join(questions.select("q_id", "q_vec"), "q_id")
    top = near.groupBy("q_id").agg(F.min("distance").alias("top1"))
    out = met.withColumn("distance", F.round(F.lit(1.0) - dot, 6) + F.lit(0.0)).join(top, "q_id", "left")
    return out.select("q_id", "rank", "key", "score", "distance", "top1", (F.col("top1") > tau).alias("low_confidence"))


def gate(ranked: DataFrame, tau: float) -> DataFrame:
    """q_id, top1, rejected: whether the nearest hit is farther than tau."""
    return ranked.groupBy("q_id").agg(F.min("distance").alias("top1")).withColumn("rejected", F.col("top1") > tau)


def hit_metrics(ranked: DataFrame, gold: DataFrame, by: list[str], ks: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """Recall@k, MRR and mean hit rank by GROUPING SETS ((), (each of by)); gold has q_id, targets, and by."""
    return rates(first_hits(ranked, gold, by), by, ks)


def rates(hit: DataFrame, by: list[str], ks: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """Recall@k, MRR and mean hit rank of first hits (q_id, by, hit; null is a miss), over all and by each of by."""
    recall: list[Column] = [F.round(F.avg(F.coalesce((F.col("hit") <= k).cast("double"), F.lit(0.0))), 6).alias(f"recall_{k}") for k in ks]
    more = [F.round(F.avg(F.coalesce(F.lit(1.0) / F.col("hit"), F.lit(0.0))), 6).alias("mrr"), F.round(F.avg("hit"), 6).alias("mean_rank")]
    return hit.groupingSets([[], *[[F.col(b)] for b in by]], *[F.col(b) for b in by]).agg(F.count(F.lit(1)).alias("n"), *recall, *more)


def first_hits(ranked: DataFrame, gold: DataFrame, by: list[str]) -> DataFrame:
    """q_id, by, hit: the best rank of any target; null is a miss."""
    return gold.withColumn("key", F.explode("targets")).join(ranked, ["q_id", "key"], "left").groupBy("q_id", *by).agg(F.min("rank").alias("hit"))


def first_hits_alike(ranked: DataFrame, questions: DataFrame, rows: DataFrame, label: str) -> DataFrame:
    """q_id, label, hit: the best rank of another row of the question's label, where any has one. questions (q_id, label) are of the rows (key, label).

    Labels are read for the hits alone; a label's rows are counted, never listed.
    """
    counts = rows.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    q = questions.select("q_id", label).join(counts, label).where(F.col("_n") > 1).select("q_id", label)
    met = ranked.where(F.col("key") != F.col("q_id")).select("q_id", "key", "rank").join(rows.select("key", F.col(label).alias("_of")), "key").join(q, "q_id")
    best = met.where(F.col("_of") == F.col(label)).groupBy("q_id").agg(F.min("rank").alias("hit"))
    return q.join(best, "q_id", "left")


def nearest_by(rows: DataFrame, questions: DataFrame, value: str, k: int = PER_PATH) -> DataFrame:
    """q_id, key, rank: the k rows (key, value) whose value is nearest to a question's (q_id, value), ties to the smaller key. Nulls take no part.

    Rows and questions are numbered together by ranges of the value, once for either side; a question then joins the places beside its own.
    """
    plain = rows.where(F.col(value).isNotNull()).select(F.col(value).alias("v"), F.col("key"), F.lit(None).cast("long").alias("q_id"))
    asked = questions.where(F.col(value).isNotNull()).select(F.col(value).alias("v"), F.lit(None).cast("long").alias("key"), F.col("q_id").cast("long").alias("q_id"))
    found = None
    for below in (True, False):
        # rows below: larger keys first, so that the smallest of the nearest value is next to the question; those of its own value lie above
        order = [F.col("v"), F.col("q_id").isNull().cast("int"), F.desc("key") if below else F.asc("key"), F.col("q_id")]
        all_ = numbered(plain.unionByName(asked), [], order, "at")
        at = numbered(all_.where("q_id is null").select("v", "key", "at"), [], ["at"], "place")
        before = all_.where("q_id is not null").select("q_id", "v", "at")
        # the rows before a question are its place less the questions before it
        q = numbered(before, [], ["at"], "nth").select("q_id", F.col("v").alias("w"), (F.col("at") - F.col("nth")).alias("n"))
        places = F.sequence(F.col("n") - (k - 1), F.col("n")) if below else F.sequence(F.col("n") + 1, F.col("n") + k)
        part = q.withColumn("place", F.explode(places)).join(at.select("place", "v", "key"), "place").select("q_id", "key", F.abs(F.col("v") - F.col("w")).alias("d"))
        found = part if found is None else found.unionByName(part)
    nearest = Window.partitionBy("q_id").orderBy("d", "key")
    return found.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k).select("q_id", "key", "rank")


def worse(base: DataFrame, other: DataFrame) -> DataFrame:
    """q_id, base, other: questions whose hit (q_id, hit) came later or was missed in the other run."""
    both = base.select("q_id", F.col("hit").alias("base")).join(other.select("q_id", F.col("hit").alias("other")), "q_id")
    return both.where(F.col("base").isNotNull() & (F.col("other").isNull() | (F.col("other") > F.col("base"))))


def reranked(ranked: DataFrame, texts: DataFrame, questions: DataFrame, scorer, k: int = 10) -> DataFrame:
    """The ranking by a scorer's score (a pandas function of question and text), of which the first k stay."""
    score = F.pandas_udf(scorer, "double")
    rows = ranked.join(texts, "key").join(questions.select("q_id", "q_text"), "q_id").withColumn("score", score("q_text", "text"))
    order = Window.partitionBy("q_id").orderBy(F.desc("score"), "rank")
    return rows.withColumn("new_rank", F.row_number().over(order)).where(F.col("new_rank") <= k).select("q_id", "key", "score", F.col("new_rank").alias("rank"))
