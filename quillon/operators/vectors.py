"""A stored vector index: coarse cells, probed per question, with the exact scan kept beside it.

Cells are the nearest centroids of a spherical k-means on a bounded sample; every row is in one cell. A cell is
stored in parts of bounded size, so that one which holds a third of all rows is many tasks. A question
reads the parts of the cells nearest to it, in whose matrix products its best rows are found.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.storage import stored

#: Rows that centroids are learned from at most, cells at most, rounds, rows of a part, questions of a lot.
SAMPLE, CELLS, ROUNDS, PART, LOT = 100_000, 4096, 12, 8192, 4096
#: The recall that probing is set to, over how many hits of how many trial rows, and how many cells a question reads at least.
TARGET, HITS, TRIALS, LEAST = 0.95, 20, 256, 4
#: Distances have six digits; what rounding may make equal to the last is kept until they are ranked.
ROUNDED = 2e-6


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A column of vectors of one length as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-30)


def centroids(sample: np.ndarray, cells: int, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    """Unit centroids of a spherical k-means: seeds are spread by distance, cells that end empty take the rows worst served."""
    x, rng = unit(sample), np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[:cells]]
    for _ in range(rounds):
        dot = x @ c.T
        own, best = dot.argmax(axis=1), dot.max(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        empty = np.flatnonzero(np.bincount(own, minlength=len(c)) == 0)
        sums[empty] = x[np.argsort(best, kind="stable")[: len(empty)]]
        c = unit(sums)
    return c


@dataclass
class VectorIndex:
    """rows (cell, part, key, v), cells (cell, centroid, n, probes: how many cells a question reads)."""

    rows: DataFrame
    cells: DataFrame

    def write(self, folder: str) -> VectorIndex:
        """Overwrite the index and read it back; rows are sorted by cell, so that Parquet's statistics lead to a cell's."""
        ranged = self.rows.repartitionByRange(max(1, self.rows.rdd.getNumPartitions()), "cell", "part").sortWithinPartitions("cell", "part")
        ranged.write.mode("overwrite").parquet(f"{folder}/rows")
        self.cells.write.mode("overwrite").parquet(f"{folder}/cells")
        return VectorIndex.read(self.rows.sparkSession, folder)

    @staticmethod
    def read(spark: SparkSession, folder: str) -> VectorIndex:
        return VectorIndex(spark.read.parquet(f"{folder}/rows"), spark.read.parquet(f"{folder}/cells"))

    def add(self, vectors: DataFrame, key: str, vector: str, folder: str) -> VectorIndex:
        """The index in folder with more rows, put into the cells that there are; what it held is not written again."""
        new = stored(_placed(vectors, key, vector, self.centres()))
        sizes = self.cells.select("cell", "n").unionByName(new.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))).groupBy("cell").agg(F.sum("n").alias("n"))
        cells = stored(self.cells.select("cell", "centroid", "probes").join(sizes, "cell"))
        new.write.mode("append").parquet(f"{folder}/rows")
        cells.write.mode("overwrite").parquet(f"{folder}/cells")
        return VectorIndex.read(new.sparkSession, folder)

    def centres(self) -> np.ndarray:
        """At most CELLS centroids, in the order of their cells."""
        return np.array([r.centroid for r in self.cells.orderBy("cell").collect()])


def _placed(vectors: DataFrame, key: str, vector: str, centres: np.ndarray) -> DataFrame:
    """cell, part, key, v: each row in the cell of its nearest centroid; parts by a hash of the key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                own = (matrix(b["v"]) @ centres.T).argmax(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), b["key"], b["v"]], names=["cell", "key", "v"])

    rows = vectors.select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("v")).where(F.col("v").isNotNull())
    return rows.mapInArrow(run, "cell int, key long, v array<double>").select("cell", F.pmod(F.xxhash64("key"), F.lit(1 << 20)).cast("int").alias("part"), "key", "v")


def vector_index(vectors: DataFrame, key: str, vector: str, cells: int | None = None, sample: int = SAMPLE, target: float = TARGET, hits: int = HITS) -> VectorIndex:
    """The index of every row with a vector; ids are longs, vectors of one length. About as many cells as the square root of the rows, CELLS at most.

    The centroids are learned in one task from `sample` rows, those of the least hashes of their ids, wherever they lie; all else covers all rows.
    How many cells a question reads is set by trial, for `target` of the `hits` nearest rows.
    """
    rows = vectors.select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("v")).where(F.col("v").isNotNull())
    n = rows.count()
    cells = cells or int(min(CELLS, max(1, round(n**0.5))))
    share = min(1.0, 1.2 * sample / max(1, n))
    bound = int(share * (1 << 30))
    picked = rows.where(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < bound).orderBy(F.xxhash64("key"), "key").limit(sample)

    def fit(b: pd.DataFrame) -> pd.DataFrame:
        c = centroids(np.stack(b["v"].to_list()), cells)
        return pd.DataFrame({"cell": np.arange(len(c), dtype=np.int32), "centroid": list(c)})

    found = stored(picked.groupBy(F.lit(1).alias("one")).applyInPandas(fit, "cell int, centroid array<double>"))
    placed = stored(_placed(rows, "key", "v", np.array([r.centroid for r in found.orderBy("cell").collect()]))) if n else rows.select(F.lit(0).alias("cell"), F.lit(0).alias("part"), "key", "v")
    sizes = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    every = stored(found.join(sizes, "cell", "left").na.fill(0, ["n"]).withColumn("probes", F.lit(found.count()).cast("int")))
    index = VectorIndex(placed, every)
    return VectorIndex(placed, stored(every.withColumn("probes", F.lit(_probes(index, target, hits)).cast("int"))))


def _probes(index: VectorIndex, target: float, hits: int) -> int:
    """The least number of cells in which TRIALS rows, those of the least hashes of their ids, find the target's share of their exact neighbours among all rows."""
    trials = stored(index.rows.orderBy(F.xxhash64("key", F.lit(1)), "key").limit(TRIALS).select(F.col("key").alias("q_id"), F.col("v").alias("q_vec")))
    asked = {r.q_id: np.array(r.q_vec) for r in trials.collect()}
    if not asked:
        return 1
    centres = index.centres()
    exact = probed(index, trials, hits).select("q_id", "key").join(index.rows.select("key", "cell"), "key").collect()  # TRIALS * hits rows
    place = {q: np.argsort(np.argsort(-(centres @ v), kind="stable"), kind="stable") for q, v in asked.items()}
    needed = np.sort([place[r.q_id][r.cell] for r in exact])
    return int(needed[min(len(needed) - 1, int(np.ceil(target * len(needed))) - 1)]) + 1


def probed(index: VectorIndex, questions: DataFrame, k: int = HITS, probes: int | None = None) -> DataFrame:
    """q_id, key, distance (1 - dot, six digits), rank by distance, then key, as cosine_topk gives them, over the rows of the cells that each question reads.

    questions has q_id and q_vec (null: no hits). A question reads as many of the nearest cells as the index was set to, or `probes`, LEAST at least, and as many more as it takes to meet k rows; with as many as there are the result is exact.
    """
    held = index.cells.orderBy("cell").collect()  # at most CELLS
    if not held:
        return index.rows.sparkSession.createDataFrame([], "q_id long, key long, distance double, rank int")
    centres, sizes = np.array([r.centroid for r in held]), np.array([r.n for r in held])
    parts = np.maximum(1, -(-sizes // PART))
    count = max(LEAST, probes or held[0].probes)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            near = np.argsort(-(matrix(b["q_vec"]) @ centres.T), axis=1, kind="stable")
            wanted = np.maximum(count, 1 + (np.cumsum(sizes[near], axis=1) < k).sum(axis=1))
            row, place = np.nonzero(np.arange(len(held))[None, :] < wanted[:, None])
            cell = near[row, place]
            times = parts[cell]
            row, cell = np.repeat(row, times), np.repeat(cell, times)
            part = np.arange(len(cell)) - np.repeat(np.cumsum(times) - times, times)
            own = b.take(pa.array(row))
            yield pa.RecordBatch.from_arrays([own["q_id"], own["q_vec"], pa.array(cell.astype(np.int32)), pa.array(part.astype(np.int32))], names=["q_id", "q_vec", "cell", "at"])

    plain = questions.select(F.col("q_id").cast("long").alias("q_id"), F.col("q_vec").cast("array<double>").alias("q_vec")).where(F.col("q_vec").isNotNull())
    asked = plain.mapInArrow(ask, "q_id long, q_vec array<double>, cell int, at int")
    lots = max(1, -(-plain.count() // LOT))
    asked = asked.withColumn("lot", F.pmod(F.xxhash64("q_id"), F.lit(lots)).cast("int"))
    counts = F.broadcast(index.cells.select("cell", F.greatest(F.lit(1), F.ceil(F.col("n") / PART)).cast("int").alias("parts")))  # at most CELLS rows
    rows = index.rows.join(counts, "cell").select("cell", (F.col("part") % F.col("parts")).alias("at"), "key", "v")
    rows = rows.withColumn("lot", F.explode(F.sequence(F.lit(0), F.lit(lots - 1)))) if lots > 1 else rows.withColumn("lot", F.lit(0))
    met = rows.select(F.col("cell").alias("of_cell"), F.col("at").alias("of_at"), F.col("lot").alias("of_lot"), "key", "v")

    def best(q: pa.Table, held: pa.Table) -> pa.Table:
        if not q.num_rows or not held.num_rows:
            return pa.table({"q_id": pa.array([], pa.int64()), "key": pa.array([], pa.int64()), "dot": pa.array([], pa.float64())})
        dot = matrix(q["q_vec"]) @ matrix(held["v"]).T
        last = np.partition(dot, -k, axis=1)[:, -k] if dot.shape[1] > k else np.full(len(dot), -np.inf)
        row, col = np.nonzero(dot >= last[:, None] - ROUNDED)
        return pa.table({"q_id": q["q_id"].to_numpy()[row], "key": held["key"].to_numpy()[col], "dot": dot[row, col]})

    found = asked.groupBy("cell", "at", "lot").cogroup(met.groupBy("of_cell", "of_at", "of_lot")).applyInArrow(best, "q_id long, key long, dot double")
    near = found.select("q_id", "key", (F.round(F.lit(1.0) - F.col("dot"), 6) + F.lit(0.0)).alias("distance"))
    order = Window.partitionBy("q_id").orderBy("distance", "key")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """questions, hits, recall: the share of the exact hits (q_id, key) that were found."""
    both = exact.select("q_id", "key").join(found.select("q_id", "key", F.lit(1).alias("one")), ["q_id", "key"], "left")
    return both.agg(F.countDistinct("q_id").alias("questions"), F.count(F.lit(1)).alias("hits"), F.round(F.count("one") / F.count(F.lit(1)), 6).alias("recall"))
