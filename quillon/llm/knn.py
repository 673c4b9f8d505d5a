"""Exact top-k by inner product: a Voronoi k-nearest-neighbour join.

With one more component that brings every vector to the greatest length, the largest inner
product is the least Euclidean distance. Queries and data are grouped by their nearest pivot;
from per-cell summaries (counts, radii, the k least distances) follows a bound on each query
group's k-th distance, and a vector goes only to the groups whose bound it may meet. Groups are
divided into blocks of queries and slices of data of bounded size, solved by matrix products
of exact integers, and the slices' best are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ready, stored

K, PIVOTS, GROUPS = 5, 64, 6
#: Pivots grow as the square root of the vectors, up to so many (they and their summaries are what the driver holds); a group of queries for every so many pivots.
MOST_PIVOTS, PER_GROUP = 4096, 10
#: Least distances that the summary of a cell holds.
SUMMARY = 64
#: Queries of a block and vectors of a slice.
BLOCK, SLICE = 2048, 16_384


def quantised(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding", scale: int = 256) -> DataFrame:
    """id, v (array of longs): floor(scale * x) of each component; rows with a null id, vector or component, or one that isn't finite, go."""
    x = F.col(f"`{column}`")
    odd = F.exists(x, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    whole = F.transform(x, lambda c: F.floor(F.lit(scale) * c.cast("double")))
    return vectors.where(F.col(f"`{id_column}`").isNotNull() & x.isNotNull() & ~odd).select(F.col(f"`{id_column}`").cast("long").alias("id"), whole.alias("v"))


def _matrix(rows: pa.Array, width: int) -> np.ndarray:
    """Rows of unequal lengths are filled with zeros."""
    lengths = np.diff(rows.offsets.to_numpy())
    flat = rows.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(rows), width), dtype=np.int64)
    out[np.arange(width)[None, :] < lengths[:, None]] = flat
    return out


class Cells:
    """Pivots and the distances of vectors to them, in the space with one more component."""

    def __init__(self, pivots: np.ndarray, top: float):
        self.p, self.top = pivots.astype(np.float64), top
        norm = (self.p**2).sum(axis=1)
        self.extra, self.norm = np.sqrt(np.maximum(top - norm, 0)), norm

    def nearest(self, v: np.ndarray, query: bool) -> tuple[np.ndarray, np.ndarray]:
        """The pivot of each vector and its distance. Data are lengthened to the greatest length, queries are not."""
        x = v.astype(np.float64)
        norm = (x**2).sum(axis=1)
        cross = x @ self.p.T
        own = norm[:, None] if query else np.full((len(x), 1), self.top)
        if not query:
            cross = cross + np.sqrt(np.maximum(self.top - norm, 0))[:, None] * self.extra[None, :]
        square = np.maximum(own + self.top - 2 * cross, 0)
        at = square.argmin(axis=1)
        return at, np.sqrt(square[np.arange(len(x)), at])

    def between(self) -> np.ndarray:
        cross = self.p @ self.p.T + np.outer(self.extra, self.extra)
        return np.sqrt(np.maximum(2 * self.top - 2 * cross, 0))


def _placed(rows: DataFrame, cells: Cells, width: int, kind: np.dtype, query: bool) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(cells)  # pivots

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = _matrix(batch["v"], width)
            at, far = shared.value.nearest(m, query)
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array([r.tobytes() for r in m.astype(kind)], pa.binary()), pa.array(at.astype(np.int32)), pa.array(far)], names=["id", "v", "pivot", "far"])

    return rows.mapInArrow(run, "id long, v binary, pivot int, far double")


def bounds(cells: Cells, radius: dict[int, float], least: dict[int, list[float]], k: int) -> dict[int, float]:
    """For each pivot with queries: a distance within which each of its queries has k vectors."""
    between, out = cells.between(), {}
    for i, u in radius.items():
        reach = sorted(u + between[i, j] + d for j, ds in least.items() for d in ds)
        out[i] = reach[k - 1] if len(reach) >= k else float("inf")
    return out


def grouped(cells: Cells, queries: dict[int, int], groups: int) -> dict[int, int]:
    """The group of each pivot with queries: seeds far apart, the others with the nearest."""
    between, have = cells.between(), sorted(queries)
    seeds = [max(have, key=lambda i: (queries[i], -i))] if have else []
    while len(seeds) < min(groups, len(have)):
        seeds.append(max((i for i in have if i not in seeds), key=lambda i: (min(between[i, s] for s in seeds), -i)))
    return {i: min(range(len(seeds)), key=lambda g: (between[i, seeds[g]], g)) for i in have}


def top_k(vectors: DataFrame, is_query: Column, k: int = K, pivots: int | None = None, groups: int | None = None, id_column: str = "vec_id", column: str = "embedding", scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k largest integer inner products, ties to the smaller id.

    is_query is a condition on the column `id`. Rows with a query's own id are no candidates for it;
    other rows that repeat an id each are; of query rows with one id the least vector counts. Shorter
    vectors count as filled with zeros. Fewer than k candidates give fewer rows, an empty table none.
    Null vectors and those with null or non-finite components take no part, nor do rows without an id; other columns, of any name, are not read.
    By default pivots grow with the vectors. Pivots and summaries, bounded by their number, are all that the driver holds.
    """
    spark = ready(vectors.sparkSession)
    schema = "query_id long, rank int, vec_id long, score long"
    data = quantised(vectors, id_column, column, scale)
    large = F.array_max(F.transform("v", F.abs))
    s = data.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("width"), F.max(large).alias("large"), F.max(F.aggregate("v", F.lit(0.0), lambda t, x: t + x.cast("double") * x)).alias("top")).first()
    if s.width is None:
        return spark.createDataFrame([], schema)
    pivots = pivots or min(MOST_PIVOTS, max(PIVOTS, int(s.n**0.5)))
    groups = groups or max(GROUPS, pivots // PER_GROUP)
    width, top, large = max(1, s.width), float(s.top or 0.0), int(s.large or 0)
    kind = next(np.dtype(f"<i{b}") for b in (2, 4, 8) if large < 1 << (8 * b - 1))
    exact = float(large) ** 2 * width < 2**53
    picked = data.orderBy(F.xxhash64("id"), "id", "v").limit(pivots).collect()
    cells = Cells(np.stack([np.pad(np.array(r.v, dtype=np.int64), (0, width - len(r.v))) for r in picked]), top)
    asked = data.where(is_query).groupBy("id").agg(F.min("v").alias("v"), F.count(F.lit(1)).alias("rows"))
    most = asked.agg(F.max("rows")).first()[0]
    if most is None:
        return spark.createDataFrame([], schema)
    placed = stored(_placed(data, cells, width, kind, False))
    queries = stored(_placed(asked.select("id", "v"), cells, width, kind, True))
    radius = {r.pivot: r.far for r in queries.groupBy("pivot").agg(F.max("far").alias("far")).collect()}
    asked_n = {r.pivot: r.n for r in queries.groupBy("pivot").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = Window.partitionBy("pivot").orderBy("far")
    least: dict[int, list[float]] = {}
    for r in placed.select("pivot", "far", F.row_number().over(order).alias("n")).where(F.col("n") <= min(k + most, SUMMARY)).collect():
        least.setdefault(r.pivot, []).append(r.far)
    cell = {r.pivot: r for r in placed.groupBy("pivot").agg(F.count(F.lit(1)).alias("n"), F.min("far").alias("low"), F.max("far").alias("high")).collect()}
    reach, group_of, between = bounds(cells, radius, least, k + most), grouped(cells, asked_n, groups), cells.between()
    n_groups = max(group_of.values()) + 1
    slack = 1e-6 * (1 + np.sqrt(top))
    nearest = np.full((n_groups, len(cells.p)), np.inf)  # a vector farther than this from its pivot may be needed
    farthest = np.full((n_groups, len(cells.p)), -np.inf)
    for i, g in group_of.items():
        nearest[g] = np.minimum(nearest[g], between[i] - radius[i] - reach[i] - slack)
        farthest[g] = np.maximum(farthest[g], between[i] + radius[i] + reach[i] + slack)
    # slices of bounded size, pivot by pivot: near ones share a slice, a pivot of many vectors has several
    begins, parts, slot, room = np.zeros(len(cells.p), dtype=np.int64), np.ones(len(cells.p), dtype=np.int64), -1, 0
    near_queries = sorted((i for i in group_of if i in cell), key=lambda i: (group_of[i], i))
    for i in [*near_queries, *sorted(set(cell) - set(near_queries))]:
        if (n := cell[i].n) <= room:
            begins[i], room = slot, room - n
        else:
            parts[i], begins[i] = -(-n // SLICE), slot + 1
            slot, room = slot + parts[i], 0 if n > SLICE else SLICE - n
    sliced = slot + 1
    wanted = []  # the slices that hold a vector which a group may need
    for g in range(n_groups):
        hit = [i for i, c in cell.items() if c.high >= nearest[g][i] and c.low <= farthest[g][i]]
        wanted.append(sorted({int(begins[i] + x) for i in hit for x in range(parts[i])}))
    blocks = [max(1, -(-sum(n for i, n in asked_n.items() if group_of[i] == g) // BLOCK)) for g in range(n_groups)]
    first = np.concatenate([[0], np.cumsum(blocks)])[:-1]
    plan = spark.sparkContext.broadcast((nearest, farthest, group_of, blocks, first, sliced, begins, parts, wanted))

    def deal(query: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            near, far_, of, n_blocks, start, slices, begin, part, want = plan.value
            for batch in batches:
                pivot, far, lot = batch["pivot"].to_numpy(), batch["far"].to_numpy(), batch["lot"].to_numpy()
                rows, cell = [], []
                if query:
                    for r, (p, x) in enumerate(zip(pivot, lot, strict=True)):
                        g = of[int(p)]
                        block = start[g] + x % n_blocks[g]
                        rows += [r] * len(want[g])
                        cell += [block * slices + s for s in want[g]]
                else:
                    for g in range(len(n_blocks)):
                        hit = np.flatnonzero((far >= near[g][pivot]) & (far <= far_[g][pivot]))
                        for b in range(n_blocks[g]):
                            rows.append(hit)
                            cell.append((start[g] + b) * slices + begin[pivot[hit]] + lot[hit] % part[pivot[hit]])
                    rows, cell = np.concatenate(rows), np.concatenate(cell)
                out = batch.select(["id", "v"]).take(pa.array(np.asarray(rows, dtype=np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(np.asarray(cell, dtype=np.int64)), out["id"], out["v"]], names=["cell", "id", "v"])

        return run

    lot = F.pmod(F.xxhash64("id", "v"), F.lit(1 << 30)).alias("lot")
    dealt = placed.select("id", "v", "pivot", "far", lot).mapInArrow(deal(False), "cell long, id long, v binary")
    asking = queries.select("id", "v", "pivot", "far", lot).mapInArrow(deal(True), "cell long, id long, v binary")

    def solve(q: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[np.ndarray, ...]] = []
        if len(q) and len(d):
            as_ = np.float64 if exact else np.int64
            ask, have = (np.frombuffer(b"".join(x["v"]), dtype=kind).reshape(len(x), width).astype(as_) for x in (q, d))
            ids, asked_ids = d["id"].to_numpy(), q["id"].to_numpy()
            for at in range(0, len(ask), 256):
                score = ask[at : at + 256] @ have.T
                for row, own in zip(score, asked_ids[at : at + 256], strict=True):
                    other = ids != own
                    row, there = row[other], ids[other]
                    if len(row) > k:
                        keep = row >= np.partition(row, len(row) - k)[len(row) - k]
                        row, there = row[keep], there[keep]
                    best = np.lexsort((there, -row))[:k]
                    out.append((np.full(len(best), own), there[best], row[best].astype(np.int64)))
        parts = [np.concatenate(c) if c else np.zeros(0, dtype=np.int64) for c in (zip(*out, strict=True) if out else ([], [], []))]
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), parts, strict=True)))

    best = asking.groupBy("cell").cogroup(dealt.groupBy("cell")).applyInPandas(solve, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best of every 50th vector; nulls, ties, repeated rows and an empty table as in top_k."""
    vectors = ready(spark).read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(vectors, F.col("id") % 50 == 0)


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS q FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
