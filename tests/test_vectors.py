"""The vector index against the exact scan, and places by value against sorting."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import retrieval, vectors
from quillon.operators.vectors import VectorIndex, probed, recall, vector_index


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    near = rng.normal(size=(30, 16))
    x = np.concatenate([near[i % 30] + 0.3 * rng.normal(size=16) for i in range(1500)]).reshape(-1, 16)
    x = vectors.unit(x)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)] + [(5000 + i, [float(c) for c in x[3]]) for i in range(400)] + [(9000, None)]  # a hot cell of equal rows
    return spark.createDataFrame(rows, "k long, v array<float>").repartition(4).cache()


def hits(df):
    return sorted((r.q_id, r.key, r.distance, r["rank"]) for r in df.collect())


@pytest.mark.parametrize(("part", "lot"), [(8192, 4096), (50, 20)])
def test_index_with_every_cell_is_exact(spark, table, monkeypatch, tmp_path, part, lot):
    monkeypatch.setattr(vectors, "PART", part)
    monkeypatch.setattr(vectors, "LOT", lot)
    q = table.where(F.col("k") % 20 == 0).select(F.col("k").alias("q_id"), F.col("v").alias("q_vec"))
    exact = hits(retrieval.cosine_topk(table, q, "k", "v", 7))
    index = vector_index(table, "k", "v")
    assert index.rows.count() == 1900 and index.cells.agg(F.sum("n")).first()[0] == 1900
    assert hits(probed(index, q, 7, probes=10**6)) == exact
    kept = index.write(str(tmp_path / "i"))
    assert hits(probed(VectorIndex.read(spark, str(tmp_path / "i")), q, 7, probes=10**6)) == exact and kept.rows.count() == 1900


def test_probing_reaches_its_recall_and_reads_less(table):
    q = table.where(F.col("k") % 20 == 0).select(F.col("k").alias("q_id"), F.col("v").alias("q_vec"))
    index = vector_index(table, "k", "v")
    cells = index.cells.collect()
    found = recall(probed(index, q), retrieval.cosine_topk(table, q, "k", "v")).first()
    assert found.recall >= 0.9 and cells[0].probes < 0.5 * len(cells)


def test_rows_added_are_found(spark, table, tmp_path):
    folder = str(tmp_path / "i")
    index = vector_index(table, "k", "v").write(folder)
    more = spark.createDataFrame([(20000 + i, [float(j == i) for j in range(16)]) for i in range(16)], "k long, v array<float>")
    grown = index.add(more, "k", "v", folder)
    q = more.select(F.col("k").alias("q_id"), F.col("v").alias("q_vec"))
    assert [(r.q_id, r.key) for r in probed(grown, q, 1).orderBy("q_id").collect()] == [(20000 + i, 20000 + i) for i in range(16)]
    assert grown.rows.count() == grown.cells.agg(F.sum("n")).first()[0] == 1916


def test_small_tables(spark, table):
    q = table.limit(3).select(F.col("k").alias("q_id"), F.col("v").alias("q_vec"))
    assert probed(vector_index(table.limit(0), "k", "v"), q).count() == 0
    few = spark.createDataFrame([(i, [float(i == j) for j in range(16)]) for i in range(5)], "k long, v array<float>")
    assert probed(vector_index(few, "k", "v"), few.select(F.col("k").alias("q_id"), F.col("v").alias("q_vec")), 20).count() == 25
    assert probed(vector_index(few, "k", "v"), few.where("k < 0").select(F.col("k").alias("q_id"), F.col("v").alias("q_vec"))).count() == 0


def test_nearest_by_value(spark):
    rng = np.random.default_rng(5)
    rows = [(i, int(rng.integers(0, 60))) for i in range(300)] + [(1000, None)]
    asked = [(i, int(rng.integers(-10, 80))) for i in range(40)] + [(99, None), (98, 30), (97, 30)]
    got = retrieval.nearest_by(spark.createDataFrame(rows, "key long, w long").repartition(3), spark.createDataFrame(asked, "q_id long, w long"), "w", 6)
    want = [(q, key, n) for q, w in asked if w is not None for n, (_, key) in enumerate(sorted((abs(v - w), key) for key, v in rows if v is not None)[:6], 1)]
    assert sorted((r.q_id, r.key, r["rank"]) for r in got.collect()) == sorted(want)
