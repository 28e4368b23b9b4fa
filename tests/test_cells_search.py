"""Nearest neighbours by cells around pivots, against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions.pivots import Blocks
from tessera.operators import neighbors


def frame(spark, m, first=0):
    return spark.createDataFrame([(first + i, v.tolist()) for i, v in enumerate(m)], "cell_id long, v array<double>")


def brute(q, k, p=None, first=0):
    same = p is None
    p = q if same else p
    d = np.sqrt(((q[:, None] - p[None]) ** 2).sum(2))
    return {(i, j, rank) for i in range(len(q)) for rank, (_, j) in enumerate(sorted((d[i, j], first + j) for j in range(len(p)) if not (same and i == j))[:k], 1)}


def found(df):
    return {(r["src"], r["dst"], r["rank"]) for r in df.collect()}


@pytest.mark.parametrize("n_pivots", [1, 5, 40])
@pytest.mark.parametrize("hold", [30, 1000])
def test_equal_to_all_pairs(spark, n_pivots, hold):
    rng = np.random.default_rng(n_pivots)
    m = np.concatenate([np.zeros((50, 3)), np.repeat(rng.normal(size=(12, 3)), 4, axis=0), 1e4 + rng.normal(size=(40, 3)), rng.normal(size=(60, 3)) * 20])
    assert found(neighbors.knn_in_cells(frame(spark, m), 6, block_rows=hold, n_pivots=n_pivots)) == brute(m, 6)


def test_other_points_and_few(spark):
    rng = np.random.default_rng(1)
    q, p = rng.normal(size=(70, 4)), rng.normal(size=(90, 4)) + 1
    assert found(neighbors.knn_in_cells(frame(spark, q), 5, frame(spark, p, 500))) == brute(q, 5, p, 500)
    assert found(neighbors.knn_in_cells(frame(spark, q[:4]), 6)) == brute(q[:4], 6)
    assert neighbors.knn_in_cells(frame(spark, q).where("false"), 5, frame(spark, p)).count() == 0
    assert neighbors.knn_in_cells(frame(spark, q), 5, frame(spark, p).where("false")).count() == 0
    assert found(neighbors.knn(frame(spark, q), 5, block_rows=20)) == brute(q, 5)


def test_clustered_points_leave_most_pairs_out(spark):
    rng = np.random.default_rng(2)
    m = np.concatenate([c + rng.normal(size=(100, 8)) for c in rng.normal(size=(30, 8)) * 15])
    compared = spark.sparkContext.accumulator(0)
    got = neighbors.knn_in_cells(frame(spark, m).repartition(4), 10, block_rows=400, compared=compared)
    d = ((m[:, None] - m[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    near = np.sort(np.sqrt(np.partition(d, 9, axis=1)[:, :10]), axis=1)
    rows = got.groupBy("src").agg(F.array_sort(F.collect_list("d")).alias("d")).collect()
    assert len(rows) == 3000 and all(r["d"] == pytest.approx(near[r["src"]]) for r in rows)
    assert 0 < compared.value < 0.3 * 3000 * 3000


def test_blocks_split_large_cells_and_keep_all():
    counts = np.array([5, 0, 1000, 7, 3, 90])
    b = Blocks.of(counts, np.array([3, 0, 2, 1, 5, 4]), 10)
    assert b.parts[2] == 10 and b.parts.sum() == 15
    blocks = b.block(np.repeat(np.arange(6), counts), np.arange(counts.sum()))
    assert blocks.min() >= 0 and blocks.max() < b.n and np.bincount(blocks).max() < 250
