"""All-pairs operators over a grid of tasks against brute force."""

import numpy as np
import pytest

from tessera.functions import tiles
from tessera.operators import clustering, losses, metrics, neighbors


@pytest.fixture(scope="module")
def points():
    """Many equal vectors, more than are asked for, and some far from the origin."""
    rng = np.random.default_rng(3)
    return np.concatenate([np.zeros((40, 4)), np.repeat(rng.normal(size=(15, 4)), 3, axis=0), 1e4 + rng.normal(size=(30, 4))])


@pytest.fixture(scope="module")
def emb(spark, points):
    return spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in enumerate(points)], "cell_id long, v array<double>, c int").cache()


def distances(points):
    return np.sqrt(((points[:, None] - points[None]) ** 2).sum(2))


@pytest.mark.parametrize("hold", [7, 50, 10_000])
def test_nearest_with_ties(emb, points, hold):
    found = {}
    for r in neighbors.knn(emb, 6, block_rows=hold).collect():
        found.setdefault(r["src"], []).append((r["rank"], r["dst"]))
    d = distances(points)
    for i in range(len(points)):
        best = sorted((d[i, j], j) for j in range(len(points)) if j != i)[:6]
        assert [j for _, j in sorted(found[i])] == [j for _, j in best]


def test_small_batches_stream_alike(spark, emb):
    whole = sorted(neighbors.knn(emb, 6).collect())
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        assert sorted(neighbors.knn(emb, 6).collect()) == whole
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_fewer_points_than_asked(spark, emb):
    few = emb.where("cell_id IN (0, 50)")
    assert sorted((r["src"], r["dst"]) for r in neighbors.knn(few, 6).collect()) == [(0, 50), (50, 0)]
    assert neighbors.knn(emb.where("false"), 6).count() == 0 and neighbors.knn(emb, 6, emb.where("false")).count() == 0


def test_extremes_and_silhouette(emb, points):
    d, c = distances(points), np.arange(len(points)) % 3
    for method, f in (("nearest", np.min), ("farthest", np.max)):
        for r in clustering.cluster_distances(emb, emb, "c", method).collect():
            assert r["d"] == pytest.approx(f(d[np.ix_(c == r["c1"], c == r["c2"])]), abs=1e-12)
    for r in metrics.silhouette(emb.select("cell_id", "v"), emb, "c").collect():
        i = r["cell_id"]
        mean = {k: d[i, c == k].sum() / ((c == k).sum() - (k == c[i])) for k in range(3)}
        a, b = mean[c[i]], min(m for k, m in mean.items() if k != c[i])
        assert r["s"] == pytest.approx((b - a) / max(a, b), abs=1e-7)


def test_pair_sums(emb, points):
    z = points + 1
    x = emb.selectExpr("cell_id AS id", "transform(v, e -> e + 1) AS z")
    unit = z / np.linalg.norm(z, axis=1, keepdims=True)
    e = np.exp(2 * unit @ unit.T)
    for r in losses.pair_sums(x, x, "dot", 2.0).collect():
        assert r["s"] == pytest.approx(e[r["id"]].sum() - e[r["id"], r["id"]]) and r["dot"] == pytest.approx(2.0)


def test_grid_bounds_what_a_task_holds():
    for n, m, tasks in ((500, 500, 8), (10**6, 10**6, 1000), (10**8, 10**8, 10_000), (0, 0, 8)):
        down, across = tiles._grid(n, m, tasks, tiles.HOLD)
        assert n <= down * tiles.HOLD and across <= max(1, -(-tasks // down)) and across >= 1
