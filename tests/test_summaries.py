import numpy as np
import pytest

from tessera.operators import clustering, integration, summaries


@pytest.fixture(scope="module")
def cells(spark):
    rng = np.random.default_rng(3)
    m = np.vstack([rng.normal(0, 1, (40, 3)), rng.normal(9, 1, (40, 3))])
    emb = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "cell_id long, v array<double>").cache()
    return emb, spark.createDataFrame([(i, i // 40, i % 2) for i in range(80)], "cell_id long, label int, batch int").cache()


def test_integration(cells):
    emb, labels = cells
    r = summaries.integration_summary(integration.mnn_correct(emb, labels, "batch", 5), labels, "batch", 10).first()
    assert (r["n_cells"], r["n_batches"]) == (80, 2) and 0.8 < r["mixing_mean"] <= 1 and 1.5 < r["lisi_mean"] <= 2


def test_splits_and_merges(cells, spark):
    emb, labels = cells
    after = clustering.subcluster(emb, labels, "label", 1, 2)
    rows = summaries.subcluster_summary(labels, after, "label").collect()
    assert {r["old"] for r in rows} == {1} and sum(r["n"] for r in rows) == 40 and {r["new"] for r in rows} == {1, 2}
    merged = summaries.merge_summary(spark.createDataFrame([(0, 0), (1, 0)], "old int, new int"), labels, "label").collect()
    assert [tuple(r) for r in merged] == [(0, [0, 1], 80)]


def test_doublets(spark):
    df = spark.createDataFrame([(i, i / 10, i > 7) for i in range(9)], "cell_id long, doublet_score double, is_doublet boolean")
    assert tuple(summaries.doublet_summary(df).first()) == pytest.approx((9, 1, 0.4, 0.4))
