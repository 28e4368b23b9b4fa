"""Sparse matrices, of which zeros are no rows, against the same statistics of all cells in NumPy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import order
from tessera.operators import cells as cell_ops
from tessera.operators import expression, matrix, stats


def ranks(x):
    return np.array([(x < v).sum() + ((x == v).sum() + 1) / 2 for v in x])


@pytest.fixture(scope="module", params=["counts", "continuous", "negative"])
def data(spark, request):
    rng = np.random.default_rng(7)
    m = rng.poisson(0.7, (80, 6)).astype(float)
    if request.param != "counts":
        m *= rng.random(m.shape) + 0.5
    if request.param == "negative":
        m *= rng.choice([-1, 1], m.shape)
    m[:, 4] = 0  # a gene without rows
    m[:, 5] = 2.5  # and one without zeros
    labels = np.where(np.arange(80) % 5 == 0, "c", np.where(rng.random(80) < 0.5, "a", "b"))
    rows = [(int(i), f"g{j}", float(m[i, j])) for i, j in zip(*np.nonzero(m), strict=True)] + [(0, "g0", 0.0)] * int(m[0, 0] == 0)
    expr = spark.createDataFrame(rows, "cell_id long, gene string, value double").repartition(3)
    cells = spark.createDataFrame([(i, str(x), float(i % 7)) for i, x in enumerate(labels)], "cell_id long, cluster string, pseudotime double")
    return m, labels, expr, cells, spark.createDataFrame([(f"g{j}",) for j in range(6)], "gene string")


def test_one_vs_rest_counts_zeros(data):
    m, labels, expr, cells, genes = data
    got = {(r["group"], r["gene"]): r for r in stats.one_vs_rest(expr, cells, "cluster", genes).collect()}
    t = {(r["group"], r["gene"]): r for r in stats.student_vs_rest(expr, cells, "cluster", genes).collect()}
    assert len(got) == len(t) == 18
    for (group, gene), r in got.items():
        x, own = m[:, int(gene[1])], labels == group
        assert (r["n1"], r["n2"]) == (own.sum(), (~own).sum())
        assert r["u"] == pytest.approx(ranks(x)[own].sum() - own.sum() * (own.sum() + 1) / 2)
        assert [r[k] for k in ("mean1", "mean2", "pct1", "pct2")] == pytest.approx([x[own].mean(), x[~own].mean(), (x[own] > 0).mean(), (x[~own] > 0).mean()])
        pooled = (((x[own] - x[own].mean()) ** 2).sum() + ((x[~own] - x[~own].mean()) ** 2).sum()) / 78
        want = (x[own].mean() - x[~own].mean()) / math.sqrt(pooled * (1 / own.sum() + 1 / (~own).sum())) if pooled else 0
        assert t[group, gene]["t"] == pytest.approx(want)


def test_two_groups_agree_with_the_dense_matrix(data):
    m, labels, expr, cells, genes = data
    dense = matrix.densify(expr.where("value <> 0"), cells, genes)
    two = [lambda e, method=method: expression.differential_expression(e, cells, "cluster", "a", "b", method=method, min_pct=0.0) for method in ("wilcoxon", "t-test")]
    for f in (*two, lambda e: expression.pairwise(e, cells, "cluster")):
        a, b = (sorted(tuple(r) for r in f(e).collect()) for e in (expr, dense))
        assert len(a) == len(b) > 0
        for x, y in zip((v for r in a for v in r), (v for r in b for v in r), strict=True):
            assert x == y if isinstance(x, str) else x == pytest.approx(y, rel=1e-6, abs=1e-9)


def test_logistic_by_newton_steps_in_numpy(data):
    m, labels, expr, cells, genes = data
    got = {r["gene"]: r["statistic"] for r in expression.differential_expression(expr, cells, "cluster", "a", "b", method="logistic", min_pct=0.0, min_cells=1, genes=genes).collect()}
    two = labels != "c"
    for gene, z in got.items():
        x, y = np.column_stack([np.ones(two.sum()), m[two, int(gene[1])]]), (labels[two] == "a").astype(float)
        beta = np.zeros(2)
        if np.ptp(x[:, 1]):
            for _ in range(60):
                mu = 1 / (1 + np.exp(-x @ beta))
                h = (x * (mu * (1 - mu))[:, None]).T @ x
                beta = beta + np.linalg.solve(h, x.T @ (y - mu))
            assert z == pytest.approx(beta[1] / math.sqrt(np.linalg.inv(h)[1, 1]), rel=1e-6)
        else:
            assert z == 0


def test_trajectory_genes(data):
    m, _, expr, cells, genes = data
    got = {r["gene"]: r["correlation"] for r in cell_ops.trajectory_genes(expr, cells, None, genes=genes).collect()}
    t = ranks(np.arange(80) % 7.0)
    for j in range(6):
        want = np.corrcoef(ranks(m[:, j]), t)[0, 1] if np.ptp(m[:, j]) else 0
        assert got[f"g{j}"] == pytest.approx(want, abs=1e-12)
    bins = {r["gene"]: r["score"] for r in cell_ops.trajectory_genes(expr, cells, None, "variance", 7, genes).collect()}
    for j in range(6):
        assert bins[f"g{j}"] == pytest.approx(np.var([m[np.arange(80) % 7 == b, j].mean() for b in range(7)]) / (np.var(m[:, j]) + 1e-10), abs=1e-9)


def test_variable_genes_and_scaled_rows(data):
    m, _, expr, cells, genes = data
    got = matrix.variable_genes(expr, 6, cells, genes).collect()
    assert sorted(r["variance"] for r in got) == pytest.approx(sorted(m.var(0)))
    z = np.clip((m - m.mean(0)) / np.where(m.std(0) == 0, 1, m.std(0)), -2, 2)[:, [0, 1, 2, 3, 5]]
    rows = {r["cell_id"]: r["v"] for r in matrix.scaled_rows(expr, cells, 2.0).collect()}
    assert len(rows) == 80 and all(rows[i] == pytest.approx(z[i], abs=1e-9) for i in rows)


def test_no_row_of_zeros_is_made(data):
    """No join makes more rows than genes by groups: the plans have no grid of cells."""
    _, _, expr, cells, genes = data
    for df in (stats.counted_cells(expr, cells, "cluster", genes=genes), stats.moments_of_cells(expr, cells, "cluster", genes=genes)):
        assert "cell_id" not in df._jdf.queryExecution().executedPlan().toString().split("BroadcastNestedLoopJoin")[1].split("\n")[0]


def test_one_continuous_gene_is_ranked_by_many_tasks(spark):
    n = 20_000
    x = spark.range(n, numPartitions=4).select(F.lit("g").alias("gene"), (F.pmod(F.xxhash64("id"), F.lit(2**40)) / 2**40).alias("value"), F.lit(1.0).alias("c"))
    # so few rows would go to one task
    conf = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        y = order.counted_below(x, "value", "gene")
        sizes = [r["count"] for r in x.repartitionByRange("gene", "value").groupBy(F.spark_partition_id()).count().collect()]
        assert len(sizes) == 16 and max(sizes) < 2 * sorted(sizes)[8]
        got = y.select("value", "_to", "_ties").orderBy("value").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert [r["_to"] for r in got] == list(range(1, n + 1)) and {r["_ties"] for r in got} == {1.0}


def test_quantiles(spark):
    rng = np.random.default_rng(2)
    rows = [(k, float(v)) for k, n in (("a", 101), ("b", 40), (None, 7), ("one", 1)) for v in rng.integers(0, 30, n)] + [("a", None), ("a", float("nan")), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    shares = (0.0, 0.25, 0.5, 0.9, 1.0)
    got = {r["k"]: r["q"] for r in order.quantiles(df, "v", "k", shares=shares).collect()}
    values = lambda k: [v for x, v in rows if x == k and v is not None and v == v]
    assert set(got) == {"a", "b", None, "one"} and all(q == pytest.approx(np.quantile(values(k), shares)) for k, q in got.items())
    assert order.medians(df, "v").first()["median"] == np.median([v for _, v in rows if v is not None and v == v])
    assert order.medians(df.limit(0), "v").count() == 0


def test_tails_of_any_size():
    import time

    from tessera.functions import special

    began = time.perf_counter()
    p = special.rank_sum_tail(3.9e8, 8, 10**8)
    assert 0.90 < p < 0.91 and special.rank_sum_tail(0, 8, 10**8) == pytest.approx(2 / math.comb(10**8 + 8, 8))
    assert special.binomial_test(5 * 10**8 + 20_000, 10**9, 0.5) == pytest.approx(math.erfc(20_000 / math.sqrt(10**9 / 4) / math.sqrt(2)), rel=1e-3)
    assert 0 < special.fisher_test(10**6 + 900, 10**6, 10**6, 10**6 + 10) < 1
    assert time.perf_counter() - began < 1


@pytest.mark.parametrize("seed", range(5))
def test_tails_by_summing_all_outcomes(seed):
    from tessera.functions import special

    rng = np.random.default_rng(seed)
    lg = math.lgamma
    for _ in range(40):
        n, p = int(rng.integers(1, 300)), float(rng.choice([0.5, 0.01, rng.random()]))
        x = int(rng.integers(0, n + 1))
        logs = np.array([lg(n + 1) - lg(i + 1) - lg(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(n + 1)])
        assert special.binomial_test(x, n, p) == pytest.approx(min(1, np.exp(logs[logs <= logs[x] + 1e-7]).sum()), abs=1e-9)
        a, b, c, d = (int(v) for v in rng.integers(0, 50, 4))
        lo, hi = max(0, a + c - c - d), min(a + b, a + c)
        base = lg(a + b + 1) + lg(c + d + 1) + lg(a + c + 1) + lg(b + d + 1) - lg(a + b + c + d + 1)
        logs = np.array([base - lg(i + 1) - lg(a + b - i + 1) - lg(a + c - i + 1) - lg(d - a + i + 1) for i in range(lo, hi + 1)])
        assert special.fisher_test(a, b, c, d) == pytest.approx(min(1, np.exp(logs[logs <= logs[a - lo] + 1e-7]).sum()), abs=1e-9)
        assert special.hypergeometric_tail(a, a + b + c + d, a + b, a + c) == pytest.approx(np.exp(logs[a - lo :]).sum(), abs=1e-9)
