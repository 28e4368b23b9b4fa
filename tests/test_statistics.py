import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import special
from tessera.operators import cells as cell_ops
from tessera.operators import expression, matrix, metrics, stats

RNG = random.Random(0)


def long(spark, m, name="Gene"):
    return spark.createDataFrame([(i, f"{name}{j}", float(v)) for i, row in enumerate(m) for j, v in enumerate(row)], "cell_id long, gene string, value double")


def test_erfc_and_t(spark):
    z = [0.0, 0.1, 0.5, 1.0, 2.0, 5.0]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in z], "z double").select(special.erfc(F.col("z"))).collect()]
    assert got == pytest.approx([math.erfc(x) for x in z], rel=2e-7)
    # P(|T| >= t) in closed form for 1 and 2 degrees of freedom
    t = np.array([0.3, 1.0, 4.0])
    assert special.beta_inc(0.5, 0.5, 1 / (1 + t**2)) == pytest.approx(1 - 2 / math.pi * np.arctan(t))
    assert special.beta_inc(1.0, 0.5, 2 / (2 + t**2)) == pytest.approx(1 - t / np.sqrt(2 + t**2))


def brute_u(a, b):
    return sum((x > y) + 0.5 * (x == y) for x in a for y in b)


def test_rank_sum_matches_pairs(spark):
    rows = [("g1", float(RNG.randint(0, 4)), i < 9) for i in range(25)] + [("g2", 1.0, i < 3) for i in range(6)]
    got = {r["k"]: r for r in stats.rank_sum(spark.createDataFrame(rows, "k string, value double, g boolean"), "k").collect()}
    one, two = ([v for k, v, g in rows if k == "g1" and g is x] for x in (True, False))
    assert got["g1"]["u"] == brute_u(one, two) and got["g1"]["n1"] == 9 and got["g1"]["n2"] == 16
    n, n1, n2 = 25, 9, 16
    ties = sum(c**3 - c for c in (sum(v == x for _, v, _ in rows[:25]) for x in range(5)))
    sd = math.sqrt(n1 * n2 / 12 * ((n + 1) - ties / (n * (n - 1))))
    assert got["g1"]["zc"] == pytest.approx(max(abs(got["g1"]["u"] - n1 * n2 / 2) - 0.5, 0) / sd)
    assert got["g2"]["pvalue"] == 1.0


def test_exact_rank_sum(spark):
    """Against all ways to choose the first group's ranks."""
    for n1, n2, u in ((3, 4, 1), (2, 5, 4), (4, 4, 8)):
        us = [sum(c) - n1 * (n1 - 1) // 2 for c in itertools.combinations(range(n1 + n2), n1)]
        low = min(u, n1 * n2 - u)
        want = min(1.0, 2 * sum(x <= low for x in us) / len(us))
        got = spark.createDataFrame([(float(u), n1, n2)], "u double, a int, b int").select(special.rank_sum_exact("u", "a", "b")).first()[0]
        assert got == pytest.approx(want)


def test_bh(spark):
    p = [0.01, 0.04, 0.03, 0.5, 0.005]
    got = [r["padj"] for r in stats.adjust(spark.createDataFrame(list(enumerate(p)), "i int, p double"), "p", order=("i",)).orderBy("i").collect()]
    assert got == pytest.approx([0.025, 0.05, 0.05, 0.5, 0.025])


def test_fisher_and_binomial(spark):
    one = spark.createDataFrame([(8, 2, 1, 5)], "a int, b int, c int, d int")
    assert one.select(special.fisher_two_sided("a", "b", "c", "d")).first()[0] == pytest.approx(0.034965, abs=1e-6)
    assert spark.createDataFrame([(2, 10, 0.5)], "k int, n int, p double").select(special.binomial_two_sided("k", "n", "p")).first()[0] == pytest.approx(0.109375)


@pytest.fixture(scope="module")
def groups(spark):
    rng = np.random.default_rng(1)
    m = rng.poisson(3, (60, 12)).astype(float)
    m[30:, :3] += 4
    cells = spark.createDataFrame([(i, "a" if i < 30 else "b", i % 2) for i in range(60)], "cell_id long, group string, cluster int")
    return long(spark, m), cells


@pytest.mark.parametrize("method", expression.METHODS)
def test_differential_expression(groups, method):
    rows = expression.differential_expression(*groups, "group", method=method).collect()
    assert len(rows) == 12
    top = sorted(rows, key=lambda r: r["pvalue"])[:3]
    assert {r["gene"] for r in top} == {"Gene0", "Gene1", "Gene2"} and all(r["log2FC"] > 0.5 and r["padj"] < 0.05 for r in top)
    assert all(0 <= r["pvalue"] <= r["padj"] <= 1 for r in rows)


def test_de_keys_and_filters(groups):
    de = expression.differential_expression(*groups, "group")
    assert expression.upregulated(de).count() == 3 and expression.downregulated(de).count() == 0 and expression.significant(de).count() == 3
    assert {r["class"] for r in expression.volcano(de).collect()} == {"up", "none"}
    assert expression.pairwise(*groups, "group").select("g1", "g2").distinct().count() == 1
    assert {r[0] for r in expression.one_vs_rest(*groups, "group").select("group").distinct().collect()} == {"a", "b"}
    assert expression.within_cluster(*groups, "group", "cluster", "a", "b").select("cluster").distinct().count() == 2
    with pytest.raises(ValueError):
        expression.differential_expression(*groups, "group", method="none")


def test_markers(groups):
    expr, cells = groups
    labels = cells.select("cell_id", F.col("group").alias("cluster"))
    for method in ("wilcoxon", "t-test"):
        top = expression.find_markers(expr, labels, n_markers=3, method=method).where("cluster = 'b'")
        assert {r["gene"] for r in top.collect()} == {"Gene0", "Gene1", "Gene2"}
    all_genes = expression.rank_genes(expr, labels, min_fold_change=0.5)
    assert all_genes.count() == 24 and all_genes.where("score = 0 AND pval = 1").count() >= 16


def test_contingency(spark):
    same = spark.createDataFrame([(i // 3, i // 3) for i in range(9)], "t int, p int")
    r = metrics.contingency_metrics(same, "t", "p").first()
    assert r["ari"] == r["nmi"] == r["v_measure"] == pytest.approx(1.0)
    assert metrics.accuracy(same.withColumn("p", (F.col("p") + 1) % 3), "t", "p") == 1.0


def test_assignment():
    rng = np.random.default_rng(3)
    for n in (1, 2, 5):
        cost = rng.random((n, n))
        best = min(sum(cost[i, p[i]] for i in range(n)) for p in itertools.permutations(range(n)))
        assert cost[np.arange(n), metrics.assignment(cost)].sum() == pytest.approx(best)


def test_abundance_methods(spark):
    cells = spark.createDataFrame([(i, i % 3 if i < 50 else i % 2, "A" if i < 50 else "B") for i in range(100)], "cell_id long, cluster int, condition string")
    for method in ("fisher", "chi2", "permutation"):
        rows = cell_ops.abundance(cells, "condition", "A", "B", method, n_permutations=30).collect()
        assert len(rows) == 3 and all(0 < r["pvalue"] <= 1 for r in rows)
        assert min(rows, key=lambda r: r["pvalue"])["cluster"] == 2
    with pytest.raises(ValueError):
        cell_ops.abundance(cells, "condition", "A", "B", "none")


def test_cleaning_and_filters(spark):
    expr = spark.createDataFrame([(0, "a", float("nan")), (0, "b", float("inf")), (1, "a", 2.0), (1, "b", None)], "cell_id long, gene string, value double")
    assert [r["value"] for r in matrix.clean(expr).orderBy("cell_id", "gene").collect()] == [0.0, 0.0, 2.0, 0.0]
    with pytest.raises(ValueError):
        matrix.preprocess(expr)
    with pytest.raises(ValueError):
        matrix.validate(expr.where("cell_id = 0"))


def test_regression_removes_a_score(spark):
    rng = np.random.default_rng(5)
    a, b = rng.random(40), rng.random(40)
    m = np.stack([3 * a - 2 * b + 1, rng.random(40)], axis=1)
    scores = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(zip(a, b, strict=True))], "cell_id long, S_score double, G2M_score double")
    out = cell_ops.regress_scores(long(spark, m), scores).where("gene = 'Gene0'").agg(F.stddev_pop("value"), F.avg("value")).first()
    assert out[0] == pytest.approx(0, abs=1e-9) and out[1] == pytest.approx(m[:, 0].mean())


def test_batch_means_agree_after_correction(spark):
    rng = np.random.default_rng(6)
    m = rng.random((40, 5))
    m[20:] += 3
    cells = spark.createDataFrame([(i, "x" if i < 20 else "y") for i in range(40)], "cell_id long, batch string")
    for f in (cell_ops.combat, cell_ops.regress_batch):
        means = f(long(spark, m), cells).join(cells, "cell_id").groupBy("gene", "batch").agg(F.avg("value").alias("m")).groupBy("gene").agg((F.max("m") - F.min("m")).alias("d"))
        assert means.agg(F.max("d")).first()[0] < 1e-9


def test_qc_and_purity(spark):
    expr = spark.createDataFrame([(0, "MT-1", 2.0), (0, "RPL1", 2.0), (0, "x", 4.0), (1, "x", 1.0)], "cell_id long, gene string, value double")
    cells = spark.createDataFrame([(0, 0, "p"), (1, 0, "q"), (2, 1, "q")], "cell_id long, cluster int, kind string")
    rows = {r["cell_id"]: r for r in cell_ops.cell_qc(expr, cells).collect()}
    assert (rows[0]["total_counts"], rows[0]["n_genes"], rows[0]["pct_mt"], rows[0]["pct_rb"]) == (8.0, 3, 25.0, 25.0)
    assert rows[2]["total_counts"] == 0 and rows[2]["n_genes"] == 0
    p = {r["cluster"]: r for r in cell_ops.purity(cells, "kind").collect()}
    assert p[0]["majority_label"] == "p" and p[0]["purity"] == 0.5 and p[1]["n_labels"] == 1


def test_cell_cycle_phases(spark):
    rng = np.random.default_rng(7)
    m = rng.poisson(2, (60, 30)).astype(float)
    m[:20, :5] += 8
    m[20:40, 5:10] += 8
    names = [f"Gene{i}" for i in range(30)]
    got = {r["cell_id"]: r["phase"] for r in cell_ops.cell_cycle(long(spark, m), names[:5], names[5:10], 10, 5).collect()}
    assert all(got[i] == "S" for i in range(20)) and all(got[i] == "G2M" for i in range(20, 40)) and set(got.values()) <= {"S", "G2M", "G1"}
    assert cell_ops.gene_set_score(long(spark, m), ["absent"]).agg(F.max(F.abs("score"))).first()[0] >= 0


def test_small_groups_have_exact_tails(spark):
    from itertools import combinations

    rng = np.random.default_rng(8)
    rows, want = [], {}
    for gene, (a, b) in enumerate([(3, 5), (8, 4), (2, 9), (9, 9)]):
        x = rng.permutation(a + b).astype(float)
        rows += [(gene, float(v), i < a) for i, v in enumerate(x)]
        u = lambda idx, a=a: sum(sorted(idx)) - a * (a - 1) / 2
        seen = u([int(v) for v in x[:a]])
        every = [u(c) for c in combinations(range(a + b), a)]
        want[gene] = min(1.0, 2 * min(np.mean([e <= seen for e in every]), np.mean([e >= seen for e in every])))
    rows += [(9, 1.0, True), (9, 1.0, False), (9, 2.0, False)]
    got = {r["gene"]: r["pvalue"] for r in stats.rank_sum(spark.createDataFrame(rows, "gene int, value double, g boolean"), "gene").collect()}
    assert all(abs(got[g] - want[g]) < 1e-12 for g in (0, 1, 2)) and abs(got[3] - want[3]) < 0.05 and 0 < got[9] <= 1


def test_rank_correlation_by_counts(spark):
    """Against Pearson's correlation of mean ranks, with ties on both sides."""
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 6, 80).astype(float), rng.integers(0, 9, 80) / 4
    mean_ranks = lambda x: np.array([(x < v).sum() + ((x == v).sum() + 1) / 2 for v in x])
    rows = [("g", float(p), float(q)) for p, q in zip(a, b)] + [("flat", 1.0, float(q)) for q in b]
    got = {r["gene"]: r["correlation"] for r in stats.rank_correlation(spark.createDataFrame(rows, "gene string, x double, y double"), "x", "y", "gene").collect()}
    assert got["g"] == pytest.approx(np.corrcoef(mean_ranks(a), mean_ranks(b))[0, 1]) and got["flat"] == 0.0


def test_welch_of_counts_equals_rows(spark):
    rng = np.random.default_rng(6)
    rows = [("g", float(v), i % 3 == 0) for i, v in enumerate(1e6 + rng.integers(0, 4, 60))] + [("one", 2.0, True), ("one", 3.0, False)]
    x = spark.createDataFrame(rows, "gene string, value double, g boolean")
    one, two = (sorted(f.select("gene", "t", "pvalue").collect()) for f in (stats.welch_t(x, "gene"), stats.welch_counted(stats.counted(x, "gene"), "gene")))
    assert one[0]["t"] == pytest.approx(two[0]["t"], rel=1e-9) and one[0]["pvalue"] == pytest.approx(two[0]["pvalue"], rel=1e-6) and one[1] == two[1]
