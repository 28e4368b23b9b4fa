import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions.order import with_positions
from tessera.functions.vectors import gathered, keyed_sums, matrix_of
from tessera.operators import cells as cell_ops
from tessera.operators import clustering, encoders, metrics, plots, report, summaries


@pytest.fixture(scope="module")
def graph(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(12, 4))
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 12, (30, 2)) if a != b]
    nodes = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "cell_id long, v array<double>").persist()
    edges = spark.createDataFrame([(a, b, 1.0) for a, b in dict.fromkeys(pairs)], "src long, dst long, w double").persist()
    return x, list(dict.fromkeys(pairs)), nodes, edges


def rows_of(df):
    return np.array([r["v"] for r in df.orderBy("cell_id").collect()])


def normalised_adjacency(pairs, n):
    a = np.eye(n)
    for s, t in pairs:
        a[t, s] += 1
    d = a.sum(1)
    return a / np.sqrt(d[:, None] * d[None, :])


def test_graph_convolution(graph):
    x, pairs, nodes, edges = graph
    rng = np.random.default_rng(1)
    w1, w2 = rng.normal(size=(4, 4)), rng.normal(size=(4, 3))
    a = normalised_adjacency(pairs, 12)
    h = a @ x @ w1
    h = np.maximum((h - h.mean(0)) / np.sqrt(h.var(0) + 1e-5), 0)
    assert np.allclose(rows_of(encoders.graph_conv(nodes, edges, [w1, w2])), a @ h @ w2)
    assert np.allclose(rows_of(encoders.graph_conv(nodes, edges, [w1, w2], residual=True)), a @ (h + x) @ w2)


def test_deep_convolution_and_head(graph):
    x, pairs, nodes, edges = graph
    rng = np.random.default_rng(2)
    first, block, last = rng.normal(size=(4, 5)), rng.normal(size=(5, 5)), rng.normal(size=(5, 2))
    a = normalised_adjacency(pairs, 12)
    h = x @ first
    h = h + encoders.gelu(encoders.layer_norm(a @ h @ block))
    assert np.allclose(rows_of(encoders.deep_graph_conv(nodes, edges, first, [block], last)), h @ last)
    h = x @ first
    h = np.maximum((h - h.mean(0)) / np.sqrt(h.var(0) + 1e-5), 0)
    assert np.allclose(rows_of(encoders.projection_head(nodes, [first, last])), h @ last)
    assert np.allclose(np.linalg.norm(rows_of(encoders.embedding(nodes)), axis=1), 1)


def test_attention(graph):
    x, pairs, nodes, edges = graph
    rng = np.random.default_rng(3)
    ws, wt, a = rng.normal(size=(4, 3)), rng.normal(size=(4, 3)), rng.normal(size=3)
    s, t = x @ ws, x @ wt
    want = np.zeros((12, 3))
    for i in range(12):
        sources = [i] + [p for p, q in pairs if q == i]
        z = s[sources] + t[i]
        e = np.exp(np.where(z > 0, z, 0.2 * z) @ a)
        want[i] = (e / e.sum()) @ s[sources]
    assert np.allclose(rows_of(encoders.graph_attention(nodes, edges, ws, wt, a)), want)
    whole, last = rng.normal(size=(4, 2)), rng.normal(size=(5, 2))
    both = np.hstack([encoders.elu(want), np.tile(encoders.elu(x.mean(0) @ whole), (12, 1))]) @ last
    assert np.allclose(rows_of(encoders.multi_scale(nodes, edges, ws, wt, a, whole, last)), both)


def test_charts(spark, graph):
    _, _, nodes, _ = graph
    cells = spark.createDataFrame([(i, i % 2, "AB"[i % 3 == 0], float(i)) for i in range(12)], "cell_id long, cluster int, condition string, confidence double")
    box = {r["cluster"]: r for r in plots.confidence_distribution(cells).collect()}
    assert (box[0]["q1"], box[0]["median"], box[0]["max"]) == (2.5, 5.0, 10.0)
    assert plots.abundance_bars(cells, "condition").groupBy("condition").agg(F.sum("prop").alias("p")).where("abs(p - 1) > 1e-9").count() == 0
    h = plots.histogram(cells, "confidence", 4).orderBy("bin").collect()
    assert [r["n"] for r in h] == [3, 3, 3, 3]
    assert plots.histogram(cells.withColumn("confidence", F.lit(1.0)), "confidence").count() == 1
    assert plots.scatter(nodes, cells, reduce="pca").columns[:3] == ["cell_id", "x", "y"]
    with pytest.raises(ValueError):
        plots.scatter(nodes, reduce="umap")
    expr = spark.createDataFrame([(i, "a", 1.0) for i in range(12)], "cell_id long, gene string, value double")
    assert plots.gene_facets(nodes, expr, ["A"]).count() == 12
    with pytest.raises(ValueError):
        plots.gene_facets(nodes, expr, ["zz"])
    bars = plots.silhouette_bars(nodes, cells, "cluster").where("pos = 1")
    assert bars.count() == 2
    table = spark.createDataFrame([(0, "t" * 50, 0.01, 0.01), (0, "u", 0.5, 0.5)], "cluster int, term string, adjusted_pvalue double, pvalue double")
    first = plots.enrichment_bars(table, 1).collect()
    assert len(first) == 1 and len(first[0]["term"]) == 40 and first[0]["neg_log10_padj"] == pytest.approx(2)


def test_summaries(spark):
    d = spark.createDataFrame([(0, 0.5, True), (1, 0.1, False), (2, 0.3, False)], "cell_id long, doublet_score double, is_doublet boolean")
    assert summaries.doublet_summary(d).first().asDict() == {"n": 3, "n_doublets": 1, "mean": pytest.approx(0.3), "median": 0.3}
    t = spark.createDataFrame([(0, 0.0), (1, 1.0)], "cell_id long, pseudotime double")
    assert tuple(summaries.trajectory_summary(t).first()) == (0, 2, 0.0, 1.0)
    scores = spark.createDataFrame([(0, "x", 0, 1.0), (0, "y", 1, 2.0)], "cluster int, cell_type string, type_order int, score double")
    assert summaries.annotation_table(spark.createDataFrame([(0, "y", 0.9)], "cluster int, cell_type string, confidence double"), scores).first().asDict() == {"cluster": 0, "cell_type": "y", "confidence": 0.9, "score_x": 1.0, "score_y": 2.0}


def test_seeds_are_put_back():
    random.seed(1)
    np.random.seed(1)
    want = random.Random(1).random(), np.random.RandomState(1).rand()
    with summaries.seeded(5) as a:
        first = a.random(), random.random(), np.random.rand()
    assert (random.random(), np.random.rand()) == want
    with summaries.seeded(5) as b:
        assert (b.random(), random.random(), np.random.rand()) == first


def test_positions_and_sums(spark):
    ids = random.Random(2).sample(range(10_000), 500)
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in ids], "cell_id long, v array<double>")
    got = {r["cell_id"]: r["pos"] for r in with_positions(df, "cell_id").collect()}
    assert got == {c: k for k, c in enumerate(sorted(ids))}
    sums = keyed_sums(df, lambda b: (np.array([0]), np.array([float(b.num_rows)]), matrix_of(b.column("v")).sum(0)[None]))
    totals, vectors = gathered(sums, 1, 2)
    assert totals[0] == 500 and vectors[0].tolist() == [float(sum(ids)), 500.0]
    assert with_positions(df.limit(0), "cell_id").count() == 0


def test_covariates(spark):
    rng = np.random.default_rng(4)
    z, b = rng.random(60), np.repeat([0, 1, 2], 20)
    value = 2 * z + np.array([0.0, 3.0, -1.0])[b] + 5
    expr = spark.createDataFrame([(i, "g", float(v)) for i, v in enumerate(value)], "cell_id long, gene string, value double")
    cells = spark.createDataFrame([(i, "abc"[k], float(c)) for i, (k, c) in enumerate(zip(b, z, strict=True))], "cell_id long, batch string, z double")
    got = [r["value"] for r in cell_ops.regress_covariates(expr, cells, ["z"]).orderBy("cell_id").collect()]
    assert got == pytest.approx((2 * z + 5).tolist())


def test_queries_are_registered():
    import __spark_entry__

    found, oracles = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(oracles) <= set(found) and len(oracles) >= 60


def test_batch_effect(spark):
    mixed = spark.createDataFrame([(i, i % 4, i // 4 % 2) for i in range(80)], "cell_id long, cluster int, batch int")
    apart = spark.createDataFrame([(i, i % 4, i % 4 // 2) for i in range(80)], "cell_id long, cluster int, batch int")
    assert cell_ops.batch_effect_test(mixed, n_permutations=50).first()["pvalue"] == 1.0
    row = cell_ops.batch_effect_test(apart, n_permutations=50).first()
    assert row["pvalue"] == 0.0 and row["statistic"] == pytest.approx(cell_ops.batch_chi2(apart).first()["statistic"]) == pytest.approx(80)


def test_consensus_and_dendrogram(spark):
    x = np.array([[0.0], [0.1], [5.0], [5.1], [9.0], [9.1]])
    emb = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "cell_id long, v array<double>")
    runs = spark.createDataFrame([(k, i, i // 2, True) for k in range(2) for i in range(6)], "iter int, cell_id long, label int, sampled boolean")
    assert [r["label"] for r in clustering.consensus_labels(runs, 3).orderBy("cell_id").collect()] == [0, 0, 1, 1, 2, 2]
    labels = emb.select("cell_id", F.floor(F.col("cell_id") / 2).cast("int").alias("label"))
    steps = clustering.dendrogram(emb, labels, "label", "average").orderBy("step").collect()
    assert [(r["a"], r["b"], r["size"]) for r in steps] == [(1, 2, 2), (0, 3, 3)] and steps[0]["distance"] == pytest.approx(4)
    assert metrics.evaluate(labels, labels.withColumnRenamed("label", "t"), "t", emb)["silhouette"] > 0.9


def test_linkage_against_definition():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(9, 2))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    for method, reduce in (("single", np.min), ("complete", np.max), ("average", np.mean)):
        groups = {i: [i] for i in range(9)}
        for new, (a, b, height, size) in enumerate(clustering.linkage(d, method), 9):
            between = {(p, q): reduce(d[np.ix_(groups[p], groups[q])]) for p in groups for q in groups if p < q}
            assert height == pytest.approx(min(between.values())) == pytest.approx(between[a, b])
            groups[new] = groups.pop(a) + groups.pop(b)
            assert len(groups[new]) == size
    with pytest.raises(ValueError):
        clustering.linkage(d, "none")


def test_doublets_of_counts(spark):
    rng = np.random.default_rng(5)
    m = rng.poisson(3, (30, 20)).astype(float)
    expr = spark.createDataFrame([(i, f"g{j}", float(v)) for i, r in enumerate(m) for j, v in enumerate(r)], "cell_id long, gene string, value double")
    out = clustering.detect_doublets_counts(expr, n_components=4)
    assert out.count() == 30 and out.where("doublet_score < 0 OR doublet_score > 1").count() == 0


def test_markdown():
    r = report.Report()
    r.add_markdown("T", "# Head\ntext **bold** and *lean* snake_case_name\n- one\n- `two`\n<b>")
    body = r.sections[0].body
    assert "<h3>Head</h3>" in body and "<b>bold</b>" in body and "<i>lean</i>" in body and "snake_case_name" in body
    assert "<ul><li>one</li><li><code>two</code></li></ul>" in body and "&lt;b&gt;" in body


def test_consensus_of_histories_equals_consensus_of_cells(spark):
    """Against linkage of the whole matrix of cells, with histories that several share and a cell that no run sampled."""
    rng = np.random.default_rng(8)
    groups = np.repeat(np.arange(4), 10)
    rows = []
    for run in range(4):
        for i, g in enumerate(groups):
            label = int(g) if rng.random() > 0.1 else int(rng.integers(0, 4))
            rows.append((run, i, label, bool(rng.random() > 0.2) and i != 39))
    runs = spark.createDataFrame(rows, "iter int, cell_id long, label int, sampled boolean")
    m = np.ones((40, 40))
    for r in clustering.consensus(runs).collect():
        m[r["i"], r["j"]] = 1 - r["consensus"]
    want = clustering.flat_clusters(clustering.linkage(m), 40, threshold=0.6)
    got = [r["label"] for r in clustering.consensus_labels(runs, len(set(want))).orderBy("cell_id").collect()]
    assert len(got) == 40 and got[39] not in got[:39]
    assert len({*zip(want, got)}) == len(set(want)) == len(set(got))
