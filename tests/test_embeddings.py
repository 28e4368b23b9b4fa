import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import annotation, callbacks, clustering, integration, losses, matrix, metrics, neighbors, report, trajectory, tuning
from tessera.operators.estimator import GraphClustering, GraphModel
from tessera.sources import io
from tessera.streaming.qc import windowed_counts


def frame(spark, x, first=0):
    return spark.createDataFrame([(first + i, [float(v) for v in r]) for i, r in enumerate(x)], "cell_id long, v array<double>")


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(0)
    y = np.repeat([0, 1, 2], 20)
    x = rng.normal(0, 0.3, (60, 4)) + np.array([[0, 0, 4, 0], [4, 0, 0, 0], [0, 4, 0, 0]])[y]
    labels = spark.createDataFrame([(i, int(c), i % 2) for i, c in enumerate(y)], "cell_id long, label int, batch int")
    return x, y, frame(spark, x).persist(), labels.persist()


def distances(x):
    return np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))


def test_knn_is_exact(blobs):
    x, _, emb, _ = blobs
    d = distances(x)
    np.fill_diagonal(d, np.inf)
    got = {}
    for r in neighbors.knn(emb, 5, block_rows=17).collect():
        got.setdefault(r["src"], {})[r["rank"]] = r["dst"]
    for i in range(60):
        assert [got[i][k] for k in range(1, 6)] == np.argsort(d[i], kind="stable")[:5].tolist()


def test_knn_of_equal_points(spark):
    rows = neighbors.knn(frame(spark, np.ones((6, 3))), 2).collect()
    assert all(r["src"] != r["dst"] and r["d"] == 0 for r in rows)
    assert {r["dst"] for r in rows if r["src"] == 5} == {0, 1}


def test_graphs(blobs):
    emb = blobs[2]
    near = neighbors.knn(emb, 5).persist()
    assert neighbors.knn_graph(near).count() == 600
    w = neighbors.adaptive_graph(emb, 3, 10)
    assert w.where("w < 0 OR w > 1").count() == 0
    snn = neighbors.snn_weights(neighbors.knn_graph(near))
    assert snn.agg(F.max("w")).first()[0] == 1.0


def test_silhouette_and_indices(blobs):
    x, y, emb, labels = blobs
    d = distances(x)
    want = []
    for i in range(60):
        own = d[i, y == y[i]].sum() / 19
        other = min(d[i, y == c].mean() for c in range(3) if c != y[i])
        want.append((other - own) / max(own, other))
    got = [r["s"] for r in metrics.silhouette(emb, labels, "label", rows=25).orderBy("cell_id").collect()]
    assert got == pytest.approx(want)
    row = metrics.calinski_davies(emb, labels, "label").first()
    assert row["calinski_harabasz"] > 100 and row["davies_bouldin"] < 0.5


def test_kmeans_and_choice_of_k(blobs):
    _, _, emb, labels = blobs
    found, _ = clustering.kmeans(emb, 3, n_init=3)
    assert metrics.contingency_metrics(found.withColumnRenamed("label", "f").join(labels, "cell_id"), "label", "f").first()["ari"] == pytest.approx(1.0)
    assert clustering.tune_n_clusters(emb, 2, 4, n_init=2) == 3


def test_linkage():
    d = distances(np.array([[0.0], [1.0], [5.0], [7.0]]))
    assert [m[2] for m in clustering.linkage(d, "single")] == [1, 2, 4]
    assert [m[2] for m in clustering.linkage(d, "complete")] == [1, 2, 7]
    assert [m[2] for m in clustering.linkage(d, "average")] == [1, 2, 5.5]
    assert clustering.linkage(d, "ward")[-1][2] == pytest.approx(np.sqrt(2 * 2 / 4 * 2 * 5.5**2))
    assert clustering.flat_clusters(clustering.linkage(d), 4, n_clusters=2) == [0, 0, 1, 1]
    assert clustering.flat_clusters(clustering.linkage(d), 4, threshold=1.5) == [0, 0, 1, 2]


def test_refinement(spark, blobs):
    _, _, emb, labels = blobs
    assert {r["new"] for r in clustering.merge_clusters(emb, labels, "label", n_clusters=2).collect()} == {0, 1}
    for method in ("nearest", "farthest"):
        assert clustering.cluster_distances(emb, labels, "label", method).count() == 3
    small = labels.withColumn("label", F.when(F.col("cell_id") < 5, 99).otherwise(F.col("label")))
    merged = clustering.apply_mapping(small, "label", clustering.auto_merge(emb, small, "label", 10))
    assert merged.select("label").distinct().count() == 3
    assert clustering.subcluster(emb, labels, "label", 0).select("label").distinct().count() == 4
    assert clustering.subcluster_recursive(emb, labels, "label", 10, 1).select("label").distinct().count() == 6
    with pytest.raises(ValueError):
        clustering.merge_clusters(emb, labels, "label")


def test_stability_and_consensus(blobs):
    _, _, emb, labels = blobs
    runs = clustering.bootstrap_labels(emb, 3, 2).persist()
    s = clustering.stability(runs, labels, "label")
    assert s.count() == 60 and s.agg(F.min("cell_stability")).first()[0] == 1.0
    c = clustering.consensus(runs)
    assert c.where("i = j AND consensus <> 1").count() == 0 and c.where("consensus < 0 OR consensus > 1").count() == 0


def test_doublets(blobs):
    emb = blobs[2]
    d = clustering.detect_doublets(emb, 0.1, 10, 30).persist()
    assert d.where("doublet_score < 0 OR doublet_score > 1").count() == 0
    assert clustering.filter_doublets(emb, d).count() == 60 - d.where("is_doublet").count()


def test_mixing(blobs):
    _, _, emb, labels = blobs
    near = neighbors.knn(emb, 10).persist()
    assert neighbors.lisi(near, labels, "batch", 10).agg(F.min("lisi")).first()[0] >= 1
    assert neighbors.batch_mixing(near, labels, "label", 10).agg(F.max("entropy")).first()[0] < 1e-6
    assert 0 <= neighbors.kbet(near, labels, "batch", 10).first()[0] <= 1
    assert neighbors.mutual_neighbors(emb.where("cell_id < 30"), emb.where("cell_id >= 30"), 5).where("ref >= 30 OR query < 30").count() == 0


def test_seeds_cost_no_more_than_exact_picks(spark):
    rng = np.random.default_rng(9)
    m = np.concatenate([c + rng.normal(size=(40, 5)) for c in rng.normal(size=(12, 5)) * 8])
    cost = lambda c: ((m[:, None] - np.asarray(c)[None]) ** 2).sum(2).min(1).sum()

    def exact(seed):
        r = np.random.default_rng(seed)
        picked = [m[r.integers(len(m))]]
        while len(picked) < 12:
            d = ((m[:, None] - np.array(picked)[None]) ** 2).sum(2).min(1)
            picked.append(m[r.choice(len(m), p=d / d.sum())])
        return picked

    seeds = [[r["center"] for r in integration.seed_centroids(frame(spark, m), 12, s).collect()] for s in range(3)]
    assert all(len(c) == 12 for c in seeds) and np.mean([cost(c) for c in seeds]) < 1.1 * np.mean([cost(exact(s)) for s in range(20)])
    same = integration.seed_centroids(frame(spark, m).repartition(7), 12, 0).collect()
    assert [r["center"] for r in same] == seeds[0]
    assert integration.seed_centroids(frame(spark, np.ones((9, 3))), 4, 0).count() == 1


def test_harmony_by_whole_matrices(spark, monkeypatch):
    """All cells in NumPy, from the same seeds; vectors of many lengths, as the original ones are corrected."""
    rng = np.random.default_rng(4)
    x = np.vstack([rng.normal(c, 1, (25, 3)) for c in (2, -3)]) * rng.random((50, 1)) * 4
    x[::3] += 1.0
    batch = (np.arange(50) % 3 == 0).astype(int)
    seeds = np.array([[1.0, 0, 0], [-0.5, -0.5, 0.1], [0, 0, 9.0]])
    monkeypatch.setattr(integration, "seed_centroids", lambda emb, k, seed: spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(seeds)], "c int, center array<double>"))
    cells = spark.createDataFrame([(i, int(b)) for i, b in enumerate(batch)], "cell_id long, batch int")
    got = {r["cell_id"]: r["v"] for r in integration.harmony(frame(spark, x), cells, "batch", 3, 4, sigma=0.5).collect()}
    length = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    z, centers = length(x), seeds.copy()
    for _ in range(4):
        r = np.exp(-((z[:, None] - centers) ** 2).sum(2) / (2 * 0.5**2))
        r /= r.sum(1, keepdims=True) + 1e-10
        counts = np.array([r[batch == b].sum(0) for b in (0, 1)]).T
        share = counts / (counts.sum(1, keepdims=True) + 1e-10)
        r *= np.clip(1 - 2 * np.abs(share - [np.mean(batch == 0), np.mean(batch == 1)]), 0.1, 1)[:, batch].T
        r /= r.sum(1, keepdims=True) + 1e-10
        centers = np.array([(r[:, [k]] * z).sum(0) / r[:, k].sum() if r[:, k].sum() > 0 else centers[k] for k in range(3)])
        z = x.copy()
        for b in (0, 1):
            for k in range(3):
                own = np.average(x[batch == b], axis=0, weights=r[batch == b, k] + 1e-10)
                z[batch == b] += r[batch == b, k : k + 1] * (np.average(x, axis=0, weights=r[:, k] + 1e-10) - own)
        z = length(z)
    assert all(got[i] == pytest.approx(z[i], abs=1e-6) for i in range(50))


@pytest.mark.parametrize("method", ["mnn", "harmony"])
def test_integration(spark, method):
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, (30, 5))
    both = frame(spark, np.vstack([x, x + 0.5])).persist()
    cells = spark.createDataFrame([(i, i // 30) for i in range(60)], "cell_id long, batch int")
    options = {"k": 5} if method == "mnn" else {"n_clusters": 4, "max_iter": 2}
    out = integration.integrate(both, cells, "batch", method, **options)
    assert out.count() == 60 and out.where(F.size("v") != 5).count() == 0
    if method == "mnn":
        gap = lambda e: e.groupBy(F.col("cell_id") >= 30).agg(F.avg(F.col("v")[0])).agg(F.stddev_pop("avg(v[0])")).first()[0]
        assert gap(out) < gap(both)
    with pytest.raises(ValueError):
        integration.integrate(both, cells, "batch", "none")


@pytest.mark.parametrize("method", ["dpt", "slingshot", "paga", "principal_curve"])
def test_trajectory(spark, method):
    rng = np.random.default_rng(3)
    t = np.linspace(0, 1, 60)
    x = np.stack([t * 6, np.sin(t * np.pi)], 1) + rng.normal(0, 0.05, (60, 2))
    emb = frame(spark, x).persist()
    labels = spark.createDataFrame([(i, i // 20) for i in range(60)], "cell_id long, label int")
    out = trajectory.infer_trajectory(emb, labels, "label", method, root={"dpt": 0, "principal_curve": 0}.get(method, 0)).orderBy("cell_id").collect()
    p = np.array([r["pseudotime"] for r in out])
    assert p.min() == 0 and p.max() == 1
    if method == "dpt":  # distances over ten components level off; the first alone orders the cells
        p = np.array([r["pseudotime"] for r in trajectory.diffusion_pseudotime(emb, 0, n_components=1).orderBy("cell_id").collect()])
    assert abs(np.corrcoef(p.argsort().argsort(), t)[0, 1]) > 0.8


def test_power_iteration_finds_the_leading_components(spark):
    rng = np.random.default_rng(4)
    x = np.stack([np.linspace(0, 5, 30), rng.normal(0, 0.05, 30)], 1)
    got = [r["pseudotime"] for r in trajectory.diffusion_pseudotime(frame(spark, x), 0, 5, 2).orderBy("cell_id").collect()]
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    near = np.argsort(d + np.eye(30) * 1e9, axis=1)[:, :5]
    sigma = np.median([d[i, j] for i in range(30) for j in near[i]])
    w = np.zeros((30, 30))
    for i in range(30):
        w[i, near[i]] = np.exp(-d[i, near[i]] ** 2 / (2 * sigma**2))
    w = (w + w.T) / 2
    values, vectors = np.linalg.eigh(w / np.sqrt(np.outer(w.sum(1), w.sum(1))))
    take = np.argsort(-values)[1:3]
    space = vectors[:, take] * np.abs(values[take])
    want = np.linalg.norm(space - space[0], axis=1)
    assert np.corrcoef(got, want)[0, 1] > 0.95


def test_losses(spark, blobs):
    x, _, emb, labels = blobs
    q = losses.soft_assign(emb, metrics.centroids(emb, labels, "label")).persist()
    assert q.groupBy("cell_id").agg(F.sum("q").alias("s")).where("abs(s - 1) > 1e-9").count() == 0
    assert losses.kl_divergence(losses.target_distribution(q)).first()[0] >= 0
    z = x / np.linalg.norm(x, axis=1, keepdims=True)
    views = emb.select(F.col("cell_id").alias("id"), F.col("v").alias("z1"), F.col("v").alias("z2"))
    assert losses.alignment(views).first()[0] == pytest.approx(0)
    e = np.exp(-2 * distances(z) ** 2)
    np.fill_diagonal(e, 0)
    assert losses.uniformity(views.select("id", F.col("z1").alias("z"))).first()[0] == pytest.approx(np.log(e.sum() / 3600))
    s = z @ z.T / 0.5
    neg = 2 * (np.exp(s).sum(1) - np.exp(np.diag(s)))
    assert losses.contrastive(views, debiased=False).first()[0] == pytest.approx(np.mean(np.log(np.exp(np.diag(s)) + neg) - np.diag(s)))


def test_estimator_learns_and_reloads(spark, blobs, tmp_path):
    _, _, emb, labels = blobs
    log = callbacks.ProgressLogger(str(tmp_path / "log.json"))
    estimator = GraphClustering(n_clusters=3, hidden_dim=16, proj_dim=8, k_neighbors=6, pretrain_epochs=30, ssc_epochs=10, lr=0.01, callbacks=[log, callbacks.Timer()])
    model = estimator.fit(emb)
    assert model.history[-1] < model.history[0] and len(log.history) == 30
    edges = estimator.graph(emb)
    found = model.predict(model.embeddings(emb, edges))
    assert metrics.contingency_metrics(found.withColumnRenamed("label", "f").join(labels, "cell_id"), "label", "f").first()["ari"] > 0.9
    model.save(spark, str(tmp_path / "model"))
    again = GraphModel.load(spark, str(tmp_path / "model"))
    assert np.allclose(again.centers, model.centers) and all(np.allclose(a, b) for a, b in zip(again.layers, model.layers, strict=True))
    with pytest.raises(ValueError):
        GraphClustering(n_clusters=60).fit(emb)


def test_callbacks():
    stop = callbacks.EarlyStopping(patience=2)
    assert [stop.on_epoch_end(i, {"loss": v}) for i, v in enumerate([3, 2, 2, 2])] == [True, True, True, False]
    saved = []
    point = callbacks.CheckpointCallback(saved.append, "c{epoch}", best_only=True)
    for i, v in enumerate([3, 4, 1]):
        point.on_epoch_end(i, {"loss": v})
    assert saved == ["c0", "c2"]


def test_tuner(spark, blobs):
    t = tuning.Tuner(n_trials=4, metric="davies")
    rows = t.tune(blobs[2], run=lambda p: -p["k_neighbors"]).collect()
    assert [r["value"] for r in rows] == sorted((r["value"] for r in rows), reverse=True) and t.best["k_neighbors"] == -rows[0]["value"]
    with pytest.raises(ValueError):
        tuning.Tuner(metric="none")
    with pytest.raises(ValueError):
        tuning.Tuner(sampler="none")


def test_densities_lead_to_better_trials():
    """A known function of every kind of parameter: the best of 60 trials, over 12 seeds, against random ones."""
    space = {"x": {"type": "float", "low": -5.0, "high": 5.0}, "n": {"type": "int", "low": 1, "high": 40}, "r": {"type": "float", "low": 1e-4, "high": 1.0, "log": True}, "c": {"type": "categorical", "choices": ["a", "b", "c"]}}

    def value(p):
        return -((p["x"] - 1) ** 2) - ((p["n"] - 30) / 10) ** 2 - (np.log10(p["r"]) + 2) ** 2 - (p["c"] != "b")

    best = {"tpe": [], "random": []}
    for seed in range(12):
        for name, found in best.items():
            rng, done = tuning.random.Random(seed), []
            for _ in range(60):
                p = tuning.suggest(space, done if name == "tpe" else [], rng)
                assert -5 <= p["x"] <= 5 and p["n"] in range(1, 41) and 1e-4 <= p["r"] <= 1
                done.append((p, value(p)))
            found.append(max(v for _, v in done))
    assert np.mean(best["tpe"]) > np.mean(best["random"]) / 2


def test_a_trial_keeps_its_error(spark, blobs):
    def run(p):
        if p["k_neighbors"] < 18:
            raise ValueError("too few neighbours")
        return 1.0

    t = tuning.Tuner(n_trials=30, n_jobs=3)
    rows = t.tune(blobs[2], run=run, num_layers=2).collect()
    assert len(rows) == 30 and "'num_layers': 2" in rows[0]["params"] and t.best["k_neighbors"] >= 18
    assert {r["error"] for r in rows if r["value"] < 0} == {"ValueError: too few neighbours"} and all(r["error"] is None for r in rows if r["value"] > 0)


def test_sources_round_trip(spark, tmp_path):
    (tmp_path / "m.csv").write_text("cell,A,B\nc1,1,0\nc2,0,2.5\n")
    want = [("c1", "A", 1.0), ("c1", "B", 0.0), ("c2", "A", 0.0), ("c2", "B", 2.5)]
    assert sorted(map(tuple, io.load_data(spark, str(tmp_path / "m.csv")).collect())) == want
    (tmp_path / "m.tsv").write_text("cell\tA\tB\nc1\t1\t0\nc2\t0\t2.5\n")
    assert sorted(map(tuple, io.load_data(spark, str(tmp_path / "m.tsv")).collect())) == want
    (tmp_path / "m.mtx").write_text("%%MatrixMarket matrix coordinate real general\n% note\n2 3 2\n1 1 4\n2 3 5.5\n")
    assert sorted(map(tuple, io.load_data(spark, str(tmp_path / "m.mtx")).collect())) == [(0, "gene_0", 4.0), (2, "gene_1", 5.5)]
    for name in ("x.h5ad", "x.zip"):
        with pytest.raises(ValueError):
            io.load_data(spark, name)
    (tmp_path / "s.gmt").write_text("T1\td\ta\tb\nshort\td\nT1\td\tc\nT2\td\ta\n")
    assert sorted(map(tuple, io.load_gmt(spark, str(tmp_path / "s.gmt")).collect())) == [("T1", "c"), ("T2", "a")]
    markers = spark.createDataFrame([(0, "x", 1), (0, "y", 0), (1, "z", 0)], "cluster int, gene string, ord int")
    io.export_gmt(markers, str(tmp_path / "out"))
    assert {(r["term"], r["gene"]) for r in io.load_gmt(spark, str(tmp_path / "out")).collect()} == {("Cluster_0", "x"), ("Cluster_0", "y"), ("Cluster_1", "z")}


def test_bundle_and_seurat(spark, blobs, tmp_path):
    expr, cells = io.simulate(spark, 20, 6, 2)
    assert expr.count() == 120 and expr.where("value < 0").count() == 0 and cells.select("label").distinct().count() == 2
    io.write_bundle(str(tmp_path / "b"), expr, cells, obsm={"pca": blobs[2]})
    back = io.read_bundle(spark, str(tmp_path / "b"))
    assert back["X"].count() == 120 and back["obsm/pca"].count() == 60
    io.to_seurat(expr, cells, blobs[2], str(tmp_path / "s"))
    assert spark.read.csv(str(tmp_path / "s/counts"), header=True).count() == 6


def test_annotation(spark):
    db = annotation.marker_database(spark, "all")
    assert db.where("cell_type = 'Endothelial' AND gene = 'KDR'").count() == 1 and db.where("cell_type = 'Endothelial' AND gene = 'CLDN5'").count() == 0
    with pytest.warns(UserWarning):
        assert annotation.marker_database(spark, "none").count() == annotation.marker_database(spark).count()
    expr = spark.createDataFrame([(i, g, 9.0 if (g == "cd14") == (i < 5) else 0.0) for i in range(10) for g in ("cd14", "CD19")], "cell_id long, gene string, value double")
    cells = spark.createDataFrame([(i, int(i >= 5)) for i in range(10)], "cell_id long, cluster int")
    m = annotation.marker_database(spark, custom={"mono": ["CD14"], "b": ["CD19"]})
    best = {r["cluster"]: r["cell_type"] for r in annotation.annotate_clusters(annotation.score_cell_types(expr, cells, m), cells).collect()}
    assert best == {0: "mono", 1: "b"}
    q = spark.createDataFrame([(0, g) for g in ("cdk1", "CDK2", "CCNA2", "TP53")], "cluster int, gene string")
    rows = annotation.enrich(q, annotation.builtin_gene_sets(spark)).collect()
    assert [r["term"] for r in rows] == ["Cell Cycle"] and rows[0]["overlap_count"] == 3


def test_preprocess_and_report(spark, tmp_path):
    expr, cells = io.simulate(spark, 40, 30, 3, dropout=0.2)
    emb = matrix.preprocess(expr, 20, 5, 3, 5)
    assert emb.first()["v"].__len__() == 5
    r = report.clustering_report(expr, cells.withColumnRenamed("label", "cluster"))
    r.save(str(tmp_path / "r.html"))
    assert "<table>" in (tmp_path / "r.html").read_text()


def test_streaming_windows_agree_with_batch(spark, tmp_path):
    rows = [("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 05:00:00", "a", 2.0), ("2024-01-02 01:00:00", "b", 3.0)]
    events = spark.createDataFrame(rows, "ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    events.write.parquet(str(tmp_path / "e"))
    stream = windowed_counts(spark.readStream.schema(events.schema).parquet(str(tmp_path / "e")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("windows").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("windows").collect())) == sorted(map(tuple, windowed_counts(events).collect()))
