"""Work and rows made by queries that once grew with the square of their input or of a group."""

import numpy as np

from pyspark.sql import functions as F

from tessera.operators import clustering, neighbors, stats


def test_mean_consensus_makes_no_pairs(spark, monkeypatch):
    """Equal to the means of all pairs, with rows of no label, repeated rows and a cell without an id."""
    rng = np.random.default_rng(3)
    rows = [(i, c, int(label) if label < 3 else None, bool(s)) for i in range(3) for c, label, s in zip(range(40), rng.integers(0, 4, 40), rng.random(40) < 0.7, strict=True)]
    rows += [(0, 5, 1, True), (1, None, 2, True), (2, 99, None, True), (0, 98, 1, False)]
    runs = spark.createDataFrame(rows, "iter int, cell_id long, label int, sampled boolean")
    pairs = {}
    for run, a, la, sa in rows:
        for other, b, lb, sb in rows:
            if run == other and sa and sb:
                pairs.setdefault((a, b), []).append(None if la is None or lb is None else float(la == lb))
    want = {}
    for (a, _), x in pairs.items():
        x = [e for e in x if e is not None]
        want.setdefault(a, []).append(sum(x) / len(x) if x else None)
    want = {a: (len(x), [e for e in x if e is not None]) for a, x in want.items()}
    monkeypatch.setattr(clustering, "consensus", None)
    got = {r["i"]: (r["n"], r["mean_consensus"]) for r in clustering.mean_consensus(runs).collect()}
    assert got.keys() == want.keys() and 98 not in got
    for a, (n, x) in want.items():
        assert got[a][0] == n
        assert (got[a][1] is None) if not x else np.isclose(got[a][1], sum(x) / len(x), atol=1e-12)


def test_adjustment_reads_no_frame_twice(spark):
    """One group of many tests: the least from each on is a running one, and equal to that by NumPy."""
    n = 60_000
    x = spark.range(n).select("id", (F.col("id") * 2654435761 % 1000003 / 1000003.0).alias("p"))
    out = stats.adjust(x, "p", order=("id",))
    assert "currentrow$(), unboundedfollowing$()" not in out._jdf.queryExecution().analyzed().toString().lower()
    rows = out.toPandas().sort_values(["p", "id"])
    q = rows["p"].to_numpy() * n / np.arange(1, n + 1)
    assert np.allclose(rows["padj"].to_numpy(), np.minimum(np.minimum.accumulate(q[::-1])[::-1], 1), rtol=0, atol=1e-12)


def _brute(m, k):
    d = np.sqrt(((m[:, None] - m[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    return [sorted(range(len(m)), key=lambda j: (d[i, j], j))[:k] for i in range(len(m))]


def test_vectors_without_structure_go_to_the_grid(spark, monkeypatch):
    """Cells would leave nothing out; and what was found is read, not searched again."""
    m = np.random.default_rng(5).normal(size=(900, 48))
    used = []
    grid = neighbors._in_grid
    monkeypatch.setattr(neighbors, "_in_grid", lambda *a: used.append(a[3:]) or grid(*a))
    near = neighbors.knn(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "cell_id long, v array<double>"), 6, block_rows=300)
    assert used == [(300, 900, 900)]
    assert "MapInArrow" not in near._jdf.queryExecution().executedPlan().toString()
    got = {}
    for r in near.collect():
        got.setdefault(r["src"], {})[r["rank"]] = r["dst"]
    assert [[got[i][r] for r in range(1, 7)] for i in range(900)] == _brute(m, 6)


def test_single_precision_leaves_none_out():
    """Far from the origin, of very different lengths, equal vectors, and some that are no numbers."""
    rng = np.random.default_rng(6)
    for m in (rng.normal(size=(700, 5)) + 1e7, rng.normal(size=(700, 5)) * 10.0 ** rng.integers(-8, 8, (700, 1)), rng.integers(0, 3, (700, 5)).astype(float), rng.normal(size=(700, 5)) * np.where(np.arange(700) % 50, 1.0, 1e25)[:, None]):
        m[690] = np.nan
        for batch in (700, 64):
            kernel = neighbors._Nearest(np.arange(300), m[:300], 7)
            for at in range(0, 700, batch):
                kernel.add(np.arange(700)[at : at + batch], m[at : at + batch], None)
            rows = kernel.rows().to_pandas().sort_values(["src", "d", "dst"])
            assert rows["dst"].to_numpy().reshape(300, 7).tolist() == _brute(np.where(np.isnan(m), np.inf, m), 7)[:300]


def test_own_cell_bounds_a_query(spark):
    """Short vectors in many cells: fewer pairs than with the few scouts' bounds alone, and the same neighbours."""
    m = np.random.default_rng(7).normal(size=(6_000, 3))
    compared = spark.sparkContext.accumulator(0)
    near = neighbors.knn_in_cells(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "cell_id long, v array<double>"), 8, block_rows=1_000, compared=compared)
    got = {}
    for r in near.collect():
        got.setdefault(r["src"], {})[r["rank"]] = r["dst"]
    for i in range(0, 6_000, 97):
        d = np.sqrt(((m - m[i]) ** 2).sum(1))
        d[i] = np.inf
        assert [got[i][r] for r in range(1, 9)] == sorted(np.argsort(d, kind="stable")[:8], key=lambda j: (d[j], j))
    assert compared.value < 0.11 * 6_000**2


def test_hierarchies_of_a_few_thousand_take_no_rounds(spark):
    m = np.random.default_rng(8).normal(size=(1_500, 8))
    merges = clustering.ward_merges(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "cell_id long, v array<double>"))
    assert merges.agg(F.max("round"), F.count("*")).first() == (0, 1_499)


def test_linkage_is_that_of_the_whole_matrix():
    """Against the least of all distances at each step, with ties."""
    rng = np.random.default_rng(9)
    for method in ("single", "complete", "average", "ward"):
        m = rng.integers(0, 4, (60, 2)).astype(float)
        d = np.sqrt(((m[:, None] - m[None]) ** 2).sum(2))
        got = clustering.linkage(d, method)
        np.fill_diagonal(d, np.inf)
        name, size = list(range(60)), np.ones(60)
        for new, step in enumerate(got, 60):
            i, j = sorted(divmod(int(d.argmin()), 60))
            assert step[:2] == tuple(sorted((name[i], name[j]))) and step[2] == d[i, j]
            x, y, best = d[i].copy(), d[j].copy(), d[i, j]
            if method == "ward":
                with np.errstate(invalid="ignore"):
                    row = np.sqrt(((size[i] + size) * x * x + (size[j] + size) * y * y - size * best * best) / (size[i] + size[j] + size))
            else:
                row = {"single": np.minimum(x, y), "complete": np.maximum(x, y), "average": (size[i] * x + size[j] * y) / (size[i] + size[j])}[method]
            row[[i, j]] = np.inf
            row[np.isnan(row)] = np.inf
            d[i], d[:, i] = row, row
            d[j], d[:, j] = np.inf, np.inf
            size[i], size[j], name[i] = size[i] + size[j], 0, new
