"""Pseudotime over embeddings (cell_id, v). Graphs of clusters (k x k) are handled on the driver."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.lineage import cut
from ..functions.order import medians
from ..functions.vectors import gathered, keyed_sums, matrix_of
from . import metrics
from .matrix import pca
from .neighbors import knn, paga_connectivity


#: Change of the leading values, by the greatest, below which the iteration ends.
TOLERANCE = 1e-3


def rescale(x: DataFrame, column: str = "pseudotime") -> DataFrame:
    """Brought to 0..1 over all cells; constant values become 0."""
    span = x.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    return x.crossJoin(F.broadcast(span)).withColumn(column, F.coalesce(F.try_divide(F.col(column) - F.col("_lo"), F.col("_hi") - F.col("_lo")), F.lit(0.0))).drop("_lo", "_hi")


def diffusion_pseudotime(emb: DataFrame, root: int | None = None, k: int = 15, n_components: int = 10, alpha: float = 1.0) -> DataFrame:
    """cell_id, pseudotime: distance to the root in diffusion space.

    The affinity of the symmetric neighbour graph is normalised on both sides, which has the spectrum of
    the random walk. The leading components come from power iterations over joins.
    """
    near = cut(knn(emb, k))
    sigma = medians(near, "d").withColumnRenamed("median", "sigma")
    w = near.crossJoin(F.broadcast(sigma)).select("src", "dst", F.exp(-F.col("d") * F.col("d") / (2 * F.col("sigma") * F.col("sigma") + 1e-10)).alias("w"))
    a = w.unionAll(w.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")).groupBy("src", "dst").agg((F.sum("w") / 2).alias("w"))
    deg = a.groupBy("src").agg(F.sum("w").alias("deg"))
    norm = cut(a.join(deg, "src").join(deg.select(F.col("src").alias("dst"), F.col("deg").alias("deg2")), "dst").select("src", "dst", (F.col("w") / F.sqrt(F.col("deg") * F.col("deg2"))).alias("w")))
    space = _power_iteration(norm, deg, n_components, alpha)
    if root is None:
        mean = metrics.centroids(space, space.select("cell_id").withColumn("c", F.lit(1)), "c").select("center")
        root = space.crossJoin(F.broadcast(mean)).select("cell_id", metrics.squared(F.col("v"), F.col("center")).alias("d")).orderBy(F.desc("d"), "cell_id").first()[0]
    start = space.where(F.col("cell_id") == root).select(F.col("v").alias("_root"))
    return rescale(space.crossJoin(F.broadcast(start)).select("cell_id", F.sqrt(metrics.squared(F.col("v"), F.col("_root"))).alias("pseudotime")))


def _power_iteration(norm: DataFrame, deg: DataFrame, n_components: int, alpha: float, rounds: int = 30, seed: int = 0) -> DataFrame:
    """Leading components by orthogonal iteration: each round two joins, and a small matrix of inner products, until that settles.

    The last round's small matrix is diagonalised, which turns the basis into the components.
    """
    m = n_components + 4  # a few more than asked for, so that those asked for settle
    start = F.array(*((F.pmod(F.xxhash64("src", F.lit(seed + i)), F.lit(20_001)) / 10_000 - 1).cast("double") for i in range(m)))
    x = deg.select(F.col("src").alias("cell_id"), start.alias("v"))

    def turned(y: DataFrame, turn: np.ndarray) -> DataFrame:
        return y.select("cell_id", F.array(*(sum((F.col("v")[i] * float(turn[i, j]) for i in range(m)), F.lit(0.0)) for j in range(turn.shape[1]))).alias("v"))

    def inner(y: DataFrame, a: str, b: str) -> np.ndarray:
        return np.array(y.agg(*(F.sum(F.col(a)[i] * F.col(b)[j]).alias(f"g{i}_{j}") for i in range(m) for j in range(m))).first(), float).reshape(m, m)

    def times(y: DataFrame) -> DataFrame:
        return norm.join(y.select(F.col("cell_id").alias("dst"), "v"), "dst").groupBy(F.col("src").alias("cell_id")).agg(F.array(*(F.sum(F.col("w") * F.col("v")[i]) for i in range(m))).alias("v"))

    before = np.zeros(m)
    for _ in range(rounds):
        y = cut(times(times(x)))
        gram = inner(y, "v", "v")
        x = cut(turned(y, np.linalg.inv(np.linalg.cholesky(gram + 1e-14 * np.trace(gram) * np.eye(m))).T))
        found = np.sqrt(np.maximum(np.linalg.eigvalsh(gram)[::-1], 0))
        settled = np.abs(found - before)[: n_components + 1].max() <= TOLERANCE * found[0]
        before = found
        if settled:
            break
    moved = times(x)
    small = inner(x.join(moved.withColumnRenamed("v", "av"), "cell_id"), "v", "av")
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    take = np.argsort(-values)[1 : n_components + 1]
    return turned(x, vectors[:, take] * np.abs(values[take]) ** alpha)


def principal_curve(emb: DataFrame, n_points: int = 100, max_iter: int = 50, tol: float = 1e-4) -> DataFrame:
    """cell_id, pseudotime: position on a kernel-smoothed curve, first ordered by the first component.

    The curve (n_points vectors) is gathered each round; cells are passed over twice.
    """
    grid = np.linspace(0, 1, n_points)
    first = rescale(pca(emb, 1).select("cell_id", F.col("v")[0].alias("pseudotime")))
    x = cut(emb.select("cell_id", "v").join(first, "cell_id"))
    width = x.select(F.size("v")).first()[0]
    for _ in range(max_iter):

        def smooth(rows: pa.RecordBatch):
            w = np.exp(-((rows.column("pseudotime").to_numpy()[:, None] - grid[None]) ** 2) / 0.05)
            return np.arange(n_points), w.sum(0), w.T @ matrix_of(rows.column("v"))

        totals, sums = gathered(keyed_sums(x.select("v", "pseudotime"), smooth), n_points, width)
        curve = sums / np.maximum(totals, 1e-300)[:, None]

        def project(batches, curve=curve):
            for rows in batches:
                v = matrix_of(rows.column("v"))
                if len(v):
                    d2 = (v * v).sum(1)[:, None] + (curve * curve).sum(1)[None] - 2 * v @ curve.T
                    yield pa.RecordBatch.from_arrays([rows.column("cell_id"), rows.column("v"), pa.array(grid[d2.argmin(1)]), rows.column("pseudotime")], ["cell_id", "v", "pseudotime", "old"])

        new = cut(x.mapInArrow(project, "cell_id long, v array<double>, pseudotime double, old double"))
        moved = new.agg(F.avg(F.abs(F.col("pseudotime") - F.col("old")))).first()[0]
        x = new.drop("old")
        if moved < tol:
            break
    return rescale(x.select("cell_id", "pseudotime"))


def _shortest(weights: dict[tuple[int, int], float], n: int, start: int) -> tuple[list[float], list[int]]:
    dist, came = [float("inf")] * n, [-1] * n
    dist[start] = 0.0
    heap = [(0.0, start)]
    while heap:
        d, a = heapq.heappop(heap)
        if d > dist[a]:
            continue
        for (x, b), w in weights.items():
            if x == a and d + w < dist[b]:
                dist[b], came[b] = d + w, a
                heapq.heappush(heap, (dist[b], b))
    return dist, came


def slingshot(emb: DataFrame, labels: DataFrame, label: str, start: object = None) -> DataFrame:
    """cell_id, pseudotime, branch: along the paths of the centroids' spanning tree from the start cluster to its leaves.

    Of clusters that several branches share the last branch's time counts.
    """
    rows = sorted(metrics.centroids(emb, labels, label).collect(), key=lambda r: r["c"])
    names = [r["c"] for r in rows]
    centers = np.array([r["center"] for r in rows])
    n = len(names)
    d = np.sqrt(((centers[:, None] - centers[None]) ** 2).sum(2))
    if start is None:
        first = pca(emb, 1).join(labels.select("cell_id", F.col(label).alias("c")), "cell_id").groupBy("c").agg(F.avg(F.col("v")[0]).alias("m")).orderBy("m", "c").first()[0]
        start = first
    root = names.index(start)
    tree: dict[tuple[int, int], float] = {}
    inside = {root}
    while len(inside) < n:
        a, b = min(((a, b) for a in inside for b in range(n) if b not in inside), key=lambda e: (d[e], e))
        tree[a, b] = tree[b, a] = float(d[a, b])
        inside.add(b)
    _, came = _shortest(tree, n, root)
    leaves = [i for i in range(n) if i != root and sum(a == i for a, _ in tree) == 1] or [root]
    steps = []
    for branch, leaf in enumerate(leaves):
        path = [leaf]
        while path[-1] != root:
            path.append(came[path[-1]])
        path.reverse()
        for i, c in enumerate(path):
            after = path[i + 1] if i + 1 < len(path) else path[i - 1] if i else c
            steps.append((names[c], branch, i, [float(v) for v in centers[after]], i + 1 == len(path)))
    kind = labels.schema[label].dataType.simpleString()
    plan = emb.sparkSession.createDataFrame(steps, f"c {kind}, branch int, step int, toward array<double>, last boolean")
    x = emb.join(labels.select("cell_id", F.col(label).alias("c")), "cell_id").join(F.broadcast(plan), "c").withColumn("d", F.sqrt(metrics.squared(F.col("v"), F.col("toward"))))
    group = Window.partitionBy("c", "branch")
    lo, hi = F.min("d").over(group), F.max("d").over(group)
    near = F.coalesce(F.try_divide(F.col("d") - lo, hi - lo), F.lit(0.0))
    x = x.withColumn("t", F.col("step") + F.when(F.col("last"), near).otherwise(1 - near))
    return rescale(x.groupBy("cell_id").agg(F.max_by("t", "branch").alias("pseudotime"), F.max("branch").alias("branch")))


def paga(emb: DataFrame, labels: DataFrame, label: str, k: int = 15, threshold: float = 0.05, root: object = None) -> DataFrame:
    """cell_id, pseudotime: shortest way over 1 / connectivity from the root cluster, plus 0.05 of the distance within the cluster."""
    w = paga_connectivity(knn(emb, k), labels, label, k).where(F.col("weight") > threshold).collect()
    names = sorted(r[0] for r in labels.select(label).distinct().collect())
    at = {c: i for i, c in enumerate(names)}
    dist, _ = _shortest({(at[r["c1"]], at[r["c2"]]): 1 / r["weight"] for r in w}, len(names), at[root] if root is not None else 0)
    reached = max([v for v in dist if v < float("inf")], default=0.0)
    rows = [(c, v if v < float("inf") else reached + 1) for c, v in zip(names, dist, strict=True)]
    steps = emb.sparkSession.createDataFrame(rows, f"c {labels.schema[label].dataType.simpleString()}, t double")
    cent = metrics.centroids(emb, labels, label).select("c", "center")
    x = emb.join(labels.select("cell_id", F.col(label).alias("c")), "cell_id").join(F.broadcast(cent), "c").join(F.broadcast(steps), "c").withColumn("d", F.sqrt(metrics.squared(F.col("v"), F.col("center"))))
    far = F.max("d").over(Window.partitionBy("c"))
    return rescale(x.select("cell_id", (F.col("t") + 0.05 * F.coalesce(F.try_divide(F.col("d"), far), F.lit(0.0))).alias("pseudotime")))


def infer_trajectory(emb: DataFrame, labels: DataFrame | None = None, label: str = "label", method: str = "dpt", root: object = None) -> DataFrame:
    if method == "dpt":
        return diffusion_pseudotime(emb, root)
    if method == "principal_curve":
        t = principal_curve(emb)
        flip = root is not None and t.where(F.col("cell_id") == root).first()["pseudotime"] > 0.5
        return t.withColumn("pseudotime", 1 - F.col("pseudotime")) if flip else t
    if method not in ("slingshot", "paga"):
        raise ValueError("method is dpt, slingshot, paga or principal_curve")
    if labels is None:
        raise ValueError("labels are needed")
    return slingshot(emb, labels, label, root) if method == "slingshot" else paga(emb, labels, label, root=root)
