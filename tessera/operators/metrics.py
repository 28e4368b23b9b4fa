"""Clustering metrics from contingency tables and from vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tiles


def contingency(pairs: DataFrame, true: str, pred: str) -> DataFrame:
    return pairs.groupBy(F.col(true).alias("t"), F.col(pred).alias("p")).agg(F.count("*").cast("double").alias("n"))


def contingency_metrics(pairs: DataFrame, true: str, pred: str) -> DataFrame:
    """One row: ari, nmi, homogeneity, completeness, v_measure of two labellings."""
    c = contingency(pairs, true, pred)
    choose = lambda x: x * (x - 1) / 2
    cell = c.agg(F.sum(choose(F.col("n"))).alias("both"), F.sum("n").alias("total"), F.sum(F.col("n") * F.ln("n")).alias("nn"))
    margin = lambda k, s: c.groupBy(k).agg(F.sum("n").alias("n")).agg(F.sum(choose(F.col("n"))).alias(f"pairs_{s}"), F.sum(F.col("n") * F.ln("n")).alias(f"ln_{s}"))
    x = cell.crossJoin(margin("t", "t")).crossJoin(margin("p", "p"))
    total = F.col("total")
    h = lambda s: F.ln(total) - F.col(f"ln_{s}") / total
    ht, hp = h("t"), h("p")
    mutual = ht + hp - (F.ln(total) - F.col("nn") / total)
    expected = F.col("pairs_t") * F.col("pairs_p") / choose(total)
    most = (F.col("pairs_t") + F.col("pairs_p")) / 2
    one = lambda a, b: F.when(F.abs(b) < 1e-12, 1.0).otherwise(a / b)
    homogeneity, completeness = one(mutual, ht), one(mutual, hp)
    return x.select(one(F.col("both") - expected, most - expected).alias("ari"), one(mutual, (ht + hp) / 2).alias("nmi"), homogeneity.alias("homogeneity"), completeness.alias("completeness"), one(2 * homogeneity * completeness, homogeneity + completeness).alias("v_measure"))


def assignment(cost: np.ndarray) -> np.ndarray:
    """Column of each row in a least-cost assignment of a square matrix (shortest augmenting paths)."""
    n = len(cost)
    u, v = np.zeros(n + 1), np.zeros(n + 1)
    row_of = np.zeros(n + 1, int)
    for i in range(1, n + 1):
        row_of[0] = i
        least, came, used = np.full(n + 1, np.inf), np.zeros(n + 1, int), np.zeros(n + 1, bool)
        j = 0
        while row_of[j]:
            used[j] = True
            free = ~used[1:]
            reduced = cost[row_of[j] - 1] - u[row_of[j]] - v[1:]
            better = free & (reduced < least[1:])
            least[1:][better] = reduced[better]
            came[1:][better] = j
            k = 1 + np.flatnonzero(free)[np.argmin(least[1:][free])]
            step = least[k]
            u[row_of[used]] += step
            v[used] -= step
            least[~used] -= step
            j = k
        while j:
            row_of[j] = row_of[came[j]]
            j = came[j]
    out = np.zeros(n, int)
    out[row_of[1:] - 1] = np.arange(n)
    return out


def accuracy(pairs: DataFrame, true: str, pred: str) -> float:
    """Share of rows whose cluster is matched to their label. The table of labels (k x k) is gathered."""
    rows = contingency(pairs, true, pred).collect()
    t = {k: i for i, k in enumerate(sorted({r["t"] for r in rows}))}
    p = {k: i for i, k in enumerate(sorted({r["p"] for r in rows}))}
    table = np.zeros((max(len(t), len(p)),) * 2)
    for r in rows:
        table[p[r["p"]], t[r["t"]]] += r["n"]
    return float(table[np.arange(len(table)), assignment(-table)].sum() / max(1.0, table.sum()))


def squared(a: Column, b: Column) -> Column:
    """Squared Euclidean distance of two arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, x: acc + x)


def centroids(emb: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """c, size, center."""
    x = emb.select("cell_id", F.posexplode("v").alias("i", "x")).join(labels.select("cell_id", F.col(label).alias("c")), "cell_id")
    return x.groupBy("c", "i").agg(F.avg("x").alias("m"), F.count("*").alias("size")).groupBy("c").agg(F.max("size").alias("size"), F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("center"))


class _ClusterSums:
    """Sums of the held vectors' distances to the streamed ones of each cluster."""

    def __init__(self, ids: np.ndarray, v: np.ndarray):
        self.ids, self.v, self.total = ids, v, {}

    def add(self, ids: np.ndarray, v: np.ndarray, clusters: pa.Array) -> None:
        names, code = np.unique(np.array(clusters.to_pylist(), object).astype(str), return_inverse=True)
        member = np.eye(len(names))[code]
        for rows in tiles.pieces(len(self.ids)):
            x = self.v[rows]
            d2 = tiles.squared_distances(x, v)
            row, col = np.nonzero(d2 <= 1e3 * tiles.slack(x, v)[:, None])
            d = np.sqrt(np.maximum(d2, 0))
            d[row, col] = tiles.exact_distances(x, v, row, col)
            for name, sums in zip(names, (d @ member).T, strict=True):
                self.total.setdefault(str(name), np.zeros(len(self.ids)))[rows] += sums

    def rows(self) -> pa.RecordBatch:
        names = np.repeat(np.array(list(self.total), object), len(self.ids))
        return pa.RecordBatch.from_arrays([pa.array(np.tile(self.ids, len(self.total))), pa.array(names, pa.string()), pa.array(np.concatenate(list(self.total.values())))], ["cell_id", "c", "total"])


def silhouette(emb: DataFrame, labels: DataFrame, label: str, rows: int = tiles.HOLD) -> DataFrame:
    """cell_id, c, s: Euclidean silhouette of each cell; a cell alone in its cluster has 0.

    Distances are summed by cluster within tasks that hold `rows` cells at most, and never listed.
    """
    marked = emb.select("cell_id", "v").join(labels.select("cell_id", F.col(label).cast("string").alias("c")), "cell_id")
    side = marked.select(F.col("cell_id").cast("long").alias("id"), "v", F.col("c").alias("x"))
    summed = tiles.tiled(side, side, lambda ids, v, _: _ClusterSums(ids, v), "cell_id long, c string, total double", rows).groupBy("cell_id", "c").agg(F.sum("total").alias("total"))
    sizes = marked.groupBy("c").agg(F.count("*").alias("size"))
    x = summed.join(F.broadcast(sizes), "c").join(marked.select("cell_id", F.col("c").alias("own")), "cell_id")
    s = x.groupBy("cell_id", "own").agg(F.max(F.when((F.col("c") == F.col("own")) & (F.col("size") > 1), F.col("total") / (F.col("size") - 1))).alias("a"), F.min(F.when(F.col("c") != F.col("own"), F.col("total") / F.col("size"))).alias("b"))
    return s.select("cell_id", F.col("own").alias("c"), F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)).alias("s"))


def calinski_davies(emb: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """One row: calinski_harabasz, davies_bouldin."""
    cent = centroids(emb, labels, label)
    n_k = labels.agg(F.count("*").alias("n"), F.count_distinct(label).alias("k"))
    mean = centroids(emb, labels.withColumn("_all", F.lit(1)), "_all").select(F.col("center").alias("mean"))
    x = emb.join(labels.select("cell_id", F.col(label).alias("c")), "cell_id").join(F.broadcast(cent), "c").select("c", squared(F.col("v"), F.col("center")).alias("d2"))
    within = x.agg(F.sum("d2").alias("w"))
    between = cent.crossJoin(F.broadcast(mean)).agg(F.sum(F.col("size") * squared(F.col("center"), F.col("mean"))).alias("b"))
    spread = x.groupBy("c").agg(F.avg(F.sqrt("d2")).alias("s")).join(cent, "c")
    pairs = spread.alias("i").join(spread.alias("j"), F.col("i.c") != F.col("j.c"))
    worst = pairs.groupBy("i.c").agg(F.max((F.col("i.s") + F.col("j.s")) / F.sqrt(squared(F.col("i.center"), F.col("j.center")))).alias("r"))
    db = worst.agg(F.avg("r").alias("davies_bouldin"))
    ch = (F.col("b") / (F.col("k") - 1)) / (F.col("w") / (F.col("n") - F.col("k")))
    return within.crossJoin(between).crossJoin(n_k).crossJoin(db).select(ch.alias("calinski_harabasz"), "davies_bouldin")


def evaluate(found: DataFrame, truth: DataFrame, label: str, emb: DataFrame | None = None) -> dict[str, float]:
    """All metrics of labels (cell_id, label) against true ones; with vectors and several clusters the inner ones too."""
    pairs = found.select("cell_id", F.col("label").alias("_found")).join(truth.select("cell_id", F.col(label).alias("_true")), "cell_id")
    out = contingency_metrics(pairs, "_true", "_found").first().asDict() | {"accuracy": accuracy(pairs, "_true", "_found")}
    if emb is not None and found.select("label").distinct().count() > 1:
        out |= calinski_davies(emb, found, "label").first().asDict() | {"silhouette": silhouette(emb, found, "label").agg(F.avg("s")).first()[0]}
    return out


def summarize(runs: DataFrame) -> DataFrame:
    """mean, std (population), min, max of each metric over runs (metric, value)."""
    return runs.groupBy("metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))


