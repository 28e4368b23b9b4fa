"""What charts show, as tables: each function returns the rows a chart would draw. Nothing is rendered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.order import quantiles
from . import matrix, metrics
from .expression import top_markers
from .neighbors import knn
from .stats import joined


def confidence_distribution(cells: DataFrame, value: str = "confidence", by: str = "cluster") -> DataFrame:
    """by, n, min, q1, median, q3, max of a value: a box for each cluster."""
    x = cells.groupBy(by).agg(F.count(value).alias("n"), F.min(value).alias("min"), F.max(value).alias("max"))
    x = joined(x, quantiles(cells, value, by, shares=(0.25, 0.5, 0.75)), [by], "left")
    return x.select(by, "n", "min", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), "max")


def abundance_bars(cells: DataFrame, condition: str) -> DataFrame:
    """cluster, condition, n, prop within the condition."""
    c = cells.groupBy("cluster", F.col(condition).alias("condition")).agg(F.count("*").alias("n"))
    return c.withColumn("prop", F.col("n") / F.sum("n").over(Window.partitionBy("condition")))


def marker_heatmap(markers: DataFrame, top_n: int = 5) -> DataFrame:
    """cluster, cell_type, gene, z_score of the top_n genes of each type by mean z (see annotation.marker_expression)."""
    order = Window.partitionBy("cell_type").orderBy(F.desc("m"), "gene")
    best = markers.groupBy("cell_type", "gene").agg(F.avg("z_score").alias("m")).withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= top_n).select("cell_type", "gene")
    return markers.join(best, ["cell_type", "gene"], "left_semi").groupBy("cluster", "cell_type", "gene").agg(F.avg("z_score").alias("z_score"))


def marker_bars(markers: DataFrame, n: int = 5) -> DataFrame:
    return top_markers(markers, n).select("cluster", "gene", "score")


def enrichment_bars(enriched: DataFrame, top_n: int = 5, key: str = "cluster") -> DataFrame:
    """key, term (40 characters at most), neg_log10_padj of each key's first terms."""
    order = Window.partitionBy(key).orderBy("adjusted_pvalue", "pvalue", "term")
    x = enriched.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= top_n)
    return x.select(key, F.substring("term", 1, 40).alias("term"), (-F.log10(F.greatest("adjusted_pvalue", F.lit(1e-300)))).alias("neg_log10_padj"))


def abundance_volcano(abundance: DataFrame, p: float = 0.05, fc: float = 0.5) -> DataFrame:
    kind = F.when((F.col("padj") < p) & (F.col("log2FC") > fc), "up").when((F.col("padj") < p) & (F.col("log2FC") < -fc), "down").otherwise("none")
    return abundance.select("cluster", "log2FC", (-F.log10(F.greatest("padj", F.lit(1e-300)))).alias("neg_log10_padj"), kind.alias("class"))


def de_heatmap(expr: DataFrame, de: DataFrame, groups: DataFrame, group: str, top_n: int = 20, p: float = 0.05, fc: float = 0.5) -> DataFrame:
    """gene, group, cell_id, z of the genes that change most either way."""
    up = de.where((F.col("padj") < p) & (F.col("log2FC") > fc)).orderBy(F.desc("log2FC"), "gene").limit(top_n)
    down = de.where((F.col("padj") < p) & (F.col("log2FC") < -fc)).orderBy("log2FC", "gene").limit(top_n)
    x = expr.join(up.unionByName(down).select("gene").distinct(), "gene", "left_semi").join(groups.select("cell_id", F.col(group).alias("group")), "cell_id")
    return matrix.scale_clip(x.select("cell_id", "gene", "value")).join(groups.select("cell_id", F.col(group).alias("group")), "cell_id").select("gene", "group", "cell_id", "z")


def histogram(rows: DataFrame, value: str, n_bins: int = 50) -> DataFrame:
    """bin, low, high, n: equal-width bins, the greatest value in the last; bins without rows are absent."""
    x = rows.where(F.col(value).isNotNull()).crossJoin(F.broadcast(rows.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))))
    width = (F.col("_hi") - F.col("_lo")) / n_bins
    b = F.when(width == 0, 0).otherwise(F.least(F.floor(F.try_divide(F.col(value) - F.col("_lo"), width)), F.lit(n_bins - 1))).cast("int")
    return x.select(b.alias("bin"), "_lo", width.alias("_w")).groupBy("bin").agg(F.first("_lo").alias("_lo"), F.first("_w").alias("_w"), F.count("*").alias("n")).select("bin", (F.col("_lo") + F.col("bin") * F.col("_w")).alias("low"), (F.col("_lo") + (F.col("bin") + 1) * F.col("_w")).alias("high"), "n")


def counts(rows: DataFrame, column: str) -> DataFrame:
    """column, n, prop: phases, predicted doublets, cell types."""
    return rows.groupBy(column).agg(F.count("*").alias("n")).crossJoin(F.broadcast(rows.agg(F.count("*").alias("_t")))).select(column, "n", (F.col("n") / F.col("_t")).alias("prop"))


def scatter(emb: DataFrame, *tables: DataFrame, axes: int = 2, reduce: str = "none") -> DataFrame:
    """cell_id, x, y (, z) and the columns of the tables by cell; reduce="pca" projects first."""
    if reduce not in ("none", "pca"):
        raise ValueError("reduce is none or pca")
    e = matrix.pca(emb, axes) if reduce == "pca" else emb
    out = e.select("cell_id", *(F.col("v")[i].alias("xyz"[i]) for i in range(axes)))
    for t in tables:
        out = out.join(t, "cell_id", "left")
    return out


def gene_facets(emb: DataFrame, expr: DataFrame, genes: list[str]) -> DataFrame:
    """gene, cell_id, x, y, value; names are compared in upper case, and ValueError if none is found."""
    found = expr.where(F.upper("gene").isin([g.upper() for g in genes]))
    if found.isEmpty():
        raise ValueError("none of the genes is in the matrix")
    return found.join(scatter(emb), "cell_id").select("gene", "cell_id", "x", "y", "value")


def trajectory_arrows(emb: DataFrame, pseudotime: DataFrame, density: float = 0.1, k: int = 10, seed: int = 0) -> DataFrame:
    """cell_id, to: for a share of the cells the nearest neighbour that is later."""
    t = pseudotime.select("cell_id", "pseudotime")
    x = knn(emb, k).join(t.select(F.col("cell_id").alias("src"), F.col("pseudotime").alias("t0")), "src").join(t.select(F.col("cell_id").alias("dst"), F.col("pseudotime").alias("t1")), "dst")
    later = x.where("t1 > t0").groupBy(F.col("src").alias("cell_id")).agg(F.min_by("dst", F.struct("d", "dst")).alias("to"))
    return later.where(F.pmod(F.xxhash64(F.lit(seed), "cell_id"), F.lit(1_000_003)) < int(density * 1_000_003))


def silhouette_bars(emb: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """cell_id, c, s, pos: silhouettes in falling order within each cluster."""
    s = metrics.silhouette(emb, labels, label)
    return s.withColumn("pos", F.row_number().over(Window.partitionBy("c").orderBy(F.desc("s"), "cell_id")))


def label_comparison(a: DataFrame, b: DataFrame, label: str) -> DataFrame:
    """label_1, label_2, n of two labellings of the same cells."""
    x = a.select("cell_id", F.col(label).alias("label_1")).join(b.select("cell_id", F.col(label).alias("label_2")), "cell_id")
    return x.groupBy("label_1", "label_2").agg(F.count("*").alias("n"))
