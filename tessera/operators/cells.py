"""Quality control, composition, abundance, batch correction and gene-set scores of cells."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.order import medians
from ..functions.special import chi2_1_sf, fisher_two_sided
from . import stats


def cell_qc(expr: DataFrame, cells: DataFrame, mt_prefix: str = "MT-", rb_prefix: str = "RP") -> DataFrame:
    """cell_id, cluster, total_counts, n_genes, pct_mt, pct_rb; cells without rows count 0."""

    def starting(prefix: str) -> Column:
        return F.sum(F.when(F.startswith(F.upper("gene"), F.lit(prefix.upper())), F.col("value")).otherwise(0.0))

    s = expr.groupBy("cell_id").agg(F.sum("value").alias("s"), F.count_if(F.col("value") > 0).alias("g"), starting(mt_prefix).alias("m"), starting(rb_prefix).alias("r"))
    x = cells.join(s, "cell_id", "left")
    total = F.coalesce("s", F.lit(0.0))
    share = lambda c: 100.0 * F.coalesce(c, F.lit(0.0)) / F.greatest(total, F.lit(1.0))
    return x.select("cell_id", "cluster", total.alias("total_counts"), F.coalesce("g", F.lit(0)).cast("long").alias("n_genes"), share("m").alias("pct_mt"), share("r").alias("pct_rb"))


def cluster_qc(qc: DataFrame) -> DataFrame:
    """Sizes, means, medians and population deviations by cluster."""
    names = {"total_counts": "counts", "n_genes": "n_genes", "pct_mt": "pct_mt", "pct_rb": "pct_rb"}
    deviations = [F.stddev_pop(c).alias(f"std_{names[c]}") for c in ("total_counts", "n_genes")]
    whole = qc.groupBy("cluster").agg(F.count("*").alias("n_cells"), *(F.avg(c).alias(f"mean_{n}") for c, n in names.items()), *deviations)
    measures = qc.select("cluster", F.inline(F.array(*(F.struct(F.lit(n).alias("measure"), F.col(c).cast("double").alias("value")) for c, n in names.items()))))
    middle = medians(measures, "value", "cluster", "measure").groupBy("cluster").agg(*(F.max(F.when(F.col("measure") == n, F.col("median"))).alias(f"median_{n}") for n in names.values()))
    return stats.joined(whole, middle, ["cluster"], "left")


def overall_qc(qc: DataFrame) -> DataFrame:
    """One row over all clusters."""
    sizes = qc.groupBy("cluster").agg(F.count("*").alias("n"), F.sum("total_counts").alias("s"))
    return sizes.agg(F.sum("n").alias("n_cells"), F.count("*").alias("n_clusters"), F.min("n").alias("min_cluster_size"), F.max("n").alias("max_cluster_size"), F.avg("n").alias("mean_cluster_size"), (F.sum("s") / F.sum("n")).alias("mean_counts"))


def cluster_means(expr: DataFrame, cells: DataFrame) -> DataFrame:
    return expr.join(cells.select("cell_id", "cluster"), "cell_id").groupBy("cluster", "gene").agg(F.avg("value").alias("mean"))


def top_varying(means: DataFrame, n: int) -> DataFrame:
    """Rows of the n genes whose cluster means vary most."""
    best = means.groupBy("gene").agg(F.var_pop("mean").alias("v")).orderBy(F.desc("v"), "gene").limit(n).select("gene")
    return means.join(best, "gene", "left_semi")


def purity(cells: DataFrame, label: str) -> DataFrame:
    """Majority label by cluster; of equal counts the smallest label."""
    counts = cells.groupBy("cluster", F.col(label).alias("label")).agg(F.count("*").alias("n"))
    group = Window.partitionBy("cluster")
    x = counts.withColumns({"r": F.row_number().over(group.orderBy(F.desc("n"), "label")), "n_cells": F.sum("n").over(group), "n_labels": F.count("*").over(group)})
    return x.where("r = 1").select("cluster", "n_cells", F.col("label").alias("majority_label"), F.col("n").alias("majority_count"), (F.col("n") / F.col("n_cells")).alias("purity"), "n_labels")


def composition(cells: DataFrame, by: str, of: str) -> DataFrame:
    """n and prop of each value of `of` within each value of `by`."""
    return cells.groupBy(by, of).agg(F.count("*").alias("n")).withColumn("prop", F.col("n") / F.sum("n").over(Window.partitionBy(by)))


def abundance(cells: DataFrame, condition: str, condition1: str, condition2: str, method: str = "fisher", min_cells: int = 10, pseudocount: float = 0.5, n_permutations: int = 1000, seed: int = 0) -> DataFrame:
    """cluster, n1, n2, prop1, prop2, log2FC, statistic, pvalue, padj of two conditions' shares of each cluster."""
    x = cells.where(F.col(condition).isin(condition1, condition2)).withColumn("_1", F.col(condition) == condition1)
    totals = x.agg(F.count_if("_1").alias("t1"), F.count_if(~F.col("_1")).alias("t2"))
    c = x.groupBy("cluster").agg(F.count_if("_1").alias("n1"), F.count_if(~F.col("_1")).alias("n2")).where(F.col("n1") + F.col("n2") >= min_cells).crossJoin(F.broadcast(totals))
    c = c.withColumns({"prop1": F.col("n1") / F.greatest("t1", F.lit(1)), "prop2": F.col("n2") / F.greatest("t2", F.lit(1))})
    c = c.withColumn("log2FC", F.log2((F.col("prop2") + pseudocount) / (F.col("prop1") + pseudocount)))
    a, b = F.col("n1").cast("double"), F.col("n2").cast("double")
    r1, r2 = F.col("t1") - a, F.col("t2") - b
    if method == "fisher":
        c = c.withColumn("statistic", F.try_divide(a * r2, b * r1)).withColumn("pvalue", fisher_two_sided("n1", "n2", F.col("t1") - F.col("n1"), F.col("t2") - F.col("n2")))
    elif method == "chi2":
        n = F.col("t1") + F.col("t2").cast("double")
        off = F.abs(a * r2 - b * r1) / n  # every |observed - expected| of a 2 x 2 table is this
        shrunk = off - F.least(F.lit(0.5), off)
        rows, others = a + b, r1 + r2
        inverse = n * F.try_divide(n * n, rows * others * F.col("t1") * F.col("t2")) / n
        stat = shrunk * shrunk * n * inverse
        c = c.withColumn("statistic", F.coalesce(stat, F.lit(0.0))).withColumn("pvalue", chi2_1_sf(F.col("statistic")))
    elif method == "permutation":
        rows = x.groupBy("cluster").agg(F.count("*").alias("n"), F.count_if("_1").alias("n1")).orderBy("cluster").collect()
        drawn = permuted([(r["cluster"], r["n"]) for r in rows], sum(r["n1"] for r in rows), n_permutations, seed)
        hits = x.sparkSession.createDataFrame(drawn, f"cluster {cells.schema['cluster'].dataType.simpleString()}, diffs array<double>")
        seen = F.abs(F.col("prop1") - F.col("prop2"))
        p = (F.size(F.filter("diffs", lambda v: v >= seen - 1e-12)) + 1) / (n_permutations + 1.0)
        c = c.join(F.broadcast(hits), "cluster").withColumn("statistic", F.col("prop1") - F.col("prop2")).withColumn("pvalue", p).drop("diffs")
    else:
        raise ValueError("method is fisher, chi2 or permutation")
    return stats.adjust(c.drop("t1", "t2"), "pvalue", order=("cluster",))


def permuted(counts: list[tuple[object, int]], n1: int, n_permutations: int, seed: int) -> list[tuple[object, list[float]]]:
    """(cluster, differences of shares) when the conditions are dealt anew over cells.

    Dealing n1 cells at random over the clusters is a draw of their sizes without replacement
    (multivariate hypergeometric), so the cells themselves are not needed, only one count a cluster.
    """
    sizes = np.array([n for _, n in counts])
    drawn = np.random.default_rng(seed).multivariate_hypergeometric(sizes, n1, n_permutations, method="marginals")
    diff = np.abs(drawn / max(1, n1) - (sizes - drawn) / max(1, int(sizes.sum()) - n1))
    return [(c, [float(v) for v in diff[:, i]]) for i, (c, _) in enumerate(counts)]


def batch_chi2(cells: DataFrame, batch: str = "batch") -> DataFrame:
    """statistic, dof of the cluster by batch table (Yates' correction for one degree of freedom)."""
    c = cells.groupBy("cluster", F.col(batch).alias("batch")).agg(F.count("*").alias("o"))
    grid = c.select("cluster").distinct().join(c.select("batch").distinct())
    full = grid.join(c, ["cluster", "batch"], "left").withColumn("o", F.coalesce("o", F.lit(0)).cast("double"))
    e = F.sum("o").over(Window.partitionBy("cluster")) * F.sum("o").over(Window.partitionBy("batch"))
    x = full.withColumns({"e": e}).crossJoin(F.broadcast(cells.agg(F.count("*").alias("n"), F.count_distinct("cluster").alias("k"), F.count_distinct(batch).alias("b"))))
    x = x.withColumn("e", F.col("e") / F.col("n")).withColumn("dof", (F.col("k") - 1) * (F.col("b") - 1))
    off = F.abs(F.col("o") - F.col("e"))
    off = F.when(F.col("dof") == 1, off - F.least(F.lit(0.5), off)).otherwise(off)
    return x.agg(F.sum(off * off / F.col("e")).alias("statistic"), F.max("dof").alias("dof"))


def batch_effect_test(cells: DataFrame, batch: str = "batch", n_permutations: int = 1000, seed: int = 0) -> DataFrame:
    """One row: statistic of the cluster by batch table and the share of dealt tables (same margins) that reach it."""
    rows = cells.groupBy("cluster", F.col(batch).alias("batch")).agg(F.count("*").alias("n")).collect()
    clusters, batches = sorted({r["cluster"] for r in rows}), sorted({r["batch"] for r in rows})
    table = np.zeros((len(clusters), len(batches)), np.int64)
    for r in rows:
        table[clusters.index(r["cluster"]), batches.index(r["batch"])] = r["n"]
    expected = table.sum(1, keepdims=True) * table.sum(0, keepdims=True) / max(1, table.sum())

    def statistic(t: np.ndarray) -> float:
        off = np.abs(t - expected)
        if (len(clusters) - 1) * (len(batches) - 1) == 1:
            off = off - np.minimum(0.5, off)
        return float((off**2 / expected).sum())

    rng, seen, hits = np.random.default_rng(seed), statistic(table), 0
    for _ in range(n_permutations):
        left, dealt = table.sum(1), []
        for size in table.sum(0):
            dealt.append(rng.multivariate_hypergeometric(left, size, method="marginals"))
            left = left - dealt[-1]
        hits += statistic(np.stack(dealt, 1)) >= seen - 1e-9
    return cells.sparkSession.createDataFrame([(seen, hits / max(1, n_permutations))], "statistic double, pvalue double")


def regress_batch(expr: DataFrame, cells: DataFrame, batch: str = "batch") -> DataFrame:
    """Values less their batch's mean, plus the first batch's, by gene."""
    b = cells.select("cell_id", F.col(batch).alias("_b"))
    x = expr.join(b, "cell_id")
    means = x.groupBy("gene", "_b").agg(F.avg("value").alias("_m"))
    first = means.groupBy("gene").agg(F.min_by("_m", "_b").alias("_first"))
    return x.join(means, ["gene", "_b"]).join(first, "gene").select("cell_id", "gene", (F.col("value") - F.col("_m") + F.col("_first")).alias("value"))


def regress_covariates(expr: DataFrame, cells: DataFrame, covariates: list[str], batch: str = "batch") -> DataFrame:
    """Values less the batch terms of a least-squares fit on batches (the first left out) and covariates, by gene.

    The normal equations of a gene are sums over its cells, made in partial aggregates; only these small
    tables are solved, and the batch effects are joined back.
    """
    names = [r[0] for r in cells.select(batch).distinct().orderBy(batch).collect()][1:]
    columns = [F.lit(1.0), *(F.when(F.col("_b") == n, 1.0).otherwise(0.0) for n in names), *(F.col(c).cast("double") for c in covariates)]
    x = expr.join(cells.select("cell_id", F.col(batch).alias("_b"), *covariates), "cell_id").withColumn("_x", F.array(*columns))
    m = len(columns)
    sums = x.groupBy("gene").agg(F.array(*(F.sum(F.col("_x")[i] * F.col("_x")[j]) for i in range(m) for j in range(m))).alias("xx"), F.array(*(F.sum(F.col("_x")[i] * F.col("value")) for i in range(m))).alias("xy"))

    def solve(frames):
        for f in frames:
            f["beta"] = [list(np.linalg.lstsq(np.array(a, float).reshape(m, m), np.array(b, float), rcond=None)[0][1 : 1 + len(names)]) for a, b in zip(f["xx"], f["xy"], strict=True)]
            yield f[["gene", "beta"]]

    beta = sums.mapInPandas(solve, f"gene {expr.schema['gene'].dataType.simpleString()}, beta array<double>")
    effect = F.coalesce(F.get("beta", F.array_position(F.array(*map(F.lit, names)), F.col("_b")) - 1), F.lit(0.0)) if names else F.lit(0.0)
    return x.select("cell_id", "gene", "value", "_b").join(beta, "gene").select("cell_id", "gene", (F.col("value") - effect).alias("value"))


def combat(expr: DataFrame, cells: DataFrame, batch: str = "batch") -> DataFrame:
    """Location and scale: z by gene, z again by gene and batch, back to the gene's scale. Variances are 1e-10 at least."""
    x = expr.join(cells.select("cell_id", F.col(batch).alias("_b")), "cell_id")
    gene = x.groupBy("gene").agg(F.avg("value").alias("_gm"), F.sqrt(F.greatest(F.var_pop("value"), F.lit(1e-10))).alias("_gs"))
    x = x.join(gene, "gene").withColumn("_z", (F.col("value") - F.col("_gm")) / F.col("_gs"))
    part = x.groupBy("gene", "_b").agg(F.avg("_z").alias("_bm"), F.sqrt(F.greatest(F.var_pop("_z"), F.lit(1e-10))).alias("_bs"))
    return x.join(part, ["gene", "_b"]).select("cell_id", "gene", ((F.col("_z") - F.col("_bm")) / F.col("_bs") * F.col("_gs") + F.col("_gm")).alias("value"))


def expression_bins(expr: DataFrame, n_bins: int) -> DataFrame:
    """gene, bin: equal-width bins of mean expression, closed on the right, the lowest value in the first."""
    means = expr.groupBy("gene").agg(F.avg("value").alias("m"))
    x = means.crossJoin(F.broadcast(means.agg(F.min("m").alias("lo"), F.max("m").alias("hi"))))
    width = (F.col("hi") - F.col("lo")) / n_bins
    return x.select("gene", F.when(width == 0, 0).otherwise(F.greatest(F.ceil(F.try_divide(F.col("m") - F.col("lo"), width)) - 1, F.lit(0))).cast("int").alias("bin"))


def gene_set_score(expr: DataFrame, gene_set: list[str], controls: int | None = 50, n_bins: int = 25, seed: int = 0) -> DataFrame:
    """cell_id, score: mean of the set less the mean over its genes of the mean of their controls.

    Controls are genes of the same expression bin outside the set, up to `controls` (None: all) by a
    hash of (seed, gene, control). Names are compared in upper case; none found scores 0.
    """
    names = [g.upper() for g in gene_set]
    bins = expression_bins(expr, n_bins)
    inside = bins.where(F.upper("gene").isin(names))
    pairs = inside.select(F.col("gene").alias("member"), "bin").join(bins.where(~F.upper("gene").isin(names)).select(F.col("gene").alias("control"), "bin"), "bin")
    if controls is not None:
        order = Window.partitionBy("member").orderBy(F.xxhash64(F.lit(seed), "member", "control"), "control")
        pairs = pairs.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= controls)
    own = expr.where(F.upper("gene").isin(names)).groupBy("cell_id").agg(F.avg("value").alias("own"))
    by_member = expr.join(F.broadcast(pairs.select(F.col("control").alias("gene"), "member")), "gene").groupBy("cell_id", "member").agg(F.avg("value").alias("c"))
    control = by_member.groupBy("cell_id").agg(F.avg("c").alias("control"))
    cells = expr.select("cell_id").distinct()
    return cells.join(own, "cell_id", "left").join(control, "cell_id", "left").select("cell_id", (F.coalesce("own", F.lit(0.0)) - F.coalesce("control", F.lit(0.0))).alias("score"))


def cell_cycle(expr: DataFrame, s_genes: list[str], g2m_genes: list[str], controls: int | None = 50, n_bins: int = 25, seed: int = 0) -> DataFrame:
    """cell_id, S_score, G2M_score, phase."""
    s = gene_set_score(expr, s_genes, controls, n_bins, seed).withColumnRenamed("score", "S_score")
    x = s.join(gene_set_score(expr, g2m_genes, controls, n_bins, seed).withColumnRenamed("score", "G2M_score"), "cell_id")
    a, b = F.col("S_score"), F.col("G2M_score")
    return x.withColumn("phase", F.when((a > 0) & (a > b), "S").when((b > 0) & (b > a), "G2M").otherwise("G1"))


def regress_scores(expr: DataFrame, scores: DataFrame, columns: tuple[str, ...] = ("S_score", "G2M_score")) -> DataFrame:
    """Residuals of each gene on one or two scores, by normal equations, plus its mean (the intercept stays)."""
    if not 1 <= len(columns) <= 2:
        raise ValueError("one or two scores")
    x = expr.join(scores.select("cell_id", *(F.col(c).alias(f"_x{i}") for i, c in enumerate(columns))), "cell_id")
    names = [f"_x{i}" for i in range(len(columns))]
    sums = x.groupBy("gene").agg(F.avg("value").alias("_my"), *(F.avg(n).alias(f"{n}m") for n in names), *(F.covar_pop(n, "value").alias(f"{n}y") for n in names), *(F.covar_pop(a, b).alias(f"{a}{b}") for i, a in enumerate(names) for b in names[i:]))
    y = x.join(sums, "gene")
    if len(names) == 1:
        slopes = [F.coalesce(F.try_divide(F.col("_x0y"), F.col("_x0_x0")), F.lit(0.0))]
    else:
        det = F.col("_x0_x0") * F.col("_x1_x1") - F.col("_x0_x1") * F.col("_x0_x1")
        usable = F.abs(det) > 1e-12 * F.col("_x0_x0") * F.col("_x1_x1")
        slopes = [F.when(usable, F.try_divide(F.col("_x0y") * F.col("_x1_x1") - F.col("_x1y") * F.col("_x0_x1"), det)).otherwise(F.coalesce(F.try_divide(F.col("_x0y"), F.col("_x0_x0")), F.lit(0.0))), F.when(usable, F.try_divide(F.col("_x1y") * F.col("_x0_x0") - F.col("_x0y") * F.col("_x0_x1"), det)).otherwise(0.0)]
    fitted = sum((b * (F.col(n) - F.col(f"{n}m")) for n, b in zip(names, slopes, strict=True)), F.lit(0.0))
    return y.select("cell_id", "gene", (F.col("value") - fitted).alias("value"))


def trajectory_genes(expr: DataFrame, pseudotime: DataFrame, n_top: int | None = 100, method: str = "correlation", n_bins: int = 10, genes: DataFrame | None = None) -> DataFrame:
    """gene, correlation, score: Spearman with pseudotime, or the share of variance between time bins. Rows that the matrix lacks are zeros."""
    if method == "correlation":
        r = stats.gene_correlation(expr, pseudotime, "pseudotime", genes).withColumn("score", F.abs("correlation"))
    else:
        span = pseudotime.agg(F.min("pseudotime").alias("lo"), F.max("pseudotime").alias("hi"))
        bins = pseudotime.crossJoin(F.broadcast(span)).select("cell_id", F.least(F.floor((F.col("pseudotime") - F.col("lo")) * n_bins / F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-10))), F.lit(n_bins - 1)).alias("bin"))
        between = stats.moments_of_cells(expr, bins, "bin", genes=genes).groupBy("gene").agg(F.var_pop("mean").alias("b"))
        whole = stats.moments_of_cells(expr, pseudotime, genes=genes).select("gene", (F.col("q") / F.col("n")).alias("v"))
        r = between.join(whole, "gene").select("gene", F.lit(0.0).alias("correlation"), (F.col("b") / (F.col("v") + 1e-10)).alias("score"))
    return r if n_top is None else r.orderBy(F.desc("score"), "gene").limit(n_top)


def pseudotime_bins(expr: DataFrame, pseudotime: DataFrame, n_bins: int = 50) -> DataFrame:
    """bin, gene, mean, z: mean expression by time bin and its z-score over the bins that have cells."""
    x = expr.join(pseudotime.select("cell_id", F.least(F.floor(F.col("pseudotime") * n_bins), F.lit(n_bins - 1)).cast("int").alias("bin")), "cell_id")
    m = x.groupBy("bin", "gene").agg(F.avg("value").alias("mean"))
    gene = Window.partitionBy("gene")
    sd = F.stddev_pop("mean").over(gene)
    return m.withColumn("z", (F.col("mean") - F.avg("mean").over(gene)) / F.when(sd == 0, 1.0).otherwise(sd))
