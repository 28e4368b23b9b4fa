"""Differential expression and marker genes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.lineage import cut
from ..functions.special import binomial_two_sided, normal_two_sided
from . import stats

METHODS = ("wilcoxon", "t-test", "negbinom", "logistic")


#: Newton steps of the logistic test, and the change of coefficients at which they end.
STEPS, STILL = 50, 1e-10


def _logistic(counts: DataFrame, *keys: str) -> DataFrame:
    """Wald statistic of the slope of a logistic regression of the group on the value, by Newton steps.

    A step is one aggregation of the counted rows of all genes; what passes between steps is two
    coefficients a gene. Values are taken from the gene's mean, which leaves the slope and its
    error as they are and keeps the steps well-conditioned.
    """
    c, y = F.col("c"), F.when(F.col("g"), 1.0).otherwise(0.0)
    own = stats.joined(counts, counts.groupBy(*keys).agg((F.sum(c * F.col("value")) / F.sum(c)).alias("_mean"), (F.max("value") - F.min("value")).alias("_span"), F.sum(c).alias("_n"), F.sum(c * y).alias("_n1")), list(keys))
    # a gene of one value, or of one group, has no slope
    rows = cut(own.where("_span > 0 AND _n1 > 0 AND _n1 < _n").select(*keys, (F.col("value") - F.col("_mean")).alias("_x"), y.alias("_y"), c.alias("_c")))
    zero = F.lit(0.0)
    fits = cut(rows.select(*keys).distinct().withColumns({"b0": zero, "b1": zero, "w1": zero, "step": F.lit(1.0)}))
    for _ in range(STEPS):
        eta = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.col("b0") + F.col("b1") * F.col("_x")))
        mu = 1 / (1 + F.exp(-eta))
        x = stats.joined(rows, fits, list(keys)).withColumns({"_w": F.col("_c") * mu * (1 - mu), "_r": F.col("_c") * (F.col("_y") - mu)})
        s = x.groupBy(*keys, "b0", "b1").agg(*(F.sum(e).alias(n) for n, e in {"a": F.col("_w"), "b": F.col("_w") * F.col("_x"), "d": F.col("_w") * F.col("_x") * F.col("_x"), "p": F.col("_r"), "q": F.col("_r") * F.col("_x")}.items()))
        a, b, d = F.col("a") + 1e-10, F.col("b"), F.col("d") + 1e-10
        det = a * d - b * b
        s0, s1 = F.try_divide(d * F.col("p") - b * F.col("q"), det), F.try_divide(a * F.col("q") - b * F.col("p"), det)
        fits = cut(s.select(*keys, (F.col("b0") + s0).alias("b0"), (F.col("b1") + s1).alias("b1"), (det / a).alias("w1"), F.greatest(F.abs(s0), F.abs(s1)).alias("step")))
        if fits.where(F.col("step") > STILL).isEmpty():
            break
    z = stats.joined(counts.select(*keys).distinct(), fits.select(*keys, (F.col("b1") * F.sqrt("w1")).alias("statistic")), list(keys), "left")
    return z.select(*keys, F.coalesce("statistic", zero).alias("statistic"), normal_two_sided(F.coalesce("statistic", zero)).alias("pvalue"))


def test_groups(values: DataFrame, *keys: str, method: str = "wilcoxon", min_cells: int = 3, min_pct: float = 0.1, pseudocount: float = 1.0) -> DataFrame:
    """DE of two groups for every combination of keys, the last of which is the gene.

    values: keys, value, g (true: group 1). Genes that too few cells of either group express are
    left out before the correction, which runs over the genes of the other keys. All methods work on
    counts of equal rows.
    """
    return test_counted(stats.counted(values, *keys), *keys, method=method, min_cells=min_cells, min_pct=min_pct, pseudocount=pseudocount)


def test_counted(counts: DataFrame, *keys: str, method: str = "wilcoxon", min_cells: int = 3, min_pct: float = 0.1, pseudocount: float = 1.0) -> DataFrame:
    """test_groups of rows keys, value, g and their number c."""
    if method not in METHODS:
        raise ValueError(f"method is one of {METHODS}")
    *outer, gene = keys
    if method == "wilcoxon":
        counts = stats.ranked(counts, *keys)
    value, positive = F.col("value"), F.col("value") > 0
    c1, c2 = F.when(F.col("g"), F.col("c")).otherwise(0.0), F.when(F.col("g"), 0.0).otherwise(F.col("c"))
    m = counts.groupBy(*keys).agg(
        F.sum(c1).alias("n1"), F.sum(c2).alias("n2"),
        F.try_divide(F.sum(c1 * value), F.sum(c1)).alias("mean_group1"), F.try_divide(F.sum(c2 * value), F.sum(c2)).alias("mean_group2"),
        F.sum(F.when(positive, c1).otherwise(0.0)).alias("e1"), F.sum(F.when(positive, c2).otherwise(0.0)).alias("e2"),
    )
    m = m.where("n1 > 0 AND n2 > 0").withColumns({"pct_group1": F.col("e1") / F.col("n1"), "pct_group2": F.col("e2") / F.col("n2")})
    m = m.where(((F.col("e1") >= min_cells) | (F.col("e2") >= min_cells)) & ((F.col("pct_group1") >= min_pct) | (F.col("pct_group2") >= min_pct)))
    m = m.withColumn("log2FC", stats.log_fold_change(F.col("mean_group2"), F.col("mean_group1"), pseudocount))
    if method == "wilcoxon":
        tests = stats.rank_sum_ranked(counts, *keys).select(*keys, F.col("u").alias("statistic"), "pvalue")
    elif method == "t-test":
        tests = stats.welch_counted(counts, *keys).select(*keys, F.col("t").alias("statistic"), "pvalue")
    elif method == "logistic":
        tests = _logistic(counts, *keys)
    else:  # counts of group 1 among all, against its share of the cells
        total = counts.groupBy(*keys).agg(F.sum(F.when(F.col("g"), F.col("c") * F.round("value"))).alias("k"), F.sum(F.col("c") * F.round("value")).alias("n"), F.try_divide(F.sum(c1), F.sum("c")).alias("share"))
        tests = total.select(*keys, F.coalesce("k", F.lit(0.0)).alias("statistic"), binomial_two_sided(F.coalesce("k", F.lit(0.0)), "n", "share").alias("pvalue"))
    out = stats.adjust(m.join(tests, list(keys)), "pvalue", *outer, order=(gene,))
    return out.select(*keys, "mean_group1", "mean_group2", "log2FC", "pct_group1", "pct_group2", "statistic", "pvalue", "padj")


def differential_expression(expr: DataFrame, groups: DataFrame, group: str, group1: str | None = None, group2: str | None = None, genes: DataFrame | None = None, **options) -> DataFrame:
    """Two groups of a label column; by default its first two values. Labels are compared as strings, and rows that the matrix lacks are zeros."""
    labels = groups.select("cell_id", F.col(group).cast("string").alias("_group"))
    if group1 is None or group2 is None:
        found = [r[0] for r in labels.select("_group").distinct().orderBy("_group").limit(2).collect()]
        if len(found) < 2:
            raise ValueError("two groups are needed")
        group1, group2 = group1 or found[0], group2 or found[1]
    two = labels.where(F.col("_group").isin(group1, group2)).select("cell_id", (F.col("_group") == group1).alias("g"))
    return test_counted(stats.counted_cells(expr, two, "g", genes=genes), "gene", **options)


def pairwise(expr: DataFrame, groups: DataFrame, group: str, genes: DataFrame | None = None, **options) -> DataFrame:
    """Every pair of groups g1 < g2, in one plan: rows are counted by gene, group and value once, and the counts form the pairs."""
    labels = groups.select("cell_id", F.col(group).cast("string").alias("_group"))
    kinds = labels.select("_group").distinct()
    pairs = kinds.select(F.col("_group").alias("g1")).join(kinds.select(F.col("_group").alias("g2")), F.col("g1") < F.col("g2"))
    of_pair = pairs.select("g1", "g2", F.explode(F.array("g1", "g2")).alias("_group"))
    counts = stats.counted_cells(expr, labels, "_group", genes=genes)
    x = counts.join(F.broadcast(of_pair), "_group").select("g1", "g2", "gene", "value", (F.col("_group") == F.col("g1")).alias("g"), "c")
    return test_counted(x, "g1", "g2", "gene", **options)


def one_vs_rest(expr: DataFrame, groups: DataFrame, group: str, min_cells: int = 3, min_pct: float = 0.1, pseudocount: float = 1.0, genes: DataFrame | None = None) -> DataFrame:
    """Every group against the rest (group 1 is the rest, so log2FC is group over rest), by rank sums."""
    labels = groups.withColumn("_g", F.col(group).cast("string"))
    s = stats.one_vs_rest(expr, labels, "_g", genes).where("n2 > 0")
    s = s.where((F.greatest("e1", "e2") >= min_cells) & (F.greatest("pct1", "pct2") >= min_pct))
    s = s.select("group", "gene", F.col("mean2").alias("mean_group1"), F.col("mean1").alias("mean_group2"), stats.log_fold_change(F.col("mean1"), F.col("mean2"), pseudocount).alias("log2FC"), F.col("pct2").alias("pct_group1"), F.col("pct1").alias("pct_group2"), (F.col("n1") * F.col("n2") - F.col("u")).alias("statistic"), "pvalue")
    return stats.adjust(s, "pvalue", "group", order=("gene",))


def within_cluster(expr: DataFrame, cells: DataFrame, condition: str, cluster: str, condition1: str, condition2: str, genes: DataFrame | None = None, **options) -> DataFrame:
    """DE of two conditions in each cluster that has both."""
    labels = cells.select("cell_id", F.col(cluster).alias("cluster"), F.col(condition).cast("string").alias("_c")).where(F.col("_c").isin(condition1, condition2))
    labels = labels.select("cell_id", "cluster", (F.col("_c") == condition1).alias("g"))
    return test_counted(stats.counted_cells(expr, labels, "cluster", "g", genes=genes), "cluster", "gene", **options)


def compare_methods(expr: DataFrame, groups: DataFrame, group: str, methods: tuple[str, ...] = ("wilcoxon", "t-test"), **options) -> DataFrame:
    """log2FC and padj of each method, left-joined on the first method's genes."""
    out = None
    for method in methods:
        name = method.replace("-", "_")
        one = differential_expression(expr, groups, group, method=method, **options).select("gene", F.col("log2FC").alias(f"log2FC_{name}"), F.col("padj").alias(f"padj_{name}"))
        out = one if out is None else out.join(one, "gene", "left")
    return out


def significant(de: DataFrame, p: float = 0.05, fc: float = 0.5) -> DataFrame:
    return de.where((F.col("padj") < p) & (F.abs("log2FC") > fc))


def upregulated(de: DataFrame, p: float = 0.05, fc: float = 0.5) -> DataFrame:
    return de.where((F.col("padj") < p) & (F.col("log2FC") > fc))


def downregulated(de: DataFrame, p: float = 0.05, fc: float = 0.5) -> DataFrame:
    return de.where((F.col("padj") < p) & (F.col("log2FC") < -fc))


def volcano(de: DataFrame, p: float = 0.05, fc: float = 0.5) -> DataFrame:
    """gene, log2FC, -log10 padj, class, and the x of the MA plot."""
    kind = F.when((F.col("padj") < p) & (F.col("log2FC") > fc), "up").when((F.col("padj") < p) & (F.col("log2FC") < -fc), "down").otherwise("none")
    return de.select("gene", "log2FC", (-F.log10(F.greatest("padj", F.lit(1e-300)))).alias("neg_log10_padj"), kind.alias("class"), F.log10((F.col("mean_group1") + F.col("mean_group2")) / 2 + 1).alias("ma_x"))


def rank_genes(expr: DataFrame, labels: DataFrame, cluster: str = "cluster", method: str = "wilcoxon", min_fold_change: float = 0.0, min_fraction: float = 0.0, genes: DataFrame | None = None) -> DataFrame:
    """cluster, gene, score, pval, pval_adj, logfoldchange of every cluster against the rest.

    The score is z without tie correction, or Student's t. Genes that fail a minimum score 0 with p 1
    and fold change 0, and still count in the correction.
    """
    if method not in ("wilcoxon", "t-test"):
        raise ValueError("method is wilcoxon or t-test")
    s = stats.one_vs_rest(expr, labels, cluster, genes)
    if method == "t-test":
        s = s.drop("z", "pvalue").join(stats.student_vs_rest(expr, labels, cluster, genes).select("gene", "group", F.col("t").alias("z"), "pvalue"), ["gene", "group"])
    lfc = stats.log_fold_change(F.col("mean1"), F.coalesce("mean2", F.lit(0.0)))
    failed = (F.col("pct1") < min_fraction) | (F.abs(lfc) < min_fold_change)
    s = s.select(F.col("group").alias("cluster"), "gene", F.when(failed, 0.0).otherwise(F.col("z")).alias("score"), F.when(failed, 1.0).otherwise(F.col("pvalue")).alias("pval"), F.when(failed, 0.0).otherwise(lfc).alias("logfoldchange"))
    return stats.adjust(s, "pval", "cluster", order=("gene",), out="pval_adj")


def top_markers(markers: DataFrame, n: int = 10) -> DataFrame:
    order = Window.partitionBy("cluster").orderBy(F.desc("score"), "gene")
    return markers.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= n).drop("_r")


def filter_markers(markers: DataFrame, p: float = 0.05, lfc: float = 0.25, n_top: int | None = None) -> DataFrame:
    x = markers.where((F.col("pval_adj") < p) & (F.abs("logfoldchange") >= lfc))
    return x if n_top is None else top_markers(x, n_top)


def find_markers(expr: DataFrame, labels: DataFrame, cluster: str = "cluster", n_markers: int = 10, p: float = 0.05, lfc: float = 0.25, method: str = "wilcoxon", genes: DataFrame | None = None) -> DataFrame:
    return filter_markers(rank_genes(expr, labels, cluster, method, genes=genes), p, lfc, n_markers)
