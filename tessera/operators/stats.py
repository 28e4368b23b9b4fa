"""Group-wise tests over long matrices, keyed by any columns.

values: rows with `keys`, value and a boolean g (true: first group). Rows are counted by value, in
partial aggregates, and the counts are ranked over ranges of (keys, value), so one gene's values
are ranked by many tasks. counted_cells() counts a sparse matrix: what has no row is a zero, and
the zeros of a group and gene are one row, the group's size less the rows seen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.lineage import cut
from ..functions.order import counted_below
from ..functions.special import normal_two_sided, rank_sum_exact, t_two_sided


#: Cells of the smaller group up to which a rank sum without ties has its exact tail.
EXACT_CELLS = 8


def joined(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join on keys in which nulls are equal."""
    names = {k: f"_{k}_right" for k in keys}
    same = F.lit(True)
    for k, n in names.items():
        same = same & F.col(k).eqNullSafe(F.col(n))
    return left.join(right.withColumnsRenamed(names), same, how).drop(*names.values())


def counted_cells(expr: DataFrame, cells: DataFrame, *by: str, genes: DataFrame | None = None) -> DataFrame:
    """gene, by, value and the number c of such cells, of a sparse matrix: rows that it lacks are zeros.

    cells: cell_id and by of all cells that count; genes: the matrix's genes, by default those that have rows.
    """
    cells = cells.select("cell_id", *by)
    # written, as zeros, bounds of ranges and ranks all read it
    counts = cut(expr.join(cells, "cell_id").groupBy("gene", *by, F.col("value").cast("double").alias("value")).agg(F.count("*").cast("double").alias("c")))
    return counts.unionByName(_grid(expr, cells, by, genes, counts.groupBy("gene", *by).agg(F.sum("c").alias("_seen"))).select("gene", *by, F.lit(0.0).alias("value"), (F.col("n") - F.col("_seen")).alias("c")).where("c > 0"))


def _grid(expr: DataFrame, cells: DataFrame, by: tuple[str, ...], genes: DataFrame | None, seen: DataFrame) -> DataFrame:
    """A row for every gene and group, with the group's size n; what is seen of it, or 0."""
    sizes = cells.groupBy(*by).agg(F.count("*").cast("double").alias("n"))
    every = (expr if genes is None else genes).select("gene").distinct().crossJoin(F.broadcast(sizes))
    x = joined(every, seen, ["gene", *by], "left")
    return x.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in seen.columns if c not in ("gene", *by)})


def moments_of_cells(expr: DataFrame, cells: DataFrame, *by: str, genes: DataFrame | None = None) -> DataFrame:
    """gene, by, n, mean and q (squared differences from the mean) of a sparse matrix's genes within groups of cells.

    The zeros of a group are added as one block, to sums of what has rows.
    """
    cells = cells.select("cell_id", *by)
    seen = expr.join(cells, "cell_id").groupBy("gene", *by).agg(F.count("value").cast("double").alias("_n"), F.avg("value").alias("_mean"), (F.var_pop("value") * F.count("value")).alias("_q"))
    x = _grid(expr, cells, by, genes, seen)
    zeros = F.col("n") - F.col("_n")
    return x.select("gene", *by, "n", (F.col("_mean") * F.col("_n") / F.col("n")).alias("mean"), (F.col("_q") + F.col("_n") * zeros / F.col("n") * F.col("_mean") * F.col("_mean")).alias("q"))


def _rank() -> Column:
    """Mean rank of the rows that share a value, after counted_below()."""
    return F.col("_to") - (F.col("_ties") - 1) / 2.0


def _tie_sum(c: str) -> Column:
    """Sums to that of t^3 - t over the different values, of which t rows each have one."""
    return F.col(c) * (F.col("_ties") * F.col("_ties") - 1)


def rank_correlation(df: DataFrame, a: str, b: str, *keys: str) -> DataFrame:
    """keys, correlation: Spearman's of two columns, 0 where either is constant.

    Rows are counted by either column's values and by both, and only different values are ranked.
    """
    both = df.groupBy(*keys, F.col(a).alias("_a"), F.col(b).alias("_b")).agg(F.count("*").cast("double").alias("c"))
    ranks = lambda x: counted_below(both.groupBy(*keys, x).agg(F.sum("c").alias("c")), x, *keys).select(*keys, x, _rank().alias(f"r{x}"))
    x = both.join(ranks("_a"), [*keys, "_a"]).join(ranks("_b"), [*keys, "_b"])
    weighted = lambda e: F.sum(F.col("c") * e)
    # ranks are taken from the middle rank, so nothing large cancels
    middle = both.groupBy(*keys).agg(((F.sum("c") + 1) / 2).alias("mid"))
    x = x.join(middle, list(keys)).withColumns({"ra": F.col("r_a") - F.col("mid"), "rb": F.col("r_b") - F.col("mid")}).groupBy(*keys)
    s = x.agg(weighted(F.col("ra") * F.col("rb")).alias("ab"), weighted(F.col("ra") * F.col("ra")).alias("aa"), weighted(F.col("rb") * F.col("rb")).alias("bb"))
    return s.select(*keys, _correlation())


def _correlation() -> Column:
    return F.coalesce(F.try_divide(F.col("ab"), F.sqrt(F.col("aa")) * F.sqrt(F.col("bb"))), F.lit(0.0)).alias("correlation")


def gene_correlation(expr: DataFrame, cells: DataFrame, by: str, genes: DataFrame | None = None) -> DataFrame:
    """gene, correlation: Spearman's of each gene of a sparse matrix with a column of its cells, 0 where either is constant.

    The cells' column is ranked once for all genes. Its ranks, taken from the middle, sum to 0, so
    those of a gene's zeros sum to the opposite of those that have rows.
    """
    times = counted_below(cells.select("cell_id", F.col(by).alias("_t"), F.lit(1.0).alias("c")), "_t")
    whole = times.agg(F.sum("c").alias("_n"))
    times = times.crossJoin(F.broadcast(whole)).select("cell_id", (_rank() - (F.col("_n") + 1) / 2).alias("t"))
    counts = cut(expr.join(times, "cell_id").groupBy("gene", F.col("value").cast("double").alias("value")).agg(F.count("*").cast("double").alias("c"), F.sum("t").alias("t")))
    seen = counts.groupBy("gene").agg(F.sum("c").alias("_seen"), F.sum("t").alias("_t"))
    zeros = _grid(expr, cells, (), genes, seen).select("gene", F.lit(0.0).alias("value"), (F.col("n") - F.col("_seen")).alias("c"), (-F.col("_t")).alias("t"))
    x = counted_below(counts.unionByName(zeros.where("c > 0")), "value", "gene").crossJoin(F.broadcast(whole))
    r = _rank() - (F.col("_n") + 1) / 2
    spread = times.agg(F.sum(F.col("t") * F.col("t")).alias("bb"))
    s = x.groupBy("gene").agg(F.sum(F.col("t") * r).alias("ab"), F.sum(F.col("c") * r * r).alias("aa")).crossJoin(F.broadcast(spread))
    return s.select("gene", _correlation())


def rank_sum(values: DataFrame, *keys: str) -> DataFrame:
    """keys, n1, n2, u, z (no tie correction), zc (tie-corrected, continuity), pvalue.

    Rows are counted by value first, in partial aggregates, and only different values are ranked.
    """
    return rank_sum_counted(counted(values, *keys), *keys)


def counted(values: DataFrame, *keys: str) -> DataFrame:
    """keys, value, g and the number c of such rows."""
    return values.groupBy(*keys, "value", "g").agg(F.count("*").cast("double").alias("c"))


def ranked(counts: DataFrame, *keys: str) -> DataFrame:
    """Counted rows with what lies at or below their value, for rank_sum_ranked(). Written, so it may be read again."""
    return counted_below(counts, "value", *keys)


def rank_sum_counted(counts: DataFrame, *keys: str) -> DataFrame:
    """rank_sum of counted rows."""
    return rank_sum_ranked(ranked(counts, *keys), *keys)


def rank_sum_ranked(x: DataFrame, *keys: str) -> DataFrame:
    first = F.when(F.col("g"), F.col("c")).otherwise(0.0)
    s = x.groupBy(*keys).agg(F.sum(first * _rank()).alias("r1"), F.sum(first).cast("long").alias("n1"), F.sum("c").cast("long").alias("n"), F.sum(_tie_sum("c")).alias("ties"))
    return finish_rank_sum(s)


def finish_rank_sum(s: DataFrame) -> DataFrame:
    """From r1, n1, n and ties to the statistics. The tail is exact where a group has EXACT_CELLS at most and no values tie."""
    n1, n = F.col("n1").cast("double"), F.col("n").cast("double")
    n2 = n - n1
    s = s.withColumn("u", F.coalesce("r1", F.lit(0.0)) - n1 * (n1 + 1) / 2).withColumn("n2", F.col("n") - F.col("n1"))
    mu = n1 * n2 / 2
    plain = F.sqrt(n1 * n2 * (n + 1) / 12)
    tied = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.try_divide(F.col("ties"), n * (n - 1))))
    usable = (n1 > 0) & (n2 > 0)
    z = F.when(usable & (plain > 0), (F.col("u") - mu) / plain).otherwise(0.0)
    zc = F.when(usable & (tied > 0), F.greatest(F.abs(F.col("u") - mu) - 0.5, F.lit(0.0)) / tied)
    s = s.withColumn("z", z).withColumn("zc", F.coalesce(zc, F.lit(0.0))).withColumn("_normal", F.when(zc.isNull(), 1.0).otherwise(normal_two_sided(zc)))
    exact = usable & (F.least(n1, n2) <= EXACT_CELLS) & (F.col("ties") == 0)
    # apart, behind an exchange: where no row comes through it, no Python worker runs
    few = s.where(exact).repartition(*s.columns[:1])
    few = few.withColumn("pvalue", rank_sum_exact("u", F.col("n1").cast("double"), F.col("n2").cast("double")))
    many = s.where(~F.coalesce(exact, F.lit(False))).withColumn("pvalue", F.col("_normal"))
    return many.unionByName(few).drop("r1", "ties", "n", "_normal")


def moments(values: DataFrame, *keys: str) -> DataFrame:
    """keys, n, mean and sample variance of either group."""
    a, b = F.when(F.col("g"), F.col("value")), F.when(~F.col("g"), F.col("value"))
    return values.groupBy(*keys).agg(F.count(a).alias("n1"), F.count(b).alias("n2"), F.avg(a).alias("mean1"), F.avg(b).alias("mean2"), F.var_samp(a).alias("var1"), F.var_samp(b).alias("var2"))


def _t(m: DataFrame, se2: Column, df: Column) -> DataFrame:
    usable = (F.col("n1") > 1) & (F.col("n2") > 1) & (se2 > 0)
    return m.withColumn("t", F.when(usable, (F.col("mean1") - F.col("mean2")) / F.sqrt(se2)).otherwise(0.0)).withColumn("df", F.when(usable, df)).withColumn("pvalue", t_two_sided("t", "df"))


def welch_t(values: DataFrame, *keys: str) -> DataFrame:
    """Unequal variances: keys, moments, t, df, pvalue."""
    return _welch(moments(values, *keys))


def _welch(m: DataFrame) -> DataFrame:
    a, b = F.col("var1") / F.col("n1"), F.col("var2") / F.col("n2")
    df = F.try_divide((a + b) * (a + b), F.try_divide(a * a, F.col("n1") - 1) + F.try_divide(b * b, F.col("n2") - 1))
    return _t(m, a + b, df)


def welch_counted(counts: DataFrame, *keys: str) -> DataFrame:
    """welch_t of counted rows."""
    m = _counted_moments(counts, *keys)
    return _welch(m.withColumns({f"var{i}": F.try_divide(F.col(f"q{i}"), F.col(f"n{i}") - 1) for i in (1, 2)}))


def _counted_moments(counts: DataFrame, *keys: str) -> DataFrame:
    """keys, n, mean and q (squared differences from the mean) of either group."""
    c1, c2, v = F.when(F.col("g"), F.col("c")).otherwise(0.0), F.when(F.col("g"), 0.0).otherwise(F.col("c")), F.col("value")
    m = counts.groupBy(*keys).agg(F.sum(c1).alias("n1"), F.sum(c2).alias("n2"), F.sum(c1 * v).alias("s1"), F.sum(c2 * v).alias("s2"))
    m = m.withColumns({"mean1": F.try_divide("s1", "n1"), "mean2": F.try_divide("s2", "n2")}).drop("s1", "s2")
    from_mean = lambda mean: (v - F.col(mean)) * (v - F.col(mean))
    spread = joined(counts, m, list(keys)).groupBy(*keys).agg(F.sum(c1 * from_mean("mean1")).alias("q1"), F.sum(c2 * from_mean("mean2")).alias("q2"))
    return joined(m, spread, list(keys))


def student_t(values: DataFrame, *keys: str) -> DataFrame:
    """Equal variances: keys, moments, t, df, pvalue."""
    df = (F.col("n1") + F.col("n2") - 2).cast("double")
    pooled = ((F.col("n1") - 1) * F.col("var1") + (F.col("n2") - 1) * F.col("var2")) / df
    return _t(moments(values, *keys), pooled * (1.0 / F.col("n1") + 1.0 / F.col("n2")), df)


def adjust(tests: DataFrame, p: str, *keys: str, order: tuple[str, ...], out: str = "padj") -> DataFrame:
    """Benjamini-Hochberg within the keys: least p * m / rank from each test on."""
    group = Window.partitionBy(*keys)
    ranked = tests.withColumn("_rn", F.row_number().over(group.orderBy(p, *order))).withColumn("_m", F.count("*").over(group))
    # backwards, as Spark keeps a running least only of what lies before a row; a frame that ends at the last row is read anew for each
    least = F.min(F.col(p) * F.col("_m") / F.col("_rn")).over(group.orderBy(F.desc("_rn")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return ranked.withColumn(out, F.least(F.lit(1.0), least)).drop("_rn", "_m")


def log_fold_change(mean1: Column, mean2: Column, pseudo: float = 1.0) -> Column:
    return F.log2((mean1 + pseudo) / (mean2 + pseudo))


def student_counted(counts: DataFrame, *keys: str) -> DataFrame:
    """student_t of counted rows."""
    m = _counted_moments(counts, *keys)
    df = F.col("n1") + F.col("n2") - 2
    return _t(m, F.try_divide(F.col("q1") + F.col("q2"), df) * (1.0 / F.col("n1") + F.try_divide(F.lit(1.0), F.col("n2"))), df)


def one_vs_rest(expr: DataFrame, labels: DataFrame, label: str, genes: DataFrame | None = None) -> DataFrame:
    """Rank-sum statistics of every group against the others, from one ranking of each gene. Rows that the matrix lacks are zeros.

    Ranks do not depend on the group, so each gene is ranked once and no row is repeated by group.
    """
    counts = counted_cells(expr, labels.select("cell_id", F.col(label).alias("group")), "group", genes=genes)
    v, c = F.col("value"), F.col("c")
    sums = {"r1": c * _rank(), "n1": c, "s1": c * v, "e1": F.when(v > 0, c).otherwise(0.0), "t1": _tie_sum("c")}
    by_group = ranked(counts, "gene").groupBy("gene", "group").agg(*(F.sum(e).alias(k) for k, e in sums.items()))
    gene = Window.partitionBy("gene")
    s = by_group.select("*", *(F.sum(f"{k}1").over(gene).alias(k) for k in ("n", "s", "e")), F.sum("t1").over(gene).alias("ties")).drop("t1")
    n2 = F.col("n") - F.col("n1")
    s = s.withColumns({"mean1": F.col("s1") / F.col("n1"), "mean2": F.try_divide(F.col("s") - F.col("s1"), n2), "pct1": F.col("e1") / F.col("n1"), "pct2": F.try_divide(F.col("e") - F.col("e1"), n2), "e2": F.col("e") - F.col("e1")})
    return finish_rank_sum(s.drop("s1", "s", "e"))


def student_vs_rest(expr: DataFrame, labels: DataFrame, label: str, genes: DataFrame | None = None) -> DataFrame:
    """gene, group, t, df, pvalue of every group against the others, equal variances. Rows that the matrix lacks are zeros.

    The others' moments follow from the gene's and the group's, so rows are read once.
    """
    one = moments_of_cells(expr, labels.select("cell_id", F.col(label).alias("group")), "group", genes=genes).withColumnsRenamed({"n": "n1", "mean": "mean1", "q": "q1"})
    gene = Window.partitionBy("gene")
    x = one.withColumn("n", F.sum("n1").over(gene)).withColumn("mean", F.sum(F.col("n1") * F.col("mean1")).over(gene) / F.col("n"))
    off = F.col("mean1") - F.col("mean")
    x = x.withColumn("q", F.sum(F.col("q1") + F.col("n1") * off * off).over(gene))
    x = x.withColumn("n2", F.col("n") - F.col("n1")).withColumn("mean2", F.try_divide(F.col("n") * F.col("mean") - F.col("n1") * F.col("mean1"), F.col("n2")))
    d = F.col("mean1") - F.col("mean2")
    q2 = F.greatest(F.lit(0.0), F.col("q") - F.col("q1") - F.col("n1") * F.col("n2") / F.col("n") * d * d)
    pooled = F.try_divide(F.col("q1") + q2, F.col("n") - 2)
    return _t(x, pooled * (1 / F.col("n1") + F.try_divide(F.lit(1.0), F.col("n2"))), F.col("n") - 2).select("gene", "group", "t", "df", "pvalue")
