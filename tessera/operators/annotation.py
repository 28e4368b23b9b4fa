"""Marker databases, cell-type annotation, gene-set enrichment."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import knowledge
from ..functions.special import hypergeometric_sf
from ..sources.io import load_gmt
from . import stats

MARKER_SCHEMA = "cell_type string, gene string, type_order int"


def marker_database(spark: SparkSession, tissue: str = "pbmc", custom: dict[str, list[str]] | None = None) -> DataFrame:
    """cell_type, gene, type_order. Of a type that several tissues have, "all" keeps the last one's genes."""
    if custom is not None:
        rows = [(t, g) for t, genes in custom.items() for g in genes]
    elif tissue == "all":
        merged: dict[str, list[str]] = {}
        for text in knowledge.MARKERS.values():
            one: dict[str, list[str]] = {}
            for t, g in knowledge.entries(text):
                one.setdefault(t, []).append(g)
            merged |= one
        rows = [(t, g) for t, genes in merged.items() for g in genes]
    else:
        if tissue not in knowledge.MARKERS:
            warnings.warn(f"no markers for {tissue}; pbmc is used", stacklevel=2)
        rows = knowledge.entries(knowledge.MARKERS.get(tissue, knowledge.PBMC))
    order = {t: i for i, t in enumerate(dict.fromkeys(t for t, _ in rows))}
    return spark.createDataFrame([(t, g, order[t]) for t, g in rows], MARKER_SCHEMA)


def marker_expression(expr: DataFrame, cells: DataFrame, markers: DataFrame) -> DataFrame:
    """cluster, cell_type, gene, expression, overall, std, z_score of the markers that the matrix has."""
    x = expr.join(F.broadcast(markers.select(F.upper("gene").alias("_g")).distinct()), F.upper("gene") == F.col("_g"), "left_semi").join(cells.select("cell_id", "cluster"), "cell_id")
    overall = x.groupBy("gene").agg(F.avg("value").alias("overall"), F.stddev_pop("value").alias("std"))
    means = x.groupBy("cluster", "gene").agg(F.avg("value").alias("expression")).join(overall, "gene")
    typed = means.withColumn("_g", F.upper("gene")).join(F.broadcast(markers.select("cell_type", "type_order", F.upper("gene").alias("_g")).distinct()), "_g")
    return typed.select("cluster", "cell_type", "type_order", "gene", "expression", "overall", "std", ((F.col("expression") - F.col("overall")) / (F.col("std") + 1e-10)).alias("z_score"))


def score_cell_types(expr: DataFrame, cells: DataFrame, markers: DataFrame, method: str = "mean") -> DataFrame:
    """cluster, cell_type, type_order, score by mean, percent or zscore; any other method is mean."""
    x = marker_expression(expr, cells, markers)
    value = {"percent": (F.col("expression") > F.col("overall") + 0.5 * F.col("std")).cast("double"), "zscore": F.col("z_score")}.get(method, F.col("expression"))
    return x.groupBy("cluster", "cell_type", "type_order").agg(F.avg(value).alias("score"))


def annotate_clusters(scores: DataFrame, clusters: DataFrame, min_confidence: float = 0.1) -> DataFrame:
    """cluster, cell_type, confidence: the best type, or Unknown where confidence is too low."""
    group = Window.partitionBy("cluster")
    best = scores.withColumns({"r": F.row_number().over(group.orderBy(F.desc("score"), "type_order")), "s": F.sum("score").over(group), "n": F.count("*").over(group)}).where("r = 1")
    confidence = F.when(F.col("score") <= 0, 0.0).otherwise(F.least(F.lit(1.0), F.col("score") / (F.col("s") + 1e-10) * F.col("n")))
    best = best.select("cluster", "cell_type", confidence.alias("confidence"))
    x = clusters.select("cluster").distinct().join(best, "cluster", "left").withColumn("confidence", F.coalesce("confidence", F.lit(0.0)))
    return x.withColumn("cell_type", F.when(F.col("cell_type").isNull() | (F.col("confidence") < min_confidence), "Unknown").otherwise(F.col("cell_type")))


def annotate_cells(cells: DataFrame, annotation: DataFrame) -> DataFrame:
    return cells.join(F.broadcast(annotation), "cluster", "left")


def builtin_gene_sets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(knowledge.entries(knowledge.GENE_SETS), "term string, gene string")


def load_gene_sets(spark: SparkSession, custom_gmt: str | None = None) -> DataFrame:
    """term, gene of a GMT file, or the built-in sets."""
    return load_gmt(spark, custom_gmt) if custom_gmt else builtin_gene_sets(spark)


def enrich(queries: DataFrame, gene_sets: DataFrame, key: str = "cluster", background: DataFrame | None = None, min_overlap: int = 3, max_term_size: int = 500, pval_cutoff: float | None = 0.05, restrict_query: bool = False) -> DataFrame:
    """Over-representation of the terms among each key's genes.

    queries: key, gene. Names are compared in upper case; the background is all genes of the sets
    unless given. query_size counts genes outside the background too, unless restrict_query.
    """
    up = F.upper(F.col("gene")).alias("gene")
    sets = gene_sets.select("term", up).distinct()
    universe = (background if background is not None else gene_sets).select(up).distinct()
    sets = sets.join(universe, "gene", "left_semi")
    genes = queries.select(F.col(key), up).distinct()
    inside = genes.join(universe, "gene", "left_semi")
    sizes = sets.groupBy("term").agg(F.count("*").alias("term_size")).where(F.col("term_size").between(min_overlap, max_term_size))
    query_sizes = (inside if restrict_query else genes).groupBy(key).agg(F.count("*").alias("query_size"))
    overlap = inside.join(sets, "gene").groupBy(key, "term").agg(F.count("*").alias("overlap_count"), F.array_join(F.array_sort(F.collect_list("gene")), ",").alias("overlap_genes")).where(F.col("overlap_count") >= min_overlap)
    x = overlap.join(sizes, "term").join(query_sizes, key).crossJoin(F.broadcast(universe.agg(F.count("*").alias("background_size"))))
    a = F.col("overlap_count")
    b, c = F.col("query_size") - a, F.col("term_size") - a
    d = F.col("background_size") - a - b - c
    odds = F.when(b * c == 0, F.lit(float("inf"))).otherwise(F.try_divide((a * d).cast("double"), (b * c).cast("double")))
    x = x.withColumn("odds_ratio", odds).withColumn("pvalue", hypergeometric_sf("overlap_count", "background_size", "term_size", "query_size"))
    x = stats.adjust(x, "pvalue", key, order=("term",), out="adjusted_pvalue")
    return x if pval_cutoff is None else x.where(F.col("adjusted_pvalue") <= pval_cutoff)


def top_terms(enriched: DataFrame, n: int = 10, key: str = "cluster") -> DataFrame:
    return enriched.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy("adjusted_pvalue", "pvalue", "term"))).where(F.col("_r") <= n).drop("_r")
