"""Matrix preprocessing. A matrix is long rows (cell_id, gene, value); absent rows are zeros, and no step here makes rows of them but densify()."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.lineage import cut
from ..functions.order import medians
from ..functions.vectors import arrays_of
from .stats import moments_of_cells


def clean(expr: DataFrame) -> DataFrame:
    """NaN, infinite and null values become 0."""
    v = F.col("value").cast("double")
    return expr.withColumn("value", F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), 0.0).otherwise(v))


def densify(expr: DataFrame, cells: DataFrame, genes: DataFrame) -> DataFrame:
    """One row for every cell and gene. The list of genes is the matrix's width and goes to every cell as an array."""
    width = genes.select("gene").distinct().agg(F.array_sort(F.collect_list("gene")).alias("_genes"))
    grid = cells.select("cell_id").crossJoin(F.broadcast(width)).select("cell_id", F.explode("_genes").alias("gene"))
    return grid.join(expr.select("cell_id", "gene", "value"), ["cell_id", "gene"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))


def filter_cells_genes(expr: DataFrame, min_cells: int = 3, min_genes: int = 200) -> DataFrame:
    """Genes seen in min_cells cells and cells with min_genes genes, both counted on the original matrix."""
    seen = expr.where("value > 0")
    genes = seen.groupBy("gene").agg(F.count("*").alias("_n")).where(F.col("_n") >= min_cells).select("gene")
    cells = seen.groupBy("cell_id").agg(F.count("*").alias("_n")).where(F.col("_n") >= min_genes).select("cell_id")
    return expr.join(genes, "gene", "left_semi").join(cells, "cell_id", "left_semi").select("cell_id", "gene", "value")


def normalize_log1p(expr: DataFrame, log: bool = True, cells: DataFrame | None = None) -> DataFrame:
    """Library sizes brought to their median, then log1p; zeros stay zeros. cells: all cells, by default those that have rows."""
    size = expr.groupBy("cell_id").agg(F.sum("value").alias("_size"))
    if cells is not None:
        size = cells.select("cell_id").join(size, "cell_id", "left")
    size = size.withColumn("_size", F.greatest(F.coalesce("_size", F.lit(0.0)), F.lit(1.0)))
    target = medians(size, "_size").withColumnRenamed("median", "_target")
    scaled = F.col("value") / F.col("_size") * F.col("_target")
    return expr.join(size, "cell_id").crossJoin(F.broadcast(target)).select("cell_id", "gene", (F.log1p(scaled) if log else scaled).alias("value"))


def variable_genes(expr: DataFrame, n_top: int = 2000, cells: DataFrame | None = None, genes: DataFrame | None = None) -> DataFrame:
    """gene, variance, rank of the n_top most variable genes. cells, genes: all there are, by default those that have rows."""
    v = moments_of_cells(expr, expr.select("cell_id").distinct() if cells is None else cells, genes=genes).select("gene", (F.col("q") / F.col("n")).alias("variance"))
    return v.orderBy(F.desc("variance"), "gene").limit(n_top).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("variance"), "gene")))


def scale_clip(expr: DataFrame, limit: float = 10.0) -> DataFrame:
    """z-scores by gene of a dense matrix (population deviation, 0 counts as 1), clipped."""
    stats = expr.groupBy("gene").agg(F.avg("value").alias("_m"), F.stddev_pop("value").alias("_s"))
    return expr.join(stats, "gene").select("cell_id", "gene", _z(F.col("value"), limit).alias("z"))


def _z(value: Column, limit: float) -> Column:
    z = (value - F.col("_m")) / F.when(F.col("_s") == 0, 1.0).otherwise(F.col("_s"))
    return F.greatest(F.least(z, F.lit(limit)), F.lit(-limit))


def scaled_rows(expr: DataFrame, cells: DataFrame, limit: float = 10.0) -> DataFrame:
    """cell_id, v: the clipped z-scores of every gene by name, of a sparse matrix.

    A cell's vector starts as that of a cell of zeros, which is as wide as the matrix, and takes the
    scores of the rows there are.
    """
    genes = moments_of_cells(expr, cells).select("gene", F.col("mean").alias("_m"), F.sqrt(F.col("q") / F.col("n")).alias("_s"))
    genes = cut(genes.select("gene", "_m", "_s", _z(F.lit(0.0), limit).alias("_zero"), (F.row_number().over(Window.orderBy("gene")) - 1).alias("_at")))
    base = np.array([r[0] for r in genes.orderBy("_at").select("_zero").collect()])
    x = expr.join(F.broadcast(genes), "gene").groupBy("cell_id").agg(F.collect_list("_at").alias("at"), F.collect_list(_z(F.col("value"), limit)).alias("z"))
    x = cells.select("cell_id").join(x, "cell_id", "left").select("cell_id", "at", "z")

    def fill(batches):
        for batch in batches:
            m = np.tile(base, (batch.num_rows, 1))
            at, z = batch.column(1), batch.column(2)
            row = np.repeat(np.arange(batch.num_rows), pa.compute.fill_null(pa.compute.list_value_length(at), 0).to_numpy())
            m[row, at.flatten().to_numpy(zero_copy_only=False)] = z.flatten().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([batch.column(0), arrays_of(m)], ["cell_id", "v"])

    return x.mapInArrow(fill, f"cell_id {x.schema['cell_id'].dataType.simpleString()}, v array<double>")


def to_rows(expr: DataFrame) -> DataFrame:
    """cell_id, v: values by gene name of a dense matrix."""
    packed = F.array_sort(F.collect_list(F.struct("gene", "value")))
    return expr.groupBy("cell_id").agg(F.transform(packed, lambda x: x["value"]).alias("v"))


def unit(v: Column) -> Column:
    """L2-normalised vector; zero stays zero."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(v, lambda x: x / F.when(norm == 0, 1.0).otherwise(norm))


def centred(emb: DataFrame) -> DataFrame:
    """Vectors less their mean."""
    mean = emb.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("_mean"))
    return emb.crossJoin(F.broadcast(mean)).withColumn("v", F.zip_with("v", "_mean", lambda a, b: a - b)).drop("_mean")


def pca(emb: DataFrame, k: int) -> DataFrame:
    """cell_id, v: the first k principal components; each axis is turned so that its largest loading is positive."""
    x = centred(emb.select("cell_id", "v")).withColumn("_x", array_to_vector("v"))
    model = PCA(k=k, inputCol="_x", outputCol="_p").fit(x)
    loadings = model.pc.toArray()
    signs = [1.0 if column[abs(column).argmax()] >= 0 else -1.0 for column in loadings.T]
    return model.transform(x).select("cell_id", F.zip_with(vector_to_array("_p"), F.array(*map(F.lit, signs)), lambda a, b: a * b).alias("v"))


def preprocess(expr: DataFrame, n_top: int = 2000, n_components: int = 50, min_cells: int = 3, min_genes: int = 200) -> DataFrame:
    """Filter, normalise, log, pick variable genes, scale, PCA: cell_id, v."""
    x = cut(filter_cells_genes(clean(expr), min_cells, min_genes))
    cells = cut(x.select("cell_id").distinct())
    if cells.isEmpty():
        raise ValueError("no cell or gene is left after filtering")
    x = normalize_log1p(x, cells=cells)
    x = cut(x.join(F.broadcast(variable_genes(x, n_top, cells).select("gene")), "gene", "left_semi"))
    rows = cut(scaled_rows(x, cells))
    width = rows.select(F.size("v")).first()[0]
    return pca(rows, min(n_components, width))


def validate(expr: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """The cleaned matrix; ValueError for fewer than two cells, no gene, or cells without a label."""
    n = expr.agg(F.count_distinct("cell_id"), F.count_distinct("gene")).first()
    if n[0] < 2 or n[1] < 1:
        raise ValueError("a matrix needs two cells and one gene at least")
    if cells is not None and not expr.join(cells, "cell_id", "left_anti").isEmpty():
        raise ValueError("cells without a label")
    return clean(expr)
