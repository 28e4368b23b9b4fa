"""Readers and writers of matrices, gene sets and results."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SUFFIXES = {".csv": "csv", ".tsv": "tsv", ".txt": "tsv", ".mtx": "mtx", ".parquet": "parquet", ".h5ad": "h5ad"}


def load_data(spark: SparkSession, path: str, file_format: str = "auto") -> DataFrame:
    """cell_id, gene, value of a csv, tsv, mtx or parquet file; ValueError for any other suffix.

    csv and tsv have cells as rows, their id first, and genes in the header. mtx is genes by cells,
    1-based, without names: ids are positions and genes are gene_<i>.
    """
    kind = file_format
    if kind == "auto":
        kind = next((k for s, k in SUFFIXES.items() if path.lower().rstrip("/").endswith(s)), "")
    if kind in ("csv", "tsv"):
        return from_wide(spark.read.csv(path, sep="," if kind == "csv" else "\t", header=True))
    if kind == "mtx":
        return load_mtx(spark, path)
    if kind == "parquet":
        return spark.read.parquet(path).select("cell_id", "gene", F.col("value").cast("double").alias("value"))
    if kind == "h5ad":
        raise ValueError("h5ad needs a reader that is not installed; convert it to mtx, csv or parquet")
    raise ValueError(f"unknown format: {path}")


def from_wide(wide: DataFrame) -> DataFrame:
    """Long rows of a table with the cell first and a column for each gene."""
    cell, *genes = wide.columns
    pairs = F.array(*(F.struct(F.lit(g).alias("gene"), F.col(f"`{g}`").cast("double").alias("value")) for g in genes))
    return wide.select(F.col(f"`{cell}`").alias("cell_id"), F.inline(pairs))


def to_wide(expr: DataFrame, genes: list[str] | None = None) -> DataFrame:
    """A column for each gene; their list is gathered (a matrix's width)."""
    genes = genes or [r[0] for r in expr.select("gene").distinct().orderBy("gene").collect()]
    return expr.groupBy("cell_id").pivot("gene", genes).agg(F.first("value")).fillna(0.0)


def load_mtx(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).where(~F.startswith("value", F.lit("%")))
    parts = F.split(F.trim("value"), r"\s+")
    x = lines.select(parts.alias("p")).where(F.size("p") >= 2)
    head = x.first()  # the size line is the file's first that is no comment
    size = (int(head["p"][0]), int(head["p"][1]), int(head["p"][2]))
    entries = x.select(F.col("p")[0].cast("long").alias("g"), F.col("p")[1].cast("long").alias("c"), F.coalesce(F.col("p")[2], F.lit("1")).cast("double").alias("value"), F.monotonically_increasing_id().alias("n"))
    return entries.where("n > 0").where((F.col("g") <= size[0]) & (F.col("c") <= size[1])).select((F.col("c") - 1).alias("cell_id"), F.concat(F.lit("gene_"), F.col("g") - 1).alias("gene"), "value")


def load_gmt(spark: SparkSession, path: str) -> DataFrame:
    """term, gene; lines of fewer than three fields are left out, and of a repeated term the last line counts."""
    parts = F.split(F.trim("value"), "\t")
    x = spark.read.text(path).select(F.monotonically_increasing_id().alias("n"), parts.alias("p")).where(F.size("p") >= 3)
    last = x.groupBy(F.col("p")[0].alias("term")).agg(F.max_by("p", "n").alias("p"))
    return last.select("term", F.explode(F.slice("p", 3, F.size("p"))).alias("gene"))


def gmt_lines(markers: DataFrame, description: str = "marker genes") -> DataFrame:
    """value: a GMT line for each cluster (cluster, gene, and ord for the genes' order)."""
    genes = F.transform(F.array_sort(F.collect_list(F.struct("ord", "gene"))), lambda s: s["gene"])
    return markers.groupBy("cluster").agg(genes.alias("g")).orderBy("cluster").select(F.concat_ws("\t", F.concat(F.lit("Cluster_"), F.col("cluster").cast("string")), F.lit(description), F.array_join("g", "\t")).alias("value"))


def export_gmt(markers: DataFrame, path: str, description: str = "marker genes") -> None:
    gmt_lines(markers, description).coalesce(1).write.mode("overwrite").text(path)


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


LOADER = """counts <- read.csv(file.path(dir, "counts"), row.names = 1)
metadata <- read.csv(file.path(dir, "metadata"), row.names = 1)
embeddings <- as.matrix(read.csv(file.path(dir, "embeddings"), row.names = 1))
object <- Seurat::CreateSeuratObject(counts = counts, meta.data = metadata)
object[["learned"]] <- Seurat::CreateDimReducObject(embeddings = embeddings, key = "DIM_")
"""


def to_seurat(expr: DataFrame, cells: DataFrame, emb: DataFrame, path: str) -> None:
    """A folder of csv tables (counts genes by cells, metadata, embeddings) and a script that loads them."""
    spark = expr.sparkSession
    ids = [r[0] for r in cells.select("cell_id").orderBy("cell_id").collect()]
    expr.groupBy("gene").pivot("cell_id", ids).agg(F.first("value")).fillna(0.0).write.mode("overwrite").csv(f"{path}/counts", header=True)
    cells.write.mode("overwrite").csv(f"{path}/metadata", header=True)
    width = emb.select(F.size("v")).first()[0]
    emb.select("cell_id", *(F.col("v")[i].alias(f"DIM_{i + 1}") for i in range(width))).write.mode("overwrite").csv(f"{path}/embeddings", header=True)
    _write_text(spark, f"{path}/load.R", LOADER)


def write_bundle(path: str, expr: DataFrame, obs: DataFrame, var: DataFrame | None = None, obsm: dict[str, DataFrame] | None = None, title: str = "analysis", schema_version: str = "3.0.0") -> None:
    """Parquet tables X, obs, var and obsm with a JSON manifest: what annotated-matrix files hold."""
    expr.write.mode("overwrite").parquet(f"{path}/X")
    obs.write.mode("overwrite").parquet(f"{path}/obs")
    (var if var is not None else expr.select("gene").distinct()).write.mode("overwrite").parquet(f"{path}/var")
    for name, emb in (obsm or {}).items():
        emb.write.mode("overwrite").parquet(f"{path}/obsm/{name}")
    _write_text(expr.sparkSession, f"{path}/manifest", json.dumps({"title": title, "schema_version": schema_version, "obsm": sorted(obsm or {})}))


def read_bundle(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    manifest = json.loads(spark.read.text(f"{path}/manifest").first()[0])
    return {name: spark.read.parquet(f"{path}/{name}") for name in ("X", "obs", "var", *(f"obsm/{m}" for m in manifest["obsm"]))}


def select_layer(layers: DataFrame, layer: str | None = None, use_raw: bool = False) -> DataFrame:
    """cell_id, gene, value of rows (cell_id, gene, layer, value): raw, else the layer, else X."""
    return layers.where(F.col("layer") == ("raw" if use_raw else layer or "X")).select("cell_id", "gene", "value")


def simulate(spark: SparkSession, n_cells: int = 1000, n_genes: int = 2000, n_clusters: int = 5, dropout: float = 0.5, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(expr, cells): Poisson counts with exponential rates by cluster and gene, dropped out; every draw is a hash of its place."""

    def uniform(*key) -> F.Column:
        return (F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(1_000_003)) + 0.5) / 1_000_003

    cells = spark.range(n_cells).select(F.col("id").alias("cell_id"), F.floor(uniform(F.lit("label"), "id") * n_clusters).cast("int").alias("label"))
    x = cells.select("cell_id", "label", F.explode(F.sequence(F.lit(0), F.lit(n_genes - 1))).alias("g"))
    rate = -2.0 * F.ln(uniform(F.lit("rate"), "label", "g"))
    # counts by inversion: how many terms of the distribution lie below the draw
    x = x.select("cell_id", F.concat(F.lit("gene_"), "g").alias("gene"), rate.alias("rate"), uniform(F.lit("draw"), "cell_id", "g").alias("u"), (uniform(F.lit("drop"), "cell_id", "g") < dropout).alias("drop"))
    terms = F.aggregate(F.sequence(F.lit(1), F.lit(60)), F.struct(F.exp(-F.col("rate")).alias("p"), F.exp(-F.col("rate")).alias("c"), F.lit(0).alias("n")), lambda a, k: F.struct((a["p"] * F.col("rate") / k).alias("p"), (a["c"] + a["p"] * F.col("rate") / k).alias("c"), (a["n"] + F.when(F.col("u") > a["c"], 1).otherwise(0)).alias("n")), lambda a: a["n"])
    return x.select("cell_id", "gene", F.when(F.col("drop"), 0.0).otherwise(terms.cast("double")).alias("value")), cells
