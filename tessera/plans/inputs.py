"""The domain's tables, made from the driver's: what each query reads, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.matrix import densify


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse matrix: customers are cells, brands genes, quantities values."""
    l = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")  # noqa: E741
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    p = read(spark, sf_dir, "part").select("p_partkey", "p_brand")
    x = l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(p, F.col("l_partkey") == F.col("p_partkey"))
    return x.groupBy(F.col("o_custkey").alias("cell_id"), F.col("p_brand").alias("gene")).agg(F.sum("l_quantity").alias("value"))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n, r = (read(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    x = c.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"))
    return x.select(F.col("c_custkey").alias("cell_id"), F.col("c_mktsegment").alias("cluster"), F.col("r_name").alias("batch"), F.when(F.col("c_acctbal") >= 0, "pos").otherwise("neg").alias("condition"), F.col("c_acctbal").alias("bal"))


def expr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dense matrix."""
    return densify(counts(spark, sf_dir), cells(spark, sf_dir), read(spark, sf_dir, "part").select(F.col("p_brand").alias("gene")))


def emb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cell_id, v, label, batch of the embeddings."""
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("cell_id"), F.col("embedding").cast("array<double>").alias("v"), "label", (F.col("vec_id") % 3).cast("int").alias("batch"))


def gene_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select(F.concat(F.lit("SIZE"), "p_size").alias("term"), F.concat(F.lit("P"), "p_partkey").alias("gene"))


def markers(spark: SparkSession) -> DataFrame:
    """A marker table over brands, five to a type."""
    rows = [(f"type{x}", f"Brand#{5 * x - 5 + y}", x - 1) for x in range(1, 6) for y in range(1, 6)]
    return spark.createDataFrame(rows, "cell_type string, gene string, type_order int")


def r6(c: Column | str) -> Column:
    """Rounded to 6 places; adding 0 turns -0 into 0."""
    return F.round(c, 6) + F.lit(0.0)


def q6(e: str) -> str:
    return f"(round({e}, 6) + 0.0)"


RAW = "raw AS (SELECT o_custkey AS cell_id, p_brand AS gene, sum(l_quantity) AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY ALL)"
CELLS = "cells AS (SELECT c_custkey AS cell_id, c_mktsegment AS cluster, r_name AS batch, CASE WHEN c_acctbal >= 0 THEN 'pos' ELSE 'neg' END AS condition, c_acctbal AS bal FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"
EXPR = f"{RAW}, {CELLS}, genes AS (SELECT DISTINCT p_brand AS gene FROM part), expr AS (SELECT cell_id, gene, coalesce(value, 0.0) AS value FROM cells CROSS JOIN genes LEFT JOIN raw USING (cell_id, gene))"
EMB = "emb AS (SELECT vec_id AS cell_id, embedding::DOUBLE[] AS v, label, (vec_id % 3)::INT AS batch FROM embeddings)"


def nearest(k: int, left: str = "emb", right: str = "emb", name: str = "nn") -> str:
    return f"{name} AS (SELECT * FROM (SELECT a.cell_id AS src, b.cell_id AS dst, list_distance(a.v, b.v) AS d, row_number() OVER (PARTITION BY a.cell_id ORDER BY list_distance(a.v, b.v), b.cell_id) AS rank FROM {left} a JOIN {right} b ON a.cell_id <> b.cell_id) WHERE rank <= {k})"
