"""Positions, counts below and medians in an order, without gathering rows in one task.

Rows are dealt to ranges of their order; what lies below a range comes from one total a range. A
key whose rows fill many ranges is counted by as many tasks.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .lineage import cut


def with_positions(df: DataFrame, key: str, name: str = "pos") -> DataFrame:
    """Adds the row's position (from 0) by a unique key: ranges of the key, counted, then numbered within."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(df.repartitionByRange(parts, key).withColumn("_part", F.spark_partition_id()))
    sizes = sorted((r["_part"], r["count"]) for r in ranged.groupBy("_part").count().collect())
    before = dict(zip((p for p, _ in sizes), accumulate((n for _, n in sizes), initial=0), strict=False))
    starts = df.sparkSession.createDataFrame(list(before.items()) or [(0, 0)], "_part int, _before long")
    within = F.row_number().over(Window.partitionBy("_part").orderBy(key)) - 1
    return ranged.join(F.broadcast(starts), "_part").withColumn(name, F.col("_before") + within).drop("_part", "_before")


def counted_below(df: DataFrame, value: str, *keys: str, weight: str = "c") -> DataFrame:
    """Adds _to and _ties: the weight of the rows of the same keys that lie at or below the value, and of those at it.

    Rows of equal keys and value go to one range, so they are to be counted first.
    """
    ranged = cut(df.repartitionByRange(*keys, value).withColumn("_part", F.spark_partition_id()))
    totals = ranged.groupBy("_part", *keys).agg(F.sum(weight).alias("_sum"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_before", F.coalesce(F.sum("_sum").over(earlier), F.lit(0.0))).drop("_sum")
    part = Window.partitionBy("_part", *keys)
    x = ranged.withColumns({"_within": F.sum(weight).over(part.orderBy(value).rangeBetween(Window.unboundedPreceding, Window.currentRow)), "_ties": F.sum(weight).over(Window.partitionBy("_part", *keys, value))})
    # null keys are groups too
    names = {k: f"_{k}_of" for k in ("_part", *keys)}
    same = F.lit(True)
    for k, n in names.items():
        same = same & F.col(k).eqNullSafe(F.col(n))
    return x.join(totals.withColumnsRenamed(names), same).withColumn("_to", F.col("_within") + F.col("_before")).drop("_part", "_within", "_before", *names.values())


def quantiles(df: DataFrame, value: str, *keys: str, shares: tuple[float, ...] = (0.5,)) -> DataFrame:
    """keys, q: exact quantiles, between neighbours in proportion; nulls and NaN do not count. Keys without a value are left out."""
    v = F.col(value).cast("double")
    counts = df.where(v.isNotNull() & ~F.isnan(v)).groupBy(*keys, v.alias("_v")).agg(F.count("*").cast("double").alias("c"))
    x = counted_below(counts, "_v", *keys)
    x = x.withColumn("_n", F.sum("c").over(Window.partitionBy(*keys))) if keys else x.crossJoin(F.broadcast(x.agg(F.sum("c").alias("_n"))))

    def at(k: Column) -> Column:
        """The value at a position, counted from 1."""
        return F.max(F.when((F.col("_to") >= k) & (F.col("_to") - F.col("_ties") < k), F.col("_v")))

    ends = [e for i, p in enumerate(shares) for place in [p * (F.col("_n") - 1) + 1] for e in (at(F.floor(place)).alias(f"_a{i}"), at(F.ceil(place)).alias(f"_b{i}"), F.max(place - F.floor(place)).alias(f"_f{i}"))]
    between = [F.col(f"_a{i}") + (F.col(f"_b{i}") - F.col(f"_a{i}")) * F.col(f"_f{i}") for i in range(len(shares))]
    return x.groupBy(*keys).agg(*ends).where("_a0 IS NOT NULL").select(*keys, F.array(*between).alias("q"))


def medians(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """keys, median."""
    return quantiles(df, value, *keys).select(*keys, F.col("q")[0].alias("median"))
