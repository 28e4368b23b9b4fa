"""One-row summaries of results, and seeds held for a block."""

from __future__ import annotations

import random
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..functions.order import medians
from . import neighbors
from .expression import downregulated, upregulated


def de_summary(de: DataFrame, p: float = 0.05, fc: float = 0.5) -> dict:
    return {"genes": de.count(), "up": upregulated(de, p, fc).count(), "down": downregulated(de, p, fc).count()}


def annotation_summary(annotated: DataFrame) -> DataFrame:
    """cell_type, n, most frequent first."""
    return annotated.groupBy("cell_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "cell_type")


def annotation_table(annotation: DataFrame, scores: DataFrame) -> DataFrame:
    """cluster, cell_type, confidence and a score_<type> column for each type."""
    types = [r[0] for r in scores.select("cell_type", "type_order").distinct().orderBy("type_order").collect()]
    wide = scores.groupBy("cluster").pivot("cell_type", types).agg(F.first("score"))
    return annotation.join(wide.select("cluster", *(F.col(f"`{t}`").alias(f"score_{t}") for t in types)), "cluster", "left")


def phase_summary(phases: DataFrame) -> DataFrame:
    n = phases.count()
    return phases.groupBy("phase").agg(F.count("*").alias("n"), (F.count("*") / max(1, n)).alias("prop"))


def doublet_summary(doublets: DataFrame) -> DataFrame:
    whole = doublets.agg(F.count("*").alias("n"), F.count_if("is_doublet").alias("n_doublets"), F.avg("doublet_score").alias("mean"))
    return whole.crossJoin(medians(doublets, "doublet_score"))


def integration_summary(corrected: DataFrame, batches: DataFrame, batch: str, k: int = 50) -> DataFrame:
    """One row: cells, batches, and of the corrected vectors the mean and median mixing entropy and the mean inverse Simpson index among k neighbours."""
    near = cut(neighbors.knn(corrected.select("cell_id", "v"), k))
    mixing = neighbors.mixing_summary(neighbors.batch_mixing(near, batches, batch, k)).where("batch IS NULL").select(F.col("mean").alias("mixing_mean"), F.col("median").alias("mixing_median"))
    lisi = neighbors.lisi(near, batches, batch, k).agg(F.avg("lisi").alias("lisi_mean"))
    sizes = batches.join(corrected.select("cell_id"), "cell_id").agg(F.count("*").alias("n_cells"), F.count_distinct(batch).alias("n_batches"))
    return sizes.crossJoin(mixing).crossJoin(lisi)


def subcluster_summary(before: DataFrame, after: DataFrame, label: str) -> DataFrame:
    """old, new, n: how many cells each part of a split cluster has; clusters that stay whole are left out."""
    moved = before.select("cell_id", F.col(label).alias("old")).join(after.select("cell_id", F.col(label).alias("new")), "cell_id").groupBy("old", "new").agg(F.count("*").alias("n"))
    split = moved.groupBy("old").agg(F.count("*").alias("_parts")).where("_parts > 1").select("old")
    return moved.join(split, "old", "left_semi")


def merge_summary(mapping: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """new, merged (the old clusters, in order), n: the clusters that a mapping makes."""
    sizes = labels.groupBy(F.col(label).alias("old")).agg(F.count("*").alias("n"))
    return mapping.join(sizes, "old").groupBy("new").agg(F.array_sort(F.collect_list("old")).alias("merged"), F.sum("n").alias("n"))


def trajectory_summary(pseudotime: DataFrame) -> DataFrame:
    """branch (one if there is none), n, min, max."""
    x = pseudotime if "branch" in pseudotime.columns else pseudotime.withColumn("branch", F.lit(0))
    return x.groupBy("branch").agg(F.count("*").alias("n"), F.min("pseudotime").alias("min"), F.max("pseudotime").alias("max"))


def stability_summary(stability: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """label, n, stability: the mean over each cluster's cells."""
    return stability.join(labels.select("cell_id", F.col(label).alias("label")), "cell_id").groupBy("label").agg(F.count("*").alias("n"), F.avg("cell_stability").alias("stability"))


@contextmanager
def seeded(seed: int = 42) -> Iterator[np.random.Generator]:
    """A generator for the block; Python's and NumPy's global states are set and put back."""
    python, numpy = random.getstate(), np.random.get_state()
    random.seed(seed)
    np.random.seed(seed % 2**32)
    try:
        yield np.random.default_rng(seed)
    finally:
        random.setstate(python)
        np.random.set_state(numpy)
