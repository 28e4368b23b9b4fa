"""Command line: cluster, tune, info."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.lineage import cut
from .operators import expression
from .operators.estimator import GraphClustering
from .operators.tuning import METRICS, Tuner
from .sources import io

VERSION = "0.1.0"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tessera")
    p.add_argument("--version", action="version", version=VERSION)
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("cluster", help="cluster a matrix (csv, tsv, mtx, parquet)")
    c.add_argument("input")
    c.add_argument("-o", "--output", required=True)
    c.add_argument("-k", "--n-clusters", type=int)
    c.add_argument("--epochs", type=int, default=100)
    c.add_argument("--min-genes", type=int, default=200)
    c.add_argument("--min-cells", type=int, default=3)
    c.add_argument("--seed", type=int, default=42)
    c.add_argument("--markers", action="store_true")
    c.add_argument("--save-model", action="store_true")
    t = sub.add_parser("tune", help="search parameters")
    t.add_argument("input")
    t.add_argument("-o", "--output", required=True)
    t.add_argument("-n", "--n-trials", type=int, default=20)
    t.add_argument("--metric", choices=METRICS, default="silhouette")
    sub.add_parser("info", help="version and engine")
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("tessera").getOrCreate()
    try:
        if args.command == "info":
            print(f"tessera {VERSION}, Spark {spark.version}")
            return 0
        expr = io.load_data(spark, args.input)
        if args.command == "tune":
            estimator = GraphClustering()
            Tuner(args.n_trials, args.metric).tune(estimator.prepare(expr)).coalesce(1).write.mode("overwrite").json(args.output)
            return 0
        estimator = GraphClustering(n_clusters=args.n_clusters, pretrain_epochs=args.epochs, min_genes=args.min_genes, min_cells=args.min_cells, seed=args.seed)
        emb = cut(estimator.prepare(expr))
        model = estimator.fit(emb)
        hidden = cut(model.embeddings(emb, estimator.graph(emb)))
        labels = cut(model.predict(hidden))
        # rows are keyed by cell, so cells that the filters dropped are absent, not shifted
        labels.select(F.col("cell_id").alias("cell"), F.col("label").alias("cluster"), "confidence").coalesce(1).write.mode("overwrite").csv(f"{args.output}/labels", header=True)
        hidden.write.mode("overwrite").parquet(f"{args.output}/embeddings")
        if args.markers:
            kept = expr.join(labels, "cell_id", "left_semi")
            expression.find_markers(kept, labels.select("cell_id", F.col("label").alias("cluster"))).coalesce(1).write.mode("overwrite").csv(f"{args.output}/markers", header=True)
        if args.save_model:
            model.save(spark, f"{args.output}/model")
        return 0
    except (ValueError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
