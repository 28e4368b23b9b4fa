import pytest

from tessera import cli
from tessera.sources import io


def test_info_and_errors(spark, capsys, tmp_path):
    assert cli.main(["info"]) == 0 and "Spark" in capsys.readouterr().out
    assert cli.main(["cluster", str(tmp_path / "matrix.h5ad"), "-o", str(tmp_path / "out")]) == 1 and "error" in capsys.readouterr().err
    with pytest.raises(SystemExit):
        cli.main(["cluster"])


def test_cluster_writes_labels_markers_and_model(spark, tmp_path):
    expr, _ = io.simulate(spark, 60, 40, 3, 0.3, 1)
    expr.write.parquet(str(tmp_path / "m.parquet"))
    out = tmp_path / "out"
    assert cli.main(["cluster", str(tmp_path / "m.parquet"), "-o", str(out), "-k", "3", "--epochs", "2", "--min-genes", "2", "--markers", "--save-model"]) == 0
    labels = spark.read.csv(str(out / "labels"), header=True)
    assert labels.count() == 60 and labels.columns == ["cell", "cluster", "confidence"] and labels.select("cluster").distinct().count() <= 3
    assert spark.read.parquet(str(out / "embeddings")).count() == 60
    assert set(spark.read.csv(str(out / "markers"), header=True).columns) >= {"cluster", "gene", "score"} and (out / "model").exists()
