import os

import pyarrow as pa

from tessera.llm import common


def test_tables_are_written_and_released(spark):
    common.release(spark)
    df = common.materialise(spark.range(5), "numbers")
    assert df.count() == 5
    (path,) = common._WRITTEN
    local = path.removeprefix("file://")
    assert path.startswith(common.shared_dir(spark)) and os.path.exists(local)
    assert common.release(spark) == 1 and not os.path.exists(local)


def test_slices_keep_all_rows():
    batch = pa.RecordBatch.from_pydict({"x": ["a" * 100] * 50})
    parts = list(common.slices([batch], 1000))
    assert len(parts) > 3 and pa.Table.from_batches(parts).to_pydict() == batch.to_pydict()
    assert list(common.slices([batch.slice(0, 0)])) == []


def test_nulls_are_empty():
    assert common.null_safe_bytes(pa.array(["é", None, ""])) == ["é".encode(), b"", b""]


def test_passing_tables_are_deleted_at_the_end(spark):
    known = list(common._WRITTEN)
    with common.passing(spark.range(7), "passing") as df:
        assert df.count() == 7
        path = df.inputFiles()[0].removeprefix("file://")
        assert os.path.exists(path) and common._WRITTEN == known
    assert not os.path.exists(path)


def test_an_owner_releases_its_own_tables(spark):
    common.release(spark)
    with common.owned("a"):
        first = common.materialise(spark.range(3), "first")
        with common.owned("b"):
            second = common.materialise(spark.range(4), "second")
    third = common.materialise(spark.range(5), "third")
    assert common.release(spark, "a") == 1 and common.release(spark, "a") == 0
    assert second.count() == 4 and third.count() == 5
    assert len(common._WRITTEN) == 2
    assert common.release(spark) == 2 and common._OWNERS == {}
    assert first.columns == ["id"]
