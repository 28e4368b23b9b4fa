"""Helpers shared by the corpus operators: tables, shared folders, Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows are handed to a Python worker's kernel in slices of about so many bytes.
SLICE_BYTES = 8 << 20
BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows of an Arrow batch while a table is written.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. A temporary one where none is set, but only where all run on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


#: Tables that this process has written to the shared folder, and who wrote them where that was said.
_WRITTEN: list[str] = []
_OWNERS: dict[str, str] = {}
_OWNER: list[str] = []


@contextmanager
def owned(owner: str) -> Iterator[None]:
    """Tables written within the block belong to this owner, or to that of a block within it."""
    _OWNER.append(owner)
    try:
        yield
    finally:
        _OWNER.pop()


def release(spark: SparkSession, owner: str | None = None) -> int:
    """Deletes the tables that materialise() has written, those of one owner or all, once their results are no longer needed; returns their number."""
    gone = [path for path in _WRITTEN if owner is None or _OWNERS.get(path) == owner]
    for path in gone:
        _WRITTEN.remove(path)
        _OWNERS.pop(path, None)
        _delete(spark, path)
    return len(gone)


def _delete(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def passing(df: DataFrame, name: str) -> Iterator[DataFrame]:
    """df, written as by materialise() and deleted at the end of the block, by when all that reads it must have run."""
    known = len(_WRITTEN)
    table = materialise(df, name)
    path = _WRITTEN.pop(known)
    _OWNERS.pop(path, None)
    try:
        yield table
    finally:
        _delete(df.sparkSession, path)


def materialise(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors. release() deletes it unless keep is set."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not keep:
        _WRITTEN.append(path)
        if _OWNER:
            _OWNERS[path] = _OWNER[-1]
    before = spark.conf.get(BATCH_CONF)
    spark.conf.set(BATCH_CONF, str(BATCH_ROWS))  # rows can be whole texts, and a batch is in memory on either side
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(BATCH_CONF, before)
    return spark.read.schema(df.schema).parquet(path)


def null_safe_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `limit` bytes, one row at least."""
    for batch in batches:
        n = batch.num_rows
        step = max(1, int(n * limit / max(1, batch.nbytes)))
        for at in range(0, n, step):
            yield batch.slice(at, step)


def map_arrow(df: DataFrame, kernel: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, limit: int = SLICE_BYTES) -> DataFrame:
    """mapInArrow of a batch-wise kernel over slices of bounded size."""

    def run(batches):
        for piece in slices(batches, limit):
            out = kernel(piece)
            if out is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)
