"""What the operators share: the shared folder, written stages, samples and slices of Arrow batches."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: UTF-8 bytes of text that one vectorised step works on; bounds a worker's memory.
SLICE_BYTES = 2 << 20


#: Lists that take the paths of the stages written while they are open.
NOTED: ContextVar[tuple[list[str], ...]] = ContextVar("NOTED", default=())


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in ``spark.checkpoint.dir``; where it is
    unset, as in tests, one under the warehouse, which all executors share too."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    return named or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_stages"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a stage that several branches read to the shared folder and read it
    again: computed once, without lineage, and there when an executor is lost."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    for paths in NOTED.get():
        paths.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, paths: Iterable[str]) -> None:
    """Delete folders of stages that nothing reads any more."""
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def noted() -> Iterator[list[str]]:
    """The paths of all stages that are written inside the block."""
    paths: list[str] = []
    token = NOTED.set((*NOTED.get(), paths))
    try:
        yield paths
    finally:
        NOTED.reset(token)


def settled(spark: SparkSession, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """What ``make`` gives, written as a stage; the stages that it wrote on the way are then removed."""
    with noted() as paths:
        df = make()
    out = stage(df, name)
    remove(spark, paths)
    return out


def narrow(df: DataFrame, id: str, text: str) -> DataFrame:
    """Only the two columns that an operator reads, under its own names, so that
    other columns of the table cannot clash with what it adds."""
    return df.select(df[id].alias("doc_id"), df[text].alias("text"))


def bounded_sample(df: DataFrame, key: Column, rows: int) -> DataFrame:
    """About ``rows`` rows, all if there are fewer, picked by a hash of ``key``."""
    share = min(1.0, rows / max(1, df.count()))
    return df.where(F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(1 << 20)) < F.lit(int(share * (1 << 20))))


def slices(batch: pa.RecordBatch, column: int = 1, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch whose texts have about ``limit`` bytes, or whose lists that many entries."""
    values = batch.column(column)
    length = pc.list_value_length if pa.types.is_list(values.type) else pc.binary_length
    size = pc.fill_null(length(values), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = np.cumsum(size) // limit
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def int_lists(parts: list[bytes], width: int = 4) -> pa.ListArray:
    """A list column from each row's little-endian integers."""
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) // width for p in parts], out=offsets[1:])
    values = np.frombuffer(b"".join(parts), f"<i{width}")
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def sha256_of_ids(ids: Column) -> Column:
    """Lowercase hex SHA-256 of the decimal ids joined by commas."""
    return F.sha2(F.concat_ws(",", ids.cast("array<string>")), 256)
