"""Helpers that several operators share: shared folders, table access, Arrow batches."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache, wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shared import cut, shared_dir

__all__ = ["Scratch", "bounded_batches", "byte_slices", "cut", "evict", "memo", "release", "shared_dir", "table", "text_or_empty", "text_slices", "texts", "whole_keys"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


BATCH_BYTES = "1m"
#: A writer holds a whole row group; each task has one.
ROW_GROUP_BYTES = 16 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Bound the bytes of the batches in which rows go to Python workers, where the session has no bound: else rows alone count, and thousands of long texts or sets stand in memory outside the heap at once."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, BATCH_BYTES)


class Scratch:
    """Tables of steps in the shared folder: a lost executor loses nothing of them, and those that no result needs any more can be dropped."""

    def __init__(self, spark: SparkSession) -> None:
        bounded_batches(spark)
        self.spark, self.place, self.tables = spark, f"{shared_dir(spark)}/steps-{uuid.uuid4().hex}", {}

    def cut(self, df: DataFrame) -> DataFrame:
        path = f"{self.place}/{len(self.tables)}"
        df.write.option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.tables[path] = out
        return out

    def drop(self, *dfs: DataFrame, but: DataFrame | None = None) -> None:
        """Delete the files of dfs, or of all tables but one."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for path, table in list(self.tables.items()):
            if table is not None and (any(table is x for x in dfs) if dfs else table is not but):
                where = jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(conf).delete(where, True)
                self.tables[path] = None


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of finished steps: Spark drops them once the driver's collectors see that nobody refers to them."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


_memos: list[Callable] = []


def memo(f: Callable) -> Callable:
    """f's results are kept in a worker from task to task, until a task of another operator begins (see evict)."""
    kept = lru_cache(maxsize=1)(f)
    _memos.append(kept)

    @wraps(f)  # tasks find it by its name
    def get(*args):  # noqa: ANN002, ANN202
        evict(kept)
        return kept(*args)

    return get


@lru_cache(maxsize=1)
def _trim() -> Callable[[int], int]:
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):  # another C library
        return lambda n: 0


def evict(but: Callable | None = None) -> None:
    """Let go of what other operators keep in this worker, and of memory that only its allocators hold, so that these don't add up."""
    for f in _memos:
        if f is not but and f.cache_info().currsize:
            f.cache_clear()
            gc.collect()
    pa.default_memory_pool().release_unused()
    _trim()(0)


def byte_slices(sizes: list[int], limit: int) -> list[tuple[int, int]]:
    """Consecutive ranges [a, b) whose sizes add up to at most limit; a larger item stands alone."""
    out, a, total = [], 0, 0
    for i, n in enumerate(sizes):
        if i > a and total + n > limit:
            out.append((a, i))
            a, total = i, 0
        total += n
    if a < len(sizes):
        out.append((a, len(sizes)))
    return out


def texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """A string column without nulls as UTF-8 bytes."""
    return batch.column(batch.schema.get_field_index(name)).cast(pa.large_binary()).to_pylist()


def text_slices(batch: pa.RecordBatch, limit: int, name: str = "text") -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """batch in slices of about limit bytes of text, each with its texts; only these are copied, slice by slice."""
    sizes = pc.binary_length(batch.column(batch.schema.get_field_index(name))).to_pylist()
    for a, b in byte_slices(sizes, limit):
        rows = batch.slice(a, b - a)
        yield rows, texts(rows, name)


def whole_keys(batches: Iterator[pa.RecordBatch], name: str, least: int) -> Iterator[list[pa.RecordBatch]]:
    """Batches that come sorted by a column of whole numbers, put together so that each has all rows of its keys, and at least so many rows but for the last."""
    held: list[pa.RecordBatch] = []
    rows, limit = 0, least
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows >= limit:
            table = pa.Table.from_batches(held)
            key = table.column(name).to_numpy()
            end = len(key) - int(np.argmax(key[::-1] != key[-1])) if key[0] != key[-1] else 0
            if end:
                yield table.slice(0, end).to_batches()
                held, rows = table.slice(end).to_batches(), len(key) - end
            limit = max(least, 2 * rows)
    if held:
        yield held
