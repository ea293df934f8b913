"""Helpers of the operators: written tables, free names, and Bloom filters that keep rows without a partner out of a join's shuffle."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut, shared_dir, written
from . import text as T

__all__ = ["cut", "free", "may_be_in", "partitions", "released", "shared_dir", "without", "written"]
#: Bits of a filter for each key, and at most: 32 MB are sent to each executor. Beyond, more rows pass the filter, and all results stay the same.
KEY_BITS, MAX_BITS = 16, 1 << 28
_PLACES = 4


def free(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, name if possible."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def partitions(df: DataFrame, each: int = 64 << 20) -> int | None:
    """Partitions of about each bytes of df's files, where the session's number of shuffle partitions is too small for that; else None.

    Without access to the plan's statistics (Spark Connect) it is None, and the session's number counts.
    """
    plan = getattr(df, "_jdf", None)
    if plan is None:
        return None
    size = int(plan.queryExecution().optimizedPlan().stats().sizeInBytes())
    wanted = -(-size // each)
    return wanted if size < 1 << 60 and wanted > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else None


def _release() -> None:
    """Gives freed memory of this process back, where the C library can do so."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, a function for mapInArrow, with freed memory given back before and after it: Spark keeps workers for later tasks, and they would hold it beside them."""

    @functools.wraps(run)
    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _release()
        try:
            yield from run(batches)
        finally:
            _release()

    return one


def _places(keys: np.ndarray, bits: int) -> np.ndarray:
    h = T.mix(keys.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    step = T.mix(h) | np.uint64(1)
    return np.stack([(h + np.uint64(k) * step) & np.uint64(bits - 1) for k in range(_PLACES)])


def may_be_in(key: Column, keys: DataFrame) -> Column:
    """Whether a long may be among keys, a frame of one long column: true for each of them, and for about one in 400 others. A null is false.

    Runs a job that counts keys and one that sets the filter's bits.
    """
    spark, name = keys.sparkSession, keys.columns[0]
    n = keys.count()
    bits = min(MAX_BITS, 1 << max(12, (KEY_BITS * n - 1).bit_length()))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.unique(_places(b.column(0).drop_null().to_numpy(), bits).ravel())
            word, first = np.unique(at >> np.uint64(6), return_index=True)
            if len(word):
                own = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), first)
                yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array(own.view(np.int64))], ["word", "bits"])

    found = keys.select(name).mapInArrow(words, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    field = np.zeros(bits // 64, np.uint64)
    field[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    shared = spark.sparkContext.broadcast(field)

    @F.arrow_udf("boolean")
    def test(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            at = _places(b.fill_null(0).to_numpy(), bits)
            hit = ((shared.value[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)).all(0)
            yield pa.array(hit & b.is_valid().to_numpy(zero_copy_only=False))

    return test(key)


def without(docs: DataFrame, gone: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """docs without the rows whose keys are all equal to those of a row of gone, in the columns of docs. Rows with a null key stay.

    keys: gone's columns, the first of them a long, and what they stand for in docs. Only rows whose first key may be in gone are shuffled.
    """
    first = next(iter(keys))
    named = {c: free(docs, c) for c in keys}
    may = free(docs, "may")
    marked = docs.withColumn(may, may_be_in(keys[first], gone.select(first)))
    own = gone.select(*[F.col(c).alias(n) for c, n in named.items()]).distinct()
    on = [keys[c] == F.col(n) for c, n in named.items()]
    return marked.where(~F.col(may)).union(marked.where(may).join(own, on, "left_anti")).drop(may)
