"""Joins of ranges that hold other ranges, as equi-joins: no pair of a file's ranges is formed unless they may meet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Widths, as powers of two, of the buckets that ranges are put into: the first that is no narrower than the range.
LEVELS = (3, 6, 9, 12, 16, 20, 24, 31, 40)


def holding(ranges: DataFrame, asked: DataFrame, lo: str, hi: str, first: str, last: str, on: str = "file") -> DataFrame:
    """Rows of asked joined with those of ranges of the same file, lo to hi of which holds first to last. The tables share no other column.

    A range covers at most two buckets of its width, and what it holds begins in one of them; asked rows are tried at each width. So a hot file is spread over as many keys as it has
    buckets. Nulls hold nothing, and a range that ends before it begins is none.
    """
    size = F.col(hi) - F.col(lo) + 1
    level = F.coalesce(*[F.when(size <= (1 << k), F.lit(k)) for k in LEVELS])
    bucket = lambda c, k: F.floor(c / F.pow(F.lit(2.0), k)).cast("long")
    left = ranges.where(size > 0).withColumn("_level", level).withColumn("_bucket", F.explode(F.sequence(bucket(F.col(lo), F.col("_level")), bucket(F.col(hi), F.col("_level")))))
    tries = asked.withColumn("_level", F.explode(F.array(*map(F.lit, LEVELS)))).withColumn("_bucket", bucket(F.col(first), F.col("_level")))
    return tries.join(left, [on, "_level", "_bucket"]).where((F.col(lo) <= F.col(first)) & (F.col(hi) >= F.col(last))).drop("_level", "_bucket")
