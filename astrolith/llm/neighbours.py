"""Approximate nearest neighbours by collision counting (query-aware hashing).

Each of m random projections is a sorted array of values. A query opens a window around its own value in every array and counts how often
each vector falls into one; the radius grows step by step (virtual rehashing), which only adds the two ends of each window.
Vectors that collide in at least a threshold of arrays are verified by their true distance. A query ends once its k-th distance is
within the radius.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .session import written

K = 10
PROJECTIONS = 64
#: Half a window's width at radius 1: a vector at the radius collides with a probability of 0.683.
HALF_WIDTH = 1.0
#: Share of the arrays in which a vector must collide: 1.9 deviations under what is expected at the radius.
THRESHOLD = 0.57
#: Factor by which the radius grows.
GROWTH = 1.12
#: Vectors to a shard, which has sorted arrays of its own, and queries to a block; bytes of vectors in a shard, in case they are wide.
SHARD_ROWS, QUERY_ROWS, SHARD_BYTES = 1 << 16, 1 << 7, 1 << 28
#: The query takes the vectors whose identifier this divides, and searches all vectors for them.
EVERY = 50
#: Vectors whose collisions are counted at once.
BLOCK_ROWS = 1 << 13


class Shard:
    """Sorted projections of one shard's vectors, and the place of each vector in each of them."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, projections: int = PROJECTIONS, seed: int = 11):
        self.ids, self.vectors = ids, vectors
        n = len(ids)
        self.a = np.random.default_rng(seed).standard_normal((vectors.shape[1], projections)).astype(np.float32)
        p = np.ascontiguousarray((vectors @ self.a).T)
        order = np.argsort(p, axis=1, kind="stable")
        self.sorted = np.take_along_axis(p, order, 1)
        self.kind = np.uint16 if n < 1 << 16 else np.uint32
        place = np.empty(p.shape, self.kind)
        np.put_along_axis(place, order, np.arange(n, dtype=self.kind)[None], 1)
        # blocks of vectors whose places fit a cache
        self.blocks = [np.ascontiguousarray(place[:, i : i + BLOCK_ROWS]) for i in range(0, n, BLOCK_ROWS)]
        self.norms = (vectors**2).sum(1)
        self.start = self._start() if n else 1e-12

    def _start(self) -> float:
        """A radius that few queries end below, by the nearest neighbours of evenly spaced vectors."""
        some = self.vectors[:: max(1, len(self.vectors) // 64)]
        d = np.maximum((some**2).sum(1)[:, None] + self.norms[None] - 2 * some @ self.vectors.T, 0)
        k = min(K, len(self.vectors) - 1)
        return max(float(np.sqrt(np.quantile(np.partition(d, k, axis=1)[:, k], 0.1))), 1e-12)

    def collisions(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """In how many arrays each vector lies in the window lo to hi of places."""
        out = np.empty(len(self.ids), np.uint8)
        lo, width = lo.astype(self.kind)[:, None], (hi - lo).astype(self.kind)[:, None]
        full = (hi - lo) > np.iinfo(self.kind).max
        for k, block in enumerate(self.blocks):
            inside = (block - lo) < width
            if full.any():
                inside[full] = True
            out[k * BLOCK_ROWS : k * BLOCK_ROWS + block.shape[1]] = np.add.reduce(inside.view(np.uint8), axis=0, dtype=np.uint8)
        return out

    def search_all(self, own: np.ndarray, queries: np.ndarray, k: int) -> list[list[tuple[float, int]]]:
        """For each query the (distance, identifier) of up to k nearest vectors, without its own identifier."""
        out: list[list[tuple[float, int]]] = []
        for i in range(0, len(queries), 64):
            out += self._search(own[i : i + 64], queries[i : i + 64], k)
        return out

    def _search(self, own: np.ndarray, queries: np.ndarray, k: int) -> list[list[tuple[float, int]]]:
        n, m = len(self.ids), len(self.sorted)
        need = int(np.ceil(THRESHOLD * m))
        p, norms = queries @ self.a, (queries**2).sum(1)
        distance = np.full((len(own), n), np.inf, np.float32)
        mine = self.ids[None] == own[:, None]
        distance[mine] = np.nan
        want = np.minimum(k, n - mine.sum(1))
        out: list[list[tuple[float, int]]] = [[] for _ in own]
        live, radius = np.flatnonzero(want > 0), self.start
        while len(live):
            reach = HALF_WIDTH * radius
            lo = np.stack([np.searchsorted(s, x) for s, x in zip(self.sorted, p[live].T - reach, strict=True)], 1)
            hi = np.stack([np.searchsorted(s, x, "right") for s, x in zip(self.sorted, p[live].T + reach, strict=True)], 1)
            going = []
            for at, q in enumerate(live.tolist()):
                d = distance[q]
                new = np.flatnonzero((self.collisions(lo[at], hi[at]) >= need) & np.isposinf(d))
                d[new] = np.sqrt(np.maximum(self.norms[new] + norms[q] - 2 * (self.vectors[new] @ queries[q]), 0))
                near = np.flatnonzero(d <= radius)
                if len(near) >= want[q] or ((hi[at] - lo[at]) >= n).all():
                    known = near if len(near) >= want[q] else np.flatnonzero(np.isfinite(d))
                    best = known[np.lexsort((self.ids[known], d[known]))[:k]]
                    out[q] = [(float(d[j]), int(self.ids[j])) for j in best]
                else:
                    going.append(q)
            live, radius = np.array(going, np.int64), radius * GROWTH
        return out


def _rows(blob: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    a = np.frombuffer(blob, np.dtype([("id", "<i8"), ("v", "<f4", (width,))]))
    return np.ascontiguousarray(a["id"]), np.ascontiguousarray(a["v"])


def _blobs(width: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        now = None

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([b"".join(held)], pa.binary())], ["part", "blob"])

        for b in batches:
            for part, i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                if part != now and held:
                    yield row()
                    held = []
                now = part
                held.append(np.int64(i).tobytes() + np.asarray(v.values.to_numpy(zero_copy_only=False), np.float32).tobytes())
        if held:
            yield row()

    return run


def nearest(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, projections: int = PROJECTIONS, every: int = 1) -> DataFrame:
    """(vec_id, neighbour_id, distance, place) of the k nearest other vectors of each vector whose identifier every divides, by Euclidean distance.

    Vectors are spread over shards by a hash of the identifier; each block of queries meets each shard in a task of its own, and the shards'
    results are merged. Null identifiers, null and empty vectors, and vectors with a null or a value that is not finite take no part; nor do those of another
    length than the most frequent one (the larger of a tie). Rows that repeat an identifier count once, with the smallest vector. Equal distances go by the smaller identifier. A
    table of one vector, or none, gives no rows. Further columns are not read. All vectors are indexed, and nothing is fitted.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>").alias("v")).where(F.col("id").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))
    shape = rows.groupBy(F.size("v").alias("width")).agg(F.countDistinct("id").alias("n")).orderBy(F.desc("n"), F.desc("width")).first()
    width, n = (shape["width"], shape["n"]) if shape else (1, 0)
    once = rows.where(F.size("v") == width).groupBy("id").agg(F.min("v").alias("v"))
    wanted = once.where(F.pmod("id", F.lit(every)) == 0)
    n_wanted, shard_rows = wanted.count(), max(1, min(SHARD_ROWS, SHARD_BYTES // (4 * width + 8)))
    blobs = lambda df, n, size, name: written(df.select(F.pmod(F.xxhash64("id"), F.lit(max(1, -(-n // size)))).alias("part"), "id", "v").repartition("part").sortWithinPartitions("part", "id").mapInArrow(_blobs(width, size), "part long, blob binary"), name)
    shards, queries = blobs(once, n, shard_rows, "shards"), blobs(wanted, n_wanted, QUERY_ROWS, "queries")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = None
        for b in batches:
            for is_query, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                rows = _rows(data.as_py(), width)
                if not is_query:  # comes before the queries that meet it
                    shard = Shard(*rows, projections)
                    continue
                found = [(i, j, d) for i, near in zip(rows[0].tolist(), shard.search_all(*rows, k), strict=True) for d, j in near]
                a, c, d = zip(*found, strict=True) if found else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(c, pa.int64()), pa.array(d, pa.float64())], ["vec_id", "neighbour_id", "distance"])

    # a shard goes to as many tasks as there are cores for, and each of them takes a share of the query blocks, one after the other
    spark = vectors.sparkSession
    blocks, cells = max(1, -(-n_wanted // QUERY_ROWS)), max(1, -(-n // shard_rows))
    splits = max(1, min(blocks, -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // cells)))
    each = lambda count: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long")))
    base = shards.select("part", each(splits).alias("split"), F.lit(False).alias("is_query"), "blob")
    asked = queries.select(each(cells).alias("to"), F.pmod("part", F.lit(splits)).alias("split"), F.lit(True).alias("is_query"), "blob").withColumnRenamed("to", "part")
    grid = base.unionByName(asked).repartitionByRange(min(cells * splits, 1 << 16), "part", "split").sortWithinPartitions("part", "split", "is_query").select("is_query", "blob")
    found = grid.mapInArrow(run, "vec_id long, neighbour_id long, distance double")
    place = F.row_number().over(Window.partitionBy("vec_id").orderBy("distance", "neighbour_id"))
    return found.withColumn("place", place).where(F.col("place") <= k)


def query(spark, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), every=EVERY)
