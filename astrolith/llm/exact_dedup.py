"""Exact dedup with a log-structured merge index of digests.

Rows (digest, doc_id) are partitioned by digest; in each partition a memtable takes them up, flushes sorted
runs with a Bloom filter each, and compaction merges the runs, keeping the smallest identifier of a digest.
Digests that occur again are hits. Hits, and only they, are then compared byte by byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import may_be_in, partitions, without, written

MEMTABLE_ROWS = 1 << 16
#: Runs of a level that compaction merges into one of the next level.
MAX_RUNS = 8
_K = np.dtype([("hi", "<u8"), ("lo", "<u8")])


class Run:
    """Sorted digests, their smallest identifiers, and a Bloom filter."""

    def __init__(self, keys: np.ndarray, ids: np.ndarray):
        self.keys, self.ids = keys, ids
        self.mask = np.uint64((1 << max(6, (10 * len(keys)).bit_length())) - 1)
        self.bits = np.zeros((int(self.mask) + 1) // 8, np.uint8)
        for at in self._places(keys):
            np.bitwise_or.at(self.bits, at >> np.uint64(3), np.left_shift(np.uint8(1), (at & np.uint64(7)).astype(np.uint8)))

    def _places(self, keys: np.ndarray) -> Iterator[np.ndarray]:
        for i in range(4):
            yield (keys["hi"] + np.uint64(i) * (keys["lo"] | np.uint64(1))) & self.mask

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key in this run, or -1: filter first, then binary search."""
        may = np.ones(len(keys), bool)
        for at in self._places(keys):
            may &= (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
        out = np.full(len(keys), -1, np.int64)
        asked = np.flatnonzero(may)
        if len(asked):
            at = np.minimum(np.searchsorted(self.keys, keys[asked]), len(self.keys) - 1)
            same = self.keys[at] == keys[asked]
            out[asked[same]] = at[same]
        return out


def _smallest(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, keys["lo"], keys["hi"]))
    keys, ids = keys[order], ids[order]
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    return keys[first], ids[first]


def merge(runs: list[Run]) -> Run:
    """Compaction: one run with the smallest identifier of each digest."""
    return Run(*_smallest(np.concatenate([r.keys for r in runs]), np.concatenate([r.ids for r in runs])))


class Index:
    """Memtable and sorted runs. Every member of a digest with two or more identifiers becomes a hit."""

    def __init__(self, memtable_rows: int = MEMTABLE_ROWS, max_runs: int = MAX_RUNS):
        self.limit, self.max_runs = memtable_rows, max_runs
        self.table: dict[tuple[int, int], int] = {}
        self.levels: list[list[Run]] = [[]]
        self.hits: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, keys: np.ndarray, ids: np.ndarray) -> None:
        for i in range(0, len(keys), self.limit):
            self._add(keys[i : i + self.limit], ids[i : i + self.limit])

    def _add(self, keys: np.ndarray, ids: np.ndarray) -> None:
        for run in (r for level in self.levels for r in level):
            at = run.find(keys)
            hit = at >= 0
            hit[hit] = run.ids[at[hit]] != ids[hit]
            if hit.any():
                self.hits.append((keys[hit], ids[hit]))
                self.hits.append((keys[hit], run.ids[at[hit]]))
        table, again = self.table, []
        for k, i in zip(keys.tolist(), ids.tolist(), strict=True):
            old = table.setdefault(k, i)
            if old != i:
                again += [(*k, i), (*k, old)]
                if i < old:
                    table[k] = i
        if again:
            a = np.array(again, np.dtype([("hi", "<u8"), ("lo", "<u8"), ("id", "<i8")]))
            k = np.empty(len(a), _K)
            k["hi"], k["lo"] = a["hi"], a["lo"]
            self.hits.append((k, a["id"]))
        if len(table) >= self.limit:
            self.flush()

    def flush(self) -> None:
        if self.table:
            self.levels[0].append(Run(*_smallest(np.array(list(self.table), _K), np.fromiter(self.table.values(), np.int64, len(self.table)))))
            self.table = {}
        level = 0
        while len(self.levels[level]) >= self.max_runs:
            if level + 1 == len(self.levels):
                self.levels.append([])
            self.levels[level + 1].append(merge(self.levels[level]))
            self.levels[level] = []
            level += 1

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        """(digests, identifiers) of the hits since the last call, each pair once."""
        if not self.hits:
            return np.zeros(0, _K), np.zeros(0, np.int64)
        keys, ids = np.concatenate([k for k, _ in self.hits]), np.concatenate([i for _, i in self.hits])
        self.hits = []
        order = np.lexsort((ids, keys["lo"], keys["hi"]))
        keys, ids = keys[order], ids[order]
        once = np.ones(len(keys), bool)
        once[1:] = (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1])
        return keys[once], ids[once]

    def close(self) -> tuple[np.ndarray, np.ndarray]:
        """(digests, identifiers) of the hits that are left."""
        self.flush()
        return self.take()


def _keys(digests: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(digests.to_pylist()), _K)


def _hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    index = Index()

    def rows(keys: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
        raw = keys.tobytes()
        return pa.RecordBatch.from_arrays([pa.array([raw[i : i + 16] for i in range(0, len(raw), 16)], pa.binary()), pa.array(ids, pa.int64())], ["digest", "doc_id"])

    for b in batches:
        if b.num_rows:
            index.add(_keys(b.column(0)), b.column(1).to_numpy(zero_copy_only=False))
            yield rows(*index.take())
    yield rows(*index.close())


def digest(text: str) -> F.Column:
    """The first 16 bytes of SHA-256 of a text column."""
    return F.substring(F.unhex(F.sha2(F.col(text), 256)), 1, 16)


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, kept_id) for each document whose text equals, byte for byte, that of a smaller identifier.

    kept_id is the smallest identifier with that text. Null texts and null identifiers are in no group; empty texts
    are equal to each other; rows that repeat one identifier with one text are one document. One identifier with
    several texts takes part with each. An empty table gives no rows; further columns are not read.
    """
    return _listed(docs, id_col, text_col).select("doc_id", "kept_id")


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs without those that exact_duplicates() lists, in the columns of docs.

    A row goes only if both its identifier and its text are listed, so that an identifier that is used for several texts
    keeps the other ones, and of rows that repeat the smallest identifier all stay. Null identifiers and null texts stay; an empty table stays empty.
    """
    gone = _listed(docs, id_col, text_col).select("doc_id", "digest")
    return without(docs, written(gone, "gone"), {"doc_id": F.col(id_col).cast("long"), "digest": digest(text_col)})


def _listed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(digest, doc_id, kept_id) of duplicates.

    Hits are verified by their bytes: the least and the largest text of a digest are equal if all are. Only texts whose identifier is among the hits
    are shuffled for that, and in partial aggregates where copies lie together. Groups hold no lists, so that one of any
    size fits; a digest of several texts, if there ever is one, is split by text.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    n = partitions(rows, 256 << 20)
    keyed = rows.withColumn("digest", digest("text"))
    hits = written(keyed.select("digest", "doc_id").repartition(*([n] if n else []), "digest").mapInArrow(_hits, "digest binary, doc_id long"), "hits")
    members = rows.where(may_be_in(F.col("doc_id"), hits.select("doc_id"))).withColumn("digest", digest("text")).join(hits.hint("shuffle_hash"), ["digest", "doc_id"], "left_semi")
    groups = written(members.groupBy("digest").agg(F.min("doc_id").alias("kept_id"), (F.min("text") == F.max("text")).alias("same")), "groups")
    found = hits.join(groups.where("same"), "digest").select("digest", "doc_id", "kept_id")
    mixed = groups.where("NOT same").select("digest")
    if not mixed.isEmpty():
        texts = members.join(mixed, "digest", "left_semi").distinct()
        found = found.union(texts.join(texts.groupBy("digest", "text").agg(F.min("doc_id").alias("kept_id")), ["digest", "text"]).select("digest", "doc_id", "kept_id"))
    return found.where("doc_id <> kept_id").distinct()


ORACLE = """
SELECT doc_id, kept_id FROM (
  SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS kept_id FROM documents
  WHERE doc_id IS NOT NULL AND text IS NOT NULL)
WHERE doc_id <> kept_id
"""


def query(spark, sf_dir: str) -> DataFrame:
    return exact_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
