"""Best-fit packing of documents into training sequences, online and with bounded space.

A stream of documents, as token ids, meets a fixed number of open bins. A bitset has bit f set if an open bin has f tokens free; the
lowest set bit at or above a piece's length is the best fit. If no open bin takes the piece and all places are in use, the
fullest bin closes first. A bin that closes leaves the stream as a sequence.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import VOCABULARY, read_vocabulary
from .session import partitions, released
from .sstable import PATTERN

CAPACITY = 2048
OPEN_BINS = 64
#: Documents to a stream, on average. Each stream is packed by itself.
STREAM_DOCS = 8192
SCHEMA = "bin string, doc_ids array<long>, pieces array<int>, starts array<long>, lengths array<int>, tokens array<int>, n_tokens int"
#: Sequences in one Arrow batch.
BATCH_BINS = 256


class Packer:
    """One stream. closed lists the bins that can take no further piece."""

    def __init__(self, capacity: int = CAPACITY, open_bins: int = OPEN_BINS):
        self.capacity, self.open_bins = capacity, open_bins
        self.bits, self.by_free, self.used, self.bins = 0, {}, 0, 0
        self.closed: list[int] = []

    def _take(self, free: int) -> int:
        queue = self.by_free[free]
        at = queue.popleft()
        if not queue:
            self.bits ^= 1 << free
        return at

    def add(self, n: int) -> list[tuple[int, int, int, int]]:
        """The pieces of a document of n tokens, as (bin, offset in the bin, start in the document, tokens).

        A document that is longer than a bin fills whole bins, and its rest is packed as any other piece. Of bins with the same free space the one that came to it first is taken.
        """
        pieces, start = [], 0
        while n - start >= self.capacity:
            pieces.append((self.bins, 0, start, self.capacity))
            self.closed.append(self.bins)
            self.bins, start = self.bins + 1, start + self.capacity
        rest = n - start
        if rest:
            fit = self.bits >> rest
            if fit:
                free = rest + ((fit & -fit).bit_length() - 1)
                at = self._take(free)
            else:
                if self.used == self.open_bins:
                    self.closed.append(self._take((self.bits & -self.bits).bit_length() - 1))
                    self.used -= 1
                at, free = self.bins, self.capacity
                self.bins, self.used = self.bins + 1, self.used + 1
            pieces.append((at, self.capacity - free, start, rest))
            left = free - rest
            if left:
                self.by_free.setdefault(left, deque()).append(at)
                self.bits |= 1 << left
            else:
                self.used -= 1
                self.closed.append(at)
        return pieces


def pack(lengths: list[int], capacity: int = CAPACITY, open_bins: int = OPEN_BINS) -> list[list[tuple[int, int, int, int]]]:
    """For each length, its pieces as Packer.add() gives them."""
    packer = Packer(capacity, open_bins)
    return [packer.add(n) for n in lengths]


def _sequences(rows: Iterator[tuple[int, int | None, np.ndarray]], capacity: int, open_bins: int) -> Iterator[tuple]:
    """Rows of SCHEMA of (stream, doc_id, tokens) rows, which come stream by stream. Only open bins are held."""
    now, packer, held = None, None, {}

    def bin_row(stream: int, at: int) -> tuple:
        own = held.pop(at)
        ids, pieces, starts, parts = zip(*own, strict=True)
        tokens = np.concatenate(parts)
        return f"{stream}-{at}", ids, pieces, starts, [len(p) for p in parts], tokens, len(tokens)

    for stream, doc, tokens in rows:
        if stream != now:
            yield from [bin_row(now, at) for at in sorted(held)]
            now, packer, held = stream, Packer(capacity, open_bins), {}
        if not len(tokens):
            yield None, [doc], [0], [0], [0], tokens, 0
            continue
        for k, (at, _, start, n) in enumerate(packer.add(len(tokens))):
            held.setdefault(at, []).append((doc, k, start, tokens[start : start + n]))
        for at in packer.closed:
            yield bin_row(stream, at)
        packer.closed.clear()
    yield from [bin_row(now, at) for at in sorted(held)]


def best_fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, stream_docs: int = STREAM_DOCS) -> DataFrame:
    """One row for each sequence: bin, doc_ids, pieces, starts, lengths, tokens, n_tokens.

    tokens are the ids that op10 gives, piece after piece; doc_ids, pieces, starts and lengths say for each piece of which document it is, the how many-th of it, where
    it begins in the document's tokens and how many it has. Every token of every text is in exactly one sequence, and none has more than capacity.
    Documents go to streams by a hash of identifier and text, about stream_docs to each, and each stream is packed in the order of doc_id (nulls first), then tokens; token ids are shuffled, in two
    bytes each if the vocabulary allows. A document of no tokens (a null or empty text) has a row of its own, without a bin. Rows that repeat are packed each, and a null identifier stays
    null. An empty table gives no rows; further columns are not read.
    """
    spark = docs.sparkSession
    ranks = read_vocabulary(vocabulary)
    shared, width = spark.sparkContext.broadcast(ranks), np.dtype("<u2" if max(ranks.values(), default=0) < 1 << 16 else "<u4")
    streams = max(1, -(-docs.select(F.count(F.lit(1))).first()[0] // stream_docs))

    @F.arrow_udf("binary")
    def encoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        coder = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=shared.value, special_tokens={})
        for b in batches:
            yield pa.array([np.array(coder.encode_ordinary(t.as_py()), width).tobytes() if t.is_valid else b"" for t in b], pa.binary())

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[int, int | None, np.ndarray]]:
            for b in batches:
                for s, i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                    yield s, i, np.frombuffer(t.as_buffer(), width).astype(np.int32)

        def batch(own: list[tuple]) -> pa.RecordBatch:
            name, ids, pieces, starts, lengths, tokens, n = zip(*own, strict=True)
            flat = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *n]), pa.int32()), pa.array(np.concatenate(tokens), pa.int32()))
            lists = [pa.array(list(map(list, c)), pa.list_(kind)) for c, kind in ((ids, pa.int64()), (pieces, pa.int32()), (starts, pa.int64()), (lengths, pa.int32()))]
            return pa.RecordBatch.from_arrays([pa.array(name, pa.string()), *lists, flat, pa.array(n, pa.int32())], ["bin", "doc_ids", "pieces", "starts", "lengths", "tokens", "n_tokens"])

        own = []
        for row in _sequences(rows(), capacity, open_bins):
            own.append(row)
            if len(own) == BATCH_BINS:
                yield batch(own)
                own = []
        if own:
            yield batch(own)

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    n = partitions(texts, 256 << 20)
    coded = texts.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(streams)).alias("stream"), "doc_id", encoded("text").alias("tokens"))
    return coded.repartition(*([n] if n else []), "stream").sortWithinPartitions("stream", "doc_id", "tokens").mapInArrow(run, SCHEMA)


def query(spark, sf_dir: str) -> DataFrame:
    return best_fit(spark.read.parquet(f"{sf_dir}/documents.parquet"))
