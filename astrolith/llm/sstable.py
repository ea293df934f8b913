"""Token-ID output as sorted-string-table shards.

A shard holds documents by identifier: blocks of prefix-compressed keys with restart points, a sparse index of the blocks' last
keys, a Bloom filter and a footer. A lookup reads the footer, asks the filter, finds the block by binary search in the index and
the key by binary search over the block's restarts.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator
from contextlib import nullcontext

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .bpe import VOCABULARY, read_vocabulary
from .session import partitions

BLOCK_BYTES = 1 << 15
SHARD_BYTES = 8 << 20
RESTART = 16
MAGIC = b"ASLTSST1"
FOOTER = struct.Struct("<QQQQQqqQ8s")
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SCHEMA = "min_id long, max_id long, n_docs long, n_tokens long, n_blocks int, image binary"
_BLOOM_BITS, _BLOOM_HASHES = 10, 7


def key_of(i: int) -> bytes:
    """8 bytes that sort as the identifiers do."""
    return struct.pack(">Q", (i + (1 << 63)) & 0xFFFFFFFFFFFFFFFF)


def id_of(key: bytes) -> int:
    return struct.unpack(">Q", key)[0] - (1 << 63)


def value_of(tokens: list[int] | None) -> bytes:
    """Width in bytes of a token (0: no text), then the tokens, little-endian."""
    if tokens is None:
        return b"\0"
    a = np.array(tokens, np.uint32)
    return b"\2" + a.astype("<u2").tobytes() if not len(a) or a.max() < 1 << 16 else b"\4" + a.astype("<u4").tobytes()


def tokens_of(value: bytes) -> list[int] | None:
    return None if value[0] == 0 else np.frombuffer(value, "<u2" if value[0] == 2 else "<u4", offset=1).tolist()


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(b: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        x = b[at]
        at += 1
        n |= (x & 127) << shift
        if x < 128:
            return n, at
        shift += 7


def _places(ids: np.ndarray, bits: int) -> np.ndarray:
    h = T.mix(ids.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    step = T.mix(h) | np.uint64(1)
    return np.stack([(h + np.uint64(k) * step) % np.uint64(bits) for k in range(_BLOOM_HASHES)])


class Writer:
    """One shard. Entries come sorted by identifier; repeated identifiers are kept."""

    def __init__(self) -> None:
        self.out, self.index, self.ids, self.n_tokens = bytearray(), [], [], 0
        self._start()

    def _start(self) -> None:
        self.block, self.restarts, self.entries, self.last = bytearray(), [], 0, b""

    def add(self, i: int, tokens: list[int] | None) -> None:
        key, value = key_of(i), value_of(tokens)
        shared = 0
        if self.entries % RESTART == 0:
            self.restarts.append(len(self.block))
        else:
            while shared < 8 and self.last[shared] == key[shared]:
                shared += 1
        self.block += _varint(shared) + _varint(8 - shared) + _varint(len(value)) + key[shared:] + value
        self.last, self.entries = key, self.entries + 1
        self.ids.append(i)
        self.n_tokens += len(tokens or ())
        if len(self.block) >= BLOCK_BYTES:
            self._finish()

    def _finish(self) -> None:
        if not self.entries:
            return
        raw = bytes(self.block) + struct.pack(f"<{len(self.restarts)}I", *self.restarts) + struct.pack("<I", len(self.restarts))
        packed = pa.compress(raw, codec="zstd", asbytes=True)
        self.index.append((self.last, len(self.out), len(packed) + 8))
        self.out += struct.pack("<II", len(raw), zlib.crc32(raw)) + packed
        self._start()

    def size(self) -> int:
        return len(self.out) + len(self.block)

    def close(self) -> bytes:
        self._finish()
        index_at = len(self.out)
        for last, at, size in self.index:
            self.out += last + struct.pack("<QI", at, size)
        filter_at = len(self.out)
        ids = np.array(self.ids, np.int64)
        bits = max(64, -(-len(ids) * _BLOOM_BITS // 8) * 8)
        field = np.zeros(bits, bool)
        if len(ids):
            field[_places(ids, bits).ravel()] = True
        self.out += np.packbits(field, bitorder="little").tobytes()
        self.out += FOOTER.pack(index_at, len(self.index), filter_at, bits, len(ids), int(ids[0]) if len(ids) else 0, int(ids[-1]) if len(ids) else -1, self.n_tokens, MAGIC)
        return bytes(self.out)


class Reader:
    """Lookups and scans of one shard, given as its bytes or as an open file of which only footer, filter bits, index entries and blocks asked for are read."""

    def __init__(self, image: bytes | pa.NativeFile):
        if isinstance(image, bytes):
            size, self._read = len(image), lambda at, n: image[at : at + n]
        else:
            size, self._read = image.size(), lambda at, n: image.read_at(n, at)
        footer = self._read(max(0, size - FOOTER.size), FOOTER.size)
        if len(footer) < FOOTER.size or not footer.endswith(MAGIC):
            raise ValueError("not a shard: its footer has no magic number")
        self.index_at, self.blocks, self.filter_at, self.bits, self.n_docs, self.min_id, self.max_id, self.n_tokens, _ = FOOTER.unpack(footer)

    def may_hold(self, i: int) -> bool:
        if not self.n_docs or not self.min_id <= i <= self.max_id:
            return False
        return all(self._read(self.filter_at + at // 8, 1)[0] >> at % 8 & 1 for at in _places(np.array([i]), self.bits).ravel().tolist())

    def _entry(self, k: int) -> tuple[bytes, int, int]:
        own = self._read(self.index_at + 20 * k, 20)
        return (own[:8], *struct.unpack("<QI", own[8:]))

    def _block(self, k: int) -> tuple[bytes, list[int], int]:
        _, at, size = self._entry(k)
        own = self._read(at, size)
        n, crc = struct.unpack("<II", own[:8])
        raw = pa.decompress(own[8:], decompressed_size=n, codec="zstd", asbytes=True)
        if zlib.crc32(raw) != crc:
            raise ValueError(f"block {k} is damaged")
        count = struct.unpack("<I", raw[-4:])[0]
        end = len(raw) - 4 - 4 * count
        return raw, list(struct.unpack(f"<{count}I", raw[end:-4])), end

    @staticmethod
    def _scan(raw: bytes, at: int, end: int) -> Iterator[tuple[bytes, bytes]]:
        key = b""
        while at < end:
            shared, at = _read_varint(raw, at)
            rest, at = _read_varint(raw, at)
            size, at = _read_varint(raw, at)
            key = key[:shared] + raw[at : at + rest]
            at += rest
            yield key, raw[at : at + size]
            at += size

    def get(self, i: int) -> list[list[int] | None]:
        """Token lists of all entries with identifier i."""
        if not self.may_hold(i):
            return []
        key, out = key_of(i), []
        lo, hi = 0, self.blocks
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (mid + 1, hi) if self._entry(mid)[0] < key else (lo, mid)
        while lo < self.blocks:
            raw, restarts, end = self._block(lo)
            a, b = 0, len(restarts)  # the last restart whose key is smaller
            while b - a > 1:
                mid = (a + b) // 2
                a, b = (mid, b) if next(self._scan(raw, restarts[mid], end))[0] < key else (a, mid)
            for k, value in self._scan(raw, restarts[a], end):
                if k == key:
                    out.append(tokens_of(value))
                elif k > key:
                    return out
            lo += 1
        return out

    def items(self) -> Iterator[tuple[int, list[int] | None]]:
        for k in range(self.blocks):
            raw, _, end = self._block(k)
            for key, value in self._scan(raw, 0, end):
                yield id_of(key), tokens_of(value)


def write_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row for each shard: min_id, max_id, n_docs, n_tokens, n_blocks, and image, the shard's bytes.

    Shards are in the order of identifiers and don't overlap, except for an identifier of several rows, all of which are stored. A null text is stored as null and an empty one as no
    tokens. A null identifier can't be looked up and isn't stored. An empty table gives no shards; further columns are not read. A shard
    closes at shard_bytes or at the end of its partition; one very long document makes a larger one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=shared.value, special_tokens={})
        w = Writer()

        def row() -> pa.RecordBatch:
            n = len(w.ids)
            low, high = w.ids[0], w.ids[-1]
            image = w.close()
            return pa.RecordBatch.from_arrays([pa.array([low]), pa.array([high]), pa.array([n]), pa.array([w.n_tokens]), pa.array([len(w.index)], pa.int32()), pa.array([image], pa.binary())], ["min_id", "max_id", "n_docs", "n_tokens", "n_blocks", "image"])

        for b in batches:
            for i, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                text = text.as_py()
                w.add(i, None if text is None else coder.encode_ordinary(text))
                if w.size() >= shard_bytes:
                    yield row()
                    w = Writer()
        if w.ids:
            yield row()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id IS NOT NULL")
    n = partitions(rows)
    return rows.repartitionByRange(*([n] if n else []), "doc_id").sortWithinPartitions("doc_id").mapInArrow(run, SCHEMA)


def save_shards(shards: DataFrame, folder: str) -> DataFrame:
    """Writes each shard as a file of its own into folder, a URI that all executors reach, and their list as the table folder/_list, which it returns: min_id, max_id, n_docs,
    n_tokens, file.

    A file's name follows from its content, and it is renamed into place once it is whole, so that a task that runs again leaves the same file. The list is written last. An empty
    table gives an empty list.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _filesystem(folder)
        for b in batches:
            names = []
            for image in b.column(4):
                raw = image.as_py()
                name = f"{hashlib.sha256(raw).hexdigest()[:32]}.sst"
                half = f"{root}/_{name}-{uuid.uuid4().hex}"
                with fs.open_output_stream(half) as f:
                    f.write(raw)
                fs.move(half, f"{root}/{name}")
                names.append(name)
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(names, pa.string())], ["min_id", "max_id", "n_docs", "n_tokens", "file"])

    fs, root = _filesystem(folder)
    fs.create_dir(root, recursive=True)
    listed = shards.select("min_id", "max_id", "n_docs", "n_tokens", "image").mapInArrow(run, "min_id long, max_id long, n_docs long, n_tokens long, file string")
    listed.write.mode("overwrite").parquet(f"{folder}/_list")
    return shards.sparkSession.read.schema(listed.schema).parquet(f"{folder}/_list")


def _filesystem(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder if "://" in folder else folder if folder.startswith("file:") else f"file://{folder}")


def read_shards(shards: DataFrame) -> DataFrame:
    """(doc_id, tokens) of every entry. A null text has null tokens, an empty one none; identifiers that repeat have a row for each entry. No shards give no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for image in b.column(0):
                ids, lists = zip(*Reader(image.as_py()).items(), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(lists, pa.list_(pa.int32()))], ["doc_id", "tokens"])

    return shards.select("image").mapInArrow(run, "doc_id long, tokens array<int>")


def lookup(shards: DataFrame, ids: DataFrame, id_col: str = "doc_id", folder: str | None = None) -> DataFrame:
    """(doc_id, tokens) of the wanted identifiers, of write_shards() rows or, with folder, of the files that save_shards() listed there.

    Only shards whose range holds a wanted identifier are opened, and of files only the blocks that may hold it are read. Identifiers that aren't stored, and null ones, have no row; one that
    is wanted twice is found once, and one that is stored several times has a row for each entry. An identifier is compared with the sorted bounds of the shards, which are sent to the
    executors: 24 bytes for each shard of 8 MB.
    """
    at = "image" if folder is None else "file"
    wanted = ids.select(F.col(id_col).cast("long").alias("doc_id")).where("doc_id IS NOT NULL").distinct()
    bounds = shards.select("min_id", "max_id").distinct().orderBy("min_id", "max_id").toArrow()
    low, high = bounds.column(0).to_numpy(), bounds.column(1).to_numpy()
    shared = shards.sparkSession.sparkContext.broadcast((low, high))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = shared.value
        for b in batches:
            own = b.column(0).to_numpy()
            # bounds only touch at identifiers of several rows: those that hold one are neighbours in the order
            a, z = np.searchsorted(high, own), np.searchsorted(low, own, "right")
            n = np.maximum(z - a, 0)
            to = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())
            yield pa.RecordBatch.from_arrays([pa.array(low[to]), pa.array(high[to]), pa.array(np.repeat(own, n))], ["min_id", "max_id", "doc_id"])

    asked = wanted.mapInArrow(route, "min_id long, max_id long, doc_id long").groupBy("min_id", "max_id").agg(F.collect_list("doc_id").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _filesystem(folder) if folder else (None, None)
        for b in batches:
            for source, own in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with fs.open_input_file(f"{root}/{source}") if folder else nullcontext(source) as opened:
                    r = Reader(opened)
                    rows = [(i, t) for i in sorted(own) for t in r.get(i)]
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int64()), pa.array([t for _, t in rows], pa.list_(pa.int32()))], ["doc_id", "tokens"])

    return shards.join(asked, ["min_id", "max_id"]).select(at, "ids").mapInArrow(run, "doc_id long, tokens array<int>")


def query(spark, sf_dir: str) -> DataFrame:
    return write_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))
