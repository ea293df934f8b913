"""Byte-level BPE encoding and decoding with DuckDB recursive queries in each partition.

Pre-tokens of a partition are cut where no token of the vocabulary can lie across, and the distinct parts become rows (place, part, token), one a byte.
A recursive query joins neighbouring tokens with the merge table and contracts, in every part, the pair of the smallest rank, leftmost first, until no part
has a pair left. As a merge makes only pairs of larger ranks, all places of a part's best pair go in one step. The recursion is keyed by place, so that it
holds one row a byte and not those of past rounds. An ordered aggregation decodes.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Words, and parts of words, that a task remembers before it starts afresh.
CACHE_WORDS = 300_000
#: Bytes of the parts in one recursion, and tokens in one aggregation; a longer part forms a recursion of its own.
BATCH_BYTES, BATCH_TOKENS = 1 << 19, 1 << 18
#: Code points that are encoded together.
SLICE = 1 << 20

ENCODE = """
WITH RECURSIVE s(g, part, tok) USING KEY (g) AS (
  SELECT g, part, tok FROM bytes_of_parts
  UNION ALL
  (WITH p AS MATERIALIZED (
     SELECT g, part, tok, c, same FROM (
       SELECT g, part, tok, nxt = tok AS same, CASE WHEN np = part THEN tok::BIGINT * 4294967296 + nxt END AS ab FROM (
         SELECT g, part, tok, lead(tok) OVER (ORDER BY g) AS nxt, lead(part) OVER (ORDER BY g) AS np FROM s WHERE tok >= 0))
     LEFT JOIN merges USING (ab)),
   b AS (SELECT part, min(c) AS best FROM p WHERE c IS NOT NULL GROUP BY part)
   SELECT g, part, CASE WHEN hit THEN best WHEN gone THEN -1 ELSE tok END FROM (
     SELECT g, part, tok, best, hit, lag(hit, 1, false) OVER (ORDER BY g) AS gone FROM (
       SELECT g, part, tok, best,
              m AND (NOT same OR (rn - max(CASE WHEN m THEN 0 ELSE rn END) OVER (ORDER BY g ROWS UNBOUNDED PRECEDING)) % 2 = 1) AS hit FROM (
         SELECT p.*, best, c IS NOT DISTINCT FROM best AS m, row_number() OVER (ORDER BY g) AS rn FROM p JOIN b USING (part)))))
)
SELECT part, tok FROM s WHERE tok >= 0 ORDER BY g
"""
DECODE = "SELECT doc, string_agg(piece, '' ORDER BY place) AS content FROM tokens JOIN vocabulary USING (tok) GROUP BY doc"


def read_vocabulary(path: str = VOCABULARY) -> dict[bytes, int]:
    """Ranks of tokens, of a file with a token in base64 and its rank to a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge_table(ranks: dict[bytes, int]) -> np.ndarray:
    """(left, right, merged) of the pair that makes each token, the merged token being the pair's rank."""
    out = []
    for token, rank in ranks.items():
        parts = [bytes([x]) for x in token]
        while len(parts) > 2:
            best = min(((r, i) for i in range(len(parts) - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None and r < rank), default=None)
            if best is None:
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        if len(parts) == 2:
            out.append((ranks[parts[0]], ranks[parts[1]], rank))
    return np.array(out, np.int64).reshape(-1, 3)


def safe_cuts(raw: np.ndarray, first: np.ndarray, spans: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Whether each byte begins a part: bytes where a word begins (first), and those that no token joins with the byte before.

    A token over the edge between two bytes is these two, or holds three bytes in a row with the edge among them. What spans() doesn't have is in no token.
    """
    pairs, triples = spans
    r = raw.astype(np.int64)
    over = np.zeros(len(r), bool)
    over[1:] = pairs[r[:-1] * 256 + r[1:]]
    inside = np.zeros(len(r), bool)
    inside[:-2] = triples[r[:-2] * 65536 + r[1:-1] * 256 + r[2:]] & ~first[1:-1] & ~first[2:]
    over[1:] |= inside[:-1]
    over[2:] |= inside[:-2]
    return first | ~over


def spans(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of bytes that are a token, and three bytes in a row that some token holds."""
    pairs, triples = np.zeros(1 << 16, bool), np.zeros(1 << 24, bool)
    for token in ranks:
        a = np.frombuffer(token, np.uint8).astype(np.int64)
        if len(a) == 2:
            pairs[a[0] * 256 + a[1]] = True
        elif len(a) > 2:
            triples[a[:-2] * 65536 + a[1:-1] * 256 + a[2:]] = True
    return pairs, triples


class Store:
    """Token lists by key, in one flat array."""

    def __init__(self) -> None:
        self.at: dict = {}
        self.first, self.count, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def add(self, keys: list, tokens: np.ndarray, count: np.ndarray) -> None:
        self.at.update(zip(keys, range(len(self.at), len(self.at) + len(keys)), strict=True))
        self.first = np.concatenate([self.first, len(self.flat) + np.cumsum(count) - count])
        self.count, self.flat = np.concatenate([self.count, count]), np.concatenate([self.flat, tokens])

    def take(self, keys: list) -> tuple[np.ndarray, np.ndarray]:
        """(tokens of all keys, count of each)."""
        own = np.fromiter(map(self.at.__getitem__, keys), np.int64, len(keys))
        n = self.count[own]
        before = np.cumsum(n) - n
        return self.flat[np.repeat(self.first[own] - before, n) + np.arange(n.sum())], n


class Coder:
    """Encoder and decoder of one task. ranks: token to rank; merges as of merge_table()."""

    def __init__(self, ranks: dict[bytes, int], merges: np.ndarray):
        self.byte = np.full(256, -1, np.int64)
        for i in range(256):
            self.byte[i] = ranks.get(bytes([i]), -1)
        if (self.byte < 0).any():
            raise ValueError("the vocabulary lacks a token for some byte")
        self.spans = spans(ranks)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "800MB", "temp_directory": ""})
        table = pa.table({"ab": merges[:, 0] * 4294967296 + merges[:, 1], "c": merges[:, 2].astype(np.int32)})
        self.db.register("m", table)
        self.db.execute("CREATE TABLE merges AS SELECT * FROM m")
        self.db.unregister("m")
        self.db.register("v", pa.table({"tok": pa.array(list(ranks.values()), pa.int64()), "piece": [b.decode("latin-1") for b in ranks]}))
        self.db.execute("CREATE TABLE vocabulary AS SELECT * FROM v")
        self.db.unregister("v")
        self.forget()

    def forget(self) -> None:
        self.known, self.parts = Store(), Store()

    def _merged(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(tokens of all parts, count of each), by the recursive query, in batches of bytes."""
        size = np.fromiter(map(len, parts), np.int64, len(parts))
        batch = (np.cumsum(size) - size) // BATCH_BYTES
        tokens, count = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        edges = np.flatnonzero(np.diff(batch, prepend=-1, append=-1))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            raw = np.frombuffer(b"".join(parts[a:b]), np.uint8)
            self.db.register("bytes_of_parts", pa.table({"g": np.arange(len(raw), dtype=np.int32), "part": np.repeat(np.arange(b - a, dtype=np.int32), size[a:b]), "tok": self.byte[raw].astype(np.int32)}))
            found = self.db.execute(ENCODE).fetchnumpy()
            self.db.unregister("bytes_of_parts")
            tokens.append(found["tok"].astype(np.int32))
            count.append(np.bincount(found["part"], minlength=b - a))
        return np.concatenate(tokens), np.concatenate(count)

    def words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(tokens of all words, count of each); no word is empty."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        raw = b"".join(words)
        first = np.zeros(len(raw), bool)
        first[np.cumsum(size) - size] = True
        starts = np.flatnonzero(safe_cuts(np.frombuffer(raw, np.uint8), first, self.spans))
        cut = starts.tolist()
        parts = [raw[a:b] for a, b in zip(cut, [*cut[1:], len(raw)], strict=True)]
        new = [p for p in dict.fromkeys(parts) if p not in self.parts.at]
        self.parts.add(new, *self._merged(new))
        tokens, count = self.parts.take(parts)
        return tokens, np.add.reduceat(count, np.searchsorted(starts, np.flatnonzero(first))) if len(words) else count

    def encode(self, texts: pa.Array) -> Iterator[pa.Array]:
        """Lists of tokens, in several arrays; a null has null. Words are told apart by all their signs."""
        valid = texts.is_valid().to_numpy(zero_copy_only=False)
        for i, j, cp, offsets in T.slices(texts, SLICE):
            cuts = T.pretokens(cp, offsets) if len(cp) else np.zeros(1, np.int64)
            whole, at = cp.tobytes().decode("utf-32-le", "surrogatepass"), cuts.tolist()
            words = [whole[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
            if len(self.known.at) > CACHE_WORDS or len(self.parts.at) > CACHE_WORDS:
                self.forget()
            new = [w for w in dict.fromkeys(words) if w not in self.known.at]
            self.known.add(new, *self.words([w.encode("utf-8", "surrogatepass") for w in new]))
            flat, n = self.known.take(words)
            bounds = np.concatenate([[0], np.cumsum(n)])[np.searchsorted(cuts[:-1], offsets)]
            yield pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat, pa.int32()), mask=pa.array(~valid[i:j]))

    def decode(self, lists: pa.ListArray) -> list[bytes | None]:
        """Bytes of each list; a null has null."""
        size = np.fromiter((len(x) if x is not None else 0 for x in lists.to_pylist()), np.int64, len(lists)) if lists.null_count else np.diff(lists.offsets.to_numpy())
        flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        doc = np.repeat(np.arange(len(lists)), size)
        out: list[bytes | None] = [None if not v else b"" for v in lists.is_valid().to_pylist()]
        pieces: dict[int, list[bytes]] = {}
        for a in range(0, len(flat), BATCH_TOKENS):
            own = flat[a : a + BATCH_TOKENS]
            self.db.register("tokens", pa.table({"doc": doc[a : a + BATCH_TOKENS], "place": np.arange(len(own)), "tok": own}))
            for k, s in self.db.execute(DECODE).fetchall():
                pieces.setdefault(k, []).append(s.encode("latin-1"))
            self.db.unregister("tokens")
        for k, own in pieces.items():
            out[k] = b"".join(own)
        return out


def _shared(df: DataFrame, vocabulary: str):
    ranks = read_vocabulary(vocabulary)
    return df.sparkSession.sparkContext.broadcast((ranks, merge_table(ranks)))


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, tokens, n_tokens, exact) for each row: the token ids of the whole text, and whether decoding them gives it back.

    A null text has null tokens, n_tokens 0 and exact true; an empty text has an empty list. Each row is encoded by itself, so that rows that repeat and null
    identifiers stay as they are. Of pairs with the same rank the leftmost goes first. An empty table gives no rows; further columns are not read. The vocabulary, of
    a fixed size, is sent to the executors. A task holds the tokens of some million signs, or of one longer text, and about 100 bytes for each byte of the longest run that
    has no place where no token can lie across.
    """
    shared = _shared(docs, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(*shared.value)
        for b in batches:
            for i in range(0, b.num_rows, 4096):
                part = b.slice(i, 4096)
                at = 0
                for lists in coder.encode(part.column(1)):
                    own = part.slice(at, len(lists))
                    at += len(lists)
                    back = coder.decode(lists)
                    exact = [x is None and y is None or (y is not None and x == y.encode("utf-8", "surrogatepass")) for x, y in zip(back, own.column(1).to_pylist(), strict=True)]
                    n = pa.array(np.diff(lists.offsets.to_numpy()), pa.int32()) if not lists.null_count else pa.array([len(x or []) for x in lists.to_pylist()], pa.int32())
                    yield pa.RecordBatch.from_arrays([own.column(0), lists, n, pa.array(exact, pa.bool_())], ["doc_id", "tokens", "n_tokens", "exact"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, tokens array<int>, n_tokens int, exact boolean")


def decode(encoded: DataFrame, id_col: str = "doc_id", tokens_col: str = "tokens", vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) for each row of token ids. A null list gives a null text, bytes that aren't UTF-8 the replacement character; ids outside the vocabulary stand for nothing."""
    shared = _shared(encoded, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(*shared.value)
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                texts = [x.decode("utf-8", "replace") if x is not None else None for x in coder.decode(part.column(1))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(tokens_col).cast("array<int>").alias("tokens")).mapInArrow(run, "doc_id long, text string")


def query(spark, sf_dir: str) -> DataFrame:
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"))
