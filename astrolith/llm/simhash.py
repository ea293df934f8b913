"""SimHash near-dedup: every pair of 128-bit fingerprints of word pairs within the radius.

The fingerprints are cut into shards, each pair of which is a task's. In a task they are sorted by a covering family of masks: whichever bits two fingerprints within
the radius differ in, some mask has none of them, so that they meet under it and no link is lost; see covering(). Rows that meet are compared by the bits set in their
difference, all rows with the row s places on at once.

Only callers that name a recall get tables keyed by sampled bits instead, which lose links: the number of bits follows the number of fingerprints, and the number of tables the
bits. There bits are stored as 128 vertical planes. The planes shifted by s give the differences of all rows to the row s places on; carry-save counters add them up, and words of 64 rows
are abandoned once all of them are beyond the radius. With a covering family's many small buckets these are slower than counting bits row by row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .components import components
from .session import released, without, written

BITS = 128
RADIUS = 26
#: Fingerprints of a shard, and in how many tasks the masks of few shards are split.
SHARD, SPLIT = 1 << 18, 16
#: With sampled tables, the least chance that two fingerprints at the radius meet in some table, unless the caller names one.
RECALL = 0.93
#: Fingerprints of a bucket, on average, and from where a bucket is cut into blocks that meet in pairs, a task each.
BUCKET, BLOCK = 256, 1 << 14
_U = np.uint64
_FOUND = "a_hi long, a_lo long, b_hi long, b_lo long, n long"


def fingerprints(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """((n, 16) bytes of fingerprints, words of each text). Features are pairs of neighbouring words in lower case, and the
    first and last word with the text's edge; each counts as often as it occurs. A text of one word has a hash of it."""
    out, n_words = np.zeros((len(texts), BITS // 8), np.uint8), np.zeros(len(texts), np.int64)
    for i, j, cp, offsets in T.slices(texts):
        low = T.lowered()[cp]
        starts, ends, at = T.words(low, offsets)
        h = T.hashes(low, starts, ends)
        n_words[i:j] = at[1:] - at[:-1]
        for k in range(j - i):
            own = h[at[k] : at[k + 1]]
            if not len(own):
                continue
            pair = np.concatenate([own, [_U(1)]]) * _U(0x9E3779B97F4A7C15) + np.concatenate([[_U(2)], own])
            bits = np.unpackbits(np.stack([T.mix(pair), T.mix(pair ^ _U(0xA0761D6478BD642F))], 1).view(np.uint8), axis=1)
            if len(own) == 1:  # of two features a bit is set only if both have it, which makes all such texts alike
                out[i + k] = np.packbits(bits[0])
                continue
            count = np.zeros(BITS, np.int64)
            for c in range(0, len(bits), 255):
                count += bits[c : c + 255].sum(0, dtype=np.uint8)
            out[i + k] = np.packbits(2 * count > len(bits))
    return out, n_words


@released
def _fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        f, n = fingerprints(b.column(1))
        halves = f.view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(np.ascontiguousarray(halves[:, 0])), pa.array(np.ascontiguousarray(halves[:, 1])), pa.array(n, pa.int64())], ["doc_id", "text_hash", "hi", "lo", "n_words"])


def shape(n: int, radius: int = RADIUS, recall: float = RECALL, bucket: int = BUCKET) -> tuple[int, int]:
    """(bits of a key, tables) for n fingerprints: buckets of about bucket rows, and tables enough for recall at the radius."""
    key_bits = max(4, min(40, round(math.log2(max(n, 1) / bucket)))) if n > bucket else 4
    meet = (1 - radius / BITS) ** key_bits
    return key_bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - meet))) if meet < 1 else 1


def samples(tables: int, key_bits: int, seed: int = 7) -> np.ndarray:
    """(tables, 2) masks of the bits of each table's key, of the two halves of a fingerprint."""
    r = np.random.default_rng(seed)
    bits = np.zeros((tables, BITS), np.uint8)
    for t in range(tables):
        bits[t, r.choice(BITS, key_bits, replace=False)] = 1
    return np.packbits(bits, axis=1).view(np.int64)


def keyed(prints: DataFrame, masks: np.ndarray) -> DataFrame:
    """(key, hi, lo) of each of prints(hi, lo) in each table: the table in the upper 16 bits, a hash of the sampled bits in the others."""
    tables = F.array(*[F.struct(F.lit(t).cast("long").alias("t"), F.lit(int(a)).cast("long").alias("a"), F.lit(int(b)).cast("long").alias("b")) for t, (a, b) in enumerate(masks)])
    own = F.xxhash64(F.col("hi").bitwiseAND(F.col("m.a")), F.col("lo").bitwiseAND(F.col("m.b"))).bitwiseAND(F.lit((1 << 47) - 1))
    return prints.select("hi", "lo", F.explode(tables).alias("m")).select((F.shiftleft("m.t", 47) + own).alias("key"), "hi", "lo")


def planes(fp: np.ndarray) -> np.ndarray:
    """(BITS, words) bit planes of fingerprints, 64 rows to a word."""
    n = len(fp)
    pad = np.zeros((-n % 64 + 64, fp.shape[1]), np.uint8)
    bits = np.unpackbits(np.concatenate([fp, pad]), axis=1)
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)


def within(p: np.ndarray, shift: int, lanes: int, radius: int) -> np.ndarray:
    """Rows i < lanes whose distance to row i + shift is at most radius; p as of planes().

    Counters hold radius + 1 less, from above: they start so that the top counter bit is set once a row is beyond the radius.
    """
    levels = (radius + 1).bit_length()
    start = (1 << levels) - radius - 1
    words = -(-lanes // 64)
    live = np.arange(words)
    down, up = _U(shift % 64), _U(64 - shift % 64)
    step = shift // 64
    counter = [np.full(words, _U(0xFFFFFFFFFFFFFFFF) if start >> k & 1 else _U(0)) for k in range(levels)]
    over = np.zeros(words, np.uint64)
    last = p.shape[1] - 1
    for at in range(0, len(p), 8):
        # carry-save: three planes of one weight become a sum and a carry; the carries go up a level
        a = p[at : at + 8][:, live]
        b = p[at : at + 8][:, np.minimum(live + step, last)]
        if shift % 64:
            b = (b >> down) | (p[at : at + 8][:, np.minimum(live + step + 1, last)] << up)
        d = a ^ b
        ones, twos, fours = [d[i] for i in range(8)], [], []

        def add(x, y, z):
            u = x ^ y
            return u ^ z, (x & y) | (u & z)

        for x, y, z in ((0, 1, 2), (3, 4, 5)):
            s, c = add(ones[x], ones[y], ones[z])
            ones.append(s)
            twos.append(c)
        s, c = add(ones[8], ones[9], ones[6])
        twos.append(c)
        one, c = s ^ ones[7], s & ones[7]
        twos.append(c)
        s, c = add(twos[0], twos[1], twos[2])
        fours.append(c)
        two, c = s ^ twos[3], s & twos[3]
        fours.append(c)
        four, eight = fours[0] ^ fours[1], fours[0] & fours[1]
        carry = np.zeros_like(one)
        for k, x in enumerate([one, two, four, eight, *[None] * (levels - 4)][:levels]):
            if x is None:
                counter[k], carry = counter[k] ^ carry, counter[k] & carry
            else:
                counter[k], carry = add(counter[k], x, carry)
        over |= carry
        if at >= 32:
            keep = over != _U(0xFFFFFFFFFFFFFFFF)
            if not keep.all():
                live, over = live[keep], over[keep]
                counter = [c[keep] for c in counter]
                if not len(live):
                    return np.zeros(0, np.int64)
    bits = np.unpackbits((~over).view(np.uint8), bitorder="little").reshape(-1, 64)
    w, k = np.nonzero(bits)
    rows = live[w] * 64 + k
    return rows[rows < lanes]


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest place of each place's component, for edges a-b."""
    r = np.arange(n)
    while len(a):
        x, y = r[a], r[b]
        low = np.minimum(x, y)
        np.minimum.at(r, x, low)
        np.minimum.at(r, y, low)
        while True:
            up = r[r]
            if (up == r).all():
                break
            r = up
        keep = r[a] != r[b]
        a, b = a[keep], b[keep]
    return r


def bucket_edges(key: np.ndarray, fp: np.ndarray, radius: int, masks: np.ndarray | None = None, block: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, rows, links): edges that tie together, within a bucket, all rows connected by distances up to radius, and how many links each row has.

    With masks, fp being pairs of longs as bytes and key as of keyed(), a link counts only in the first table in which its rows meet. With block, only rows of different blocks are
    compared. Pairs are taken up shift by shift and never held as a whole.
    """
    links = np.zeros(len(key), np.int64)
    order = np.argsort(key, kind="stable")
    k = key[order]
    cut = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    size = np.diff(np.append(cut, len(k)))
    many = size > 1
    cut, size = cut[many], size[many]
    if not len(cut):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), links
    by = np.argsort(-size, kind="stable")
    cut, size = cut[by], size[by]
    base = np.cumsum(size) - size
    rows = order[np.repeat(cut - base, size) + np.arange(size.sum())]
    bucket = np.repeat(np.arange(len(size)), size)
    own = np.ascontiguousarray(fp[rows])
    p, halves, table = planes(own), own.view(np.int64), key[rows] >> 47
    total = np.cumsum(size)
    n, at, to, held = len(rows), [], [], 0

    def tied() -> tuple[np.ndarray, np.ndarray]:
        r = roots(n, np.concatenate(at), np.concatenate(to))
        child = np.flatnonzero(r != np.arange(n))
        return child, r[child]

    for s in range(1, int(size[0])):
        lanes = int(total[np.searchsorted(-size, -s, "left") - 1]) - s  # buckets of more than s rows come first
        i = within(p, s, lanes, radius)
        i = i[bucket[i] == bucket[i + s]]
        if block is not None:
            i = i[block[rows[i]] != block[rows[i + s]]]
        if not len(i):
            continue
        at.append(i)
        to.append(i + s)
        held += len(i)
        if masks is not None:
            x, y = halves[i], halves[i + s]
            first = np.full(len(i), len(masks), np.int64)
            for t in range(len(masks) - 1, -1, -1):
                first[(((x ^ y) & masks[t]) == 0).all(1)] = t
            i = i[first == table[i]]
            np.add.at(links, rows[i], 1)
            np.add.at(links, rows[i + s], 1)
        if held > 1 << 20:
            child, root = tied()
            at, to, held = [child], [root], len(child)
    if not at:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), links
    child, root = tied()
    return rows[child], rows[root], links


def _compare(radius: int, masks: np.ndarray, blocks: bool = False, chunk: int = 1 << 16):
    """_FOUND rows of batches (key, hi, lo), or (key, hi, lo, block): edges, and for each fingerprint with links their number, with a null b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        n = 0

        def found(columns: list[np.ndarray]) -> pa.RecordBatch:
            halves = np.stack(columns[1:3], 1)
            a, b, links = bucket_edges(columns[0], np.ascontiguousarray(halves).view(np.uint8), radius, masks, columns[3] if blocks else None)
            some = np.flatnonzero(links)
            one, two = np.concatenate([halves[a], halves[some]]), halves[b]
            none = np.concatenate([np.zeros(len(a), bool), np.ones(len(some), bool)])
            pad = np.zeros((len(some), 2), np.int64)
            two = np.concatenate([two, pad])
            return pa.RecordBatch.from_arrays([pa.array(one[:, 0]), pa.array(one[:, 1]), pa.array(two[:, 0], mask=none), pa.array(two[:, 1], mask=none), pa.array(np.concatenate([np.zeros(len(a), np.int64), links[some]]), mask=~none)], ["a_hi", "a_lo", "b_hi", "b_lo", "n"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append([c.to_numpy() for c in batch.columns])
            n += batch.num_rows
            # the last bucket may go on: batches are joined once it has ended
            if n >= chunk and held[0][0][0] != held[-1][0][-1]:
                columns = [np.concatenate(c) for c in zip(*held, strict=True)]
                m = int(np.searchsorted(columns[0], columns[0][-1]))
                yield found([c[:m] for c in columns])
                held = [[c[m:] for c in columns]]
                n -= m
        if held:
            yield found([np.concatenate(c) for c in zip(*held, strict=True)])

    return run


def _links(prints: DataFrame, radius: int, masks: np.ndarray) -> DataFrame:
    """_FOUND rows of prints(hi, lo). A key of more than BLOCK fingerprints is cut into blocks by a hash; each pair of them is a task's."""
    rows = keyed(prints, masks)
    hot = written(rows.groupBy("key").count().where(F.col("count") > BLOCK).select("key", F.ceil(F.col("count") / BLOCK).alias("m")), "hot")
    if hot.isEmpty():
        return rows.repartition("key").sortWithinPartitions("key").mapInArrow(_compare(radius, masks), _FOUND)
    usual = rows.join(hot, "key", "left_anti").repartition("key").sortWithinPartitions("key").mapInArrow(_compare(radius, masks), _FOUND)
    cut = rows.join(hot, "key").withColumn("block", F.pmod(F.xxhash64("lo", "hi"), F.col("m")))
    mates = cut.select("key", "hi", "lo", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)).alias("mate"))
    pairs = mates.select("key", "hi", "lo", "block", F.least("block", "mate").alias("x"), F.greatest("block", "mate").alias("y"))
    order = ["key", "x", "y"]
    within_block = pairs.where("x = y").repartition(*order).sortWithinPartitions(*order).select(F.col("key"), "hi", "lo", "x")
    across = pairs.where("x <> y").repartition(*order).sortWithinPartitions(*order).select("key", "hi", "lo", "block", "x", "y")
    return usual.union(within_block.mapInArrow(_pieces(radius, masks, False), _FOUND)).union(across.mapInArrow(_pieces(radius, masks, True), _FOUND))


def _pieces(radius: int, masks: np.ndarray, blocks: bool):
    """_compare() of each run of rows with the same key and block, or pair of blocks: the columns after hi, lo and block tell runs apart."""
    one = _compare(radius, masks, blocks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None
        for b in batches:
            if not b.num_rows:
                continue
            marks = np.stack([b.column(i).to_numpy() for i in (0, *range(4 if blocks else 3, b.num_columns))], 1)
            edges = np.flatnonzero(np.concatenate([[True], (marks[1:] != marks[:-1]).any(1)]))
            for a, z in zip(edges.tolist(), [*edges[1:].tolist(), b.num_rows], strict=True):
                own = tuple(marks[a].tolist())
                if own != now and held:
                    yield from one(iter(held))
                    held = []
                now = own
                held.append(b.slice(a, z - a).select(["key", "hi", "lo", *(["block"] if blocks else [])]))
        if held:
            yield from one(iter(held))

    return run


@lru_cache(maxsize=32)
def _covering(parts: int, radius: int) -> np.ndarray:
    """(masks, 2) of the two halves: for any radius bits, one at least of the masks has none of them.

    The bits are cut into parts, which bear t differences each, the sum of all t + 1 being radius + 1: two fingerprints within the radius differ in at most t bits of some part. Each bit of a
    part has a vector of t + 1 bits, and each other vector but 0 a mask of the bits whose vectors have an odd number of bits in common with it. The t vectors of t differences are orthogonal
    to some vector, whose mask has none of them. Of several random choices of vectors the one is taken whose masks have the most bits.
    """
    order, at, out = np.random.default_rng(3).permutation(BITS), 0, []
    for q in range(parts):
        width, t = BITS // parts + (q < BITS % parts), (radius + 1 - parts) // parts + (q < (radius + 1 - parts) % parts)
        v, best = np.arange(1, 2 << t), None
        for seed in range(50):
            r = np.random.default_rng(seed)
            of_bit = np.concatenate([r.permutation(v) for _ in range(-(-width // len(v)))])[:width]
            has = np.bitwise_count(v[:, None] & of_bit) & 1
            cost = (0.5 ** has.sum(1)).sum()
            if best is None or cost < best[0]:
                best = cost, has
        bits = np.zeros((len(v), BITS), np.uint8)
        bits[:, order[at : at + width]] = best[1]
        at += width
        out.append(np.packbits(bits, axis=1).view(np.int64))
    return np.concatenate(out)


def covering(n: int, radius: int = RADIUS) -> np.ndarray:
    """The masks of a covering family that costs the least for n fingerprints: more masks have more bits, and fewer rows meet under each. All lose no pair."""
    least, most = max(1, -(-(radius + 1) // 8)), max(1, min(radius + 1, 9))
    families = [_covering(p, radius) for p in range(min(least, most), most + 1)]
    return min(families, key=lambda m: len(m) * (1e-4 + 4e-8 * n) + 4e-9 * n * n * (0.5 ** np.bitwise_count(m.view(np.uint64)).sum(1, dtype=np.int64).astype(float)).sum())


def mask_edges(halves: np.ndarray, radius: int, masks: np.ndarray, own: range, shard: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, rows, links): edges that tie together all rows of fingerprints connected by distances up to radius, and how many links each row has, of links whose first mask is in own.

    The first mask of two rows is the first of masks under which they are equal. With shard, only rows of different shards are compared. Pairs are never held as a whole.
    """
    n, step = len(halves), 1 << 15
    links, at, to, held = np.zeros(n, np.int64), [], [], 0
    x, d, e = np.empty(step, np.uint64), np.empty(step, np.uint8), np.empty(step, np.uint8)

    def keep(t: int, a: np.ndarray, b: np.ndarray) -> None:
        nonlocal at, to, held, links
        if shard is not None:
            other = shard[a] != shard[b]
            a, b = a[other], b[other]
        differ = halves[a] ^ halves[b]
        new = ((differ & masks[t]) == 0).all(1)
        a, b, differ = a[new], b[new], differ[new]
        for m in masks[:t]:
            if not len(a):
                return
            new = ((differ & m) != 0).any(1)
            if not new.all():
                a, b, differ = a[new], b[new], differ[new]
        links += np.bincount(a, minlength=n) + np.bincount(b, minlength=n)
        at.append(a)
        to.append(b)
        held += len(a)
        if held > 1 << 20:
            child, root = tied()
            at, to, held = [child], [root], len(child)

    def tied() -> tuple[np.ndarray, np.ndarray]:
        r = roots(n, np.concatenate(at), np.concatenate(to))
        child = np.flatnonzero(r != np.arange(n))
        return child, r[child]

    for t in own:
        h = T.mix((halves & masks[t]).view(np.uint64) * np.array([0x9E3779B97F4A7C15, 0xA0761D6478BD642F], _U))
        key = ((h[:, 0] ^ h[:, 1]) >> _U(48)).astype(np.uint16)  # rows of several values may share a key: keep() tells them apart
        size = np.bincount(key, minlength=1 << 16)
        order = np.argsort(key, kind="stable")
        by = np.argsort(-size, kind="stable")
        cut, size = (np.cumsum(size) - size)[by], size[by]
        by = int(np.searchsorted(-size, -1, "left"))
        cut, size = cut[:by], size[:by]
        if not len(size):
            continue
        total = np.cumsum(size)
        rows = order[np.repeat(cut - (total - size), size) + np.arange(total[-1])]
        hi, lo = halves[rows].view(np.uint64).T.copy()
        found, waiting = [], 0
        for s in range(1, int(size[0])):
            lanes = int(total[np.searchsorted(-size, -s, "left") - 1]) - s  # buckets of more than s rows come first
            for i in range(0, lanes, step):
                w = min(step, lanes - i)
                np.bitwise_xor(hi[i : i + w], hi[i + s : i + s + w], out=x[:w])
                np.bitwise_count(x[:w], out=d[:w])
                np.bitwise_xor(lo[i : i + w], lo[i + s : i + s + w], out=x[:w])
                np.bitwise_count(x[:w], out=e[:w])
                np.add(d[:w], e[:w], out=d[:w])
                some = np.flatnonzero(d[:w] <= radius)
                if len(some):
                    found.append(np.stack([rows[i + some], rows[i + s + some]]))
                    waiting += len(some)
                    if waiting > 1 << 17:
                        keep(t, *np.concatenate(found, 1))
                        found, waiting = [], 0
        if found:
            keep(t, *np.concatenate(found, 1))
    if not at:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), links
    child, root = tied()
    return child, root, links


def _cells(radius: int, masks: np.ndarray, shards: int, split: int):
    """_FOUND rows of batches (cell, hi, lo, shard) in the order of cells: a cell is a pair of shards and a part of the masks, (first * shards + second) * split + part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def found() -> Iterator[pa.RecordBatch]:
            cell, *halves, shard = (np.concatenate(c) for c in zip(*held, strict=True))
            halves = np.ascontiguousarray(np.stack(halves, 1))
            pair, part = divmod(int(cell[0]), split)
            a, b, links = mask_edges(halves, radius, masks, range(part, len(masks), split), None if pair // shards == pair % shards else shard)
            none = pa.nulls(len(a), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(halves[a, 0]), pa.array(halves[a, 1]), pa.array(halves[b, 0]), pa.array(halves[b, 1]), none], ["a_hi", "a_lo", "b_hi", "b_lo", "n"])
            some = np.flatnonzero(links)
            none = pa.nulls(len(some), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(halves[some, 0]), pa.array(halves[some, 1]), none, none, pa.array(links[some])], ["a_hi", "a_lo", "b_hi", "b_lo", "n"])

        for batch in batches:
            columns = [c.to_numpy() for c in batch.columns]
            edges = np.flatnonzero(np.diff(columns[0])) + 1 if batch.num_rows else []
            for a, z in zip([0, *edges], [*edges, batch.num_rows], strict=True):
                if a == z:
                    continue
                if held and held[0][0][0] != columns[0][a]:
                    yield from found()
                    held.clear()
                held.append([c[a:z] for c in columns])
        if held:
            yield from found()

    return run


def _all_links(prints: DataFrame, n: int, radius: int) -> DataFrame:
    """_FOUND rows of prints(hi, lo), n of them, all different: every link. Each row goes to as many cells as there are shards, times the parts that the masks are split in."""
    shards = max(1, -(-n // SHARD))
    masks = covering(min(n, 2 * SHARD), radius)
    pairs = shards * (shards + 1) // 2
    split = max(1, min(SPLIT // pairs, -(-n * len(masks) >> 21)))
    own = F.pmod(F.xxhash64("lo", "hi"), F.lit(shards)) if shards > 1 else F.lit(0).cast("long")
    mates = prints.select("hi", "lo", own.alias("shard")).withColumn("mate", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
    pair = F.least("shard", "mate") * shards + F.greatest("shard", "mate")
    rows = mates.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(split - 1).cast("long")))).select((pair * split + F.col("part")).alias("cell"), "hi", "lo", "shard")
    return rows.repartition(min(2 * pairs * split, 4096), "cell").sortWithinPartitions("cell").mapInArrow(released(_cells(radius, masks, shards, split)), _FOUND)


def _grouped(docs: DataFrame, id_col: str, text_col: str, radius: int, recall: float | None) -> DataFrame:
    """(doc_id, text_hash, kept_id, n_links) of the rows in a group of near copies, but for those with the group's smallest identifier."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL").withColumn("text_hash", F.xxhash64("text"))
    fps = written(rows.mapInArrow(_fingerprint, "doc_id long, text_hash long, hi long, lo long, n_words long").where("n_words > 0").drop("n_words"), "simhash")
    prints = written(fps.select("hi", "lo").distinct(), "prints")
    n = prints.count()
    found = written(_all_links(prints, n, radius) if recall is None else _links(prints, radius, samples(*shape(n, radius, recall)[::-1])), "links")
    node = lambda x: F.struct(F.col(f"{x}_hi").alias("hi"), F.col(f"{x}_lo").alias("lo")).alias(x)
    roots_of = components(found.where("b_hi IS NOT NULL").select(node("a"), node("b"))).select("id.hi", "id.lo", "root")
    links = found.where("b_hi IS NULL").groupBy(F.col("a_hi").alias("hi"), F.col("a_lo").alias("lo")).agg(F.sum("n").alias("n_links"))
    classed = fps.join(roots_of.join(links, ["hi", "lo"]), ["hi", "lo"], "left").select("doc_id", "text_hash", F.coalesce("root", F.struct("hi", "lo")).alias("root"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    least = classed.groupBy("root").agg(F.min("doc_id").alias("kept_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    return classed.join(least, "root").where("doc_id <> kept_id").select("doc_id", "text_hash", "kept_id", "n_links")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, recall: float | None = None) -> DataFrame:
    """(doc_id, kept_id, n_links) for each document in a group of near copies, but for the group's smallest identifier, kept_id, which names the group.

    Two texts are near if their fingerprints differ in at most radius bits; groups are the connected components. n_links counts the other fingerprints
    that are near a document's own, each once, and never its copies. Every link is found, at any number of documents. Only with a recall are links lost: the tables are then of sampled bits, and find a link with a
    probability of at least recall at the radius and more below it, 1 - (1 - (1 - d/128) ** key_bits) ** tables at distance d; equal fingerprints are always found. Null identifiers, null texts and texts without a letter or number are in no
    group. Rows that repeat an identifier and a text count once; an identifier of several texts is in the group of each. A tie of votes leaves a bit unset. An empty table
    gives no rows; further columns are not read.
    """
    return _grouped(docs, id_col, text_col, radius, recall).groupBy("doc_id", "kept_id").agg(F.max("n_links").alias("n_links"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of docs without those that near_groups() lists, in the columns of docs.

    A row goes only if its identifier and its text are listed, so that an identifier that is used for an unrelated text as well keeps that one. Rows with a group's smallest identifier
    stay, repeated ones too; so do null identifiers, null texts and texts without a letter or number. An empty table stays empty.
    """
    gone = _grouped(docs, id_col, text_col, how.get("radius", RADIUS), how.get("recall")).select("doc_id", "text_hash")
    return without(docs, written(gone, "gone"), {"doc_id": F.col(id_col).cast("long"), "text_hash": F.xxhash64(text_col)})


def query(spark, sf_dir: str) -> DataFrame:
    return near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
