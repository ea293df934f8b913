"""Vectorised text kernels over Arrow batches: code points, runs, rolling hashes, pre-tokens."""

from __future__ import annotations

import functools
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
#: Code points in one kernel call. Longer texts form a call of their own.
SLICE = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@functools.cache
def classes() -> np.ndarray:
    """Class of each code point: white space, letter, number or other."""
    table = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    for c in range(0x40000):  # beyond, nothing is a letter or a number
        k = unicodedata.category(chr(c))[0]
        if k == "L":
            table[c] = LETTER
        elif k == "N":
            table[c] = NUMBER
    table[_WHITE] = SPACE
    return table


@functools.cache
def lowered() -> np.ndarray:
    """Lower case of each code point that has a single one."""
    table = np.arange(sys.maxunicode + 1, dtype=np.uint32)
    for c in range(0x3000):
        x = chr(c).lower()
        if len(x) == 1:
            table[c] = ord(x)
    return table


@functools.lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def of(base: np.uint64) -> np.ndarray:
        out = np.ones(n, np.uint64)
        out[1:] = base
        return np.multiply.accumulate(out)

    return of(_BASE), of(_INVERSE)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def slices(texts: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, code points, offsets of rows) of runs of rows; a null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    strings = texts.to_pylist()
    i = 0
    while i < len(strings):
        j, n = i, 0
        while j < len(strings) and (j == i or n + len(strings[j] or "") <= limit):
            n += len(strings[j] or "")
            j += 1
        part = [s or "" for s in strings[i:j]]
        offsets = np.zeros(len(part) + 1, np.int64)
        np.cumsum([len(s) for s in part], out=offsets[1:])
        cp = np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), np.uint32)
        yield i, j, cp, offsets
        i = j


def hashes(cp: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of code points."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    n = max(SLICE, 1 << (len(cp)).bit_length())
    power, inverse = _powers(n)
    total = np.zeros(len(cp) + 1, np.uint64)
    np.cumsum((cp.astype(np.uint64) + np.uint64(1)) * power[: len(cp)], out=total[1:])
    h = (total[ends] - total[starts]) * inverse[starts]
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def words(cp: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, words before each row's first) of runs of letters and numbers."""
    c = classes()[cp]
    inside = (c == LETTER) | (c == NUMBER)
    edge = np.zeros(len(cp) + 1, bool)
    edge[1:-1] = inside[1:] != inside[:-1]
    if len(cp):
        edge[0] = edge[-1] = True
        edge[offsets] = True
    cuts = np.flatnonzero(edge)
    starts, ends = cuts[:-1], cuts[1:]
    if len(cp):
        keep = inside[starts]
        starts, ends = starts[keep], ends[keep]
    return starts, ends, np.searchsorted(starts, offsets)


def pretokens(cp: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of pre-tokens, and the end of the last.

    They are those of the usual pattern of byte-level BPE: contractions, then runs of letters, of numbers
    and of other signs, each with at most one space before it, then white space.
    """
    n = len(cp)
    if not n:
        return np.zeros(1, np.int64)
    c = classes()[cp]
    first = np.zeros(n + 1, bool)
    first[1:-1] = c[1:] != c[:-1]
    row = np.zeros(n + 1, bool)
    row[offsets] = True
    first |= row
    # the last sign of white space that a word follows: a plain space goes to the word, any other stands alone
    last = np.flatnonzero((c[:-1] == SPACE) & (c[1:] != SPACE) & ~row[1:-1])
    first[last] = True
    first[last[cp[last] == 32] + 1] = False
    q = np.flatnonzero((cp == 39) & first[:-1])
    if len(q):
        pad = np.concatenate([cp, np.zeros(3, np.uint32)])
        rows = np.concatenate([row, np.ones(3, bool)])
        a, b = pad[q + 1], pad[q + 2]
        one = np.isin(a, [115, 116, 109, 100]) & ~rows[q + 1]
        two = ((((a == 114) | (a == 118)) & (b == 101)) | ((a == 108) & (b == 108))) & ~rows[q + 1] & ~rows[q + 2]
        first[q[one | two] + 1] = False
        for end in (q[one] + 2, q[two & ~one] + 3):
            first[end] = True
    first[n] = True
    return np.flatnonzero(first)
