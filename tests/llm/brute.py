"""Plain versions of the operators: all pairs, whole scans, no tricks."""

from collections import defaultdict

import numpy as np
import regex


def components(n, pairs):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def exact(rows):
    """(doc_id, kept_id) of (doc_id, text) rows."""
    by = defaultdict(set)
    for i, t in rows:
        if i is not None and t is not None:
            by[t].add(i)
    return sorted((i, min(ids)) for ids in by.values() for i in ids if i != min(ids))


def near(ids, prints, radius):
    """(doc_id, kept_id) of fingerprints within radius bits, all pairs compared."""
    bits = np.unpackbits(prints, axis=1).astype(np.int16)
    d = bits @ (1 - bits).T
    d = d + d.T
    pairs = np.argwhere(np.triu(d <= radius, 1)).tolist()
    order = np.argsort(ids, kind="stable")
    at = {int(k): i for i, k in enumerate(order)}
    root = components(len(ids), [(at[a], at[b]) for a, b in pairs])
    ranked = [ids[k] for k in order]
    return sorted({(ranked[i], ranked[r]) for i, r in enumerate(root) if ranked[i] != ranked[r]})


def pack(lengths, capacity, open_bins):
    """Bins as lists: the fullest open bin that still takes the piece, the longest waiting of equals."""
    bins, active, out, tick = [], [], [], 0  # active: [free, since, bin]
    for n in lengths:
        own, start = [], 0
        while n - start >= capacity:
            own.append((len(bins), 0, start, capacity))
            bins.append(capacity)
            start += capacity
        if n > start:
            need = n - start
            fits = [b for b in active if b[0] >= need]
            if fits:
                b = min(fits, key=lambda b: (b[0], b[1]))
            else:
                if len(active) == open_bins:
                    active.remove(min(active, key=lambda b: (b[0], b[1])))
                b = [capacity, tick, len(bins)]
                bins.append(0)
                active.append(b)
            own.append((b[2], capacity - b[0], start, need))
            tick += 1
            b[0] -= need
            b[1] = tick
            if not b[0]:
                active.remove(b)
        out.append(own)
    return out


def links(found, window):
    """Reported secrets of parts (role, kind, strong, start, stop, value): (start, stop, kind, linked)."""
    out = []
    for role, kind, strong, a, z, _ in found:
        if role == "secret":
            linked = any(r != "secret" and max(x - z, a - y, 0) <= window for r, _, _, x, y, _ in found)
            if strong or linked:
                out.append((a, z, kind, linked))
    return sorted(out)


PRETOKEN = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")


def pretokens(text):
    return PRETOKEN.findall(text)


def bpe(word, ranks):
    """Tokens of a word: the leftmost pair of the smallest rank is merged, one at a time."""
    parts = [bytes([x]) for x in word]
    while True:
        found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks]
        if not found:
            return [ranks[p] for p in parts]
        i = min(found)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
