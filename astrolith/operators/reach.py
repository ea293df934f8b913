"""Closures and strong components of graphs whose edges a task can hold: kernels over codes of the nodes, in one job instead of one a round."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

#: Edges that a task holds at most; copies of edges that a closure sends out at most.
HELD_EDGES, COPIES = 2_000_000, 50_000_000
#: Bytes of a batch of sources' visited nodes, edges that a step expands at once, rows in a batch of the result.
VISITED, STEP, BATCH = 1 << 26, 1 << 21, 1 << 16
#: Rounds in which nodes that begin or end edges only are peeled off together, before the rest is walked through.
PEELED = 50


def _coded(src: pa.ChunkedArray, dst: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(values in their order, codes of src, codes of dst), a code being the place of a value."""
    values = pc.unique(pa.chunked_array([*src.chunks, *dst.chunks], type=src.type))
    values = values.take(pc.sort_indices(values))
    code = lambda c: pc.index_in(c, value_set=values).combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64)
    return values, code(src), code(dst)


def _adjacency(n: int, src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(where the successors of each node begin, successors)."""
    return np.concatenate([[0], np.cumsum(np.bincount(src, minlength=n))]), dst[np.argsort(src, kind="stable")]


def _reached(n: int, first: np.ndarray, after: np.ndarray, roots: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(root, node) of all nodes that a path leads to from each of roots, each pair once, in pieces."""
    size = max(1, VISITED // max(n, 1))
    for at in range(0, len(roots), size):
        own = roots[at : at + size]
        seen = np.zeros(len(own) * n, dtype=bool)
        who, node = np.arange(len(own)), own
        while len(who):
            degree = first[node + 1] - first[node]
            ends = np.cumsum(degree)
            cuts = np.unique(np.append(np.searchsorted(ends, np.arange(STEP, ends[-1], STEP)) + 1, len(ends)))
            found = []
            for a, z in zip(np.append(0, cuts[:-1]), cuts, strict=True):
                d = degree[a:z]
                at_edge = np.arange(d.sum()) + np.repeat(first[node[a:z]] - (np.cumsum(d) - d), d)
                key = np.repeat(who[a:z], d) * n + after[at_edge]
                key = np.unique(key[~seen[key]])
                seen[key] = True
                found.append(key)
            who, node = np.divmod(np.concatenate(found), n)
            yield own[who], node


def closure(e: DataFrame, n_edges: int, starts: DataFrame | None = None) -> DataFrame:
    """graph.closure() of distinct edges without nulls, n_edges of them, which are copied to each block of sources."""
    most = max(1, min(4 * e.sparkSession.sparkContext.defaultParallelism, COPIES // max(n_edges, 1)))
    wanted = None if starts is None else starts.select("src").where("src IS NOT NULL").distinct()
    blocks = max(1, min(most, (n_edges if wanted is None else wanted.count()) // 256))
    rows = e.select("src", "dst", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    if wanted is not None:
        rows = rows.union(wanted.select("src", F.lit(None).cast(e.schema["dst"].dataType), F.pmod(F.xxhash64("src"), F.lit(blocks)).cast("int")))
    out, chosen = e.select("src", "dst").schema, wanted is not None
    out = StructType([StructField(f.name, f.dataType) for f in out])
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        block, edges = table["block"][0].as_py(), table.filter(table["dst"].is_valid())
        values, src, dst = _coded(edges["src"], edges["dst"])
        first, after = _adjacency(len(values), src, dst)
        if chosen:
            roots = pc.index_in(table.filter(table["dst"].is_null())["src"], value_set=values).drop_null().to_numpy().astype(np.int64)
        else:
            roots = np.unique(src[src % blocks == block])
        del table, edges, src, dst
        parts, n = [], 0

        def batch() -> pa.RecordBatch:
            a, b = (np.concatenate(x) for x in zip(*parts, strict=True))
            return pa.RecordBatch.from_arrays([values.take(pa.array(x)).cast(t) for x, t in zip((a, b), arrow.types, strict=True)], schema=arrow)

        for a, b in _reached(len(values), first, after, roots):
            for k in range(0, len(a), BATCH):
                parts.append((a[k : k + BATCH], b[k : k + BATCH]))
                n += len(parts[-1][0])
                if n >= BATCH:
                    yield batch()
                    parts, n = [], 0
        if parts:
            yield batch()

    return rows.repartitionById(blocks, F.col("block")).mapInArrow(run, out)


def _groups(n: int, src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its group) of the nodes that lie in a strong component of two or more, by Tarjan's walk."""
    for _ in range(PEELED):
        keep = (np.bincount(dst, minlength=n)[src] > 0) & (np.bincount(src, minlength=n)[dst] > 0)
        if keep.all():
            break
        src, dst = src[keep], dst[keep]
    if not len(src):
        return src, dst
    ids, both = np.unique(np.concatenate([src, dst]), return_inverse=True)
    first, after = (x.tolist() for x in _adjacency(len(ids), both[: len(src)], both[len(src) :]))
    order, low, held, stack, found = [-1] * len(ids), [0] * len(ids), bytearray(len(ids)), [], []
    count = 0
    for root in range(len(ids)):
        if order[root] >= 0:
            continue
        order[root] = low[root] = count
        count += 1
        stack.append(root)
        held[root] = 1
        path, at = [root], [first[root]]
        while path:
            v, k = path[-1], at[-1]
            if k < first[v + 1]:
                at[-1] += 1
                w = after[k]
                if order[w] < 0:
                    order[w] = low[w] = count
                    count += 1
                    stack.append(w)
                    held[w] = 1
                    path.append(w)
                    at.append(first[w])
                elif held[w] and order[w] < low[v]:
                    low[v] = order[w]
                continue
            path.pop()
            at.pop()
            if path and low[v] < low[path[-1]]:
                low[path[-1]] = low[v]
            if low[v] == order[v]:
                k = len(stack) - 1
                while stack[k] != v:
                    k -= 1
                group = stack[k:]
                del stack[k:]
                for x in group:
                    held[x] = 0
                if len(group) > 1:
                    found.append(group)
    nodes = np.array([x for g in found for x in g], dtype=np.int64)
    least = np.array([m for g in found for m in [min(g)] * len(g)], dtype=np.int64)
    return ids[nodes], ids[least]


def strong(e: DataFrame) -> DataFrame:
    """(node, component) of the nodes on cycles of two or more, component being the least node of those that reach each other. One task holds the edges, HELD_EDGES at most."""
    kind = e.schema["src"].dataType
    out = StructType([StructField("node", kind), StructField("component", kind)])
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        values, src, dst = _coded(table["src"], table["dst"])
        own = src != dst
        nodes, least = _groups(len(values), src[own], dst[own])
        for k in range(0, len(nodes), BATCH):
            yield pa.RecordBatch.from_arrays([values.take(pa.array(x[k : k + BATCH])).cast(t) for x, t in zip((nodes, least), arrow.types, strict=True)], schema=arrow)

    return e.select("src", "dst").repartition(1).mapInArrow(run, out)
