"""Exact and near dedup against brute force."""

import os
import subprocess
import sys
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from astrolith.llm import exact_dedup as E
from astrolith.llm import simhash as S

from . import brute

DATA = "/root/testdata/sf0.001/documents.parquet"
EDGE = [(5, "a"), (3, "a"), (3, "a"), (None, "a"), (9, None), (1, ""), (2, ""), (4, "b"), (3, "b"), (7, "x" * 300_000), (6, "x" * 300_000), (8, "A")]


def pairs(df):
    """(doc_id, kept_id) rows, sorted."""
    return sorted((r.doc_id, r.kept_id) for r in df.collect())


def test_exact_same_as_brute_force(spark):
    docs = spark.read.parquet(DATA)
    assert pairs(E.exact_duplicates(docs)) == brute.exact([(r.doc_id, r.text) for r in docs.collect()])


def test_exact_edges(spark):
    docs = spark.createDataFrame(EDGE, "doc_id long, text string").withColumns({"digest": F.lit(1), "gone_id": F.lit(2), "kept_id": F.lit(3), "ids": F.lit(4)})
    assert pairs(E.exact_duplicates(docs)) == brute.exact(EDGE) == [(2, 1), (4, 3), (5, 3), (7, 6)]
    left = E.drop_exact_duplicates(docs)
    assert left.columns == docs.columns
    assert sorted((r.doc_id or 0, "-" if r.text is None else r.text[:3]) for r in left.collect()) == [(0, "a"), (1, ""), (3, "a"), (3, "a"), (3, "b"), (6, "xxx"), (8, "A"), (9, "-")]
    assert E.exact_duplicates(docs.where("false")).count() == E.drop_exact_duplicates(docs.where("false")).count() == 0


def test_index_with_small_runs():
    r = np.random.default_rng(1)
    for _ in range(20):
        n = int(r.integers(1, 400))
        keys = np.zeros(n, E._K)
        keys["hi"], keys["lo"] = r.integers(0, 40, n), r.integers(0, 2, n)
        ids = r.integers(0, 200, n)
        index = E.Index(memtable_rows=16, max_runs=2)
        got = set()
        for i in range(0, n, 13):
            index.add(keys[i : i + 13], ids[i : i + 13])
            k, j = index.take()
            got |= {(tuple(a), int(b)) for a, b in zip(k.tolist(), j.tolist(), strict=True)}
        k, j = index.close()
        got |= {(tuple(a), int(b)) for a, b in zip(k.tolist(), j.tolist(), strict=True)}
        by = {}
        for a, b in zip(keys.tolist(), ids.tolist(), strict=True):
            by.setdefault(tuple(a), set()).add(b)
        # each identifier of a digest with several, the smallest with certainty
        assert got == {(a, b) for a, bs in by.items() if len(bs) > 1 for b in bs}


def test_distances_by_planes():
    r = np.random.default_rng(2)
    fp = r.integers(0, 256, (300, 16), dtype=np.uint8)
    for i in range(0, 200, 3):  # some close rows at several distances apart
        fp[i + int(r.integers(1, 70))] = fp[i] ^ np.packbits(r.random(128) < 0.15)
    p, bits = S.planes(fp), np.unpackbits(fp, axis=1).astype(int)
    for radius in (0, 3, 20, 26):
        for shift in (1, 5, 63, 64, 65, 130):
            lanes = len(fp) - shift
            want = np.flatnonzero((bits[:lanes] != bits[shift:]).sum(1) <= radius)
            assert S.within(p, shift, lanes, radius).tolist() == want.tolist()


def test_near_same_as_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = docs.orderBy("doc_id").select("doc_id", "text").collect()
    prints, words = S.fingerprints(pa.array([r.text for r in texts]))
    ok = words > 0
    want = set(brute.near([r.doc_id for r, k in zip(texts, ok, strict=True) if k], prints[ok], S.RADIUS))
    got = set(pairs(S.near_groups(docs)))
    assert len(got & want) >= 0.97 * len(want) and not {i for i, _ in got} - {i for i, _ in want}
    exact = brute.exact([(r.doc_id, r.text) for r in texts])
    assert {i for i, _ in exact} <= {i for i, _ in got}


def test_links_same_as_brute_force(spark, monkeypatch):
    """Links counted once each over all tables; buckets cut into blocks give the same."""
    r = np.random.default_rng(5)
    fp = r.integers(0, 256, (900, 16), dtype=np.uint8)
    for i in range(0, 900, 3):
        fp[i + 1], fp[i + 2] = fp[i] ^ np.packbits(r.random(128) < 0.04), fp[i] ^ np.packbits(r.random(128) < 0.1)
    fp[600:] = fp[600] ^ np.packbits(r.random((300, 128)) < 0.06, axis=1)  # one large group of different texts
    fp = np.unique(fp, axis=0)
    halves, bits = fp.view(np.int64), np.unpackbits(fp, axis=1).astype(int)
    masks = S.samples(*S.shape(len(fp), recall=0.999)[::-1])
    near = ((bits[:, None] != bits[None]).sum(2) <= 26) & ~np.eye(len(fp), dtype=bool)
    meet = np.zeros_like(near)
    for m in masks:
        own = halves & m
        meet |= (own[:, None] == own[None]).all(2)
    want = {tuple(h): int(n) for h, n in zip(halves.tolist(), (near & meet).sum(1), strict=True) if n}
    prints = spark.createDataFrame(halves.tolist(), "hi long, lo long")
    for block in (S.BLOCK, 40):
        monkeypatch.setattr(S, "BLOCK", block)
        got, edges = {}, []
        for x in S._links(prints, 26, masks).collect():
            if x.b_hi is None:
                got[x.a_hi, x.a_lo] = got.get((x.a_hi, x.a_lo), 0) + x.n
            else:
                edges.append(((x.a_hi, x.a_lo), (x.b_hi, x.b_lo)))
        assert got == want and (near & meet).sum() >= 0.99 * near.sum()
        at = {tuple(h): i for i, h in enumerate(halves.tolist())}
        assert brute.components(len(fp), [(at[a], at[b]) for a, b in edges]) == brute.components(len(fp), np.argwhere(near & meet).tolist())


def test_near_finds_every_link(spark):
    """Pairs of texts at all distances up to the radius: no link is lost."""
    r = np.random.default_rng(11)
    rows = []
    for k in range(1500):
        words = [f"w{k}x{i}" for i in range(60)]
        rows.append((2 * k, " ".join(words)))
        for i in r.choice(60, int(r.integers(3, 9)), replace=False):
            words[i] = f"n{k}x{i}"
        rows.append((2 * k + 1, " ".join(words)))
    bits = np.unpackbits(S.fingerprints(pa.array([t for _, t in rows]))[0], axis=1).astype(np.float32)
    near = (bits @ (1 - bits).T + (1 - bits) @ bits.T <= S.RADIUS) & ~np.eye(len(rows), dtype=bool)
    want = {(i, int(near[i].sum())) for i, k in brute.near([i for i, _ in rows], np.packbits(bits.astype(np.uint8), axis=1), S.RADIUS)}
    assert {(x.doc_id, x.n_links) for x in S.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == want


@pytest.mark.parametrize("radius", [0, 1, 5, 26, 40])
def test_some_mask_has_none_of_the_differences(radius):
    r = np.random.default_rng(radius)
    differ = np.zeros((3000, 128), np.uint8)
    for i in range(3000):  # anywhere, or close together
        width = int(r.integers(max(radius, 1), 129))
        differ[i, int(r.integers(0, 129 - width)) + r.choice(width, radius, replace=False)] = 1
    halves = np.packbits(differ, axis=1).view(np.int64)
    for n in (1, 10**4, 10**5, 10**6):
        missed = np.ones(len(halves), bool)
        for m in S.covering(n, radius):
            missed &= ((halves & m) != 0).any(1)
        assert not missed.any()


def test_all_links_over_shards(spark, monkeypatch):
    """Every link once, of rows in one shard and in two, with the masks in one part and in several."""
    r = np.random.default_rng(6)
    fp = r.integers(0, 256, (500, 16), dtype=np.uint8)
    for i in range(0, 300, 3):
        fp[i + 1], fp[i + 2] = fp[i] ^ np.packbits(r.random(128) < 0.1), fp[i] ^ np.packbits(r.random(128) < 0.19)
    fp[300:] = fp[300] ^ np.packbits(r.random((200, 128)) < 0.11, axis=1)  # one large group of different texts
    fp = np.unique(fp, axis=0)
    halves, bits = fp.view(np.int64), np.unpackbits(fp, axis=1).astype(int)
    near = ((bits[:, None] != bits[None]).sum(2) <= 26) & ~np.eye(len(fp), dtype=bool)
    want = {tuple(h): int(n) for h, n in zip(halves.tolist(), near.sum(1), strict=True) if n}
    at = {tuple(h): i for i, h in enumerate(halves.tolist())}
    for shard, n in ((S.SHARD, len(fp)), (S.SHARD, 200_000), (200, len(fp)), (9, 30)):
        monkeypatch.setattr(S, "SHARD", shard)
        got, edges = {}, []
        for x in S._all_links(spark.createDataFrame(halves.tolist(), "hi long, lo long"), n, 26).collect():
            if x.b_hi is None:
                got[x.a_hi, x.a_lo] = got.get((x.a_hi, x.a_lo), 0) + x.n
            else:
                edges.append((at[x.a_hi, x.a_lo], at[x.b_hi, x.b_lo]))
        assert got == want
        assert brute.components(len(fp), edges) == brute.components(len(fp), np.argwhere(near).tolist())


def test_shape_keeps_buckets_and_recall():
    for n in (0, 1, 300, 10_000, 10**6, 10**9):
        key_bits, tables = S.shape(n)
        assert 1 - (1 - (1 - S.RADIUS / S.BITS) ** key_bits) ** tables >= S.RECALL and n / 2**key_bits <= 2 * S.BUCKET


def test_near_keeps_an_unrelated_text_of_a_listed_identifier(spark):
    base, other = " ".join(f"w{i}" for i in range(60)), " ".join(f"z{i}" for i in range(60))
    docs = spark.createDataFrame([(1, base), (2, base + " tail"), (2, other), (3, other + " end"), (None, base)], "doc_id long, text string")
    assert sorted((x.doc_id or 0, x.text) for x in S.drop_near_duplicates(docs).collect()) == [(0, base), (1, base), (2, other)]
    assert sorted((x.doc_id, x.kept_id, x.n_links) for x in S.near_groups(docs).collect()) == [(2, 1, 1), (3, 2, 1)]
    words = spark.createDataFrame([(i, f"word{i}") for i in range(3000)] + [(5000, "WORD7"), (5001, "word7 !")], "doc_id long, text string")
    assert pairs(S.near_groups(words)) == [(5000, 7), (5001, 7)]


def test_fingerprints_leave_no_memory_behind():
    """A worker's memory after a task: Spark keeps the process, which must not hold what the task has freed."""
    code = """if True:
        import re
        import pyarrow as pa
        from astrolith.llm import simhash as S

        def anonymous():
            return sum(map(int, re.findall(r"\\nPss_(?:Anon|Shmem):\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) >> 10

        def run(n):
            text = " ".join(f"word{i}" for i in range(900))
            batch = lambda: pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array([f"{i} {text}" for i in range(n)]), pa.array(range(n))], ["doc_id", "text", "text_hash"])
            return sum(b.num_rows for b in S._fingerprint(batch() for _ in range(3)))

        run(1)
        before = anonymous()
        assert run(2000) == 6000
        print(anonymous() - before)
    """
    root = str(Path(S.__file__).resolve().parents[2])
    left = int(subprocess.run([sys.executable, "-c", code], env={**os.environ, "PYTHONPATH": root}, capture_output=True, text=True, check=True).stdout)
    assert left <= 35, left


def test_near_edges(spark):
    long = " ".join(f"word{i} other{i * 7}" for i in range(20_000))
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(1, base), (2, base + " tail"), (2, base + " tail"), (3, None), (None, base), (4, ""), (5, "!!!"), (6, long), (7, long + " end"), (8, " ".join(f"z{i}" for i in range(60))), (9, base.upper())]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"fp": F.lit(1), "root": F.lit(1), "gone_id": F.lit(9)})
    assert pairs(S.near_groups(docs)) == [(2, 1), (7, 6), (9, 1)]
    left = S.drop_near_duplicates(docs)
    assert left.columns == docs.columns and sorted(r.doc_id or 0 for r in left.collect()) == [0, 1, 3, 4, 5, 6, 8]
    assert S.near_groups(docs.where("false")).count() == 0


@pytest.mark.parametrize("n", [1, 2, 500])
def test_bucket_edges_connect_like_all_pairs(n):
    r = np.random.default_rng(n)
    fp, key = r.integers(0, 256, (n, 16), dtype=np.uint8), r.integers(0, 9, n)
    for i in range(1, n, 2):
        fp[i], key[i] = fp[i - 1] ^ np.packbits(r.random(128) < 0.1), key[i - 1]
    a, b, _ = S.bucket_edges(key, fp, 26)
    bits = np.unpackbits(fp, axis=1).astype(int)
    close = [(i, j) for i in range(n) for j in range(i + 1, n) if key[i] == key[j] and (bits[i] != bits[j]).sum() <= 26]
    assert brute.components(n, zip(a.tolist(), b.tolist(), strict=True)) == brute.components(n, close)
