"""Closures, strong components and what is made of them, against plain searches, over what a task holds and over more."""

import random

import numpy as np
import pytest

from astrolith.operators import graph, reach


def pairs(edges):
    after = {}
    for a, b in edges:
        after.setdefault(a, set()).add(b)
    out = set()
    for root in after:
        todo, seen = list(after[root]), set()
        while todo:
            if (x := todo.pop()) not in seen:
                seen.add(x)
                todo += after.get(x, ())
        out |= {(root, x) for x in seen}
    return out


@pytest.mark.parametrize("held", [reach.HELD_EDGES, 5])
@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_closure_and_cycles(spark, monkeypatch, kind, held):
    monkeypatch.setattr(reach, "HELD_EDGES", held)
    r = random.Random(3)
    name = (lambda x: x) if kind == "bigint" else (lambda x: f"n{x}")
    edges = {(name(r.randrange(40)), name(r.randrange(40))) for _ in range(45)}
    df = spark.createDataFrame([*edges, *edges, (None, name(1)), (name(1), None)], f"src {kind}, dst {kind}")
    want = pairs(edges)
    got = [tuple(x) for x in graph.closure(df).collect()]
    assert len(got) == len(want) and set(got) == want
    starts = spark.createDataFrame([(name(k),) for k in range(10)] + [(name(999),)], f"src {kind}")
    assert {tuple(x) for x in graph.closure(df, starts).collect()} == {p for p in want if p[0] in {name(k) for k in range(10)}}
    assert {x.node: x.size for x in graph.on_cycles(df).collect()} == {a: len({x for y, x in want if y == a and (x, a) in want}) for a, b in want if a == b}
    targets = spark.createDataFrame([(name(3),), (name(5),)], f"node {kind}")
    assert {x.node for x in graph.reaching(df, targets).collect()} == {name(3), name(5)} | {a for a, b in want if b in (name(3), name(5))}


def test_pieces_of_a_step(monkeypatch):
    r = random.Random(4)
    edges = sorted({(r.randrange(50), r.randrange(50)) for _ in range(150)})
    src, dst = (np.array(x) for x in zip(*edges, strict=True))
    first, after = reach._adjacency(50, src, dst)
    for step, visited in ((1, 1), (7, 150), (1000, 1 << 20)):
        monkeypatch.setattr(reach, "STEP", step)
        monkeypatch.setattr(reach, "VISITED", visited)
        got = [p for a, b in reach._reached(50, first, after, np.unique(src)) for p in zip(a.tolist(), b.tolist(), strict=True)]
        assert len(got) == len(set(got)) and set(got) == pairs(edges)


def test_jobs_and_broadcasts_do_not_grow_with_depth(spark):
    """A ring with a tail: joins a round had as many jobs as the longest path, and a broadcast in each."""
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("deep", "deep")
    try:
        df = spark.createDataFrame([(k, k + 1) for k in range(300)] + [(300, 200)], "src bigint, dst bigint")
        assert graph.closure(df).count() == sum(301 - k - 1 for k in range(200)) + 101 * 101
        assert {x.size for x in graph.on_cycles(df).collect()} == {101}
        assert len(tracker.getJobIdsForGroup("deep")) < 60
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_rounds_of_chains_never_broadcast(spark, monkeypatch):
    plans, cut = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or cut(df))
    df = spark.createDataFrame([(k, k // 2) for k in range(1, 40)], "src bigint, dst bigint")
    assert {x.node: x.length for x in graph.longest_chains(df).collect()} == {k: k.bit_length() for k in range(40)}
    joined = [p for p in plans if "Join" in p]
    assert len(joined) > 4 and all(p.count("Join") == p.count("strategy=merge") for p in joined)
