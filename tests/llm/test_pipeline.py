"""The pipeline against plain versions of its stages."""

import functools

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline as C
from astrolith.llm import bpe, language, packing, secrets, simhash

from . import brute

DATA = "/root/testdata/sf0.01"


@functools.cache
def coder():
    return tiktoken.Encoding("own", pat_str=brute.PRETOKEN.pattern, mergeable_ranks=bpe.read_vocabulary(), special_tokens={})


def plainly(rows, model):
    """What is left of (doc_id, text) rows before packing: stage by stage, over all pairs."""
    _, _, rejected = model.classify(pa.array([t for _, t in rows], pa.string()))
    rows = [r for r, bad in zip(rows, rejected, strict=True) if not bad]
    least = {t: min(i for i, x in rows if x == t and i is not None) for t in {t for i, t in rows if i is not None}}
    rows = [(i, t) for i, t in rows if i is None or i == least[t]]
    prints, words = simhash.fingerprints(pa.array([t for _, t in rows], pa.string()))
    own = [k for k, (i, _) in enumerate(rows) if i is not None and words[k]]
    # places instead of identifiers, in the order of identifiers: an identifier may have several texts
    own.sort(key=lambda k: rows[k][0])
    found = brute.near(list(range(len(own))), prints[own], simhash.RADIUS)
    gone = {own[a] for a, b in found if rows[own[a]][0] != rows[own[b]][0]}
    rows = [r for k, r in enumerate(rows) if k not in gone]
    out = []
    for i, t in rows:
        for a, z, *_ in sorted(brute.links(secrets.parts(t), secrets.WINDOW), reverse=True):
            t = f"{t[:a]}[SECRET]{t[z:]}"
        out.append((i, t))
    return out


def sequences(rows):
    """Bins of the rows in one stream, as (doc_id, piece, start, tokens) lists."""
    rows = sorted(((i is not None, i or 0, np.array(coder().encode_ordinary(t), "<u2").tobytes(), i, coder().encode_ordinary(t)) for i, t in rows), key=lambda r: r[:3])
    bins = {}
    for (*_, i, tokens), pieces in zip(rows, brute.pack([len(r[4]) for r in rows], packing.CAPACITY, packing.OPEN_BINS), strict=True):
        for k, (at, offset, start, n) in enumerate(pieces):
            bins.setdefault(at, []).append((offset, i, k, start, tokens[start : start + n]))
    return sorted([(i or 0, *x) for _, i, *x in sorted(own, key=lambda p: p[0])] for own in bins.values())


def found(df):
    out = []
    for r in df.collect():
        at, own = 0, []
        for i, k, start, n in zip(r.doc_ids, r.pieces, r.starts, r.lengths, strict=True):
            own.append((i or 0, k, start, r.tokens[at : at + n]))
            at += n
        out.append(own)
    return sorted(out)


def test_same_as_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = language.fit(*language.sample(docs, language.FIT_ROWS, "text", "lang", "doc_id"))
    before = [(r.doc_id, r.text) for r in docs.collect()]
    want = plainly(before, model)
    assert len(want) < len(before) and any("[SECRET]" in t for _, t in want)
    assert found(C.run(spark, DATA)) == sequences(want)


def odd_rows():
    base = " ".join(f"the house {w} and a garden" for w in ("old", "new", "red", "blue", "green", "white", "tall", "small"))
    key = 'token = "9c8b45435718dcc700c184a7e303cdc64c6a8f7f"'
    texts = [(1, base), (2, base), (2, base), (3, base + " end"), (3, "quite another text of the cat, the dog and the bird in the house"), (None, base), (None, base), (4, None), (5, ""), (6, "!!! 123"), (None, None)]
    return texts + [(7, f"the house and the garden with {key} in the text"), (None, f"the dog and the house with {key} in the text"), (8, "the house of the dog is near the river " * 20_000), (9, "the cat"), (9, "the cat")]


def test_odd_rows_same_as_brute_force(spark, tmp_path):
    """Null identifiers and texts, repeated rows, an identifier of several texts, very long texts and further columns with clashing names."""
    rows = [(i, t, "en", "s", len(t) if t is not None else None) for i, t in odd_rows()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({n: F.lit(k) for k, n in enumerate(["digest", "may", "gone_id", "text_hash", "hi", "spans", "stream", "tokens", "bin", "label", "h"])})
    docs.coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    model = language.fit(*language.sample(docs, language.FIT_ROWS, "text", "lang", "doc_id"))
    want = plainly(odd_rows(), model)
    assert found(C.run(spark, str(tmp_path))) == sequences(want)
    kept = sorted((i or 0, t[:12]) for i, t in want)
    assert (1, "the house ol") in kept and (3, "quite anothe") in kept and not any(i == 2 for i, _ in kept) and sum(i == 9 for i, _ in kept) == 2 and sum(t == "the house ol" for i, t in kept if not i) == 2
    assert sum("[SECRET]" in t for _, t in want) == 2
    now = docs
    for _, stage in C.STAGES[:-1]:
        now = stage(spark, now, "")
        assert now.dtypes == docs.dtypes


def test_empty_table(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    docs.where("false").write.parquet(f"{tmp_path}/documents.parquet")
    assert C.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("k", range(5))
def test_stages_keep_columns(spark, k):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert [n for n, _ in C.STAGES] == ["language_id", "exact_dedup", "near_dedup", "secret_scan", "packing"]
    empty = C.STAGES[k][1](spark, docs.where("false"), DATA)
    assert empty.count() == 0 and (k == 4 or empty.dtypes == docs.dtypes)
