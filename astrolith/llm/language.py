"""Language identification by nearest centroids of TF-IDF n-gram vectors.

Texts become L2-normalised TF-IDF vectors of hashed character n-grams. Each language has several centroids, found by spherical
k-means over a bounded sample of labelled rows. A text gets the language of the centroid with the largest cosine; it is rejected
if that cosine is under a floor which depends on how many n-grams the text has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import text as T
from .session import released

#: Most labelled rows that the centroids are fitted on.
FIT_ROWS = 4000
#: Size of the hashed n-gram space, and centroids of each language.
DIMENSIONS = 4096
CENTROIDS = 4
#: The floor is this share of the least similarity that the sample has among texts of about that size.
FLOOR = 0.6
_U = np.uint64


def ngram_counts(texts: pa.Array, dimensions: int = DIMENSIONS) -> np.ndarray:
    """(texts, dimensions) counts of n-grams of 1 to 3 signs within words, in lower case; a word's edge counts as a space."""
    out = np.zeros((len(texts), dimensions), np.float32)
    for i, j, cp, offsets in T.slices(texts):
        if not len(cp):
            continue
        low = T.lowered()[cp].astype(np.uint64)
        c = T.classes()[cp]
        low[c != T.LETTER] = 32
        row = np.repeat(np.arange(j - i, dtype=np.int64), np.diff(offsets))
        letter = c == T.LETTER
        for n in (1, 2, 3):
            if len(low) < n:
                break
            m = len(low) - n + 1
            h = low[:m].copy()
            good = letter[:m].copy()
            for k in range(1, n):
                h = h * _U(0x100000001B3) + low[k : k + m]
                good |= letter[k : k + m]
            good &= row[:m] == row[n - 1 :]
            at = (T.mix(h[good] + _U(n << 56)) % _U(dimensions)).astype(np.int64) + row[:m][good] * dimensions
            out[i:j] += np.bincount(at, minlength=(j - i) * dimensions).reshape(j - i, dimensions)
    return out


def normalised(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


class Model:
    """Centroids and their languages, inverse document frequencies, and the floor by size."""

    def __init__(self, idf: np.ndarray, centroids: np.ndarray, languages: list[str], of: np.ndarray, floor: np.ndarray):
        self.idf, self.centroids, self.languages, self.of, self.floor = idf, centroids, languages, of, floor

    def classify(self, texts: pa.Array) -> tuple[list[str | None], np.ndarray, np.ndarray]:
        """(language or None if rejected, cosine to the nearest centroid, rejected)."""
        labels: list[str | None] = []
        cosines, rejected = np.zeros(len(texts)), np.zeros(len(texts), bool)
        for i in range(0, len(texts), 256):
            counts = ngram_counts(texts.slice(i, 256), len(self.idf))
            s = normalised(counts, self.idf) @ self.centroids.T if len(self.centroids) else np.zeros((len(counts), 1))
            best = s.argmax(1)
            cosines[i : i + 256] = s[np.arange(len(s)), best]
            n = counts.sum(1)
            bad = (n == 0) | (cosines[i : i + 256] < self.floor[size_class(n)]) | (not len(self.centroids))
            rejected[i : i + 256] = bad
            labels += [None if x else self.languages[self.of[b]] for x, b in zip(bad, best, strict=True)]
        return labels, cosines, rejected


def size_class(n: np.ndarray) -> np.ndarray:
    """0 to 11, by the logarithm of the number of n-grams."""
    return np.clip(np.log2(np.maximum(n, 1)), 0, 11).astype(np.int64)


def fit(texts: list[str], labels: list[str], centroids: int = CENTROIDS, dimensions: int = DIMENSIONS, seed: int = 3) -> Model:
    """A model of labelled texts. Without any, the model rejects everything."""
    idf = np.ones(dimensions, np.float32)
    if not texts:
        return Model(idf, np.zeros((0, dimensions), np.float32), [], np.zeros(0, np.int64), np.zeros(12))
    counts = np.concatenate([ngram_counts(pa.array(texts[i : i + 256], pa.string()), dimensions) for i in range(0, len(texts), 256)])
    idf = (np.log((1 + len(texts)) / (1 + (counts > 0).sum(0))) + 1).astype(np.float32)
    x, y = normalised(counts, idf), np.array(labels)
    r = np.random.default_rng(seed)
    languages, found, of = sorted(set(labels)), [], []
    for k, language in enumerate(languages):
        own = x[(y == language) & (counts.sum(1) > 0)]
        if not len(own):
            continue
        c = own[r.choice(len(own), min(centroids, len(own)), replace=False)]
        for _ in range(10):
            at = (own @ c.T).argmax(1)
            c = np.stack([own[at == i].mean(0) if (at == i).any() else c[i] for i in range(len(c))])
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        found.append(c)
        of += [k] * len(c)
    c, of = np.concatenate(found) if found else np.zeros((0, dimensions), np.float32), np.array(of, np.int64)
    floor = np.zeros(12)
    if len(c):
        s, size = (x @ c.T).max(1), size_class(counts.sum(1))
        sized = [s[size == k].min() if (size == k).sum() >= 5 else np.nan for k in range(12)]
        known = [k for k in range(12) if not np.isnan(sized[k])]
        floor = np.interp(range(12), known, [sized[k] for k in known]) * FLOOR if known else floor
        floor = np.minimum.accumulate(floor[::-1])[::-1]
    return Model(idf, c.astype(np.float32), languages, of, floor)


def sample(docs: DataFrame, fit_rows: int, text_col: str, label_col: str, id_col: str) -> tuple[list[str], list[str]]:
    """At most fit_rows labelled rows, those with the smallest hashes of the identifier in each label: the same ones at each run.

    Labels take turns, so that each has an equal share, and what rare ones leave goes to the others.
    """
    own = docs.select(F.col(id_col).alias("sample_id"), F.col(text_col).alias("text"), F.col(label_col).alias("label")).where("label IS NOT NULL")
    ranked = own.where("text IS NOT NULL").select(F.xxhash64("sample_id").alias("h"), "sample_id", "label").withColumn("turn", F.row_number().over(Window.partitionBy("label").orderBy("h", "sample_id")))
    ids = ranked.where(F.col("turn") <= fit_rows).orderBy("turn", "h", "sample_id").limit(fit_rows).select("sample_id").distinct()
    rows = own.where("text IS NOT NULL").join(F.broadcast(ids), "sample_id").orderBy("sample_id", "text").limit(fit_rows).collect()
    return [r[1] for r in rows], [str(r[2]) for r in rows]


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", fit_rows: int = FIT_ROWS, labelled: DataFrame | None = None) -> DataFrame:
    """(doc_id, language, cosine, rejected) for each row of docs.

    The model is fitted on at most fit_rows labelled rows of labelled, or of docs itself. Null and empty texts, and texts
    without letters, have cosine 0, are rejected and have no language; so have all rows if no row is labelled. A tie goes to the language that comes first
    in the alphabet. Rows that repeat are classified each; null identifiers stay null. Further columns are not read.
    """
    model = fit(*sample(docs if labelled is None else labelled, fit_rows, text_col, label_col, id_col))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            labels, cosines, rejected = shared.value.classify(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(labels, pa.string()), pa.array(cosines, pa.float64()), pa.array(rejected, pa.bool_())], ["doc_id", "language", "cosine", "rejected"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, language string, cosine double, rejected boolean")


def keep_identified(docs: DataFrame, text_col: str = "text", label_col: str = "lang", id_col: str = "doc_id", fit_rows: int = FIT_ROWS) -> DataFrame:
    """The rows of docs that identify() doesn't reject, in the columns of docs, with the language that it gives in label_col."""
    model = fit(*sample(docs, fit_rows, text_col, label_col, id_col))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at, to = docs.columns.index(text_col), docs.columns.index(label_col)

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            labels, _, rejected = shared.value.classify(b.column(at))
            yield b.set_column(to, b.schema.field(to), pa.array(labels, b.schema.field(to).type)).filter(pa.array(~rejected))

    return docs.mapInArrow(run, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
