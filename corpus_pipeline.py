"""Corpus pipeline: language ID, exact dedup, near-dedup, secret scan, best-fit packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the docs of the next.
All but the last return the columns of documents. The stages are too much for SQL (n-gram vectors, fingerprints, bounded-space
packing), so that ORACLE_SQL is None; tests/llm holds run() against a brute-force version.

In every stage an empty table gives no rows, further columns pass through whatever their names, rows that repeat are treated alike, and texts of any length are taken whole.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from astrolith.llm import exact_dedup, language, packing, secrets, simhash
from astrolith.llm.session import shared_dir

ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language, lang being what the classifier says; rejected ones go.

    Null and empty texts, and texts without letters, are rejected, and so is everything if no row has a lang to fit on. A tie goes to the first language of the
    alphabet. Null identifiers and rows that repeat are classified each.
    """
    return language.keep_identified(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts, the one with the smallest doc_id.

    Rows with a null doc_id or text stay; so do rows that repeat the smallest doc_id of their text, as one document. A doc_id of several texts loses only those
    that a smaller one has. Empty texts are equal to each other.
    """
    return exact_dedup.drop_exact_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document with the smallest doc_id.

    Rows with a null doc_id, a null text or a text without a letter or number stay, and so do rows that repeat the smallest doc_id of their group. A doc_id of several
    texts loses only those in a group with a smaller one.
    """
    return simhash.drop_near_duplicates(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with reported secrets replaced by [SECRET] and n_chars set to the new length.

    Null and empty texts, and texts without a reported secret, don't change; a null doc_id is no exception, and rows that repeat change alike.
    """
    return secrets.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of token ids, each with the documents and places that its pieces come from.

    A null or empty text has a row of its own without tokens. A null doc_id stays null, and rows that repeat are packed each. Of bins with the same free space the first is
    taken. Columns other than doc_id and text end here.
    """
    return packing.best_fit(docs)


STAGES = [("language_id", language_id), ("exact_dedup", exact), ("near_dedup", near), ("secret_scan", secret_scan), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        out.write.parquet(f"{base}/{k}-{name}")
        docs = spark.read.parquet(f"{base}/{k}-{name}")
    return docs
