"""PII: information-theoretic sanitisation.

Protected entities (addresses, numbers of phones, cards and accounts, identifiers) are found by patterns and generalised to their
kind. Other terms of a text may still give an entity away: what a term t says about an entity c is measured by their pointwise mutual
information over the contexts of the corpus, PMI(c;t) = log p(c,t) / (p(c) p(t)). A term with PMI(c;t) >= IC(c) / alpha, IC(c) = -log p(c)
being all there is to say about c, exceeds the disclosure threshold: in documents with c it is generalised or removed. The estimate counts with its lower
bound, which few distinct contexts widen.

A context is a sentence or line, cut into windows of at most WINDOW words.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .exact_dedup import digest
from .session import written

#: Words in a context.
WINDOW = 64
#: The share of an entity's information content that a term may give away is 1 / ALPHA.
ALPHA = 1.5
#: Normal quantile of the estimate's lower bound: 90% on one side.
QUANTILE = 1.2816
#: Terms that a task counts before it passes them on.
HELD_TERMS = 1 << 20
_KINDS = {
    "EMAIL": r"(?<![\w.+%-])[\w.+%-]+@[\w-]+(?:\.[\w-]+)+",
    "ID": r"(?<![0-9A-Za-z])[0-9a-fA-F]{32,}(?![0-9A-Za-z])",
    "IBAN": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
    "CARD": r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])",
    "SSN": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "IP": r"(?<![0-9.])(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}(?![0-9])(?!\.[0-9])",
    "PHONE": r"(?<![0-9+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])|(?<![0-9])\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,5}(?![0-9])",
}
ENTITY = re.compile("|".join(f"(?P<{k}>{p})" for k, p in _KINDS.items()))
#: What each text with an entity has. Java, RE2 and Python read it alike.
MAYBE = r"@|[0-9][0-9(). -]{5,}[0-9]|[0-9a-fA-F]{32}|[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}"
_FOUND = "digest binary, entity long, term long, context long, n long"
_END = np.array([ord(x) for x in ".!?"], np.uint32)


def entities(text: str) -> list[tuple[int, int, str, int]]:
    """(start, stop, kind, hash of the value without signs between) of a text's entities."""
    out = []
    for m in ENTITY.finditer(text):
        value = re.sub(r"[^\w@]", "", m[0]).lower()
        out.append((*m.span(), m.lastgroup, xxhash.xxh3_64_intdigest(f"{m.lastgroup}:{value}") >> 1))
    return out


def terms(cp: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, hashes, contexts) of the words of a slice's texts, in lower case, and the hash of each context."""
    low = T.lowered()[cp]
    starts, ends, _ = T.words(low, offsets)
    h = (T.hashes(low, starts, ends) >> np.uint64(1)).astype(np.int64) | 1  # 0 is no term
    space = T.classes()[cp] == T.SPACE
    edge = np.zeros(len(cp) + 1, bool)
    edge[1:] = cp == 10
    edge[1:-1] |= np.isin(cp[:-1], _END) & space[1:]
    edge[offsets] = True
    sentence = np.cumsum(edge)[starts]
    if not len(starts):
        return starts, ends, h, np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.concatenate([[True], sentence[1:] != sentence[:-1]])
    place = np.arange(len(starts)) - np.maximum.accumulate(np.where(first, np.arange(len(starts)), 0))
    new = first | (place % WINDOW == 0)
    context = np.cumsum(new) - 1
    begin = np.flatnonzero(new)
    last = np.append(begin[1:], len(starts)) - 1
    return starts, ends, h, context, T.hashes(low, starts[begin], ends[last]).view(np.int64)


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (digest, entity, term, context, 1) for each entity, term of its context and occurrence; term 0 stands for the context. Without a
    digest: n contexts with a term; term 0 again for all."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def counted(final: bool) -> Iterator[pa.RecordBatch]:
        if not held:
            return
        keys, back = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
        n = np.bincount(back, np.concatenate([n for _, n in held])).astype(np.int64)
        held[:] = [(keys, n)]
        if final or len(keys) >= HELD_TERMS:
            held.clear()
            none = pa.nulls(len(keys), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.nulls(len(keys), pa.binary()), none, pa.array(keys), none, pa.array(n)], ["digest", "entity", "term", "context", "n"])

    for b in batches:
        maybe = np.asarray(pc.fill_null(pc.match_substring_regex(b.column(0), MAYBE), False))
        strings = b.column(0).to_pylist()
        for i, j, cp, offsets in T.slices(b.column(0)):
            starts, ends, h, context, context_hash = terms(cp, offsets)
            plain = np.ones(len(starts), bool)
            rows = []
            for k in np.flatnonzero(maybe[i:j]).tolist():
                own = entities(strings[i + k])
                if not own:
                    continue
                key = hashlib.sha256(strings[i + k].encode("utf-8", "surrogatepass")).digest()[:16]
                for a, z, _, e in own:
                    x, y = np.searchsorted(ends, offsets[k] + a, "right"), np.searchsorted(starts, offsets[k] + z)
                    plain[x:y] = False
                    rows += [(key, e, c) for c in np.unique(context[x:y]).tolist()]
            pairs = np.unique(np.stack([context[plain], h[plain]], 1), axis=0) if plain.any() else np.zeros((0, 2), np.int64)
            t, n = np.unique(pairs[:, 1], return_counts=True)
            held.append((np.append(t, 0), np.append(n, len(context_hash))))
            if len(held) >= 16:
                yield from counted(False)
            if rows:
                first = np.searchsorted(pairs[:, 0], np.arange(len(context_hash) + 1))
                out = [(key, e, t, c) for key, e, c in dict.fromkeys(rows) for t in [0, *pairs[first[c] : first[c + 1], 1].tolist()]]
                key, e, t, c = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(key, pa.binary()), pa.array(e, pa.int64()), pa.array(t, pa.int64()), pa.array(context_hash[list(c)]), pa.array(np.ones(len(c), np.int64))], ["digest", "entity", "term", "context", "n"])
    yield from counted(True)


def disclosing(docs: DataFrame, text_col: str = "text", alpha: float = ALPHA) -> tuple[DataFrame, DataFrame]:
    """((entity, term, n_entity, n_term, n_both, n_contexts, pmi, content) of terms over the threshold, (digest, entity, term) of them by text).

    All counts are of contexts, over all rows of docs. Entities and terms are hashes. With k distinct contexts that an entity and a term share, copies of one being one,
    pmi is lessened by log2 of k over the lower bound of a Poisson mean of which k were seen (Wilson and Hilferty): 3.3 bits for k = 1, 2.0 for k = 2, 0.7 for k = 10.
    """
    found = written(docs.select(F.col(text_col)).where(F.col(text_col).isNotNull()).mapInArrow(_gather, _FOUND), "sanitise")
    here, counts = found.where("digest IS NOT NULL"), found.where("digest IS NULL")
    total = counts.where("term = 0").agg(F.sum("n").alias("n_contexts"))
    one = here.where("term = 0").groupBy("entity").agg(F.sum("n").alias("n_entity"))
    both = here.where("term <> 0").groupBy("entity", "term", "context").agg(F.sum("n").alias("n")).groupBy("entity", "term").agg(F.sum("n").alias("n_both"), F.count("*").alias("n_distinct"))
    each = counts.where("term <> 0").groupBy("term").agg(F.sum("n").alias("n_term"))
    table = both.join(one, "entity").join(each, "term").crossJoin(total)
    ratio = lambda a, b: F.log2(F.col(a).cast("double") / F.col(b))
    bound = 3 * F.log2(1 - 1 / (9 * F.col("n_distinct")) - QUANTILE / (3 * F.sqrt("n_distinct")))
    table = table.withColumns({"content": -ratio("n_entity", "n_contexts"), "pmi": ratio("n_both", "n_entity") - ratio("n_term", "n_contexts") + bound})
    over = table.where(F.col("pmi") >= F.col("content") / alpha).drop("n_distinct")
    return over, here.where("term = 0").select("digest", "entity").distinct().join(over.select("entity", "term"), "entity")


def sanitised(text: str, disclosing: set[int]) -> tuple[str, int, int]:
    """(text, entities, terms replaced). Entities become their kind in brackets; a term with a figure [NUMBER], one with a capital [NAME];
    any other term goes, with the white space before it."""
    spans = [(a, z, f"[{kind}]") for a, z, kind, _ in entities(text)]
    n = len(spans)
    if disclosing and text:
        cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        starts, ends, h, _, _ = terms(cp, np.array([0, len(cp)]))
        hit = np.isin(h, np.fromiter(disclosing, np.int64))
        at = 0
        for a, z in zip(starts[hit].tolist(), ends[hit].tolist(), strict=True):
            while at < n and spans[at][1] <= a:
                at += 1
            if at < n and spans[at][0] < z:
                continue
            word = text[a:z]
            if any(x.isdigit() for x in word):
                spans.append((a, z, "[NUMBER]"))
            elif word[0].isupper():
                spans.append((a, z, "[NAME]"))
            else:
                spans.append((a - (a > 0 and text[a - 1] in " \t"), z, ""))
    out, last = [], 0
    for a, z, new in sorted(spans):
        out += [text[last : max(a, last)], new]
        last = z
    return "".join([*out, text[last:]]), n, len(spans) - n


def _sanitise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        new = [sanitised(t, set(own or ())) for t, own in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
        texts, n, m = zip(*new, strict=True) if new else ((), (), ())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(n, pa.int32()), pa.array(m, pa.int32())], ["doc_id", "text", "n_entities", "n_terms"])


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", alpha: float = ALPHA) -> DataFrame:
    """(doc_id, text, n_entities, n_terms) for each row of docs: the sanitised text, and how many places were replaced.

    Texts without an entity stay as they are; null texts stay null and empty ones empty. Null identifiers stay null; rows that repeat are each
    in the result, with the same text. An empty table gives no rows; further columns are not read. A term exactly at the threshold goes.
    """
    _, by_text = disclosing(docs, text_col, alpha)
    listed = by_text.groupBy("digest").agg(F.collect_set("term").alias("terms"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    maybe = F.coalesce(F.col("text").rlike(MAYBE), F.lit(False))
    rest = rows.where(~maybe).select("doc_id", "text", F.lit(0).alias("n_entities"), F.lit(0).alias("n_terms"))
    # only texts that may hold an entity are shuffled; the key is the text itself, so that identifiers may be null or repeat
    some = rows.where(maybe).withColumn("digest", digest("text")).join(listed, "digest", "left").select("doc_id", "text", "terms")
    return rest.unionByName(some.mapInArrow(_sanitise, "doc_id long, text string, n_entities int, n_terms int"))


def query(spark, sf_dir: str) -> DataFrame:
    return sanitise(spark.read.parquet(f"{sf_dir}/documents.parquet"))
