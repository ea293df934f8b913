"""Secret scan with multipart credential linking.

Parts of credentials are found with their places: secrets, access identifiers and endpoints. An interval join within a document
ties the parts whose gap is at most a window. Strong secrets are reported alone or linked; weak candidates, which might as well be
something else, only if a complementary part lies within their window.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter
from itertools import accumulate
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import written

WINDOW = 160
_EOL, _LEAD = r"[ \t]*[\"']?(?:\r?\n|\\r\\n|\\n)", r"[ \t>#*+|\"']*"
#: A key ends at its END line. Without one it is the base64 that follows the header and no more, and the header by itself is no key.
_PEM = (
    r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:"
    rf"(?:(?:{_EOL})+{_LEAD}(?:[A-Za-z0-9+/]+={{0,2}}|[A-Z][A-Za-z-]*: [^\n\\]*)|[ \t]+[A-Za-z0-9+/]{{16,}}={{0,2}})*(?:{_EOL})*{_LEAD}-----END [A-Z ]*PRIVATE KEY-----"
    rf"|(?:(?:(?:{_EOL})+{_LEAD}|[ \t]*)[A-Za-z0-9+/]{{16,}}={{0,2}}(?![A-Za-z0-9+/=]))+)"
)
_NAMED = r"(?i:(?<![A-Za-z0-9])(?:[A-Za-z0-9]+[_.-]){0,8}(?:token|secret|passw(?:or)?d|pwd|api[_-]?key|access[_-]?key|auth[_-]?key|private[_-]?key|credentials?)\s*(?:=|:(?!//)|:=|=>)\s*)"
SECRET = [
    # (kind, strong, pattern with the value in group 1, shortest value, least bits of entropy a sign)
    ("private_key", True, re.compile(f"({_PEM})"), 0, 0.0),
    ("prefixed", True, re.compile(r"(?<![A-Za-z0-9])((?:gh[pousr]_[A-Za-z0-9]{30,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{30,}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]*))"), 0, 0.0),
    ("named_quoted", True, re.compile(_NAMED + r"""["']([^"'\s]{6,})["']"""), 6, 2.0),
    ("named_bare", False, re.compile(_NAMED + r"""([^\s"',;]{6,})"""), 6, 2.0),
    ("opaque", False, re.compile(r"(?<![A-Za-z0-9+/_-])((?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{24,}={0,2})(?![A-Za-z0-9+/_=-])"), 24, 3.0),
]
IDENTIFIER = [
    ("access_key_id", re.compile(r"(?<![A-Za-z0-9])((?:AKIA|ASIA)[A-Z0-9]{16})(?![A-Za-z0-9])")),
    ("email", re.compile(r"(?<![\w.+-])([\w.+-]+@[\w-]+(?:\.[\w-]+)+)")),
    ("named_identifier", re.compile(r"""(?i:(?<![a-z0-9])(?:user(?:name)?|login|account(?:[_-]?name)?|client[_-]?id|key[_-]?id|uid)\s*[=:]\s*)["']?([^\s"',;]{2,})""")),
]
ENDPOINT = [
    ("url", re.compile(r"([A-Za-z][A-Za-z0-9+.-]{0,20}://[^\s\"'<>]+)")),
    ("address", re.compile(r"(?<![\d.])((?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}(?::\d{1,5})?)(?![\d.]*\d)")),
    ("named_endpoint", re.compile(r"""(?i:(?<![a-z0-9])(?:host(?:name)?|endpoint(?:[_-]?suffix)?|server|url)\s*[=:]\s*)["']?([^\s"',;]{3,})""")),
]
#: What each text with a secret of SECRET has.
MAYBE = r"(?i)(token|secret|passw|pwd|key|credential|gh[pousr]_|xox[abprs]-|sk_live_|AIza|eyJ|[A-Za-z0-9+/_-]{24})"
PARTS = "doc_id long, digest binary, role string, kind string, strong boolean, start int, stop int, value_sha256 string"


def entropy(value: str) -> float:
    """Bits a sign."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


def parts(text: str) -> list[tuple[str, str, bool, int, int, str]]:
    """(role, kind, strong, start, stop, value) of a text's parts, none over an earlier one of its role. Without a secret there are none.

    Parts of different roles may overlap, as a URL and the key in it do; their gap is 0 then. A part that is no more than the secret itself, or whose path the
    secret is, doesn't complement it: with no other secret in the text it is left out.
    """
    taken: dict[str, list[tuple[int, int]]] = {"secret": [], "identifier": [], "endpoint": []}
    out = []

    def free(role: str, a: int, b: int) -> bool:
        if any(x < b and a < y for x, y in taken[role]):
            return False
        taken[role].append((a, b))
        return True

    for kind, strong, pattern, shortest, least in SECRET:
        for m in pattern.finditer(text):
            value = m[1]
            if len(value) >= shortest and entropy(value) >= least and free("secret", *m.span(1)):
                out.append(("secret", kind, strong, *m.span(1), value))
    secrets = [(kind, a, b) for _, kind, _, a, b, _ in out]

    def own(kind: str, a: int, b: int, secret: str, x: int, y: int) -> bool:
        if kind == "url" and secret == "opaque" and a <= x and y <= b:
            return not any(s in text[a:x] for s in "?#=") and text[y : y + 1] != "@"
        return kind in ("email", "url", "address") and x <= a and b <= y

    if out:
        for role, patterns in (("identifier", IDENTIFIER), ("endpoint", ENDPOINT)):
            for kind, pattern in patterns:
                for m in pattern.finditer(text):
                    if not all(own(kind, *m.span(1), *s) for s in secrets) and free(role, *m.span(1)):
                        out.append((role, kind, True, *m.span(1), m[1]))
    return out


def reported(found: list[tuple[str, str, bool, int, int, str]], window: int = WINDOW) -> list[tuple[int, int]]:
    """(start, stop) of the secrets among a text's parts() that scan() reports, by a sweep: strong ones, and weak ones with another part within window."""
    others = sorted((a, z) for role, _, _, a, z, _ in found if role != "secret")
    starts, ends = [a for a, _ in others], list(accumulate((z for _, z in others), max))

    def linked(a: int, z: int) -> bool:
        k = bisect_right(starts, z + window)
        return k > 0 and ends[k - 1] >= a - window

    return sorted((a, z) for role, _, strong, a, z, _ in found if role == "secret" and (strong or linked(a, z)))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.binary(), pa.string(), pa.string(), pa.bool_(), pa.int32(), pa.int32(), pa.string()]
    for b in batches:
        maybe = b.filter(pc.fill_null(pc.match_substring_regex(b.column(1), MAYBE), False))
        rows = []
        for i, text in zip(maybe.column(0).to_pylist(), maybe.column(1).to_pylist(), strict=True):
            if found := parts(text):
                key = hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest()[:16]
                rows += [(i, key, *p[:5], hashlib.sha256(p[5].encode("utf-8", "surrogatepass")).hexdigest()) for p in found]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 8, kinds, strict=True)], ["doc_id", "digest", "role", "kind", "strong", "start", "stop", "value_sha256"])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row for each reported secret: doc_id, start, stop, kind, confidence, value_sha256, identifiers, endpoints.

    start and stop count characters. identifiers and endpoints list the kinds and places of the parts that lie within window
    characters, nearest first, then by place. confidence is "linked" with such a part, else "alone"; weak candidates are reported only when linked. The value itself
    never leaves the scan. The scope of a link is one text: equal texts are linked once, whatever rows hold them. Null and empty texts have no rows; a null identifier stays null;
    rows that repeat an identifier and a text are reported once, and an identifier of several texts for each of them. An empty table gives no rows; further columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    # three uses follow: the texts are read once, and the parts, without their values, are kept
    every = written(rows.mapInArrow(_scan, PARTS), "parts")
    found = every.drop("doc_id").distinct()
    # places are put into buckets of the window's width: a part within reach is in the same one or a neighbour
    secrets = found.where("role = 'secret'").drop("role").withColumns({"lo": F.floor(F.col("start") / window) - 1, "hi": F.floor(F.col("stop") / window) + 1})
    others = found.where("role <> 'secret'").select("digest", "role", F.col("kind").alias("part"), F.col("start").alias("p_start"), F.col("stop").alias("p_stop"), F.explode(F.sequence(F.floor(F.col("start") / window), F.floor(F.col("stop") / window))).alias("bucket"))
    gap = F.greatest(F.col("p_start") - F.col("stop"), F.col("start") - F.col("p_stop"), F.lit(0))
    reach = secrets.withColumn("bucket", F.explode(F.sequence("lo", "hi"))).join(others, ["digest", "bucket"]).withColumn("gap", gap).where(F.col("gap") <= window)
    key = ["digest", "start", "stop", "kind", "value_sha256"]
    part = F.struct("gap", F.col("p_start").alias("start"), F.col("p_stop").alias("stop"), F.col("part").alias("kind"))
    links = reach.groupBy(*key).agg(*[F.array_sort(F.collect_set(F.when(F.col("role") == role, part))).alias(f"{role}s") for role in ("identifier", "endpoint")])
    none = F.array().cast("array<struct<gap:int,start:int,stop:int,kind:string>>")
    linked = F.col("identifiers").isNotNull()
    said = secrets.drop("lo", "hi").join(links, key, "left").where(F.col("strong") | linked)
    owners = every.where("role = 'secret'").select("doc_id", "digest").distinct()
    return owners.join(said, "digest").select("doc_id", "start", "stop", "kind", "strong", F.when(linked, "linked").otherwise("alone").alias("confidence"), "value_sha256", F.coalesce("identifiers", none).alias("identifiers"), F.coalesce("endpoints", none).alias("endpoints"))


def redacted(text: str, window: int = WINDOW) -> str:
    """text with each reported secret replaced by [SECRET]."""
    out, last = [], 0
    for a, z in reported(parts(text), window):
        out += [text[last:a], "[SECRET]"]
        last = z
    return "".join([*out, text[last:]])


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", count_col: str = "n_chars", window: int = WINDOW) -> DataFrame:
    """docs, with each secret that scan() reports replaced by [SECRET] and count_col, if there, set to the new length.

    A text is its own scope, so that one pass over the rows links and replaces: nothing is shuffled, and identifiers may be null or repeat. Rows without a reported
    secret, null and empty texts among them, don't change; rows that repeat change alike. Of equal and overlapping candidates the pattern that comes first counts. An empty table gives no rows.
    """

    @F.arrow_udf("string")
    def clean(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            maybe = pc.fill_null(pc.match_substring_regex(b, MAYBE), False)
            new = pa.array([redacted(t, window) for t in b.filter(maybe).to_pylist()], b.type)
            yield pc.replace_with_mask(b, maybe, new)

    new = clean(F.col(text_col))
    out = docs.withColumn(text_col, new)
    if count_col in docs.columns:
        same = F.col(text_col).eqNullSafe(new)
        out = docs.withColumns({text_col: new, count_col: F.when(same, F.col(count_col)).otherwise(F.length(new)).cast(docs.schema[count_col].dataType)})
    return out


def query(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
