"""Source trees as files(file, content, length, mtime), and their languages."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths
from . import language_data

#: (name, type, popular, endings, file names, interpreters, aliases).
LANGUAGES = language_data.rows()
_MODELINE = r"(?s)-\*-\s*(?:.*?mode:\s*)?([A-Za-z0-9+#_-]+)\s*(?:;.*?)?-\*-|(?:\b(?:vi|vim|ex):\s*(?:.*?\s)?|\b(?:vi|vim|ex):\s*set?\s.*?)(?:ft|filetype|syntax)=([A-Za-z0-9+#_-]+)"
#: A section's digit with letters, or one of the endings that manual pages have.
_MANPAGE = r"(?i)\.([1-9]([a-z_][a-z_0-9]*)?|man|mdoc|0p|n)(\.in)?$"
#: Characters that tell languages of one ending apart.
HEURISTIC_CHARS = 50 * 1024


def read_tree(spark: SparkSession, root: str, include: list[str] = (), exclude: list[str] = ()) -> DataFrame:
    """files(file, content, length, mtime) of a folder tree, by path relative to root, without hidden ones."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    prefix = F.regexp_replace(F.lit(root.rstrip("/") + "/"), r"^file:/+", "/")
    rel = F.expr("substring(clean, length(prefix) + 1)")
    files = raw.select(F.regexp_replace("path", r"^file:/+", "/").alias("clean"), prefix.alias("prefix"), "content", "length", F.unix_micros("modificationTime").alias("micros"))
    return files.select(rel.alias("file"), "content", "length", (F.col("micros") / 1e6).alias("mtime")).where(paths.in_scope(F.col("file"), include, exclude))


def languages(spark: SparkSession) -> DataFrame:
    """The language dimension: name, type, popular, extensions, filenames, interpreters, aliases, rank."""
    return spark.createDataFrame([(*x, k) for k, x in enumerate(LANGUAGES)], "name string, type string, popular boolean, extensions array<string>, filenames array<string>, interpreters array<string>, aliases array<string>, rank int")


def _listed(at: int) -> dict[str, list[str]]:
    """Names of the languages that list a key, in rank order, by the key in lower case."""
    table: dict[str, list[str]] = {}
    for x in LANGUAGES:
        for v in x[at]:
            table.setdefault(v.lower(), []).append(x[0])
    return table


_ENDINGS, _NAMES, _INTERPRETERS, _ALIASES = map(_listed, (3, 4, 5, 6))
_KINDS = {"programming": 0, "markup": 1, "prose": 2, "data": 3}
_RANK = {x[0]: (len(x[3]), _KINDS[x[1]], k) for k, x in enumerate(LANGUAGES)}


def interpreter(text: Column) -> Column:
    """The interpreter that a first line #! names: env is skipped with its flags and settings, and a version's ending goes."""
    first = F.regexp_extract(text, r"^#!\s*([^\n\r]*)", 1)
    words = F.filter(F.split(F.trim(first), r"\s+"), lambda w: w != "")
    names = F.transform(words, lambda w: F.element_at(F.split(w, "/"), -1))
    past_env = F.filter(F.slice(names, 2, F.greatest(F.size(names), F.lit(1))), lambda w: ~w.startswith("-") & ~w.contains("="))
    name = F.when(F.size(names) == 0, None).when(F.get(names, F.lit(0)) == "env", F.get(past_env, F.lit(0))).otherwise(F.get(names, F.lit(0)))
    return F.regexp_replace(name, r"(\.\d+)+$", "")


def modeline(text: Column) -> Column:
    """The language alias in an editor's mode line within the first or last five lines."""
    parts = F.split(text, "\n")
    ends = F.array_join(F.concat(F.slice(parts, 1, 5), F.slice(parts, F.greatest(F.size(parts) - 4, F.lit(1)), 5)), "\n")
    found = F.coalesce(F.nullif(F.regexp_extract(ends, _MODELINE, 1), F.lit("")), F.nullif(F.regexp_extract(ends, _MODELINE, 2), F.lit("")))
    return F.when(~ends.contains("UseVimball"), found)


def _by_text(ending: Column, text: Column) -> Column:
    """The language that the beginning of a text decides on among those of its ending; null if nothing does."""
    head, out = F.substring(text, 1, HEURISTIC_CHARS), F.lit(None).cast("string")
    for endings, choices in reversed(language_data.HEURISTICS):
        own = F.coalesce(*[F.when(head.rlike(p) if p else F.lit(True), F.lit(name)) for name, p in choices])
        out = F.when(ending.isin(*endings), own).otherwise(out)
    return out


def _best(candidates: list[str], ending: str | None) -> str | None:
    """One of several languages: what its ending is known for, else the one with the fewest endings, programs before markup, prose and data, then the first in the list."""
    preferred = language_data.PREFERRED.get(ending)
    return preferred if preferred in candidates else min(candidates, key=_RANK.__getitem__, default=None)


def decide(alias: str | None, name: str | None, interpreter: str | None, double: str | None, ending: str | None, xml: bool | None, manpage: bool | None, by_text: str | None) -> str | None:
    """The language of what language() finds in a file, by its strategies in their order: one candidate decides, several narrow down, and of what is left the best known is taken."""
    low = lambda x: x.lower() if x is not None else None
    strategies = [
        _ALIASES.get(low(alias)), _NAMES.get(low(name)), _INTERPRETERS.get(low(interpreter)), _ENDINGS.get(low(double)) or _ENDINGS.get(low(ending)),
        ["XML"] if xml else None, ["Roff Manpage", "Roff"] if manpage else None, [by_text] if by_text is not None else None,
    ]
    state: list[str] = []
    for s in strategies:
        if not s or len(state) == 1:
            continue
        state = [x for x in dict.fromkeys(state) if x in s] or state if state else s
    return _best(state, ending)


def _decided(*columns: pd.Series) -> pd.Series:
    return pd.Series([decide(*[None if x is None or x != x else x for x in row]) for row in zip(*columns, strict=True)], dtype=object)


def language(file: Column, text: Column) -> Column:
    """Language of a file: mode line, file name, first line, ending, XML head, manual page, then what tells languages of its ending apart. Null if nothing fits.

    Expressions find each in the text, once; what they find is short, and a worker looks it up in the dimension.
    """
    name, ending = paths.basename(file), paths.extension(file)
    found = [
        modeline(text), name, F.when(text.startswith("#!"), interpreter(text)), F.regexp_extract(name, r"(\.[^.]+\.[^.]+)$", 1), ending,
        text.rlike(r"^[^\n]*\n?[^\n]*<\?xml version="), name.rlike(_MANPAGE), _by_text(ending, text),
    ]
    return F.pandas_udf(_decided, "string")(*found)


def classify(files: DataFrame) -> DataFrame:
    """files with language; binary content has none."""
    from ..functions.text import is_binary

    text = F.decode("content", "UTF-8")
    return files.withColumn("language", F.when(~is_binary(F.col("content")), language(F.col("file"), text)))
