"""Column expressions over paths and dotted names."""

from __future__ import annotations

import fnmatch
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_regex(glob: str) -> str:
    """Java pattern of a shell pattern in which * matches / too; **/x also stands for x at the root."""
    one = lambda g: fnmatch.translate(g).replace(r"\z", "$").replace(r"\Z", "$")
    return f"(?:{one(glob)})|(?:{one(glob[3:])})" if glob.startswith("**/") else one(glob)


def matches_any(path: Column, globs: list[str]) -> Column:
    """Whether a path matches one of the patterns; none match nothing."""
    return reduce(lambda a, b: a | b, [path.rlike(f"^(?:{glob_regex(g)})$") for g in globs], F.lit(False))


def hidden(path: Column) -> Column:
    """Whether some part of a path begins with a dot."""
    return path.rlike(r"(^|/)\.[^/]")


def in_scope(path: Column, include: list[str] = (), exclude: list[str] = ()) -> Column:
    """Not hidden, matched by include if there is any, and not by exclude."""
    ok = ~hidden(path) & ~matches_any(path, list(exclude))
    return ok & matches_any(path, list(include)) if include else ok


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """The last ending of a file's name with its dot, in lower case; none for a name that only begins with dots."""
    return F.lower(F.regexp_extract(basename(path), r"^\.*[^.].*(\.[^.]*)$", 1))


def extensions(path: Column) -> Column:
    """All endings of a file's name, longest first."""
    parts = F.split(F.lower(basename(path)), r"\.")
    n = F.size(parts)
    return F.when(n > 1, F.transform(F.sequence(F.lit(2), n), lambda k: F.concat(F.lit("."), F.array_join(F.slice(parts, k, n), ".")))).otherwise(F.array().cast("array<string>"))


def package_at(path: Column, depth: int) -> Column:
    """The first depth folders of a path, without a leading src; null for a file that has none."""
    parts = F.split(F.regexp_replace(path, "^src/", ""), "/")
    folders = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.when(F.size(folders) > 0, F.array_join(F.slice(folders, 1, depth), "/"))


def is_init(path: Column) -> Column:
    return basename(path) == "__init__.py"


def folder(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def leaf(path: Column) -> Column:
    """The last segment of a dotted name."""
    return F.element_at(F.split(path, r"\."), -1)


def address(text: Column) -> Column:
    """struct(file, first, last) of file:a-b; file is null for anything else."""
    pattern = r"^(.+?):(\d+)-(\d+)$"
    part = lambda k: F.nullif(F.regexp_extract(text, pattern, k), F.lit(""))
    return F.struct(part(1).alias("file"), part(2).cast("int").alias("first"), part(3).cast("int").alias("last"))
