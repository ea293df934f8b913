"""Blank lines between definitions, and unified diffs, as Pandas UDFs over whole texts."""

from __future__ import annotations

import difflib
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_HEAD = re.compile(r"^(\s*)(@|def |async def |class )")


def normalised(text: str) -> str:
    """Two blank lines before definitions at the top of a module, one before those within a class; comments and decorators stay with them."""
    lines = text.split("\n")
    out: list[str] = []
    k = 0
    while k < len(lines):
        m = _HEAD.match(lines[k])
        if m and not (out and out[-1].lstrip().startswith("@")):
            indent, comments = m[1], []
            while out and out[-1].strip().startswith("#") and out[-1].startswith(indent) and not out[-1][len(indent) : len(indent) + 1].isspace():
                comments.insert(0, out.pop())
            while out and not out[-1].strip():
                out.pop()
            opens = not out or (indent and out[-1].rstrip().endswith(":"))
            out += ([] if opens else [""] * (1 if indent else 2)) + comments
        out.append(lines[k])
        k += 1
    return "\n".join(out).rstrip("\n") + "\n" if text.strip() else ""


def unified(old: str, new: str, name: str = "file", most: int | None = None) -> str:
    """A unified diff; with most, its first lines and a note of how many follow."""
    lines = list(difflib.unified_diff(old.splitlines(), new.splitlines(), f"a/{name}", f"b/{name}", lineterm=""))
    if most is not None and len(lines) > most:
        lines = [*lines[:most], f"... {len(lines) - most} more lines"]
    return "\n".join(lines)


def numbered(old: str, new: str) -> str:
    """The changed lines, each with its number in the old text (-) or the new one (+), and those that stay as they are with three dots for each run."""
    a, b, out = old.splitlines(), new.splitlines(), []
    width = len(str(max(len(a), len(b), 1)))
    for op, i, j, k, m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
        if op == "equal":
            out.append("...")
            continue
        out += [f"{n + 1:{width}} - {a[n]}" for n in range(i, j)] + [f"{n + 1:{width}} + {b[n]}" for n in range(k, m)]
    return "\n".join(out)


@F.pandas_udf(StringType())
def normalised_udf(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else normalised(t))


@F.pandas_udf(StringType())
def unified_udf(old: pd.Series, new: pd.Series, name: pd.Series) -> pd.Series:
    return pd.Series([unified(a or "", b or "", n or "file") for a, b, n in zip(old, new, name, strict=True)], dtype=object)
