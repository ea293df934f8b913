"""Dependencies that a project declares, from manifests(path, content)."""

from __future__ import annotations

import configparser
import re
import tomllib
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import dep_name

#: Kinds of declarations, first the ones that win.
PRIORITY = {"project": 10, "optional": 20, "group": 30, "poetry": 40, "requirements": 50, "setup_cfg": 60, "pipfile": 70}


def _pyproject(text: str) -> Iterator[tuple[str, str]]:
    doc = tomllib.loads(text)
    project = doc.get("project", {})
    yield from (("project", x) for x in project.get("dependencies", []))
    for own in project.get("optional-dependencies", {}).values():
        yield from (("optional", x) for x in own)
    for own in doc.get("dependency-groups", {}).values():
        yield from (("group", x) for x in own if isinstance(x, str))
    poetry = doc.get("tool", {}).get("poetry", {})
    for own in [poetry.get("dependencies", {}), *[g.get("dependencies", {}) for g in poetry.get("group", {}).values()]]:
        yield from (("poetry", x) for x in own if x.lower() != "python")


def declared(path: str, text: str) -> list[tuple[str, str]]:
    """(kind, requirement) of a manifest; a broken one has none."""
    name = path.rsplit("/", 1)[-1]
    try:
        if name == "pyproject.toml":
            return list(_pyproject(text))
        if re.fullmatch(r"requirements.*\.txt", name):
            return [("requirements", x) for x in (y.split(" #")[0].strip() for y in text.splitlines()) if x and not x.startswith(("#", "-"))]
        if name == "setup.cfg":
            c = configparser.ConfigParser()
            c.read_string(text)
            return [("setup_cfg", x.strip()) for x in c.get("options", "install_requires", fallback="").splitlines() if x.strip()]
        if name == "Pipfile":
            return [("pipfile", x) for x in tomllib.loads(text).get("packages", {})]
    except (tomllib.TOMLDecodeError, configparser.Error, AttributeError, TypeError):
        pass
    return []


def requirements(manifests: DataFrame) -> DataFrame:
    """(path, kind, prio, pos, requirement, name) of manifests(path, content). Null contents declare nothing."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows: list[tuple[Any, ...]] = []
            for path, text in zip(f["path"], f["content"], strict=True):
                rows += [(path, kind, PRIORITY[kind], k, r) for k, (kind, r) in enumerate(declared(path, text))]
            yield pd.DataFrame(rows, columns=["path", "kind", "prio", "pos", "requirement"])

    rows = manifests.where(F.col("content").isNotNull() & F.col("path").isNotNull()).select("path", F.col("content").cast("string").alias("content"))
    return rows.mapInPandas(run, "path string, kind string, prio int, pos int, requirement string").withColumn("name", dep_name(F.col("requirement"))).where("name <> ''")


def first_of_each(deps: DataFrame, name: str = "name", order: tuple[str, ...] = ("prio", "path", "pos")) -> DataFrame:
    """One row of each name: the first by order."""
    others = [c for c in deps.columns if c != name]
    first: Column = F.min_by(F.struct(*others), F.struct(*order))
    return deps.groupBy(name).agg(first.alias("_first")).select(name, *[F.col(f"_first.{c}") for c in others])
