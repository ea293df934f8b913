"""Layered settings: later layers win, sets unite."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class ProjectConfig:
    """Settings of a project; what isn't given has these defaults."""

    include: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)
    disabled: list[str] = field(default_factory=list)
    severity: dict[str, str] = field(default_factory=dict)
    min_severity: str = "warning"
    map_limit: int = 10
    thresholds: dict[str, tuple[int, int, int]] = field(default_factory=dict)


def parse_config(own: str | None = None, pyproject: str | None = None, section: str = "astrolith") -> ProjectConfig:
    """Of a file of its own, else of pyproject's tool section; broken TOML means defaults."""
    try:
        doc: dict[str, Any] = tomllib.loads(own) if own is not None else tomllib.loads(pyproject or "").get("tool", {}).get(section, {})
        known = {k: v for k, v in doc.items() if k in ProjectConfig.__dataclass_fields__}
        known["thresholds"] = {k: (v["info"], v["warning"], v["error"]) for k, v in known.get("thresholds", {}).items()}
        return ProjectConfig(**known)
    except (tomllib.TOMLDecodeError, KeyError, TypeError, AttributeError):
        return ProjectConfig()


def last_wins(layers: DataFrame, key: list[str], layer: str = "layer") -> DataFrame:
    """The row of the highest layer of each key. Ties within a layer go to the largest row."""
    others = [c for c in layers.columns if c not in key and c != layer]
    best = F.max_by(F.struct(*others, F.col(layer)), F.struct(layer, *others))
    return layers.groupBy(*key).agg(best.alias("_b")).select(*key, *[F.col(f"_b.{c}") for c in [*others, layer]])


def united(*layers: DataFrame) -> DataFrame:
    out = layers[0]
    for x in layers[1:]:
        out = out.unionByName(x)
    return out.distinct()


def active_frameworks(packages: DataFrame, deps: DataFrame, files: DataFrame) -> DataFrame:
    """Names of packages(name, detect_deps, detect_files) of which a dependency is declared or a file is there."""
    by_dep = packages.select("name", F.explode("detect_deps").alias("dep")).join(deps.select(F.col("name").alias("dep")).distinct(), "dep", "left_semi").select("name")
    by_file = packages.select("name", F.explode("detect_files").alias("file")).join(files.select("file").distinct(), "file", "left_semi").select("name")
    return by_dep.union(by_file).distinct()
