"""What a project adds: package specs in TOML, rules in modules of its own, and hooks that frames pass through."""

from __future__ import annotations

import importlib.util
import tomllib
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..operators import rules
from ..schemas import SEVERITY

PACKAGE = "name string, category string, import_name string, severity string, prefixes array<struct<prefix:string,severity:string>>, orphan_patterns array<string>, detect_deps array<string>, detect_files array<string>, exclude map<string,array<string>>"


class SpecError(ValueError):
    """What is wrong with a spec, a line for each fault."""


@dataclass
class Spec:
    """What is known of a package: where it belongs, how it is imported, which of its calls matter at import, and how a project that uses it is told."""

    name: str
    category: str
    import_name: str | None = None
    severity: str = "info"
    calls: dict[str, list[str]] = field(default_factory=dict)
    orphan_patterns: list[str] = field(default_factory=list)
    detect_deps: list[str] = field(default_factory=list)
    detect_files: list[str] = field(default_factory=list)
    exclude: dict[str, list[str]] = field(default_factory=dict)


_LISTS = ("orphan_patterns", "detect_deps", "detect_files")


def parse_spec(text: str) -> Spec:
    """A spec of a TOML text with name and category, and the other fields of Spec where they are given. Faults raise SpecError, all of them at once."""
    try:
        doc = tomllib.loads(text)
    except tomllib.TOMLDecodeError as e:
        raise SpecError(f"no TOML: {e}") from e
    wrong = [f"{k} is missing" for k in ("name", "category") if not doc.get(k)]
    wrong += [f"{k} is unknown" for k in doc if k not in Spec.__dataclass_fields__]
    strings = lambda v: isinstance(v, list) and all(isinstance(x, str) for x in v)
    wrong += [f"{k} is no text" for k in ("name", "category", "import_name", "severity") if k in doc and not isinstance(doc[k], str)]
    wrong += [f"{k} is no list of texts" for k in _LISTS if k in doc and not strings(doc[k])]
    wrong += [f"{k} is no table of lists of texts" for k in ("calls", "exclude") if k in doc and not (isinstance(doc[k], dict) and all(map(strings, doc[k].values())))]
    levels = [doc.get("severity", "info"), *(doc.get("calls", {}) if isinstance(doc.get("calls", {}), dict) else [])]
    wrong += [f"{x} is no severity" for x in levels if isinstance(x, str) and x not in SEVERITY]
    if wrong:
        raise SpecError("\n".join(wrong))
    return Spec(**doc)


def packages(spark: SparkSession, specs: Iterable[Spec]) -> DataFrame:
    """PACKAGE rows of specs; of several with a name, the last one counts."""
    own = {s.name: s for s in specs}.values()
    rows = [(s.name, s.category, s.import_name or s.name.replace("-", "_"), s.severity, [(c, level) for level, cs in s.calls.items() for c in cs], s.orphan_patterns, s.detect_deps or [s.name], s.detect_files, s.exclude) for s in own]
    return spark.createDataFrame(rows, PACKAGE)


def load_specs(folder: str) -> tuple[list[Spec], dict[str, str]]:
    """(specs, faults by file) of the TOML files of a folder, in the order of their names."""
    found, wrong = [], {}
    for p in sorted(Path(folder).glob("*.toml")):
        try:
            found.append(parse_spec(p.read_text("utf-8")))
        except SpecError as e:
            wrong[p.name] = str(e)
    return found, wrong


def load_rules(paths: Iterable[str], root: str = ".") -> tuple[list[str], dict[str, str]]:
    """(names of the rules added, faults by path) of Python files, or of all in a folder, that register rules as the package's own do.

    Files run on the driver, as code of the project that names them. One that fails adds nothing and stops no other.
    """
    wrong, before = {}, set(rules.RULES)
    files = [f for p in paths for q in [Path(root, p)] for f in (sorted(q.glob("*.py")) if q.is_dir() else [q])]
    for k, f in enumerate(files):
        kept = dict(rules.RULES)
        try:
            spec = importlib.util.spec_from_file_location(f"astrolith_rules_{k}_{f.stem}", f)
            spec.loader.exec_module(importlib.util.module_from_spec(spec))
        except Exception as e:  # noqa: BLE001 - whatever a project's file raises is its own fault
            rules.RULES.clear()
            rules.RULES.update(kept)
            wrong[str(f)] = f"{type(e).__name__}: {e}"
    return sorted(set(rules.RULES) - before), wrong


Handler = Callable[[Any], Any]


class Hooks:
    """Handlers by event. A value passes through an event's handlers by priority, then in the order in which they were added; a handler that returns None leaves it as it is."""

    def __init__(self) -> None:
        self._handlers: dict[str, list[tuple[int, int, Handler]]] = {}

    def on(self, event: str, priority: int = 50) -> Callable[[Handler], Handler]:
        def add(f: Handler) -> Handler:
            own = self._handlers.setdefault(event, [])
            own.append((priority, len(own), f))
            return f

        return add

    def run(self, event: str, value: Any) -> Any:
        for _, _, f in sorted(self._handlers.get(event, []), key=lambda x: x[:2]):
            new = f(value)
            value = value if new is None else new
        return value

    def names(self, event: str) -> list[str]:
        return [f.__name__ for _, _, f in sorted(self._handlers.get(event, []), key=lambda x: x[:2])]
