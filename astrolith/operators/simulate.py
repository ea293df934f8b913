"""Import simulation: which circular imports fail. State never leaves a weak component of the files that lead to a cycle, so that components run side by side."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from . import graph

CYCLE = "component string, chain array<string>, line int, name string, reason string"


def simulate(files: list[str], edges: dict[str, list[tuple[str, list[str], int]]], defs: dict[str, dict[str, int]], modules: dict[str, str]) -> list[tuple[list[str], int, str, str]]:
    """(chain, line, name, reason) of imports that fail, loading the files in order.

    edges: (module, names, line) of a file in order. An import of a module that is still loading fails for names that are
    neither * nor loadable submodules nor bound before the line where that module waits. Each set of modules is told once.
    """
    state, waits, stack, out, told = dict.fromkeys(files, "new"), {}, [], [], set()

    def targets(module: str, names: list[str]) -> list[str]:
        if not names:
            return [modules[module]] if module in modules else []
        subs = [modules.get(f"{module}.{n}" if module else n) for n in names]
        return [s for s in subs if s] + ([modules[module]] if None in subs and module in modules else [])

    def meets(source: str, target: str, module: str, names: list[str], line: int) -> None:
        paused, known = waits.get(target, 0), defs.get(target, {})
        failed = []
        for n in names:
            sub = modules.get(f"{module}.{n}" if module else n)
            if n == "*" or (sub and state.get(sub) != "loading") or known.get(n, paused) < paused:
                continue
            failed.append(n)
        chain = [*stack[stack.index(target) :], target]
        if failed and (key := frozenset(chain)) not in told:
            told.add(key)
            for n in failed:
                why = f"{n} is bound at line {known[n]} of {target}, which waits at line {paused}" if n in known else f"{n} is never bound in {target}"
                out.append((chain, line, n, why))

    for f in files:
        if state[f] != "new":
            continue
        # frames: file and the imports it has yet to run
        frames = [(f, iter([(e, t) for e in edges.get(f, []) for t in targets(e[0], e[1])]))]
        state[f] = "loading"
        stack.append(f)
        while frames:
            own, todo = frames[-1]
            for (module, names, line), target in todo:
                if target not in state:
                    continue
                waits[own] = line
                if state[target] == "new":
                    state[target] = "loading"
                    stack.append(target)
                    frames.append((target, iter([(e, t) for e in edges.get(target, []) for t in targets(e[0], e[1])])))
                    break
                if state[target] == "loading":
                    meets(own, target, module, names, line)
            else:
                frames.pop()
                stack.pop()
                state[own] = "done"
    return out


def involved(edges: DataFrame) -> DataFrame:
    """(file, component) of the files that lead to a cycle and of what they import, by weak components of these; the least file of a component names it.

    Loading any other file ends before it meets one that waits, so that it tells nothing and one component that holds a whole project doesn't come into one task.
    """
    e = cut(edges.select("src", "dst").distinct())
    leading = graph.reaching(e, graph.strong(e).select("node"))
    return graph.components(e.join(leading.withColumnRenamed("node", "src"), "src", "left_semi")).withColumnRenamed("node", "file")


def cycles(scan: DataFrame) -> DataFrame:
    """CYCLE rows of a scan table: the imports between its files that fail at run time."""
    files = scan.select("file")
    modules = graph.module_map(files)
    raw = scan.select("file", F.explode("edges").alias("e")).select("file", "e.*")
    group = involved(graph.resolve_imports(raw, modules))
    names = modules.groupBy("file").agg(F.collect_set("module").alias("modules"))
    live = F.filter("edges", lambda e: e["scope"] != "type_checking")
    rows = scan.select("file", live.alias("edges"), "defs").join(names, "file", "left").join(group, "file")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("file")
        edges = {f: [(e["module"], list(e["names"]), e["line"]) for e in sorted(es, key=lambda e: e["ord"])] for f, es in zip(frame["file"], frame["edges"], strict=True)}
        defs = {f: dict(d) for f, d in zip(frame["file"], frame["defs"], strict=True)}
        modules = {m: f for f, ms in zip(frame["file"], frame["modules"], strict=True) if ms is not None for m in ms}
        found = simulate(list(frame["file"]), edges, defs, modules)
        return pd.DataFrame([(frame["component"].iloc[0], *x) for x in found], columns=["component", "chain", "line", "name", "reason"])

    # components are few bytes and long to run, so that they are spread by number
    spread = 4 * scan.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(spread, "component").groupBy("component").applyInPandas(run, CYCLE)
