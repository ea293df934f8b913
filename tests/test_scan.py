"""Scans of small source trees, with results that follow from the definitions by hand."""

from pyspark.sql import functions as F

from astrolith.operators import graph, metrics, rules, simulate
from astrolith.sources import corpus, go_scan, python_scan

MODULE = b'''import os
import os.path as p
from a.b import c as d, e

X = 1
y: int = 2


class A(Base):
    attr: int = 1
    other = 2

    @deco
    def m(self, q: int) -> int:
        """Doc."""
        z = helper(q)
        # comment
        return z + other.thing


async def f(a, *rest, k=1):
    if a and k:
        for i in rest:
            try:
                run(i)
            except ValueError:
                pass
    elif rest:
        return [A() for _ in rest]


start(X)
log.info("x")
if __name__ == "__main__":
    f(1)
    d.go()
'''


def files(spark, tree):
    return spark.createDataFrame([(k, v if isinstance(v, bytes) else v.encode()) for k, v in tree.items()], "file string, content binary").withColumn("language", F.when(F.col("file").endswith(".go"), "Go").otherwise("Python"))


def scanned(spark, tree):
    return python_scan.scan(files(spark, tree))


def test_python_module(spark):
    row = scanned(spark, {"src/pkg/mod.py": MODULE}).first()
    assert row.parse_error is None
    assert [(s.path, s.kind, s.parent, s.s_line, s.e_line) for s in row.declarations] == [("pkg.mod.A", "class", -1, 9, 18), ("pkg.mod.A.m", "method", 0, 13, 18), ("pkg.mod.f", "async_function", -1, 21, 29)]
    m = row.declarations[1]
    assert MODULE[m.s_byte : m.e_byte].strip().startswith(b"@deco") and MODULE[m.s_byte : m.e_byte].endswith(b"other.thing")
    assert m.preview == "z = helper(q)\nreturn z + other.thing"
    assert {(r.name, r.kind) for r in m.refs} == {("deco", "name"), ("helper", "name"), ("other", "name"), ("thing", "attr")}
    assert row.declarations[2].signature == "async def f(a, *rest, k=1)"
    assert [(i.name, i.source) for i in row.imports] == [("os", "os"), ("p", "os.path"), ("d", "a.b.c"), ("e", "a.b.e")]
    assert [(e.module, e.names, e.scope) for e in row.edges] == [("os", [], "top"), ("os.path", [], "top"), ("a.b", ["c", "e"], "top")]
    assert [(g.line, g.call) for g in row.guards] == [(35, "f()"), (36, "d.go()")]
    assert [(c.call, c.leaf) for c in row.calls] == [("start", "start"), ("log.info", "info")]
    assert [(h.line, h.type, h.context) for h in row.handlers] == [(26, "ValueError", "f")]
    assert dict(row.defs) == {"os": 1, "p": 2, "d": 3, "e": 3, "X": 5, "y": 6, "A": 9, "f": 21}
    c = row.counters
    assert (c.functions, c.methods, c.classes, c.args, c.typed_args, c.typed_functions, c.attrs, c.typed_attrs, c.vars, c.typed_vars) == (1, 1, 1, 4, 1, 1, 2, 1, 2, 1)
    f = next(e for e in row.exports if e.name == "f")
    # 1 + if + and + for + handler + elif
    assert (f.kind, f.complexity, f.max_depth) == ("async_function", 6, 3)
    assert {e.name: e.internal_refs for e in row.exports} == {"X": -1, "y": -1, "A": 1, "f": 1}


def test_broken_and_empty_files(spark):
    got = {r.file: r for r in scanned(spark, {"a.py": b"def (:\n", "b.py": b"\xff\xfe", "c.py": b"", "d.go": b"package x\nfunc ("}).collect()}
    assert got["a.py"].parse_error.startswith("SyntaxError") and got["b.py"].parse_error.startswith("UnicodeDecodeError")
    assert got["c.py"].parse_error is None and got["c.py"].declarations == [] and "isn't closed" in got["d.go"].parse_error
    none = spark.createDataFrame([("x.py", None, "Python"), ("y.rs", b"fn", "Rust")], "file string, content binary, language string")
    assert python_scan.scan(none).count() == 0


def test_go(spark):
    text = b'''package model

import (
\t"fmt"
\tstr "strings"
)

const Limit = 10

var cache map[string]User

type User struct {
\tName string
}

func (u *User) Greet(who string) string {
\tmsg := fmt.Sprintf("%s", str.ToUpper(who))
\treturn msg + helper(Limit)
}

func helper[T any](n T) string { return "" }
'''
    row = scanned(spark, {"model/user.go": text}).first()
    assert [(s.path, s.kind) for s in row.declarations] == [("model.Limit", "const"), ("model.cache", "var"), ("model.User", "type"), ("model.User.Greet", "method"), ("model.helper", "function")]
    assert [(i.name, i.source) for i in row.imports] == [("fmt", "fmt"), ("str", "strings")]
    refs = {(r.name, r.kind) for r in row.declarations[3].refs}
    assert {("helper", "name"), ("Limit", "name"), ("Sprintf", "attr"), ("fmt", "name")} <= refs and ("msg", "name") not in refs and ("who", "name") not in refs
    assert go_scan.scan_go("x.go", b"// only\n")["parse_error"]


def test_relative_imports_and_scopes():
    import ast

    tree = ast.parse("from . import a\nfrom ..x import y\nif TYPE_CHECKING:\n    import t\ndef f():\n    import late\n")
    got = [(e["module"], e["names"], e["scope"]) for e in python_scan.import_edges(tree, "p/q/m.py")]
    assert got == [("p.q", ["a"], "top"), ("p.x", ["y"], "top"), ("t", [], "type_checking"), ("late", [], "deferred")]
    assert python_scan.import_edges(ast.parse("from . import a"), "p/__init__.py")[0]["module"] == "p"


def edges_of(spark, tree):
    scan = scanned(spark, tree)
    modules = graph.module_map(scan.select("file"))
    raw = scan.select("file", F.explode("edges").alias("e")).select("file", "e.*")
    return scan, sorted(tuple(r) for r in graph.resolve_imports(raw, modules).collect())


def test_import_resolution(spark):
    tree = {"src/p/__init__.py": "from p.a import A\n", "src/p/a.py": "import os\nA = 1\n", "main.py": "from p import a, other\nimport p.a\nfrom main import x\n", "t.py": "from typing import TYPE_CHECKING\nif TYPE_CHECKING:\n    import main\n"}
    _, got = edges_of(spark, tree)
    assert got == [("main.py", "src/p/__init__.py"), ("main.py", "src/p/a.py"), ("src/p/__init__.py", "src/p/a.py")]


def test_propagation_and_hotspots(spark):
    e = spark.createDataFrame([("x.py", "p/__init__.py"), ("y.py", "p/__init__.py"), ("p/__init__.py", "p/a.py"), ("x.py", "p/a.py")], "src string, dst string")
    assert sorted(tuple(r) for r in graph.propagate(e).collect()) == sorted([tuple(r) for r in e.collect()] + [("y.py", "p/a.py")])
    assert [tuple(r) for r in graph.hotspots(e, 1).collect()] == [("p/a.py", 4)]


def test_cycle_simulation(spark):
    real = {"a.py": "from b import x\ny = 1\n", "b.py": "from a import y\nx = 1\n"}
    safe = {"c.py": "y = 1\nfrom d import x\n", "d.py": "from c import y\nx = 1\n"}
    got = simulate.cycles(scanned(spark, real | safe)).collect()
    assert [(r.chain, r.line, r.name) for r in got] == [(["a.py", "b.py", "a.py"], 1, "y")]
    assert simulate.simulate([], {}, {}, {}) == []


def test_rules(spark):
    scan, _ = edges_of(spark, {"m.py": MODULE, "lib.py": "def go(): pass\n", "old_script.py": "try:\n    x\nexcept:\n    ...\n"})
    assert rules.entrypoints(scan).count() == 2
    assert sorted((r.file, r.type) for r in rules.swallowed(scan).collect()) == [("m.py", "ValueError"), ("old_script.py", "bare except")]
    roles = spark.createDataFrame([("log", "info"), ("log.info", "debug")], "prefix string, severity string")
    assert sorted((r.call, r.severity) for r in rules.side_effects(scan, roles).collect()) == [("log.info", "info"), ("start", "warning")]
    deps = spark.createDataFrame([("flask",), ("a",)], "name string")
    tables = {"scan": scan, "edges": spark.createDataFrame([("m.py", "lib.py")], "src string, dst string"), "deps": deps, "package_roles": roles}
    got = rules.run(spark, tables)
    assert sorted((r.section, r.detail, r.severity) for r in rules.at_least(got, "warning").collect()) == [("orphans", "script", "warning"), ("side_effects", "start", "warning"), ("swallowed", "", "warning"), ("unused_deps", "flask", "warning")]
    assert rules.exit_code(got).first().exit_code == 0
    assert rules.run(spark, tables, disabled=["orphans"]).where("section = 'orphans'").count() == 0


def test_metrics(spark):
    scan = scanned(spark, {"m.py": MODULE, "n.py": "from m import f, X\n"})
    s = metrics.structure(scan).first()
    assert (s.functions, s.methods, s.return_pct, s.arg_pct, s.attr_pct, s.overall_pct) == (1, 1, 50.0, 25.0, 50.0, 37.5)
    measured = metrics.file_metrics(files(spark, {"m.py": MODULE}).withColumn("content", F.decode("content", "UTF-8")))
    row = metrics.per_file(scan, measured).first()
    assert (row.file, row.loc, row.classes, row.functions, row.max_depth, row.typed_pct) == ("m.py", 36, 1, 2, 3, 50.0)
    used = {(r.file, r.name): r.used_by for r in metrics.export_usage(scan, graph.module_map(scan.select("file"))).collect()}
    assert used == {("m.py", "A"): [], ("m.py", "X"): ["n.py"], ("m.py", "f"): ["n.py"], ("m.py", "y"): []}


def test_line_ends(spark):
    df = spark.createDataFrame([("a\r\nb\x0bc\x85d e\n",), ("",), (None,), ("x\n\n  \n",), ("\n",)], "t string")
    from astrolith.functions import text as T

    assert [tuple(r) for r in df.select(T.loc(F.col("t")), T.sloc(F.col("t"))).collect()] == [(5, 5), (0, 0), (0, 0), (3, 1), (1, 0)]


def test_languages(spark):
    rows = [("a/b.py", "x"), ("Makefile", "all:"), ("run", "#!/usr/bin/env -S FOO=1 python3.11\n"), ("x.pl", "% hi"), ("y.h", "int x;"), ("z", "<?xml version='1.0'?>"), ("ls.1", ".TH"), ("q.txt", "# vim: ft=ruby"), ("u", "?"), ("s.weird", "#!/bin/bash")]
    df = spark.createDataFrame([(a, b.encode()) for a, b in rows], "file string, content binary").union(spark.createDataFrame([("bin.py", b"a\x00b"), ("null.py", None)], "file string, content binary"))
    got = {r.file: r.language for r in corpus.classify(df).collect()}
    assert got == {"a/b.py": "Python", "Makefile": "Makefile", "run": "Python", "x.pl": "Perl", "y.h": "C", "z": "XML", "ls.1": "Roff Manpage", "q.txt": "Ruby", "u": None, "s.weird": "Shell", "bin.py": None, "null.py": None}


def test_read_tree(spark, tmp_path):
    for name in ("a.py", "d/b.py", ".git/c", "d/.h.py", "venv/x.py"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x = 1\n")
    assert sorted(r.file for r in corpus.read_tree(spark, str(tmp_path), exclude=["venv/*"]).collect()) == ["a.py", "d/b.py"]
    assert [r.file for r in corpus.read_tree(spark, str(tmp_path), include=["**/b.py"]).collect()] == ["d/b.py"]


def test_signature_of_a_long_head(spark):
    head = "def f(" + ", ".join(f"argument_{k}: int={k}" for k in range(400)) + ", last: str='z') -> int:"
    source = f"@wraps(g)\n{head}\n    return 1\n"
    assert len(head) > 8192
    found = python_scan.scan_python("a.py", source.encode())["declarations"][0]["signature"]
    assert found == head.rstrip(":")


def test_tables_are_built_from_written_files_in_many_tasks(spark):
    from astrolith.plans import reports

    rows = [(f"p/m{k}.py", bytearray(f"import p.m{k + 1}\n".encode())) for k in range(200)] + [("svc/go.mod", bytearray(b"module example.com/svc\n")), ("svc/a/x.go", bytearray(b"package a\n")), (None, bytearray(b"x"))]
    tables = reports.build_tables(spark.createDataFrame(rows, "file string, content binary").coalesce(1))
    # the text of a plan that looks languages up again has over a million signs
    assert len(tables["files"]._jdf.queryExecution().optimizedPlan().toString()) < 10_000
    assert len(tables["files"].inputFiles()) > 4 and len(tables["scan"].inputFiles()) > 1
    assert {r.file: r.module for r in tables["scan"].where("file LIKE 'svc/%' OR file = 'p/m7.py'").collect()} == {"svc/a/x.go": "example.com/svc/a", "p/m7.py": "p.m7"}
    assert tables["edges"].count() == 199


def test_python_files_are_not_joined_for_their_module(spark):
    from astrolith.sources import go_scan

    rows = spark.createDataFrame([("a.py", "Python", b"x"), ("b/c.go", "Go", b"x"), ("n", None, b"x")], "file string, language string, content binary")
    own = go_scan.with_modules(rows, rows)
    assert sorted((r.file, r.module) for r in own.collect()) == [("a.py", None), ("b/c.go", "b"), ("n", None)]
    plan = own._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Union") < plan.index("Join")


def test_only_files_that_lead_to_a_cycle_are_simulated(spark):
    edges = spark.createDataFrame([("x", "y"), ("y", "x"), ("w", "x"), ("v", "w"), ("y", "a"), ("a", "b"), ("c", "b"), ("p", "q"), ("q", "p")], "src string, dst string")
    assert {tuple(r) for r in simulate.involved(edges).collect()} == {(f, "a") for f in "avwxy"} | {("p", "p"), ("q", "p")}


def test_cycles_of_random_trees_are_those_of_a_whole_load(spark):
    import random

    r = random.Random(4)
    tree, n = {}, 40
    for k in range(n):
        body = ["import json", *[r.choice([f"from m{j} import x{j}", f"import m{j}", f"from m{j} import *"]) for j in r.sample(range(n), r.choice([0, 1, 2, 2]))], f"x{k} = 1"]
        r.shuffle(body)
        tree[f"m{k}.py"] = "\n".join(body) + "\n"
    scan = scanned(spark, tree)
    rows = sorted(scan.collect(), key=lambda x: x.file)
    edges = {x.file: [(e.module, list(e.names), e.line) for e in sorted(x.edges, key=lambda e: e.ord)] for x in rows}
    want = simulate.simulate([x.file for x in rows], edges, {x.file: dict(x.defs) for x in rows}, {f"m{k}": f"m{k}.py" for k in range(n)})
    got = [(list(x.chain), x.line, x.name, x.reason) for x in simulate.cycles(scan).collect()]
    assert want and sorted(got) == sorted((list(a), b, c, d) for a, b, c, d in want)
