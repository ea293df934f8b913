"""Renames, chains with cycles, range joins, saved indexes and refreshed tables, against plain versions and by hand."""

import numpy as np
import pytest

from astrolith.operators import graph, incremental, lookup, ranges, rename
from astrolith.plans import reports
from astrolith.streaming import refresh


def bucketed(found, text):
    """{(bucket, line, kind)} of places, each of which must hold the name."""
    raw = text.encode()
    assert all(raw[a:z] == b"total" for _, _, a, z, _ in found)
    return {(b, line, k) for b, line, _, _, k in found}


RENAMES = [
    # (file, text, places of shop.prices.total)
    ("shop/other.py", "from other import total\ntotal()\n", {("skipped_mismatch", 1, "import"), ("skipped_mismatch", 2, "name")}),
    ("shop/cart.py", "class Cart:\n    total = 1\n    def sum(self):\n        return self.total\n", {("skipped_mismatch", 2, "name")}),
    ("run.py", "from shop import prices\nimport shop.prices\nimport shop.prices as p\nimport shop.carts as c\nprices.total([])\nshop.prices.total([])\np.total([])\nc.total()\nx.total\n", {("rewrite", 5, "attribute"), ("rewrite", 6, "attribute"), ("rewrite", 7, "attribute"), ("skipped_mismatch", 8, "attribute")}),
    ("shop/prices.py", "def total(x):\n    return total(x[1:])\ndef f(total):\n    return total\ndef g():\n    global total\n    total = 2\nclass A:\n    total = 3\n    def m(self):\n        return total\nz = [total for total in [1]]\nw = lambda x: total\n", {("rewrite", 1, "definition"), ("rewrite", 2, "name"), ("skipped_mismatch", 4, "name"), ("rewrite", 6, "global"), ("rewrite", 7, "name"), ("skipped_mismatch", 9, "name"), ("rewrite", 11, "name"), ("skipped_mismatch", 12, "name"), ("rewrite", 13, "name")}),
    ("shop/__init__.py", "from shop.prices import total\nfrom .prices import total\n__all__ = []\n", {("rewrite", 1, "import"), ("rewrite", 2, "import")}),
    ("caller.py", "from shop import total\ndef use():\n    return total()\n", {("rewrite", 1, "import"), ("rewrite", 3, "name")}),
    ("alias.py", "from shop.prices import total as t\ntotal = 5\nt()\n", {("rewrite", 1, "import"), ("skipped_mismatch", 2, "name")}),
    ("own.py", "def total(): return 99\ndef use():\n    return total()\n", {("skipped_mismatch", 1, "definition"), ("skipped_mismatch", 3, "name")}),
]


@pytest.mark.parametrize("file, text, want", RENAMES, ids=[r[0] for r in RENAMES])
def test_rename_of_a_module_name(file, text, want):
    assert bucketed(rename.module_places(text, file, "shop.prices", "total"), text) == want


def test_rename_of_a_member():
    text = "from m import A as K\nimport m\ndef make() -> A: ...\ndef use(x: 'm.A', y: m.B):\n    K().total()\n    m.A().total()\n    v = make()\n    v.total()\n    x.total()\n    y.total()\n    q.total()\n"
    want = {("rewrite", n, "attribute") for n in (5, 6, 8, 9)} | {("skipped_mismatch", 10, "attribute"), ("unresolved", 11, "attribute")}
    assert bucketed(rename.member_places(text, "total", "A", False), text) == want
    assert {b for b, *_ in rename.member_places(text, "total", "A", True)} == {"rewrite"}


def test_rename_in_go():
    text = 'package main\n\nimport (\n\tp "ex.com/a"\n\t"ex.com/b"\n)\n\n// total\nvar s = "total"\nvar x = p.total + b.total + total\n'
    assert bucketed(rename.go_places(text, "ex.com/a", "ex.com/main", "total", False, True), text) == {("rewrite", 10, "selector")}
    assert bucketed(rename.go_places(text, "ex.com/main", "ex.com/main", "total", False, True), text) == {("rewrite", 10, "name")}
    method = "package a\n\nfunc (u *U) total() int { return u.total() }\n"
    assert bucketed(rename.go_places(method, "ex.com/a", "ex.com/a", "total", True, False), method) == {("rewrite", 3, "name"), ("unresolved", 3, "selector")}


def tree(spark, files):
    return reports.build_tables(spark.createDataFrame([(k, v.encode()) for k, v in files.items()], "file string, content binary"))


def test_rename_front_door(spark):
    t = tree(spark, {"lib.py": "def f(): pass\ndef g(): f()\n", "app.py": "from lib import f\nf()\n", "no.py": "x = 1\n"})
    assert [rename.rename(t, p, n)[0] for p, n in (("lib.f", "g"), ("lib.f", "for"), ("lib.f", "f"), ("lib.h", "k"), ("lib.f", "fresh"))] == ["collision", "bad_name", "bad_name", "not_found", "ok"]
    found = rename.rename(t, "lib.f", "fresh")[1]
    assert {(r.file, r.line, r.bucket) for r in found.collect()} == {("lib.py", 1, "rewrite"), ("lib.py", 2, "rewrite"), ("app.py", 1, "rewrite"), ("app.py", 2, "rewrite")}


def test_go_modules(spark):
    t = tree(spark, {"go.mod": "module ex.com/root\n", "pkg/user/u.go": "package user\n", "sub/go.mod": "// own\n\nmodule \"ex.com/sub\"\n", "sub/x/y.go": 'package x\nimport "ex.com/root/pkg/user"\n', "main.go": "package main\n"})
    assert {(r.file, r.module) for r in t["scan"].collect()} == {("pkg/user/u.go", "ex.com/root/pkg/user"), ("sub/x/y.go", "ex.com/sub/x"), ("main.go", "ex.com/root")}
    assert [tuple(r) for r in t["edges"].collect()] == [("sub/x/y.go", "pkg/user/u.go")]
    assert tree(spark, {"sub/pkg/f.go": "package pkg\n"})["scan"].first()["module"] == "sub/pkg"


def plain_chain(edges, node):
    """The longest chain of an acyclic graph, by depth-first search; __init__ files are passed through."""
    best = min((plain_chain(edges, d) for s, d in edges if s == node), key=lambda c: (-len(c), c), default=[])
    return ([] if node.endswith("__init__.py") else [node]) + best


def test_deep_chains(spark):
    r = np.random.default_rng(3)
    names = [f"n{i:02}.py" if i % 4 else f"p{i}/__init__.py" for i in range(24)]
    edges = sorted({(names[a], names[b]) for a, b in (sorted(r.choice(24, 2, replace=False)) for _ in range(40))})
    df = spark.createDataFrame(edges, "src string, dst string")
    assert {(x.node, x.length, tuple(x.chain)) for x in graph.deep_chains(df, 1).collect()} == {(s, len(c), tuple(c)) for s in {a for a, _ in edges} if (c := plain_chain(edges, s))}
    cyclic = spark.createDataFrame([("a.py", "b.py"), ("b.py", "c.py"), ("c.py", "a.py"), ("c.py", "d.py"), ("x.py", "b.py"), ("x.py", "x.py")], "src string, dst string")
    got = {x.node: (x.length, x.chain) for x in graph.deep_chains(cyclic, 1).collect()}
    assert got == {"x.py": (3, ["x.py", "a.py", "d.py"])} | {n: (2, ["a.py", "d.py"]) for n in ("a.py", "b.py", "c.py")}
    assert graph.deep_chains(cyclic, 3).first()["severity"] == "debug" and graph.deep_chains(cyclic.where("false"), 1).count() == 0


def test_map_has_chains_and_targets(spark):
    t = tree(spark, {"a.py": "from b import x", "b.py": "from c import x\nx = 1", "c.py": "from d import x\nx = 1", "d.py": "x = 1"})
    from astrolith.operators.config import ProjectConfig

    found = reports.project_map(t, ProjectConfig(thresholds={"deep_chains": (4, 6, 10)}), target="d.py")
    assert [(x.node, len(x.chain)) for x in found["deep_chains"].collect()] == [("a.py", 4)]
    assert found["summary"].first()["longest_chain"] == 4 and {(x.node, x.reach) for x in found["blast"].collect()} == {("c.py", "direct"), ("a.py", "transitive"), ("b.py", "transitive")}


def test_ranges_same_as_all_pairs(spark):
    r = np.random.default_rng(8)
    held = [(int(r.integers(0, 3)), int(a), int(a + n)) for a, n in zip(r.integers(-50, 5000, 200), r.choice([0, 1, 5, 60, 700, 90_000, -3], 200), strict=True)]
    asked = [(int(r.integers(0, 3)), int(a), int(a + n)) for a, n in zip(r.integers(-50, 5000, 200), r.integers(-2, 30, 200), strict=True)]
    a, b = spark.createDataFrame([*held, (0, None, 5)], "file long, lo long, hi long"), spark.createDataFrame([*asked, (None, 1, 2), (0, None, 2)], "file long, first long, last long")
    got = sorted(tuple(x) for x in ranges.holding(a, b, "lo", "hi", "first", "last").select("file", "lo", "hi", "first", "last").collect())
    assert got == sorted((f, x, y, p, q) for f, x, y in held for g, p, q in asked if f == g and y >= x and x <= p and y >= q and p <= y) and got


def test_matching_files(spark):
    files = spark.createDataFrame([("src/models.py",), ("src/a/models.py",), ("src/views.py",), ("z.py",)], "file string")
    wanted = spark.createDataFrame([(x,) for x in ("z.py", "views.py", "models.py", "a/mod", "none", None)], "wanted string")
    assert {r.wanted: r.file for r in lookup.match_files(files, wanted).collect()} == {"z.py": "z.py", "views.py": "src/views.py", "models.py": "src/a/models.py", "a/mod": "src/a/models.py", "none": None}
    assert {r.wanted: r.file for r in lookup.match_files(files, wanted, loose=False).collect()}["a/mod"] is None


def test_a_save_that_breaks_off_leaves_the_last_one(spark, tmp_path):
    path = str(tmp_path / "i")
    one = {"a": spark.createDataFrame([(1,)], "x int"), "b": spark.createDataFrame([(1,)], "x int")}
    incremental.save_index(one, path, "/r")
    broken = {"a": spark.createDataFrame([(2,)], "x int"), "b": spark.createDataFrame([(2,)], "x int").selectExpr("raise_error('lost') AS x")}
    with pytest.raises(Exception, match="lost"):
        incremental.save_index(broken, path, "/r")
    assert [t.first()["x"] for t in incremental.load_index(spark, path, "/r").values()] == [1, 1]
    for k in (3, 4, 5):
        incremental.save_index({n: spark.createDataFrame([(k,)], "x int") for n in one}, path, "/r")
    assert [t.first()["x"] for t in incremental.load_index(spark, path, "/r").values()] == [5, 5]
    assert incremental.load_index(spark, path, "/other") is None and incremental.load_index(spark, path, "/r", 2) is None and incremental.load_index(spark, path + "x", "/r") is None


def test_ensure_fresh(spark, tmp_path):
    path, asked = str(tmp_path / "i"), []
    stamps = lambda rows: spark.createDataFrame(rows, "file string, mtime long")
    rows = lambda df: {"rows": df.selectExpr("file", "concat('new ', file) AS text")}

    def rescan(files):
        asked.append(sorted(r.file for r in files.collect()))
        return rows(files)

    first = stamps([("a", 1), ("b", 1)])
    build = lambda: {"rows": first.selectExpr("file", "concat('old ', file) AS text")}
    assert incremental.ensure_fresh(spark, path, "/", first, build, rescan)[0] == "build"
    assert incremental.ensure_fresh(spark, path, "/", first, build, rescan)[0] == "load"
    action, t = incremental.ensure_fresh(spark, path, "/", stamps([("b", 2), ("c", 1)]), build, rescan)
    assert action == "refresh" and asked == [["b", "c"]] and sorted(r.text for r in t["rows"].collect()) == ["new b", "new c"]
    many = stamps([(f"f{i}", 1) for i in range(300)])
    assert incremental.ensure_fresh(spark, path, "/", many, lambda: rows(many), rescan)[0] == "rebuild"


def test_refreshed_table(spark, tmp_path):
    """Touched parts only, a batch that runs again, a commit that never came, and a new checkpoint over the same table."""
    src, table = str(tmp_path / "in"), str(tmp_path / "t")
    schema = "file string, change string, x long"
    scan = lambda df: df.select("file", "x")

    def batch(rows, checkpoint):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        refresh.refresh_table(refresh.read_changes(spark, src, schema), table, str(tmp_path / checkpoint), scan, parts=4).awaitTermination()
        df = refresh.latest_version(spark, table)
        return {} if df is None else {r.file: r.x for r in df.collect()}

    assert batch([(f"f{i}", "added", i) for i in range(20)], "cp") == {f"f{i}": i for i in range(20)}
    before = refresh._last_commit(spark, table)[1]
    want = {f"f{i}": i for i in range(20)} | {"f3": 33}
    assert batch([("f3", "modified", 33)], "cp") == want
    after = refresh._last_commit(spark, table)[1]
    assert sum(before[p] != after[p] for p in before) == 1
    (tmp_path / "t" / "v-999999999999-half" / "part=0").mkdir(parents=True)  # of a batch that never committed
    del want["f3"], want["f4"]
    assert batch([("f3", "deleted", None), ("f4", "deleted", None), ("f4", "added", 1)], "cp") == want
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(src)
    assert batch([("new", "added", 7)], "cp2") == want | {"new": 7}
    assert batch([(f, "deleted", None) for f in [*want, "new"]], "cp2") == {}


CLASS = "class A:\n    \"\"\"Doc.\"\"\"\n    x = 1\n\n    def m(self):\n        return 1\n\n\ndef f(): return 2\n"


def applied(spark, t, made):
    from astrolith.operators import edits

    return {r.file: r.content.decode() for r in edits.apply(t["files"].select("file", "content"), made).collect()}


def test_guarded_inserts(spark):
    from astrolith.operators import edits

    t = tree(spark, {"m.py": CLASS})
    of = lambda leaf: t["declarations"].where(f"leaf = '{leaf}'")
    new = "def n(self):\n    return 3"
    cases = {("A", "start"): CLASS.replace("    x = 1\n", "    def n(self):\n        return 3\n\n    x = 1\n"), ("A", "end"): CLASS.replace("        return 1\n", "        return 1\n\n    def n(self):\n        return 3\n"), ("m", "before"): CLASS.replace("    def m", "    def n(self):\n        return 3\n\n    def m"), ("m", "after"): CLASS.replace("        return 1\n", "        return 1\n\n    def n(self):\n        return 3\n"), ("f", "after"): CLASS.rstrip("\n") + "\n\n\n" + new + "\n"}
    for (leaf, where), want in cases.items():
        made, said = edits.checked_insert(of(leaf), where, new)
        assert [r.status for r in said.collect()] == ["ok"] and applied(spark, t, made) == {"m.py": want}, (leaf, where)
    said = lambda leaf, where, text: edits.checked_insert(of(leaf), where, text)[1].first()["status"]
    assert [said("f", "end", new), said("A", "end", "def ("), said("A", "end", "x = 1\ny = 2"), said("A", "end", "x = 1")] == ["not_a_container", "parse_error", "not_one", "not_one"]
    with pytest.raises(ValueError):
        edits.insert(of("A"), "beside", new)


def test_guarded_replacements(spark):
    from astrolith.operators import edits

    t = tree(spark, {"m.py": CLASS, "u.go": "package u\n\nfunc F() int { return 1 }\n"})
    of = lambda leaf: t["declarations"].where(f"leaf = '{leaf}'")
    said = lambda leaf, text, language="Python": edits.checked_replace(t["declarations"], of(leaf), text, language)[1].first()["status"]
    assert [said("m", "def k(self): ..."), said("m", "class K: ..."), said("m", "def (:"), said("m", "def a(): ...\ndef b(): ..."), said("f", "class A: ..."), said("f", "def A(): ..."), said("m", "def m(self): ...")] == ["ok", "kind_mismatch", "parse_error", "not_one", "kind_mismatch", "collision", "ok"]
    made, _ = edits.checked_replace(t["declarations"], of("m"), "def m(self):\n    return 5\n")
    assert applied(spark, t, made) == {"m.py": CLASS.replace("return 1", "return 5")}
    assert [said("F", "func F() int { return 2 }", "Go"), said("F", "func F() {", "Go"), said("F", "type T int", "Go")] == ["ok", "parse_error", "kind_mismatch"]


def test_stored_transactions(spark, tmp_path):
    from astrolith.operators import edits

    path = str(tmp_path / "s")
    frame = lambda files: spark.createDataFrame([(k, v.encode()) for k, v in files.items()], "file string, content binary")
    stored = lambda: {r.file: r.content.decode() for r in incremental.load_index(spark, path, path)["store"].collect()}
    assert edits.undo_last(spark, path) == ("nothing_to_undo", None)
    assert edits.transact(spark, path, frame({"a": "1", "b": "2"})) == ("ok", 1) and edits.transact(spark, path, frame({"a": "3", "c": "4"})) == ("ok", 2)
    assert edits.transact(spark, path, frame({"a": "bad"}), verify=lambda after: after.where("content = X'626164'").isEmpty()) == ("rejected", None)
    assert stored() == {"a": "3", "b": "2", "c": "4"}
    assert edits.undo_last(spark, path) == ("ok", 2) and stored() == {"a": "1", "b": "2"}
    assert edits.undo_last(spark, path) == ("ok", 1) and stored() == {} and edits.undo_last(spark, path)[0] == "nothing_to_undo"


SPEC = 'name = "web-kit"\ncategory = "web"\nseverity = "warning"\ndetect_files = ["kit.cfg"]\n[calls]\nerror = ["web_kit.run"]\n[exclude]\norphans = ["**/pages/*"]\n'


def test_specs(spark, tmp_path):
    from astrolith.operators import config
    from astrolith.plans import extend

    (tmp_path / "a.toml").write_text(SPEC)
    (tmp_path / "b.toml").write_text('category = 3\nodd = 1\nseverity = "loud"\n')
    (tmp_path / "c.toml").write_text("= no")
    specs, wrong = extend.load_specs(str(tmp_path))
    assert [s.name for s in specs] == ["web-kit"] and set(wrong) == {"b.toml", "c.toml"}
    assert wrong["b.toml"].split("\n") == ["name is missing", "odd is unknown", "category is no text", "loud is no severity"]
    rows = extend.packages(spark, specs)
    one = rows.first()
    assert (one.import_name, one.detect_deps, [tuple(p) for p in one.prefixes]) == ("web_kit", ["web-kit"], [("web_kit.run", "error")])
    deps, files = spark.createDataFrame([("other",)], "name string"), spark.createDataFrame([("kit.cfg",)], "file string")
    assert [r.name for r in config.active_frameworks(rows, deps, files).collect()] == ["web-kit"]


def test_rules_of_a_project(spark, tmp_path):
    from astrolith.operators import rules
    from astrolith.plans import extend

    (tmp_path / "own.py").write_text("from pyspark.sql import functions as F\nfrom astrolith.operators.rules import finding, rule\n@rule('long_names', 5)\ndef f(t):\n    return finding(t['scan'].where('length(file) > 10'), 'long_names', F.lit('long'), F.col('file'), F.lit('info'), F.col('file'))\n")
    (tmp_path / "bad.py").write_text("from astrolith.operators.rules import rule\nrule('half', 1)(lambda t: t)\nraise RuntimeError('no')\n")
    try:
        names, wrong = extend.load_rules([str(tmp_path), "missing.py"])
        assert names == ["long_names"] and [w.split(":")[0] for w in wrong.values()] == ["RuntimeError", "FileNotFoundError"]
        t = tree(spark, {"a_rather_long_name.py": "", "b.py": ""})
        got = rules.run(spark, t)
        assert got.first()["section"] == "long_names" and got.where("section = 'long_names'").count() == 1
        assert "long_names" not in {r.section for r in rules.run(spark, t, disabled=["long_names"]).collect()}
    finally:
        rules.RULES.pop("long_names", None)
    deps = spark.createDataFrame([("flask",)], "name string")
    known = spark.createDataFrame([("flask", "web")], "name string, category string")
    assert [tuple(r) for r in rules.VIEWS["stack"]["by_category"]({"deps": deps, "packages": known}).collect()] == [("web", ["flask"])]


def test_hooks():
    from astrolith.plans import extend

    h = extend.Hooks()
    h.on("rows", 60)(lambda x: x + ["last"])
    h.on("rows", 10)(lambda x: x + ["first"])
    h.on("rows", 60)(lambda x: None)
    assert h.run("rows", []) == ["first", "last"] and h.run("other", 3) == 3 and len(h.names("rows")) == 3


def test_scanner_tiers(spark):
    from astrolith.sources import python_scan

    try:
        assert not python_scan.add_scanner("Go", None, tier=9, available=lambda: False) and python_scan.scanners()["Go"].__name__ == "scan_go"
        assert python_scan.add_scanner("Text", python_scan.scan_python, tier=1) and "Text" in python_scan.scanners()
    finally:
        python_scan._SCANNERS.pop("Text", None)


@pytest.mark.parametrize("stored", [False, True])
def test_read_log(spark, tmp_path, stored):
    folder = str(tmp_path / "log") if stored else None
    log = incremental.ReadLog(spark, folder)
    rows = lambda *r: spark.createDataFrame(r, incremental.ReadLog.READ)
    asked = spark.createDataFrame([(1, "a", 5, 8), (2, "b", 1, 1)], "query long, file string, first long, last long")
    assert log.covering(asked).count() == 0
    log.add(rows((1, "a", 1, 10, 1.0, 1.0), (2, "a", 4, 9, 2.0, 1.0)))
    log.add(rows((3, "b", 1, 1, 3.0, 1.0)))
    if stored:
        log = incremental.ReadLog(spark, folder)
    assert {(r.query, r.read_id) for r in log.covering(asked).collect()} == {(1, 2), (2, 3)}
    log.invalidate(spark.createDataFrame([("a",)], "file string"))
    assert {(r.query, r.read_id) for r in log.covering(asked).collect()} == {(2, 3)}
    log.clear()
    assert log.rows().count() == 0


def test_warm_tables(spark, tmp_path):
    path = str(tmp_path / "i")
    warm = incremental.Warm(spark, path, "/")
    assert warm.tables() is None
    incremental.save_index({"a": spark.range(3)}, path, "/")
    first = warm.tables()
    assert first["a"].count() == 3 and warm.tables() is first
    incremental.save_index({"a": spark.range(5)}, path, "/")
    assert warm.tables()["a"].count() == 5
    warm.drop()


def test_whole_files_and_cleaning(spark, tmp_path):
    from astrolith import session

    path = f"{tmp_path}/x.txt"
    for text in ("one", "zwei ü"):
        session.write_text(spark, path, text)
        assert open(path, encoding="utf-8").read() == text
    assert session.listed(spark, str(tmp_path)) == ["x.txt"] or all(x.startswith((".", "x.txt")) for x in session.listed(spark, str(tmp_path)))
    df = session.written(spark.range(2), "some")
    assert df.count() == 2


def test_layouts(spark):
    t = tree(spark, {"a.py": "import b\ndef f():\n    try:\n        b.g()\n    except Exception:\n        pass\n", "b.py": "def g(): ...\n"})
    deps = spark.createDataFrame([("flask",)], "name string")
    from astrolith.operators import metrics
    from astrolith.operators.config import ProjectConfig

    found = {r.section: r for r in reports.audit_layout(reports.audit(spark, t, deps, ProjectConfig(min_severity="skip"))).collect()}
    assert found["swallowed"].worst == "warning" and found["swallowed"].counts == {"warning": 1} and found["swallowed"].findings[0].location == "a.py:5"
    measured = metrics.file_metrics(t["files"].selectExpr("file", "language", "decode(content, 'UTF-8') AS content"))
    loc = reports.loc_layout(measured).first()
    assert loc.total.files == 2 and [(x.language, x.files) for x in loc.languages] == [("Python", 2)]
    assert {r.section for r in reports.map_layout(reports.project_map(t)).collect()} == {"hotspots", "fragile", "leaves", "coupling", "deep_chains", "cycles", "summary"}
    one = reports.analysis_layout(t, "a.py").first()
    assert [(x.name, x.source_file) for x in one.imported] == [("b", "b.py")] and reports.analysis_layout(t, "none.py") is None


def test_text_predicates(spark):
    from astrolith.functions import text as T
    from astrolith.operators import layout

    rows = [("a", b"plain"), ("b", b"\x00x"), ("c", b"\xff\xfe\x00"), ("d", "ü".encode() * 600), ("e", b"\xe9t\xe9"), ("f", b"\xef\xbb\xbfx"), ("g", b"")]
    got = {r.k: (r.binary, r.enc) for r in spark.createDataFrame([(k, bytearray(v)) for k, v in rows], "k string, v binary").select("k", T.is_binary(__import__("pyspark").sql.functions.col("v")).alias("binary"), T.encoding(__import__("pyspark").sql.functions.col("v")).alias("enc")).collect()}
    assert got == {"a": (False, "UTF-8"), "b": (True, None), "c": (True, "UTF-16"), "d": (False, "UTF-8"), "e": (True, "ISO-8859-1"), "f": (False, "UTF-8"), "g": (False, "UTF-8")}
    assert layout.numbered("a\nb\nc", "a\nx\nc") == "...\n2 - b\n2 + x\n..."


LANGUAGES = [
    ("x.h", "int f(void);\n", "C"), ("x.h", "namespace a {\n}\n", "C++"), ("x.h", "@interface A\n@end\n", "Objective-C"), ("x.m", "function y = f(x)\n", "MATLAB"), ("x.pl", "a(X) :- b(X).\n", "Prolog"), ("x.pl", "use strict;\nmy $x = 1;\n", "Perl"),
    ("x.ts", "const a = 1\n", "TypeScript"), ("x.ts", '<?xml version="1.0"?>\n<TS version="2">\n', "XML"), ("x.sql", "SELECT 1;\n", "SQL"), ("x.v", "Theorem a : True.\n", "Coq"), ("x.v", "module m(a);\nendmodule\n", "Verilog"), ("x.fs", "let a = 1\n", "F#"), ("x.ml", "let rec f x = x;;\n", "OCaml"),
    ("x.cls", "\\NeedsTeXFormat{LaTeX2e}\n", "TeX"), ("x.blade.php", "", "Blade"), ("x.rs", "fn main() {}\n", "Rust"), ("x.md", "# a\n", "Markdown"), ("go.mod", "module a\n", "Go Module"), ("Gemfile", "", "Ruby"), ("tsconfig.json", "{}", "JSON with Comments"), ("a.1", "text\n", "Roff Manpage"), ("a.10", "text\n", None), ("run", "#!/usr/bin/env -S deno run\n", "JavaScript"), ("x.xyz", "", None), ("x.txt", "# vim: set ft=ruby :\n", "Ruby"),
]


def test_languages(spark):
    from astrolith.sources import corpus

    rows = [(k, f, t) for k, (f, t, _) in enumerate(LANGUAGES)]
    from pyspark.sql import functions as F

    got = {r.k: r.l for r in spark.createDataFrame(rows, "k int, file string, t string").select("k", corpus.language(F.col("file"), F.col("t")).alias("l")).collect()}
    assert {LANGUAGES[k][:2]: v for k, v in got.items()} == {(f, t): want for f, t, want in LANGUAGES}
    names = [x[0] for x in corpus.LANGUAGES]
    assert len(names) == len(set(names)) > 400
