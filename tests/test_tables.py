"""Edits, renames, manifests, settings, saved tables and streams on small inputs."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from astrolith.operators import config, edits, graph, incremental, lookup, rename
from astrolith.sources import manifests
from astrolith.streaming import refresh

EDIT = "file string, k int, start bigint, end bigint, new string"


def content(df):
    return {r.file: bytes(r.content) if r.content is not None else None for r in df.collect()}


def store(spark, tree):
    return spark.createDataFrame([(k, v.encode()) for k, v in tree.items()], "file string, content binary")


def test_splices(spark):
    s = store(spark, {"a": "αβγ delta", "b": "12345", "c": "xyz", "d": "same"})
    e = spark.createDataFrame([("a", 0, 0, 2, "A"), ("a", 1, 4, 6, None), ("b", 0, 1, 4, "-"), ("b", 1, 3, 5, "!"), ("c", 0, 2, 9, "?"), ("none", 0, 0, 0, "x")], EDIT)
    got = {r.file: (bytes(r.content).decode(), r.status) for r in edits.apply(s, e).collect()}
    assert got == {"a": ("Aβ delta", "ok"), "b": ("12345", "overlap"), "c": ("xyz", "bad_range")}
    assert edits.apply(s, e.where("false")).count() == 0


def test_locate_by_text(spark):
    s = store(spark, {"a": "one two one", "b": "é two", "c": "aaa"})
    e = spark.createDataFrame([("a", 0, None, None, "one", "1"), ("a", 1, None, None, "two", "2"), ("b", 0, None, None, "two", "2"), ("c", 0, None, None, "aa", "b"), ("a", 2, 0, 99, None, ""), ("x", 0, 0, 0, None, ""), ("b", 1, None, None, "", "z")], "file string, k int, start bigint, end bigint, old string, new string")
    got = {(r.file, r.k): (r.status, r.start, r.end) for r in edits.locate(e, s).collect()}
    assert got[("a", 0)][0] == "ambiguous" and got[("a", 1)] == ("ok", 4, 7) and got[("b", 0)] == ("ok", 3, 6)
    assert got[("c", 0)][0] == "ambiguous" and got[("a", 2)][0] == "bad_range" and got[("x", 0)][0] == "no_file" and got[("b", 1)][0] == "not_found"


def test_transaction_and_undo(spark):
    s = store(spark, {"a": "1", "b": "2"})
    after, log = edits.commit(s, store(spark, {"a": "new", "c": "made"}), 3)
    assert content(after) == {"a": b"new", "b": b"2", "c": b"made"}
    assert content(edits.undo(after, log)) == content(s)
    many = spark.range(60).select(F.col("id").alias("tx_id"), F.lit("f").alias("file"))
    assert edits.prune(many).agg(F.min("tx_id")).first()[0] == 10


def test_insert_delete_replace(spark):
    s = store(spark, {"m.py": "def f():\n    pass\n"})
    sym = spark.createDataFrame([("i", "m.py", 0, 17, 0, 9, 4)], "id string, file string, s_byte bigint, e_byte bigint, col int, body_byte bigint, indent int")
    assert content(edits.apply(s, edits.insert(sym, "after", "g = 1\n")))["m.py"] == b"def f():\n    pass\n\n\ng = 1\n"
    assert content(edits.apply(s, edits.insert(sym, "before", "g = 1")))["m.py"] == b"g = 1\n\n\ndef f():\n    pass\n"
    assert content(edits.apply(s, edits.delete(sym)))["m.py"] == b"\n"
    assert edits.delete(sym, spark.createDataFrame([("i", True)], "id string, blocked boolean")).count() == 0
    assert content(edits.apply(s, edits.replace(sym, "h = 2\n")))["m.py"] == b"h = 2\n"
    with pytest.raises(ValueError):
        edits.insert(sym, "beside", "x")


CODE = """class A:
    def save(self):
        self.save()

class B:
    def save(self): ...

def use(x: B, z):
    a = A()
    a.save()
    x.save()
    z.save()
"""


def test_member_rename(spark):
    found = rename.rename_places(store(spark, {"m.py": CODE, "bad.py": "def ("}), "m.A.save", owners=2, member=True)
    got = sorted((r.bucket, r.line, r.kind) for r in found.where("file = 'm.py'").collect())
    assert got == [("rewrite", 2, "definition"), ("rewrite", 3, "attribute"), ("rewrite", 10, "attribute"), ("skipped_mismatch", 11, "attribute"), ("unresolved", 12, "attribute")]
    assert found.where("file = 'bad.py'").first().bucket == "unresolved"
    new = content(edits.apply(store(spark, {"m.py": CODE}), rename.rename_edits(found, "store")))["m.py"].decode()
    assert new.count("store") == 3 and new.count("save") == 3
    unique = rename.rename_places(store(spark, {"m.py": "z.save()\n"}), "m.A.save", owners=1, member=True)
    assert [r.bucket for r in unique.collect()] == ["rewrite"]


def test_module_rename(spark):
    text = "from lib import f\nf()\ndef g(f):\n    return f\ndef h():\n    return f()\n"
    found = rename.rename_places(store(spark, {"a.py": text}), "lib.f", owners=1, member=False)
    assert [(r.line, r.kind) for r in found.where("bucket = 'rewrite'").orderBy("start").collect()] == [(1, "import"), (2, "name"), (6, "name")]


def test_manifests(spark):
    py = '[project]\ndependencies = ["flask[async]>=2.0", "Django_X~=4.0"]\n[project.optional-dependencies]\nx = ["numpy"]\n[dependency-groups]\ng = ["pytest", {include-group = "x"}]\n[tool.poetry.dependencies]\npython = "3"\nflask = "*"\n'
    rows = [("pyproject.toml", py), ("requirements-dev.txt", "# c\n-r x\nflask==1 # y\nruff\n"), ("setup.cfg", "[options]\ninstall_requires =\n    attrs\n"), ("Pipfile", "[packages]\nblack = '*'\n"), ("b/pyproject.toml", "[["), ("n", None)]
    reqs = manifests.requirements(spark.createDataFrame(rows, "path string, content string"))
    got = [(r.name, r.prio) for r in manifests.first_of_each(reqs).orderBy("prio", "path", "pos").collect()]
    assert got == [("flask", 10), ("django-x", 10), ("numpy", 20), ("pytest", 30), ("ruff", 50), ("attrs", 60), ("black", 70)]


def test_settings(spark):
    c = config.parse_config(pyproject='[tool.astrolith]\nexclude = ["x"]\n[tool.astrolith.thresholds.cycles]\ninfo = 1\nwarning = 2\nerror = 3\n')
    assert c.exclude == ["x"] and c.thresholds == {"cycles": (1, 2, 3)} and config.parse_config("[[").map_limit == 10
    packages = spark.createDataFrame([("web", ["flask"], []), ("ci", [], ["tox.ini"]), ("no", ["x"], ["y"])], "name string, detect_deps array<string>, detect_files array<string>")
    got = config.active_frameworks(packages, spark.createDataFrame([("flask",)], "name string"), spark.createDataFrame([("tox.ini",)], "file string"))
    assert sorted(r.name for r in got.collect()) == ["ci", "web"]


def test_saved_tables(spark, tmp_path):
    t = {"declarations": spark.createDataFrame([("a", 1)], "path string, n int")}
    incremental.save_index(t, str(tmp_path / "i"), "/root")
    assert incremental.load_index(spark, str(tmp_path / "i"), "/root")["declarations"].collect() == t["declarations"].collect()
    assert incremental.load_index(spark, str(tmp_path / "i"), "/other") is None and incremental.load_index(spark, str(tmp_path / "none"), "/root") is None


def test_search_limits_and_nulls(spark):
    s = spark.createDataFrame([("1", "a.b", "class", "f"), ("2", "x.a.b", "method", "f"), ("3", None, "method", "f")], "id string, path string, kind string, file string")
    assert [r.id for r in lookup.search(s, ["a.b"]).collect()] == ["1", "2"] and lookup.search(s, ["b"], limit=0).count() == 0
    assert lookup.search(s, []).count() == 3 and lookup.search(s.where("false"), ["b"]).count() == 0


def test_empty_and_cyclic_graphs(spark):
    none = spark.createDataFrame([], "src string, dst string")
    assert graph.closure(none).count() == graph.components(none).count() == graph.longest_chains(none).count() == 0
    # a cycle counts as one file
    loop = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("z", "a")], "src string, dst string")
    assert {(r.node, r.length) for r in graph.longest_chains(loop).collect()} == {("a", 1), ("b", 1), ("c", 0), ("z", 2)}


def test_refresh_stream(spark, tmp_path):
    schema = "file string, change string, n int"
    src, table, cp = (str(tmp_path / x) for x in ("src", "table", "cp"))
    scan = lambda df: df.select("file", "n")
    for rows in ([("a", "added", 1), ("b", "added", 2)], [("a", "modified", 5), ("b", "deleted", None), ("c", "added", 3)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        refresh.refresh_table(refresh.read_changes(spark, src, schema), table, cp, scan).awaitTermination()
    assert sorted(tuple(r) for r in refresh.latest_version(spark, table).collect()) == [("a", 5), ("c", 3)]


def test_read_state_stream(spark, tmp_path):
    schema = "file string, start bigint, end bigint, served_at timestamp_ntz"
    src = str(tmp_path / "reads")
    spark.createDataFrame([("a", 1, 2, datetime(2024, 1, 1)), ("a", 1, 2, datetime(2024, 1, 3)), ("b", 1, 2, datetime(2024, 1, 2))], schema).write.parquet(src)
    q = refresh.latest_reads(refresh.read_changes(spark, src, schema)).writeStream.format("memory").queryName("reads").outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination()
    assert sorted((r.file, r.served_at, r.n) for r in spark.table("reads").collect()) == [("a", datetime(2024, 1, 3), 2), ("b", datetime(2024, 1, 2), 1)]


def test_activity_windows(spark):
    e = spark.createDataFrame([(datetime(2024, 1, 1, 0, 5), "x"), (datetime(2024, 1, 1, 0, 50), "x"), (datetime(2024, 1, 1, 1, 0), "x")], "ts timestamp_ntz, section string")
    assert [(r.window_start, r.n) for r in refresh.activity(e).orderBy("window_start").collect()] == [(datetime(2024, 1, 1, 0), 2), (datetime(2024, 1, 1, 1), 1)]


def test_reports(spark, tmp_path):
    from astrolith.plans import reports

    tree = {"app.py": "from core import run\nimport requests\nrequests.get('x')\nrun()\n", "core.py": "def run():\n    '''Doc.'''\n    return helper()\n\n\nclass K:\n    def m(self): return run()\n", "lonely.py": "x = 1\n", "go.mod": "module x", "Dockerfile": "FROM x"}
    t = reports.build_tables(store(spark, tree))
    assert sorted((r.path, r.kind, r.parent) for r in t["declarations"].collect()) == [("core.K", "class", None), ("core.K.m", "method", "core.py#1"), ("core.run", "function", None)]
    assert [(r.path, r.ref_kind) for r in lookup.callers(t["refs"], t["declarations"], "core.run").orderBy("path").collect()] == [("core.K", "name")] * 0 + [("core.K.m", "name")]
    assert [tuple(r) for r in t["edges"].collect()] == [("app.py", "core.py")]
    deps = spark.createDataFrame([("requests",), ("flask",)], "name string")
    found = reports.audit(spark, t, deps)
    assert sorted((r.section, r.detail, r.severity) for r in found.collect()) == [("orphans", "dead code", "warning"), ("side_effects", "requests.get", "error"), ("side_effects", "run", "warning"), ("unused_deps", "flask", "warning")]
    m = reports.project_map(t, config.ProjectConfig(thresholds={"hotspots": (1, 5, 9)}))
    assert [tuple(r) for r in m["hotspots"].collect()] == [("core.py", 1, "info")] and m["cycles"].count() == 0 and m["summary"].first().orphans == 1
    rows = {r.file: r for r in reports.dump(t).collect()}
    assert [(u.name, u.used_by) for u in rows["core.py"].usage] == [("K", []), ("run", ["app.py"])]
    reports.write_json(reports.dump(t), str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 3
    assert {r.section: r.text for r in reports.ignore_config(found).collect()}["side_effects"] == 'ignore = ["requests.get", "run"]'
    assert sorted(r.file for r in reports.config_files(t["files"]).collect()) == ["Dockerfile"]


def test_layout(spark):
    from astrolith.operators import layout

    text = "import os\n# about f\n@deco\ndef f():\n    pass\nclass A:\n\n    x = 1\n    def m(self): ...\n\n\n    def n(self): ...\n"
    want = "import os\n\n\n# about f\n@deco\ndef f():\n    pass\n\n\nclass A:\n\n    x = 1\n\n    def m(self): ...\n\n    def n(self): ...\n"
    assert layout.normalised(text) == want == layout.normalised(want) and layout.normalised("") == ""
    df = spark.createDataFrame([("a\nb\n", "a\nc\n", "f.py"), (None, None, None)], "a string, b string, n string")
    got = [r.d for r in df.select(layout.unified_udf("a", "b", "n").alias("d")).collect()]
    assert got == ["--- a/f.py\n+++ b/f.py\n@@ -1,2 +1,2 @@\n a\n-b\n+c", ""]
    assert layout.unified("a\n", "b\n", most=2).endswith("... 3 more lines")
    assert [r.d for r in df.select(layout.normalised_udf("a").alias("d")).collect()] == ["a\nb\n", None]


def test_distinct_views_have_partitions_by_rows(spark, monkeypatch):
    from astrolith.plans import project

    data = "/root/testdata/sf0.001"
    want = sorted(map(tuple, project.view(spark, data, "refs").collect()))
    monkeypatch.setattr(project, "DISTINCT_ROWS", 500)
    got = project.view(spark, data, "refs")
    assert sorted(map(tuple, got.collect())) == want and got.rdd.getNumPartitions() > 10
