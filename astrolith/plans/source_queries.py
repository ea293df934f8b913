"""Queries over the source tree that project.VIEWS generates from whole tables. Their SQL says from the same tables, without any source, what the scanners must find."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import config, graph, incremental, lookup, metrics, rename, rules, simulate
from ..sources import manifests
from . import reports
from .queries import query

_INIT = "'src/r' || r || '/n' || n || '/__init__.py'"
#: (file, language, module, broken) of what is scanned.
_SCANNED = f"""SELECT file, 'Python' AS language, module, broken FROM v_py UNION ALL SELECT {_INIT}, 'Python', 'r' || r || '.n' || n, false FROM v_inits UNION ALL SELECT 'src/r' || r_regionkey || '/__init__.py', 'Python', 'r' || r_regionkey, false FROM region
    UNION ALL SELECT 'use/u' || s || '.py', 'Python', 'use.u' || s, false FROM v_uses UNION ALL SELECT 'loops/a' || s || '.py', 'Python', 'loops.a' || s, false FROM v_uses UNION ALL SELECT 'loops/b' || s || '.py', 'Python', 'loops.b' || s, false FROM v_uses
    UNION ALL SELECT 'svc/s' || s || '/model.go', 'Go', 'example.com/svc/s' || s, false FROM v_uses"""
_EDGES = f"""SELECT file AS src, to_file AS dst FROM v_py WHERE NOT broken AND k > 0 UNION ALL SELECT {_INIT}, file FROM v_inits AS i JOIN v_py AS p USING (k) UNION ALL SELECT 'use/u' || s || '.py', {_INIT} FROM v_uses
    UNION ALL SELECT 'loops/a' || s || '.py', 'loops/b' || s || '.py' FROM v_uses UNION ALL SELECT 'loops/b' || s || '.py', 'loops/a' || s || '.py' FROM v_uses UNION ALL SELECT 'svc/s' || s || '/model.go', 'svc/s' || s // 2 || '/model.go' FROM v_uses WHERE s > 0"""
_EDGES = _EDGES.replace("SELECT 'src/r' || r || '/n' || n || '/__init__.py', file FROM v_inits AS i", "SELECT 'src/r' || i.r || '/n' || i.n || '/__init__.py', file FROM v_inits AS i")
_TREE = f"WITH scanned AS ({_SCANNED}), edges AS ({_EDGES})"
#: (file, path, leaf, kind, s_line, e_line, signature) of the declarations.
_DECLARED = """SELECT file, module || '.C' || k AS path, 'C' || k AS leaf, 'class' AS kind, 6 AS s_line, 12 AS e_line, 'class C' || k AS signature FROM v_py WHERE NOT broken
    UNION ALL SELECT file, module || '.C' || k || '.m' || k, 'm' || k, 'method', 9, 12, 'def m' || k || '(self, item: str, n=1) -> int' FROM v_py WHERE NOT broken
    UNION ALL SELECT file, module || '.f' || k, 'f' || k, 'function', 15, 19, 'def f' || k || '(x)' FROM v_py WHERE NOT broken UNION ALL SELECT file, module || '.g' || k, 'g' || k, 'function', 22, last, 'def g' || k || '(x)' FROM v_py WHERE NOT broken
    UNION ALL SELECT 'svc/s' || s || '/model.go', 'example.com/svc/s' || s || '.User' || s, 'User' || s, 'type', 5, 5, 'type User' || s || ' struct{ Name string }' FROM v_uses
    UNION ALL SELECT 'svc/s' || s || '/model.go', 'example.com/svc/s' || s || '.User' || s || '.Greet', 'Greet', 'method', 7, 9, 'func (u *User' || s || ') Greet() string' FROM v_uses
    UNION ALL SELECT 'svc/s' || s || '/model.go', 'example.com/svc/s' || s || '.User' || s || '.Save', 'Save', 'method', 11, 11, 'func (u *User' || s || ') Save() error { return nil }' FROM v_uses WHERE s % 2 = 0"""
_EXPORTS = f"""SELECT file, 'LIMIT' AS name, 'variable' AS kind, 3 AS line, 0 AS complexity, 0 AS max_depth, -1 AS internal_refs FROM v_py WHERE NOT broken UNION ALL SELECT file, 'C' || k, 'class', 6, 3, 2, 1 FROM v_py WHERE NOT broken
    UNION ALL SELECT file, 'f' || k, 'function', 15, 2, 1, CAST(k % 3 = 0 AS INT) + CAST(k = 0 AS INT) FROM v_py WHERE NOT broken UNION ALL SELECT file, 'g' || k, 'function', 22, CAST(2 + more AS INT), CAST(1 + more AS INT), 0 FROM v_py WHERE NOT broken
    UNION ALL SELECT {_INIT}, 'N' || n, 'variable', 2, 0, 0, -1 FROM v_inits UNION ALL SELECT 'use/u' || s || '.py', 'total', 'variable', 2, 0, 0, -1 FROM v_uses
    UNION ALL SELECT 'loops/a' || s || '.py', 'x', 'variable', CASE WHEN s % 2 = 0 THEN 2 ELSE 1 END, 0, 0, -1 FROM v_uses UNION ALL SELECT 'loops/b' || s || '.py', 'y', 'variable', 3, 0, 0, -1 FROM v_uses"""
_OTHER = "CASE s % 12 WHEN 0 THEN 'Makefile' WHEN 1 THEN 'Shell' WHEN 2 THEN 'C' WHEN 3 THEN 'JavaScript' WHEN 4 THEN 'Rust' WHEN 5 THEN 'Perl' WHEN 6 THEN 'XML' WHEN 7 THEN 'XML' WHEN 8 THEN 'Roff Manpage' WHEN 9 THEN 'Ruby' WHEN 10 THEN 'Markdown' END"


@query(f"WITH scanned AS ({_SCANNED}) SELECT file, language FROM scanned UNION ALL SELECT file, {_OTHER} FROM v_tools UNION ALL SELECT 'svc/go.mod', 'Go Module' FROM region WHERE r_regionkey = 0")
def source_languages(tree):
    return tree["files"].select("file", "language")


@query(f"WITH scanned AS ({_SCANNED}) SELECT file, language, module, CASE WHEN broken THEN 'SyntaxError: invalid syntax (line 1)' END AS parse_error FROM scanned")
def source_parse_errors(tree):
    return tree["scan"].select("file", "language", "module", "parse_error")


@query(f"WITH declared AS ({_DECLARED}) SELECT * FROM declared")
def source_declarations(tree):
    return tree["declarations"].select("file", "path", "leaf", "kind", "s_line", "e_line", "signature")


@query("""SELECT module || '.C' || k AS path, 'def m' || k || '(self, item: str, n=1) -> int:' AS first, 'size: int = 0' AS preview, 'class C' || k || ':' AS head FROM v_py WHERE NOT broken""")
def source_bodies(tree):
    from ..functions import text as T

    own = tree["declarations"].where("kind = 'class'").join(tree["files"].select("file", "content"), "file").withColumn("body", T.body(F.col("content"), F.col("s_byte"), F.col("e_byte")))
    return own.select("path", F.trim(T.window(F.col("body"), 3, 1)).alias("first"), T.window(F.col("preview"), 0, 1).alias("preview"), T.window(F.col("body"), 0, 1).alias("head"))


@query("""SELECT module || '.g' || k AS path, repeat('    elif x == 9:' || chr(10) || '        x = 2' || chr(10), CAST(more AS INT)) || '    return x' AS tail FROM v_py WHERE NOT broken""")
def source_body_windows(tree):
    from ..functions import text as T

    own = tree["declarations"].where("kind = 'function' AND leaf LIKE 'g%'").join(tree["files"].select("file", "content"), "file")
    return own.select("path", T.window(T.body(F.col("content"), F.col("s_byte"), F.col("e_byte")), 3, None).alias("tail"))


@query(f"""SELECT file, 'json' AS name, 'json' AS source, 1 AS line FROM v_py WHERE NOT broken UNION ALL SELECT file, 'C' || h, to_module || '.C' || h, 2 FROM v_py WHERE NOT broken AND k > 0 UNION ALL SELECT file, 'f' || h, to_module || '.f' || h, 2 FROM v_py WHERE NOT broken AND k > 0
UNION ALL SELECT file, 'logging', 'logging', 2 FROM v_py WHERE k = 0 UNION ALL SELECT {_INIT}, 'C' || k, 'r' || r || '.n' || n || '.c' || k || '.C' || k, 1 FROM v_inits UNION ALL SELECT 'use/u' || s || '.py', 'top', 'r' || r || '.n' || n || '.N' || n, 1 FROM v_uses
UNION ALL SELECT 'loops/a' || s || '.py', 'y', '.b' || s || '.y', CASE WHEN s % 2 = 0 THEN 1 ELSE 2 END FROM v_uses UNION ALL SELECT 'loops/b' || s || '.py', 'TYPE_CHECKING', 'typing.TYPE_CHECKING', 1 FROM v_uses UNION ALL SELECT 'loops/b' || s || '.py', 'x', 'loops.a' || s || '.x', 2 FROM v_uses
UNION ALL SELECT 'svc/s' || s || '/model.go', CASE WHEN s > 0 THEN 's' || s // 2 ELSE 'fmt' END, CASE WHEN s > 0 THEN 'example.com/svc/s' || s // 2 ELSE 'fmt' END, 3 FROM v_uses""")
def source_imports(tree):
    return tree["imports"].select("file", "name", "source", "line")


@query(f"WITH scanned AS ({_SCANNED}) SELECT module, file FROM scanned UNION ALL SELECT 'src.' || module, file FROM scanned WHERE file LIKE 'src/%'")
def source_modules(tree):
    return tree["modules"].select("module", "file")


@query(f"{_TREE} SELECT src, dst FROM edges")
def source_edges(tree):
    return tree["edges"]


@query("""SELECT 'loops/b' || s || '.py' AS file, 'typing' AS module, 'top' AS scope, 0 AS level FROM v_uses UNION ALL SELECT 'loops/b' || s || '.py', 'loops.a' || s, 'top', 0 FROM v_uses UNION ALL SELECT 'loops/b' || s || '.py', 'r0', 'type_checking', 0 FROM v_uses UNION ALL SELECT 'loops/a' || s || '.py', 'loops.b' || s, 'top', 1 FROM v_uses""")
def source_import_scopes(tree):
    return tree["edges_raw"].where("file LIKE 'loops/%'").select("file", "module", "scope", "level")


@query(f"{_TREE} SELECT src, dst FROM edges UNION ALL SELECT 'use/u' || s || '.py', file FROM v_uses AS u JOIN v_inits AS i ON u.n = i.n JOIN v_py AS p ON p.k = i.k")
def source_propagated_edges(tree):
    return graph.propagate(tree["edges"])


@query("""SELECT 'loops/a' || s || '.py > loops/b' || s || '.py > loops/a' || s || '.py' AS chain, 2 AS line, 'x' AS name, 'x is bound at line 2 of loops/a' || s || '.py, which waits at line 1' AS reason FROM v_uses WHERE s % 2 = 0""")
def source_cycles(tree):
    return simulate.cycles(tree["scan"].where("language = 'Python'")).select(F.array_join("chain", " > ").alias("chain"), "line", "name", "reason")


@query("SELECT file, CAST(last + 4 AS INT) AS line, 'f' || k || '()' AS call FROM v_py WHERE NOT broken AND k % 3 = 0")
def source_entrypoints(tree):
    return rules.entrypoints(tree["scan"])


@query("SELECT file, 18 AS line, CASE WHEN k % 2 = 0 THEN 'ValueError' ELSE 'Exception' END AS type, 'f' || k AS context FROM v_py WHERE NOT broken")
def source_swallowed(tree):
    return rules.swallowed(tree["scan"])


@query("SELECT file, 4 AS line, CASE k % 5 WHEN 1 THEN 'prepare' ELSE 'logging.info' END AS call, CASE k % 5 WHEN 1 THEN 'warning' ELSE 'debug' END AS severity FROM v_py WHERE NOT broken AND k % 5 IN (1, 2)")
def source_side_effects(spark, tree):
    return rules.side_effects(tree["scan"], spark.createDataFrame(reports.PACKAGE_ROLES, "prefix string, severity string"))


_ORPHANS = "SELECT file FROM scanned WHERE file NOT IN (SELECT dst FROM edges) AND file NOT LIKE '%/__init__.py' AND file NOT IN (SELECT file FROM v_py WHERE NOT broken AND k % 3 = 0)"


@query(f"{_TREE} SELECT file, 'dead code' AS reason FROM ({_ORPHANS}) AS o")
def source_orphans(tree):
    return rules.orphans(tree["scan"].select("file"), tree["edges"], rules.entrypoints(tree["scan"]))


@query(f"WITH e AS ({_EXPORTS}) SELECT * FROM e")
def source_exports(tree):
    return tree["scan"].select("file", F.explode("exports").alias("e")).select("file", "e.name", "e.kind", "e.line", "e.complexity", "e.max_depth", "e.internal_refs")


@query("SELECT file, 'm' || k AS name, 9 AS line, 4 AS lines, 3 AS complexity, 1 AS max_depth, false AS is_async FROM v_py WHERE NOT broken")
def source_methods(tree):
    return tree["scan"].select("file", F.explode("exports").alias("e")).select("file", F.explode("e.methods").alias("m")).select("file", "m.*")


@query(f"""WITH e AS ({_EXPORTS}), u AS (SELECT to_file AS file, 'C' || h AS name, file AS importer FROM v_py WHERE NOT broken AND k > 0 UNION ALL SELECT to_file, 'f' || h, file FROM v_py WHERE NOT broken AND k > 0 UNION ALL SELECT {_INIT}, 'N' || n, 'use/u' || s || '.py' FROM v_uses
UNION ALL SELECT 'loops/a' || s || '.py', 'x', 'loops/b' || s || '.py' FROM v_uses UNION ALL SELECT 'loops/b' || s || '.py', 'y', 'loops/a' || s || '.py' FROM v_uses)
SELECT e.file, e.name, coalesce(string_agg(importer, ',' ORDER BY importer), '') AS used_by FROM e LEFT JOIN u ON e.file = u.file AND e.name = u.name GROUP BY e.file, e.name""")
def source_export_usage(tree):
    return metrics.export_usage(tree["scan"], tree["modules"]).withColumn("used_by", F.array_join("used_by", ","))


@query("""WITH n AS (SELECT count(*) AS n, sum(more) AS more FROM v_py WHERE NOT broken), i AS (SELECT count(*) AS i FROM v_inits), s AS (SELECT count(*) AS s FROM v_uses)
SELECT CAST(2 * n AS BIGINT) AS functions, n AS methods, n AS classes, CAST(13 * n + 2 * more AS BIGINT) AS callable_lines, n AS typed_functions, CAST(4 * n AS BIGINT) AS args, n AS typed_args, n AS attrs, n AS typed_attrs, CAST(n + i + 3 * s AS BIGINT) AS vars, CAST(0 AS BIGINT) AS typed_vars,
CAST(floor((13 * n + 2 * more) / (3 * n)) AS BIGINT) AS avg_lines, CAST(33.3 AS DOUBLE) AS return_pct, CAST(25 AS DOUBLE) AS arg_pct, CAST(100 AS DOUBLE) AS attr_pct, CAST(37.5 AS DOUBLE) AS overall_pct FROM n, i, s""")
def source_structure(tree):
    found = metrics.structure(tree["scan"])
    return found.select(*[F.col(c).cast("double" if c.endswith("_pct") else "bigint").alias(c) for c in found.columns])


@query("""SELECT file, CAST(last + CASE WHEN k % 3 = 0 THEN 4 ELSE 0 END AS BIGINT) AS loc, CAST(last - 6 - CASE WHEN k % 5 IN (1, 2) THEN 0 ELSE 1 END + CASE WHEN k % 3 = 0 THEN 2 ELSE 0 END AS BIGINT) AS sloc, 1 AS classes, 3 AS functions, CAST(7 + more AS INT) AS complexity, CAST(greatest(2, 1 + more) AS INT) AS max_depth, CAST(33.3 AS DOUBLE) AS typed_pct FROM v_py WHERE NOT broken""")
def source_per_file(tree):
    measured = metrics.file_metrics(tree["files"].withColumn("content", F.decode("content", "UTF-8")))
    found = metrics.per_file(tree["scan"], measured).where("classes > 0")
    return found.withColumn("typed_pct", F.col("typed_pct").cast("double"))


@query("""SELECT to_module || '.f' || h AS name, module || '.C' || k || '.m' || k AS path, file, 11 AS line FROM v_py WHERE NOT broken AND k > 0 AND h NOT IN (SELECT k FROM v_py WHERE broken) UNION ALL SELECT module || '.C' || k || '.m' || k, module || '.f' || k, file, 17 FROM v_py WHERE NOT broken
UNION ALL SELECT module || '.C' || k, module || '.f' || k, file, 17 FROM v_py WHERE NOT broken UNION ALL SELECT module || '.f' || k, module || '.C' || k || '.m' || k, file, 11 FROM v_py WHERE k = 0""")
def source_callers(tree):
    names = tree["declarations"].where("language = 'Python'").select(F.col("path").alias("name"))
    found = lookup.callers(tree["refs"], tree["declarations"], names).select(F.col("name").alias("leaf"), "path", "file", "line")
    return names.withColumn("leaf", F.element_at(F.split("name", r"\."), -1)).join(found, "leaf").select("name", "path", "file", "line")


@query("""SELECT module || '.C' || k || '.m' || k AS path, 'LIMIT' AS name, 'name' AS kind, 10 AS line FROM v_py WHERE NOT broken UNION ALL SELECT module || '.C' || k || '.m' || k, 'f' || h, 'name', 11 FROM v_py WHERE NOT broken UNION ALL SELECT module || '.C' || k || '.m' || k, 'json', 'name', 12 FROM v_py WHERE NOT broken
UNION ALL SELECT module || '.C' || k || '.m' || k, 'dumps', 'attr', 12 FROM v_py WHERE NOT broken UNION ALL SELECT module || '.f' || k, 'C' || k, 'name', 17 FROM v_py WHERE NOT broken UNION ALL SELECT module || '.f' || k, 'm' || k, 'attr', 17 FROM v_py WHERE NOT broken
UNION ALL SELECT 'example.com/svc/s' || s || '.User' || s, 'Name', 'name', 5 FROM v_uses UNION ALL SELECT 'example.com/svc/s' || s || '.User' || s || '.Greet', 'Name', 'attr', 8 FROM v_uses""")
def source_refs(tree):
    return tree["refs"].join(tree["declarations"].select(F.col("id").alias("source_id"), "path"), "source_id").select("path", "name", "kind", "line")


@query("""SELECT file, 'rewrite' AS bucket, 15 AS line, 'definition' AS kind FROM v_py WHERE k = 1 UNION ALL SELECT file, 'rewrite', 2, 'import' FROM v_py WHERE h = 1 AND k > 1 AND NOT broken UNION ALL SELECT file, 'rewrite', 11, 'name' FROM v_py WHERE h = 1 AND k > 1 AND NOT broken UNION ALL SELECT file, 'unresolved', NULL, 'file' FROM v_py WHERE broken""")
def source_rename(tree):
    target = tree["declarations"].where("leaf = 'f1'").first()["path"]
    return rename.rename_places(tree["files"].where("language = 'Python'"), target, owners=1, member=False).select("file", "bucket", "line", "kind")


@query("""SELECT file, 'rewrite' AS bucket, 9 AS line, 'definition' AS kind FROM v_py WHERE k = 2 UNION ALL SELECT file, 'rewrite', 17, 'attribute' FROM v_py WHERE k = 2""")
def source_rename_member(tree):
    status, found = rename.rename(tree, tree["declarations"].where("leaf = 'm2'").first()["path"], "renamed")
    return found.where(F.lit(status == "ok")).select("file", "bucket", "line", "kind")


@query("""SELECT 'svc/s' || s || '/model.go' AS file, 'rewrite' AS bucket, line, 'name' AS kind FROM (SELECT 5 AS line UNION ALL SELECT 7 UNION ALL SELECT 11) AS l, v_uses WHERE s = 2""")
def source_rename_go(tree):
    return rename.rename(tree, "example.com/svc/s2.User2", "Person")[1].select("file", "bucket", "line", "kind")


@query("""SELECT w AS wanted, s AS status FROM (VALUES ('bad name', 'bad_name'), ('class', 'bad_name'), ('f1', 'bad_name'), ('g1', 'collision'), ('ok_name', 'ok')) AS t(w, s)""")
def source_rename_checks(spark, tree):
    target = tree["declarations"].where("leaf = 'f1'").first()["path"]
    return spark.createDataFrame([(w, rename.rename(tree, target, w)[0]) for w in ("bad name", "class", "f1", "g1", "ok_name")], "wanted string, status string")


@query("""SELECT 'r' || n_nationkey AS name, 10 AS prio FROM nation UNION ALL SELECT 'common-lib', 10 UNION ALL SELECT 'opt' || n_nationkey, 20 FROM nation UNION ALL SELECT 'grp' || n_nationkey, 30 FROM nation UNION ALL SELECT 'poe' || n_nationkey, 40 FROM nation
UNION ALL SELECT 'req' || n_nationkey, 50 FROM nation UNION ALL SELECT 'cfg' || n_nationkey, 60 FROM nation UNION ALL SELECT 'pip' || n_nationkey, 70 FROM nation""")
def source_dependencies(manifests):
    return _deps(manifests).select("name", "prio")


def _deps(files):
    return manifests.first_of_each(manifests.requirements(files))


@query("""WITH d AS (SELECT 'r' || n_nationkey AS name FROM nation UNION ALL SELECT 'common-lib' UNION ALL SELECT unnest(['opt', 'grp', 'poe', 'req', 'cfg', 'pip']) || n_nationkey FROM nation) SELECT name FROM d WHERE name NOT IN (SELECT 'r' || r FROM v_py WHERE NOT broken UNION SELECT 'r' || r FROM v_uses)""")
def source_unused_deps(manifests, tree):
    used = tree["scan"].select(F.explode("edges").alias("e")).where("e.level = 0").select(F.col("e.module").alias("module"))
    return rules.unused_deps(_deps(manifests), used)


@query("""SELECT 'Greeter' AS interface, 'example.com/svc/s' || s || '.User' || s AS type FROM v_uses UNION ALL SELECT 'Both', 'example.com/svc/s' || s || '.User' || s FROM v_uses WHERE s % 2 = 0""")
def source_interfaces(spark, tree):
    own = tree["declarations"].where("language = 'Go' AND kind = 'method'").select(F.regexp_replace("path", r"\.[^.]*$", "").alias("type"), F.col("leaf").alias("name"))
    need = spark.createDataFrame([("Greeter", "Greet"), ("Both", "Save"), ("Both", "Greet"), ("More", "Save"), ("More", "Load")], "interface string, name string")
    return lookup.interface_impact(own, need)


@query(f"""{_TREE}, n AS (SELECT dst AS file, count(*) AS n FROM edges GROUP BY dst), g AS (SELECT e.dst AS file, n FROM edges AS e JOIN n ON n.file = e.src WHERE e.src LIKE '%/__init__.py' AND regexp_replace(e.src, '/[^/]*$', '') = regexp_replace(e.dst, '/[^/]*$', ''))
SELECT file, CAST(sum(n) AS BIGINT) AS fan_in FROM (SELECT * FROM n UNION ALL SELECT * FROM g) AS t WHERE file NOT LIKE '%/__init__.py' GROUP BY file HAVING sum(n) >= 3""")
def source_hotspots(tree):
    return graph.hotspots(tree["edges"], 3)


@query(f"{_TREE} SELECT src AS file, count(*) AS fan_out FROM edges WHERE src NOT LIKE '%/__init__.py' OR src IN (SELECT {_INIT} FROM v_inits) GROUP BY src")
def source_fragile(tree):
    return graph.fragile(tree["edges"], tree["scan"], 1)


_LOC = "CASE WHEN p.broken THEN 1 ELSE p.last + CASE WHEN p.k % 3 = 0 THEN 4 ELSE 0 END END"


@query(f"""{_TREE}, one AS (SELECT dst, min(src) AS importer FROM edges GROUP BY dst HAVING count(*) = 1) SELECT dst AS node, importer, CAST({_LOC} AS BIGINT) AS lines FROM one JOIN v_py AS p ON p.file = dst WHERE {_LOC} < 30
UNION ALL SELECT dst, importer, CASE WHEN dst LIKE 'loops/b%' THEN 5 ELSE 2 END FROM one WHERE dst LIKE 'loops/%' UNION ALL SELECT dst, importer, CASE WHEN CAST(regexp_extract(dst, 's([0-9]+)', 1) AS BIGINT) % 2 = 0 THEN 11 ELSE 9 END FROM (SELECT * FROM one WHERE dst LIKE 'svc/%') AS g""")
def source_leaves(tree):
    sizes = metrics.file_metrics(tree["files"].withColumn("content", F.decode("content", "UTF-8"))).select(F.col("file").alias("node"), F.col("loc").alias("lines"))
    return graph.leaves(tree["edges"], sizes, 30)


@query(f"""WITH RECURSIVE edges AS ({_EDGES}), c(node, length) AS (SELECT dst, 1 FROM edges WHERE dst LIKE 'src/%' OR dst LIKE 'svc/%' UNION SELECT src, CAST(length + CASE WHEN src LIKE '%/__init__.py' THEN 0 ELSE 1 END AS INT) FROM edges JOIN c ON dst = node),
s AS (SELECT node, max(length) AS length FROM c GROUP BY node) SELECT node, length FROM s WHERE node IN (SELECT src FROM edges)
UNION ALL SELECT 'loops/' || x || s || '.py', 1 FROM v_uses, (SELECT 'a' AS x UNION ALL SELECT 'b') AS t""")
def source_chains(tree):
    """Files on one cycle count once, as the least of them."""
    return graph.deep_chains(tree["edges"], 1).select("node", "length")


@query("""WITH RECURSIVE u(k, pos, chain) AS (SELECT k, k, file FROM v_py WHERE NOT broken UNION ALL SELECT u.k, p.h, chain || ' > ' || to_file FROM u JOIN v_py AS p ON p.k = u.pos WHERE p.k > 0 AND NOT p.broken)
SELECT file AS node, len(string_split(chain, ' > ')) AS length, chain FROM (SELECT k, arg_max(chain, length(chain)) AS chain FROM u GROUP BY k) AS c JOIN v_py USING (k) WHERE len(string_split(chain, ' > ')) >= 5""")
def source_deep_chains(tree):
    found = graph.deep_chains(tree["edges"], 5).where("node LIKE 'src/%' AND node NOT LIKE '%/__init__.py'")
    return found.select("node", F.col("length").cast("bigint").alias("length"), F.array_join("chain", " > ").alias("chain"))


@query(f"""{_TREE}, u AS (SELECT DISTINCT dst AS package FROM edges) SELECT (SELECT count(*) FROM scanned) AS total, (SELECT count(*) FROM (SELECT src FROM edges UNION SELECT dst FROM edges) AS t) AS connected, (SELECT count(*) FROM scanned) - (SELECT count(*) FROM (SELECT src FROM edges UNION SELECT dst FROM edges) AS t) AS orphans, (SELECT count(*) FROM edges) AS edges""")
def source_summary(tree):
    return graph.summary(tree["edges"], tree["scan"].select(F.col("file").alias("node")))


@query("""SELECT file, 'json' AS name, 'json' AS source_module, '' AS source_file, 'top' AS scope FROM v_py WHERE NOT broken UNION ALL SELECT file, unnest(['C', 'f']) || h, to_module, to_file, 'top' FROM v_py WHERE NOT broken AND k > 0 UNION ALL SELECT file, 'logging', 'logging', '', 'top' FROM v_py WHERE k = 0""")
def source_import_names(tree):
    return graph.import_names(tree["edges_raw"], tree["modules"]).where("file LIKE 'src/%/c%.py'")


@query("""SELECT w AS wanted, CASE w WHEN 'loops/a1.py' THEN 'loops/a1.py' WHEN 'u2.py' THEN 'use/u2.py' WHEN 's3/mod' THEN 'svc/s3/model.go' WHEN 'loops/' THEN 'loops/a0.py' END AS file, CASE w WHEN 'loops/a1.py' THEN 'loops/a1.py' WHEN 'u2.py' THEN 'use/u2.py' END AS analysed FROM (VALUES ('loops/a1.py'), ('u2.py'), ('s3/mod'), ('loops/'), ('nowhere')) AS t(w)""")
def source_targets(spark, tree):
    wanted = spark.createDataFrame([(x,) for x in ("loops/a1.py", "u2.py", "s3/mod", "loops/", "nowhere")], "wanted string")
    files = tree["scan"].select("file")
    return lookup.match_files(files, wanted).join(lookup.match_files(files, wanted, loose=False).withColumnRenamed("file", "analysed"), "wanted")


@query("""WITH RECURSIVE a(k, pos) AS (SELECT k, h FROM v_py WHERE k > 0 AND NOT broken UNION SELECT a.k, p.h FROM a JOIN v_py AS p ON p.k = a.pos WHERE p.k > 0 AND NOT p.broken)
SELECT file AS node, CASE WHEN h = 3 THEN 'direct' ELSE 'transitive' END AS reach FROM a JOIN v_py USING (k) WHERE pos = 3
UNION ALL SELECT DISTINCT 'src/r' || i.r || '/n' || i.n || '/__init__.py', CASE WHEN i.k = 3 THEN 'direct' ELSE 'transitive' END FROM v_inits AS i LEFT JOIN a ON a.k = i.k WHERE i.k = 3 OR pos = 3
UNION ALL SELECT DISTINCT 'use/u' || s || '.py', 'transitive' FROM v_uses AS u JOIN v_inits AS i ON u.n = i.n LEFT JOIN a ON a.k = i.k WHERE i.k = 3 OR pos = 3""")
def source_blast(tree):
    target = lookup.match_files(tree["scan"].select("file"), tree["scan"].sparkSession.createDataFrame([("/c3.py",)], "wanted string")).first()["file"]
    return graph.blast(tree["edges"], target)


@query(f"""{_TREE} SELECT section, severity, count(*) AS n FROM (SELECT 'entrypoints' AS section, 'debug' AS severity FROM v_py WHERE NOT broken AND k % 3 = 0 UNION ALL SELECT 'orphans', 'warning' FROM ({_ORPHANS}) AS o UNION ALL SELECT 'side_effects', 'warning' FROM v_py WHERE NOT broken AND k % 5 = 1
UNION ALL SELECT 'swallowed', CASE WHEN k % 2 = 0 THEN 'info' ELSE 'warning' END FROM v_py WHERE NOT broken UNION ALL SELECT 'unused_deps', 'warning' FROM (SELECT 'common-lib' UNION ALL SELECT unnest(['opt', 'grp', 'poe', 'req', 'cfg', 'pip']) || n_nationkey FROM nation UNION ALL SELECT 'r' || n_nationkey FROM nation WHERE 'r' || n_nationkey NOT IN (SELECT 'r' || r FROM v_py WHERE NOT broken UNION SELECT 'r' || r FROM v_uses)) AS d
UNION ALL SELECT 'code_structure', 'debug' UNION ALL SELECT 'stack', 'info' FROM nation WHERE n_nationkey = 0) AS f GROUP BY section, severity""")
def source_findings(spark, manifests, tree):
    everything = config.ProjectConfig(min_severity="skip")
    packages = spark.createDataFrame([("req0", "web")], "name string, category string")
    return rules.severity_counts(reports.audit(spark, tree, _deps(manifests), everything, packages))


@query(f"WITH scanned AS ({_SCANNED}), declared AS ({_DECLARED}) SELECT (SELECT count(*) FROM scanned) AS files, (SELECT count(*) FROM declared) AS declarations")
def source_index_stats(tree):
    return metrics.index_stats(tree["scan"], tree["declarations"], tree["refs"], tree["imports"]).select("files", "declarations")


@query("""SELECT file, 'rest' AS state FROM v_py WHERE NOT broken AND k % 7 <> 0 UNION ALL SELECT file, 'scanned again' FROM v_py WHERE NOT broken AND k % 7 = 0""")
def source_refreshed(tree):
    """A refresh after which every seventh file was scanned again, its first declaration standing for the file."""
    rows = tree["declarations"].where("kind = 'class'").select("file", F.lit("rest").alias("state"))
    old = rows.select("file", F.lit(1).alias("mtime"))
    seventh = F.regexp_extract("file", r"c(\d+)\.py$", 1).cast("bigint") % 7 == 0
    new = old.withColumn("mtime", F.when(seventh, 2).otherwise(F.col("mtime")))
    changes = incremental.diff(old, new)
    return incremental.refresh(rows, changes, incremental.to_scan(changes).withColumn("state", F.lit("scanned again")))
