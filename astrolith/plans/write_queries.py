"""Queries of edits, reports, reads and predicates, over the generated tree and the driver's tables, each with the SQL that says the same."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import session
from ..functions import paths
from ..functions import text as T
from ..operators import config, edits, graph, incremental, layout, lookup, rules
from ..sources import corpus
from . import project, reports
from .queries import query

_NEW = "def extra(self):\n    return LIMIT\n"
#: The text of a customer's file around the class and the last function, as project.VIEWS has it.
_TEXT = f"SELECT k, file, module, ({project._LINES}) AS content FROM v_py WHERE NOT broken"


@query(f"WITH t AS ({_TEXT}) SELECT file, replace(content, '        return json.dumps(item)' || chr(10), '        return json.dumps(item)' || chr(10) || chr(10) || '    def extra(self):' || chr(10) || '        return LIMIT' || chr(10)) AS content, 'ok' AS status FROM t")
def write_insert_end(tree):
    return _written(tree, edits.checked_insert(tree["declarations"].where("kind = 'class'"), "end", _NEW))


@query(f"WITH t AS ({_TEXT}) SELECT file, replace(content, '    size: int = 0' || chr(10), '    def extra(self):' || chr(10) || '        return LIMIT' || chr(10) || chr(10) || '    size: int = 0' || chr(10)) AS content, 'ok' AS status FROM t")
def write_insert_start(tree):
    return _written(tree, edits.checked_insert(tree["declarations"].where("kind = 'class'"), "start", _NEW))


@query(f"WITH t AS ({_TEXT}) SELECT file, replace(content, 'class C', 'def extra(self):' || chr(10) || '    return LIMIT' || chr(10) || chr(10) || chr(10) || 'class C') AS content, 'ok' AS status FROM t")
def write_insert_before(tree):
    return _written(tree, edits.checked_insert(tree["declarations"].where("kind = 'class'"), "before", _NEW))


@query(f"WITH t AS ({_TEXT}) SELECT file, replace(content, '        if n > LIMIT and item:' || chr(10) || '            return f' || k // 2 || '(n)' || chr(10) || '        return json.dumps(item)', '        return 1') AS content, 'ok' AS status FROM (SELECT k, file, replace(content, 'def m' || k || '(self, item: str, n=1) -> int:', 'def m' || k || '(self):') AS content FROM t) AS t")
def write_replace(tree):
    """Each method gets another body; the new text's name is the old one's, file by file."""
    own = tree["declarations"].where("kind = 'method' AND language = 'Python'")
    text = F.concat(F.lit("    def "), F.col("leaf"), F.lit("(self):\n        return 1"))
    made = own.select("file", F.lit(0).alias("k"), F.col("s_byte").alias("start"), F.col("e_byte").alias("end"), text.alias("new"))
    return _written(tree, (made, own.select("id", F.lit("ok").alias("status"))))


@query("""SELECT module || '.f' || k AS path, CASE WHEN k = 1 THEN 'collision' ELSE 'ok' END AS status, 'parse_error' AS broken, 'not_one' AS two, 'kind_mismatch' AS other, 'not_a_container' AS inside FROM v_py WHERE NOT broken""")
def write_guards(tree):
    own = tree["declarations"].where("leaf LIKE 'f%' AND kind = 'function' AND language = 'Python'")
    said = lambda text, name: edits.checked_replace(tree["declarations"], own, text)[1].withColumnRenamed("status", name)
    inside = edits.checked_insert(own, "end", _NEW)[1].withColumnRenamed("status", "inside")
    out = own.select("id", "path").join(said("def g1(x): ...", "status"), "id").join(said("def (", "broken"), "id").join(said("def a(): ...\ndef b(): ...", "two"), "id").join(said("class K: ...", "other"), "id").join(inside, "id")
    return out.select("path", "status", "broken", "two", "other", "inside")


def _written(tree, made):
    done = edits.apply(tree["files"].select("file", "content"), made[0])
    return done.select("file", F.decode("content", "UTF-8").alias("content"), "status")


@query(f"WITH t AS ({_TEXT}), d AS (SELECT file, length(content) - length('def g' || k || '(x):' || chr(10) || '    if x == 0:' || chr(10) || '        x = 1' || chr(10)) - (k % 4) * length('    elif x == 9:' || chr(10) || '        x = 2' || chr(10)) - length('    return x') AS n FROM t) SELECT file, CAST(n AS INT) AS n FROM d")
def write_delete(tree):
    """The last functions are deleted, since nothing calls them."""
    own = tree["declarations"].where("language = 'Python' AND kind = 'function' AND leaf LIKE 'g%'")
    made = edits.delete(own, lookup.delete_guard(own.select("id", "path"), tree["refs"]))
    return edits.apply(tree["files"].select("file", "content"), made).select("file", F.length(F.decode("content", "UTF-8")).alias("n"))


@query("""SELECT 'a' AS file, '1' AS content, 'undone' AS at UNION ALL SELECT 'k' || c_custkey, c_name, 'undone' FROM customer UNION ALL SELECT 'k' || c_custkey, c_name || '!', 'committed' FROM customer UNION ALL SELECT 'a', '1', 'committed' UNION ALL SELECT 'n' || n_nationkey, n_name, 'committed' FROM nation""")
def write_transactions(spark, texts):
    """Three transactions on a stored project, the last of which is rejected; then one is undone."""
    path = f"{session.shared_dir(spark)}/{session._own(spark)}/project-{uuid.uuid4().hex}"
    names = texts.select("file", F.regexp_extract("content", "^([^/]*)", 1).alias("name"))
    first = names.select("file", F.encode("name", "UTF-8").alias("content")).union(spark.createDataFrame([("a", bytearray(b"1"))], "file string, content binary"))
    second = names.select("file", F.encode(F.concat("name", F.lit("!")), "UTF-8").alias("content")).union(_nations(spark, texts))
    edits.transact(spark, path, first)
    edits.transact(spark, path, second)
    edits.transact(spark, path, first, verify=lambda after: False)
    stored = lambda at: incremental.load_index(spark, path, path)["store"].select("file", F.decode("content", "UTF-8").alias("content"), F.lit(at).alias("at"))
    committed = session.cut(stored("committed"))
    edits.undo_last(spark, path)
    return committed.union(stored("undone"))


def _nations(spark, texts):
    rows = [(f"n{k}", bytearray(f"NATION_{k}".encode())) for k in range(25)]
    return spark.createDataFrame(rows, "file string, content binary")


@query("""SELECT query, file, CAST(first AS INT) AS first, CAST(last AS INT) AS last, true AS bare FROM v_asked""")
def address_parts(asked):
    found = paths.address(F.concat("file", F.lit(":"), "first", F.lit("-"), "last"))
    return asked.select("query", found.alias("a"), paths.address(F.concat("file", F.lit(".name")))["file"].isNull().alias("bare")).select("query", "a.*", "bare")


@query("SELECT file, language IN ('Makefile') AS build, CASE WHEN file LIKE '%/Makefile' THEN 'build' END AS role FROM (SELECT file, CASE WHEN s % 12 = 0 THEN 'Makefile' END AS language FROM v_tools) AS t WHERE file LIKE '%/Makefile'")
def config_roles(tree):
    found = reports.config_files(tree["files"])
    return found.select("file", (F.col("role") == "build").alias("build"), "role")


@query("SELECT 'kit' || n_nationkey AS name FROM nation WHERE n_nationkey < 5 UNION SELECT 'tool' || s FROM v_tools WHERE s % 12 = 0")
def framework_detection(spark, manifests, tree, tools):
    """Packages told by a declared dependency that exists, or by a file."""
    from ..sources import manifests as reader

    deps = reader.first_of_each(reader.requirements(manifests)).select("name")
    by_dep = spark.range(50).select(F.concat(F.lit("kit"), "id").alias("name"), F.array(F.when(F.col("id") < 5, F.concat(F.lit("r"), "id")).otherwise("none")).alias("detect_deps"), F.array().cast("array<string>").alias("detect_files"))
    by_file = tools.select(F.concat(F.lit("tool"), "s").alias("name"), F.array(F.lit("none")).alias("detect_deps"), F.array(F.concat(F.lit("tools/s"), "s", F.lit("/Makefile"))).alias("detect_files"))
    return config.active_frameworks(by_dep.union(by_file), deps, tree["files"])


@query("SELECT doc_id, round(length(text) / greatest(1, len(string_split(text, chr(10))) - CAST(ends_with(text, chr(10)) AS INT)), 6) AS ratio, 'UTF-8' AS encoding, CASE WHEN text = '' THEN 'UTF-8' ELSE 'UTF-16' END AS wide FROM documents WHERE text IS NOT NULL")
def text_predicates(files):
    doc = F.regexp_extract("file", r"d(\d+)\.txt$", 1).cast("bigint").alias("doc_id")
    return files.select(doc, F.round(T.long_line_ratio(F.col("content")), 6).alias("ratio"), T.encoding(F.encode("content", "UTF-8")).alias("encoding"), T.encoding(F.encode("content", "UTF-16")).alias("wide"))


_PATHS = "SELECT file FROM v_files UNION ALL SELECT 'node_modules/' || file FROM v_files UNION ALL SELECT 'docs/' || file || '.tar.gz' FROM v_files"


@query(f"WITH p AS ({_PATHS}) SELECT file, starts_with(file, 'node_modules/') AS vendored, starts_with(file, 'docs/') AS documentation, CASE WHEN file LIKE '%.gz' THEN '.txt.tar.gz,.tar.gz,.gz' ELSE '.txt' END AS extensions FROM p")
def path_predicates(files):
    f = files.select("file")
    p = f.union(f.select(F.concat(F.lit("node_modules/"), "file"))).union(f.select(F.concat(F.lit("docs/"), "file", F.lit(".tar.gz"))))
    return p.select("file", reports.vendored(F.col("file")).alias("vendored"), reports.documentation(F.col("file")).alias("documentation"), F.array_join(paths.extensions(F.col("file")), ",").alias("extensions"))


@query("""WITH f AS (SELECT section, severity, sev_ord, message, location FROM v_findings), c AS (SELECT section, severity, count(*) AS n FROM f GROUP BY ALL), s AS (SELECT section, arg_max(severity, sev_ord) AS worst, count(*) AS total, min(message) FILTER (sev_ord = m AND location = l) AS first FROM (SELECT *, max(sev_ord) OVER (PARTITION BY section) AS m, min(location) OVER (PARTITION BY section) AS l FROM f) AS x GROUP BY section)
SELECT section, worst, total, first, (SELECT string_agg(severity || '=' || n, ',' ORDER BY severity) FROM c WHERE c.section = s.section) AS counts FROM s""")
def report_audit(findings):
    found = reports.audit_layout(findings)
    counts = F.array_join(F.transform(F.map_entries("counts"), lambda x: F.concat_ws("=", x["key"], x["value"])), ",")
    first = F.array_min(F.transform(F.filter("findings", lambda x: x["location"] == F.element_at("findings", 1)["location"]), lambda x: x["message"]))
    return found.select("section", "worst", "total", first.alias("first"), counts.alias("counts"))


@query("""WITH n AS (SELECT dst AS node, count(*) AS n FROM v_edges GROUP BY dst), r AS (SELECT row_number() OVER (ORDER BY n DESC, node) AS place, node, n FROM n) SELECT place, node, n FROM r WHERE place <= 10""")
def report_section(edges):
    """A sorted section with its cap, which is the feature."""
    found = graph.fan_in(edges).orderBy(F.desc("fan_in"), "node").limit(10)
    return found.select(F.row_number().over(Window.orderBy(F.desc("fan_in"), "node")).cast("bigint").alias("place"), "node", F.col("fan_in").alias("n"))


@query("""WITH t AS (SELECT file, upper(regexp_extract(content, '(?i)#\\s*(TODO|FIXME|HACK|XXX)\\b', 1)) AS tag FROM v_comments), o AS (SELECT *, row_number() OVER (ORDER BY tag <> 'FIXME', tag <> 'TODO', file) AS place FROM t WHERE tag <> '') SELECT place, file, tag FROM o""")
def todo_order(comments):
    """Places in the order in which the findings come."""
    found = rules.todos(comments).withColumn("k", F.monotonically_increasing_id())
    return found.select(F.row_number().over(Window.orderBy("k")).cast("bigint").alias("place"), "file", "tag")


@query("""SELECT count(*) AS reads, count(DISTINCT file) AS files, (SELECT count(*) FROM v_read_log WHERE file NOT IN (SELECT 'f' || c_custkey FROM customer WHERE c_custkey < 10)) AS left_reads FROM v_read_log""")
def read_log_kept(spark, read_log, snap_old):
    folder = f"{session.shared_dir(spark)}/{session._own(spark)}/reads-{uuid.uuid4().hex}"
    log = incremental.ReadLog(spark, folder)
    rows = read_log.select("read_id", "file", "start", "end", F.unix_micros(F.col("served_at").cast("timestamp")).cast("double").alias("served_at"), F.col("served_mtime").cast("double").alias("served_mtime"))
    log.add(rows)
    whole = session.cut(log.rows().agg(F.count("*").alias("reads"), F.countDistinct("file").alias("files")))
    log.invalidate(snap_old.where(F.substring("file", 2, 20).cast("bigint") < 10).select(F.concat(F.lit("f"), F.substring("file", 2, 20)).alias("file")))
    return whole.crossJoin(log.rows().agg(F.count("*").alias("left_reads")))


@query("""SELECT file, length(content) - length(replace(content, chr(10), '')) + 1 AS lines, '1 - ' || string_split(content, chr(10))[1] AS first FROM v_texts""")
def numbered_diffs(texts):
    diff = F.pandas_udf(lambda old: old.map(lambda t: layout.numbered(t, "changed")), "string")
    return texts.select("file", (F.regexp_count("content", F.lit("\n")) + 1).cast("bigint").alias("lines"), F.element_at(F.split(diff("content"), "\n"), 1).alias("first"))


@query("SELECT name, kind, found FROM (SELECT 'Python' AS name, 'programming' AS kind, 'py' AS found UNION ALL SELECT 'Go', 'programming', 'golang' UNION ALL SELECT 'Markdown', 'prose', 'md') AS t")
def language_lookup(spark):
    own = corpus.languages(spark).select("name", F.col("type").alias("kind"), F.explode("aliases").alias("found"))
    return own.where(F.col("found").isin("py", "golang", "md"))
