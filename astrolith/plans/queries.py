"""Queries over the driver's tables, each with the SQL that says the same."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths
from ..functions import text as T
from ..operators import config, graph, incremental, lookup, metrics, rules
from ..operators import edits as edits_module
from ..session import ship
from . import project

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Callable[..., DataFrame]], Query]:
    """Registers a function of views, which are given by the names of its parameters (spark gets the session, tree the tables of the generated source tree). sql may name views as v_<name>."""

    def add(f: Callable[..., DataFrame]) -> Query:
        names = f.__code__.co_varnames[: f.__code__.co_argcount]

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(*[spark if n == "spark" else project.tables(spark, sf_dir) if n == "tree" else project.view(spark, sf_dir, n) for n in names])

        QUERIES[f.__name__] = run
        if sql is not None:
            used = dict.fromkeys(n for n in re.findall(r"\bv_(\w+)", sql) if n in project.VIEWS)
            views = ", ".join(f"v_{n} AS ({project.duckdb(n)})" for n in used)
            text = sql.strip()
            if used:
                text = f"WITH RECURSIVE {views}, {text[len('WITH RECURSIVE') :]}" if text.startswith("WITH RECURSIVE") else f"WITH {views}, {text[4:]}" if text.startswith("WITH") else f"WITH {views} {text}"
            ORACLE_SQL[f.__name__] = text
        return run

    return add


_PARTS = r"string_split_regex(content, '\r\n|[\n\x0B\f\r\x{85}\x{2028}\x{2029}\x1C-\x1E]')"
_LINES = f"(CASE WHEN content = '' THEN [] WHEN {_PARTS}[-1] = '' THEN {_PARTS}[:-2] ELSE {_PARTS} END)"
_MEASURED = f"m AS (SELECT file, language, CAST(len({_LINES}) AS BIGINT) AS loc, CAST(len(list_filter({_LINES}, lambda x: regexp_matches(x, '[^\\s\\x{{A0}}\\x{{85}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}\\x{{1680}}\\x0B]'))) AS BIGINT) AS sloc, CAST(octet_length(encode(content)) AS BIGINT) AS size FROM v_files)"


@query(f"WITH {_MEASURED} SELECT file, language, loc, sloc, size, lower(regexp_extract(file, '(\\.[^./]*)$', 1)) AS extension FROM m")
def file_metrics(files):
    return metrics.file_metrics(files).select("file", "language", "loc", "sloc", "size", paths.extension(F.col("file")).alias("extension"))


@query(f"WITH {_MEASURED} SELECT language, count(*) AS files, CAST(sum(loc) AS BIGINT) AS loc, CAST(sum(sloc) AS BIGINT) AS sloc, CAST(sum(size) AS BIGINT) AS size FROM m GROUP BY language")
def loc_by_language(files):
    return metrics.language_stats(metrics.file_metrics(files))


@query(f"WITH {_MEASURED}, s AS (SELECT language, sum(sloc) AS sloc FROM m GROUP BY language) SELECT language, CAST(CASE WHEN language <> 'en' THEN floor(sloc * 10000 / (SELECT sum(sloc) FROM s WHERE language <> 'en')) END AS BIGINT) AS share_bp FROM s")
def language_shares(files):
    return metrics.shares(metrics.language_stats(metrics.file_metrics(files)), F.col("language") != "en").select("language", "share_bp")


@query(f"WITH {_MEASURED} SELECT count(*) AS files, count(DISTINCT language) AS languages, CAST(sum(loc) AS BIGINT) AS loc, CAST(sum(sloc) AS BIGINT) AS sloc, CAST(sum(size) AS BIGINT) AS size FROM m")
def loc_totals(files):
    return metrics.totals(metrics.file_metrics(files))


@query(f"WITH {_MEASURED} SELECT file, loc FROM m ORDER BY loc DESC, file LIMIT 10")
def biggest_files(files):
    return metrics.biggest(metrics.file_metrics(files)).select("file", "loc")


@query(f"""WITH {_MEASURED}, s AS (SELECT language, sum(sloc) AS sloc FROM m GROUP BY language), w AS (SELECT language, row_number() OVER (ORDER BY sloc DESC, language) AS k, count(*) OVER () AS n, greatest(1, round(sloc * 60 / sum(sloc) OVER ())) AS w FROM s)
SELECT language, CAST(CASE WHEN k = n THEN greatest(1, 60 - coalesce((SELECT sum(x.w) FROM w AS x WHERE x.k < w.k), 0)) ELSE w END AS BIGINT) AS width FROM w""")
def bar_widths(files):
    return metrics.bar_widths(metrics.language_stats(metrics.file_metrics(files)))


@query("SELECT file, substr(sha256(content), 1, 16) AS content_key, sha1(content) AS sha1, content LIKE '%' || chr(0) || '%' AS is_binary, content <> '' AS is_binary_utf16 FROM v_files")
def content_keys(files):
    return files.select("file", T.content_key(F.encode("content", "UTF-8")).alias("content_key"), T.content_sha1(F.encode("content", "UTF-8")).alias("sha1"), T.is_binary(F.encode("content", "UTF-8")).alias("is_binary"), T.is_binary(F.encode("content", "UTF-16")).alias("is_binary_utf16"))


@query("""WITH p AS (SELECT file, string_split(content, chr(10)) AS parts FROM v_files), l AS (SELECT file, unnest(range(1, len(parts) + 1)) AS line, unnest(parts) AS one FROM p)
SELECT file, line, CAST(sum(octet_length(encode(one)) + 1) OVER w - octet_length(encode(one)) - 1 AS BIGINT) AS start, CAST(sum(octet_length(encode(one)) + 1) OVER w - 1 AS BIGINT) AS "end" FROM l WINDOW w AS (PARTITION BY file ORDER BY line)""")
def line_ranges(files):
    return edits_module.line_ranges(files.withColumn("content", F.encode("content", "UTF-8"))).select("file", F.col("line").cast("bigint").alias("line"), "start", "end")


@query("SELECT id, path, kind FROM v_declarations WHERE path = 'NATION_7' OR path LIKE '%.NATION\\_7' ESCAPE '\\' ORDER BY path, id LIMIT 100")
def search_suffix(declarations):
    return lookup.search(declarations, ["NATION_7"]).select("id", "path", "kind")


@query("SELECT id, path, kind FROM v_declarations WHERE regexp_matches(path, 'NATION_1[0-9]') AND regexp_matches(path, '#0+[0-9]+7$') AND kind = 'method'")
def search_regex(declarations):
    return lookup.search(declarations, ["NATION_1[0-9]", "#0+[0-9]+7$"], kind="method", regex=True, limit=None).select("id", "path", "kind")


@query("SELECT id, path, kind FROM v_declarations WHERE contains(lower(path), 'asia.nation') AND file = 'ASIA.py'")
def search_fixed(declarations):
    return lookup.search(declarations, ["aSiA.Nation"], file="ASIA.py", fixed=True, ignore_case=True, limit=None).select("id", "path", "kind")


@query("""WITH w AS (SELECT path AS wanted FROM v_declarations UNION SELECT string_split(path, '.')[-1] FROM v_declarations UNION SELECT 'none.' || id FROM v_declarations),
p AS (SELECT wanted, id, path = wanted AS ex FROM w JOIN v_declarations ON string_split(path, '.')[-1] = string_split(wanted, '.')[-1] AND (path = wanted OR ends_with(path, '.' || wanted))),
g AS (SELECT wanted, count(*) FILTER (ex) AS e, count(*) AS n, min(id) FILTER (ex) AS ei, min(id) AS ai FROM p GROUP BY wanted),
c AS (SELECT w.wanted, coalesce(CASE WHEN e > 0 THEN e ELSE n END, 0) AS candidates, coalesce(ei, ai) AS id FROM w LEFT JOIN g USING (wanted))
SELECT wanted, CASE WHEN candidates = 0 THEN 'not_found' WHEN candidates = 1 THEN 'found' ELSE 'ambiguous' END AS status, candidates, CASE WHEN candidates = 1 THEN id END AS id FROM c""")
def resolve_addresses(declarations):
    wanted = declarations.select(F.col("path").alias("wanted")).union(declarations.select(paths.leaf(F.col("path")))).union(declarations.select(F.concat(F.lit("none."), "id")))
    return lookup.resolve(declarations, wanted)


@query("""WITH q AS (SELECT id || '?' AS query, file, s_line + 1 AS first, e_line - 1 AS last FROM v_declarations UNION ALL SELECT id, file, s_line, e_line FROM v_declarations),
r AS (SELECT query, q.file, first, last, id, NOT (s_line = first AND e_line = last) AS loose, row_number() OVER (PARTITION BY query, q.file, first, last ORDER BY NOT (s_line = first AND e_line = last), e_line - s_line, id) AS k FROM q LEFT JOIN v_declarations AS s ON q.file = s.file AND s_line <= first AND e_line >= last)
SELECT query, id, CASE WHEN id IS NULL THEN 'slice' WHEN loose THEN 'enclosing' ELSE 'exact' END AS match FROM r WHERE k = 1""")
def enclosing_declarations(declarations):
    ranges = declarations.select(F.concat("id", F.lit("?")).alias("query"), "file", (F.col("s_line") + 1).alias("first"), (F.col("e_line") - 1).alias("last")).union(declarations.select("id", "file", "s_line", "e_line"))
    return lookup.enclosing(declarations, ranges).select("query", "id", "match")


@query("SELECT name, id, path, file, line, r.kind AS ref_kind FROM v_refs AS r JOIN v_declarations AS s ON source_id = id")
def callers(refs, declarations, deps):
    return lookup.callers(refs, declarations, deps.select(F.regexp_replace("name", "^part-", "p").alias("name")))


@query("SELECT name, id, path, file, line, r.kind AS ref_kind FROM v_refs AS r JOIN v_declarations AS s ON source_id = id WHERE name = 'p7'")
def callers_of_one(refs, declarations):
    return lookup.callers(refs, declarations, "catalogue.p7")


@query("SELECT name, count(*) AS n_refs, count(DISTINCT source_id) AS n_callers FROM v_refs GROUP BY name")
def caller_counts(refs):
    return lookup.caller_counts(refs)


@query("SELECT source_id, name, kind, min(line) AS line, array_to_string(list_sort(list(DISTINCT line)), ',') AS lines FROM v_refs GROUP BY source_id, name, kind")
def grouped_refs(refs):
    return lookup.grouped_refs(refs).withColumn("lines", F.array_join(F.col("lines").cast("array<string>"), ","))


@query("SELECT source_id, name, source, line FROM v_imports AS i SEMI JOIN (SELECT * FROM v_refs WHERE kind = 'name') AS r USING (source_id, name)")
def imports_used(imports, refs):
    return lookup.imports_used(imports, refs).select("source_id", "name", "source", "line")


@query("""WITH g AS (SELECT source_id, name, kind, min(line) AS line FROM v_refs GROUP BY source_id, name, kind), r AS (SELECT source_id, string_agg(line || ':' || name || ':' || kind, ',' ORDER BY line, name, kind) AS refs FROM g GROUP BY source_id),
u AS (SELECT DISTINCT source_id, line, name, source FROM v_imports AS i SEMI JOIN (SELECT * FROM v_refs WHERE kind = 'name') AS x USING (source_id, name)), i AS (SELECT source_id, string_agg(line || ':' || name || ':' || source, ',' ORDER BY line, name, source) AS imports FROM u GROUP BY source_id)
SELECT id, coalesce(refs, '') AS refs, coalesce(imports, '') AS imports FROM v_declarations LEFT JOIN r ON id = r.source_id LEFT JOIN i ON id = i.source_id""")
def declaration_payloads(declarations, refs, imports):
    join = lambda c, *f: F.array_join(F.transform(c, lambda x: F.concat_ws(":", *[x[n].cast("string") for n in f])), ",").alias(c)
    return lookup.payload(declarations, refs, imports).select("id", join("refs", "line", "name", "kind"), join("imports", "line", "name", "source"))


@query("""WITH d AS (SELECT id, file, s_line, CASE kind WHEN 'module' THEN 0 WHEN 'class' THEN 1 ELSE 2 END AS depth FROM v_declarations) SELECT id, file, CAST(depth AS INT) AS depth, CAST(row_number() OVER (PARTITION BY file ORDER BY s_line, depth, id) AS INT) AS position FROM d""")
def outline(declarations):
    return lookup.outline(declarations).select("id", "file", "depth", "position")


@query("""WITH RECURSIVE d AS (SELECT id AS root, id, CAST(0 AS INT) AS depth FROM v_declarations UNION ALL SELECT d.root, s.id, CAST(d.depth + 1 AS INT) FROM d JOIN v_declarations AS s ON s.parent = d.id) SELECT root, id, depth FROM d""")
def descendants(declarations):
    return lookup.descendants(declarations)


@query("SELECT string_split(path, '.')[-1] AS name, path, id FROM v_declarations WHERE string_split(path, '.')[-1] IN (SELECT name FROM v_calls)")
def name_owners(declarations, calls):
    return lookup.owners(declarations, calls)


@query("""WITH s AS (SELECT id, string_split(path, '.')[-1] AS name FROM v_declarations), h AS (SELECT id, count(*) AS n FROM s JOIN (SELECT DISTINCT name, source_id FROM v_calls) AS c USING (name) WHERE source_id <> id GROUP BY id)
SELECT id, coalesce(n, 0) AS n_callers, coalesce(n, 0) > 0 AS blocked FROM s LEFT JOIN h USING (id)""")
def delete_guard(declarations, calls):
    return lookup.delete_guard(declarations, calls)


@query("""SELECT DISTINCT file, 'declares' AS why FROM v_declarations WHERE string_split(path, '.')[-1] = 'NATION_3' UNION SELECT DISTINCT s.file, 'uses' FROM v_calls JOIN v_declarations AS s ON id = source_id WHERE name = 'NATION_3' UNION SELECT DISTINCT s.file, 'imports' FROM v_imports JOIN v_declarations AS s ON id = source_id WHERE name = 'NATION_3'""")
def rename_candidates(declarations, calls, imports):
    return lookup.rename_candidates(declarations, calls, imports, "NATION_3")


@query("""WITH m AS (SELECT DISTINCT source_id AS type, name FROM v_calls), n AS (SELECT interface, count(*) AS need FROM v_needs GROUP BY interface)
SELECT interface, type FROM v_needs JOIN m USING (name) JOIN n USING (interface) GROUP BY interface, type, need HAVING count(*) = need""")
def interface_impact(calls, needs):
    return lookup.interface_impact(calls.select(F.col("source_id").alias("type"), "name"), needs)


_CLASS = "CASE WHEN {0} >= {3} THEN 'error' WHEN {0} >= {2} THEN 'warning' WHEN {0} >= {1} THEN 'info' ELSE 'debug' END"


@query(f"SELECT dst AS node, count(*) AS fan_in, {_CLASS.format('count(*)', 5, 15, 25)} AS severity FROM v_dense GROUP BY dst")
def fan_in(dense):
    return graph.fan_in(dense)


@query(f"SELECT src AS node, count(DISTINCT dst) AS fan_out, {_CLASS.format('count(DISTINCT dst)', 8, 15, 25)} AS severity FROM v_dense GROUP BY src")
def fan_out(dense):
    return graph.fan_out(dense)


@query("SELECT dst AS node, min(src) AS importer, CAST(10 * s_nationkey AS BIGINT) AS lines FROM v_edges JOIN supplier ON s_suppkey = dst GROUP BY dst, s_nationkey HAVING count(*) = 1 AND 10 * s_nationkey < 100")
def graph_leaves(edges, uses):
    return graph.leaves(edges, uses.select(F.col("s").alias("node"), (10 * F.col("n")).cast("bigint").alias("lines")))


@query("SELECT a.src AS a, a.dst AS b FROM v_dense AS a JOIN v_dense AS b ON a.src = b.dst AND a.dst = b.src WHERE a.src < a.dst")
def mutual_imports(dense):
    return graph.mutual(dense)


_PACKAGE = "SELECT DISTINCT array_to_string(string_split(src, '/')[2:{0}], '/') AS package, array_to_string(string_split(dst, '/')[2:{0}], '/') AS dep FROM v_file_edges"
_COUPLING = "WITH p AS (SELECT * FROM (" + _PACKAGE + ") AS x WHERE package <> dep) SELECT p.package, p.dep, EXISTS (SELECT 1 FROM p AS q WHERE q.package = p.dep AND q.dep = p.package) AS mutual FROM p"


@query(_COUPLING.format(2))
def coupling_top(file_edges):
    return graph.coupling(file_edges, 1)


@query(_COUPLING.format(3))
def coupling_sub(file_edges):
    return graph.coupling(file_edges, 2)


_REACH = "WITH RECURSIVE t AS (SELECT src, dst FROM v_edges UNION SELECT t.src, e.dst FROM t JOIN v_edges AS e ON t.dst = e.src)"


@query(f"{_REACH} SELECT src, dst FROM t")
def transitive_closure(edges):
    return graph.closure(edges)


@query(f"{_REACH} SELECT src AS node, CASE WHEN EXISTS (SELECT 1 FROM v_edges AS e WHERE e.src = t.src AND e.dst = 3) THEN 'direct' ELSE 'transitive' END AS reach FROM t WHERE dst = 3")
def blast_radius(edges):
    return graph.blast(edges, 3)


@query(f"{_REACH}, d AS (SELECT dst, count(*) AS n FROM v_edges GROUP BY dst) SELECT t.dst AS node, coalesce(any_value(d.n), 0) AS direct, count(*) - coalesce(any_value(d.n), 0) AS transitive FROM t LEFT JOIN d ON t.dst = d.dst WHERE t.src <> t.dst GROUP BY t.dst")
def importer_counts(edges):
    return graph.importer_counts(edges)


@query(f"{_REACH}, s AS (SELECT a.src AS node, count(*) AS size FROM t AS a JOIN t AS b ON a.src = b.dst AND a.dst = b.src GROUP BY a.src) SELECT node, size FROM s WHERE node IN (SELECT src FROM t WHERE src = dst)")
def on_cycles(edges):
    return graph.on_cycles(edges)


@query("WITH RECURSIVE p AS (SELECT src AS node, dst AS at, 1 AS length FROM v_dag UNION SELECT p.node, e.dst, p.length + 1 FROM p JOIN v_dag AS e ON p.at = e.src) SELECT node, CAST(max(length) AS INT) AS length FROM (SELECT node, length FROM p UNION ALL SELECT dst, 0 FROM v_dag) AS x GROUP BY node")
def longest_chains(dag):
    return graph.longest_chains(dag)


@query(f"WITH RECURSIVE p AS (SELECT src AS node, dst AS at, 1 AS length FROM v_dag UNION SELECT p.node, e.dst, p.length + 1 FROM p JOIN v_dag AS e ON p.at = e.src) SELECT node, CAST(max(length) AS INT) AS length, {_CLASS.format('max(length)', 7, 12, 18)} AS severity FROM p GROUP BY node HAVING max(length) >= 7")
def deep_chains(dag):
    return graph.chain_heads(graph.longest_chains(dag))


@query("WITH RECURSIVE b AS (SELECT src, dst FROM v_edges UNION SELECT dst, src FROM v_edges), t AS (SELECT src, dst FROM b UNION SELECT t.src, b.dst FROM t JOIN b ON t.dst = b.src) SELECT src AS node, least(src, min(dst)) AS component FROM t GROUP BY src")
def components(edges):
    return graph.components(edges)


@query("WITH n AS (SELECT src AS node FROM v_edges UNION SELECT dst FROM v_edges), a AS (SELECT s_suppkey AS node FROM supplier UNION SELECT -1 - s_suppkey FROM supplier) SELECT count(*) AS total, count(n.node) AS connected, count(*) - count(n.node) AS orphans, (SELECT count(*) FROM v_edges) AS edges FROM a LEFT JOIN n USING (node)")
def graph_summary(edges, snap_new):
    keys = snap_new.where(F.col("file").startswith("s")).select(F.substring("file", 2, 20).cast("bigint").alias("node"))
    return graph.summary(edges, keys.union(keys.select(-1 - F.col("node"))))


@query("SELECT section, message, severity, location FROM v_findings WHERE sev_ord >= CASE section WHEN 'signup' THEN 1 ELSE 2 END")
def findings_at_least(findings):
    return rules.at_least(findings, "warning", {"signup": "info"}).select("section", "message", "severity", "location")


@query("SELECT section, severity, count(*) AS n FROM v_findings GROUP BY section, severity")
def severity_counts(findings):
    return rules.severity_counts(findings)


@query("SELECT CAST(max(sev_ord) >= 3 AS INT) AS exit_code FROM v_findings")
def exit_code(findings):
    return rules.exit_code(findings)


@query("WITH f AS (SELECT location, sev_ord, message, row_number() OVER (PARTITION BY location ORDER BY sev_ord DESC, message) AS k FROM v_findings) SELECT location, max(sev_ord) AS worst, count(*) AS n, string_agg(message, ',' ORDER BY k) FILTER (k <= 3) AS messages FROM f GROUP BY location")
def worst_by_file(findings):
    return rules.worst_by(findings).withColumn("messages", F.array_join("messages", ","))


@query("WITH t AS (SELECT file, regexp_extract(content, '(?i)#\\s*(TODO|FIXME|HACK|XXX)\\b[:\\s]*(.*)', ['tag', 'text']) AS m FROM v_comments) SELECT file, CAST(1 AS INT) AS line, upper(m.tag) AS tag, trim(m.text) AS text FROM t WHERE m.tag <> ''")
def todo_comments(comments):
    return rules.todos(comments)


@query("WITH t AS (SELECT upper(regexp_extract(content, '(?i)#\\s*(TODO|FIXME|HACK|XXX)\\b', 1)) AS tag FROM v_comments) SELECT tag, count(*) AS n FROM t WHERE tag <> '' GROUP BY tag")
def todo_counts(comments):
    return rules.todos(comments).groupBy("tag").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT name FROM v_deps WHERE replace(name, '-', '_') NOT IN (SELECT string_split(module, '.')[1] FROM v_used)")
def unused_deps(deps, used):
    return rules.unused_deps(deps, used)


@query("SELECT category, name FROM v_deps")
def stack(deps):
    known = deps.select("name", "category")
    return rules.stack(deps.select(F.concat("name", F.lit("-py")).alias("name")), known).select("category", F.regexp_replace("name", "-py$", "").alias("name"))


@query("SELECT category, 'part' AS family, min(name) AS name FROM v_deps WHERE length(name) = (SELECT min(length(d.name)) FROM v_deps AS d WHERE d.category = v_deps.category) GROUP BY category")
def collapsed_stack(deps):
    return rules.collapsed(deps)


@query("WITH f AS (SELECT DISTINCT src AS file FROM v_file_edges UNION SELECT 'src/' || s_name || '/test_script.py' FROM supplier UNION SELECT 'src/' || s_name || '/test_it.py' FROM supplier) SELECT file, CASE WHEN contains(lower(file), 'script') THEN 'script' WHEN contains(lower(file), 'test') THEN 'test' ELSE 'dead code' END AS reason FROM f WHERE file NOT IN (SELECT dst FROM v_file_edges)")
def orphan_files(spark, file_edges, snap_new):
    base = snap_new.where(F.col("file").startswith("s")).select(F.concat(F.lit("src/Supplier#"), F.lpad(F.substring("file", 2, 20), 9, "0")).alias("b"))
    files = file_edges.select(F.col("src").alias("file")).union(base.select(F.concat("b", F.lit("/test_script.py")))).union(base.select(F.concat("b", F.lit("/test_it.py"))))
    return rules.orphans(files, file_edges, spark.createDataFrame([], "file string"))


_CHANGES = "c AS (SELECT coalesce(o.file, n.file) AS file, CASE WHEN o.file IS NULL THEN 'added' WHEN n.file IS NULL THEN 'deleted' WHEN o.mtime = n.mtime THEN 'same' ELSE 'modified' END AS change FROM v_snap_old AS o FULL JOIN v_snap_new AS n ON o.file = n.file)"


@query(f"WITH {_CHANGES} SELECT file, change FROM c")
def snapshot_diff(snap_old, snap_new):
    return incremental.diff(snap_old, snap_new)


@query(f"WITH {_CHANGES} SELECT count(*) = 0 AS clean FROM c WHERE change <> 'same'")
def snapshot_is_clean(snap_old, snap_new):
    return incremental.is_clean(incremental.diff(snap_old, snap_new))


@query(f"""WITH {_CHANGES}, n AS (SELECT count(*) FILTER (change <> 'same') AS changes, count(*) FILTER (change <> 'deleted') AS live, count(*) FILTER (change = 'deleted') AS dead FROM c)
SELECT changes, CASE WHEN changes = 0 THEN 'load' WHEN changes > 200 THEN 'rebuild' WHEN dead >= 100 AND dead >= 0.3 * (live + dead) THEN 'compact' ELSE 'refresh' END AS action FROM n""")
def refresh_policy(snap_old, snap_new):
    changes = incremental.diff(snap_old, snap_new)
    return incremental.policy(changes, live=changes.where("change <> 'deleted'").count(), dead=changes.where("change = 'deleted'").count())


@query(f"WITH {_CHANGES} SELECT o.file, mtime FROM v_snap_old AS o JOIN c ON o.file = c.file WHERE change = 'same' UNION ALL SELECT n.file, mtime FROM v_snap_new AS n JOIN c ON n.file = c.file WHERE change IN ('added', 'modified')")
def refresh_rows(snap_old, snap_new):
    changes = incremental.diff(snap_old, snap_new)
    return incremental.refresh(snap_old, changes, snap_new.join(incremental.to_scan(changes), "file", "left_semi"))


@query("""WITH j AS (SELECT query, a.file, read_id, start, "end", served_at, row_number() OVER (PARTITION BY query ORDER BY served_at DESC, read_id DESC) AS k FROM v_asked AS a JOIN v_read_log AS r ON a.file = r.file AND start <= first AND "end" >= last) SELECT query, file, read_id, start, "end", served_at FROM j WHERE k = 1""")
def covering_reads(read_log, asked):
    return incremental.covering(read_log, asked).drop("served_mtime")


@query("""WITH j AS (SELECT *, row_number() OVER (PARTITION BY file, start, "end" ORDER BY served_at DESC, read_id DESC) AS k FROM v_read_log) SELECT read_id, file, start, "end", served_at FROM j WHERE k = 1""")
def latest_reads(read_log):
    return incremental.latest_reads(read_log).drop("served_mtime")


@query("""WITH now AS (SELECT file, max(served_mtime) AS mtime FROM v_read_log GROUP BY file) SELECT query, CASE WHEN EXISTS (SELECT 1 FROM v_read_log AS r JOIN now USING (file) WHERE r.file = a.file AND start <= first AND "end" >= last AND served_mtime = mtime) THEN 'ok' ELSE 'needs_read_confirmation' END AS status FROM v_asked AS a""")
def patch_preflight(read_log, asked):
    return incremental.preflight(asked, read_log, read_log.groupBy("file").agg(F.max("served_mtime").alias("mtime")))


@query("""WITH e AS (SELECT *, max("end") OVER (PARTITION BY file ORDER BY start, "end", k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM v_edits) SELECT file, k FROM e WHERE start < r""")
def overlapping_edits(edits):
    return edits_module.overlaps(edits)


@query("""SELECT file, k, CAST(start + coalesce(sum(length(new) - 3) OVER w, 0) AS BIGINT) AS new_start, CAST(start + length(new) + coalesce(sum(length(new) - 3) OVER w, 0) AS BIGINT) AS new_end FROM v_edits WINDOW w AS (PARTITION BY file ORDER BY start, "end", k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def shifted_edits(edits):
    return edits_module.shifted(edits).select("file", "k", "new_start", "new_end")


_APPLY = """a AS (SELECT t.file, content, x.new AS n0, y.start AS s, y.new AS n1 FROM v_texts AS t JOIN v_edits AS x ON t.file = x.file AND x.k = 0 JOIN v_edits AS y ON t.file = y.file AND y.k = 1),
b AS (SELECT file, content, CASE WHEN s + 3 > length(content) THEN 'bad_range' WHEN s < 5 THEN CASE WHEN s + 3 <= 2 THEN 'ok' ELSE 'overlap' END ELSE 'ok' END AS status, substr(content, 1, 2) || n0 || substr(content, 6, s - 5) || n1 || substr(content, s + 4) AS spliced FROM a)"""


@query(f"WITH {_APPLY} SELECT file, CASE WHEN status = 'ok' THEN spliced ELSE content END AS content, status FROM b")
def apply_edits(texts, edits):
    done = edits_module.apply(texts.withColumn("content", F.encode("content", "UTF-8")), edits)
    return done.withColumn("content", F.decode("content", "UTF-8"))


@query("""WITH t AS (SELECT file, content, (length(content) - length(replace(content, '0', ''))) AS n FROM v_texts) SELECT file, CASE WHEN n = 0 THEN 'not_found' WHEN n > 1 THEN 'ambiguous' ELSE 'ok' END AS status, CASE WHEN n = 1 THEN CAST(instr(content, '0') - 1 AS BIGINT) END AS start FROM t""")
def locate_edits(texts):
    wanted = texts.select("file", F.lit(0).alias("k"), F.lit(None).cast("bigint").alias("start"), F.lit(None).cast("bigint").alias("end"), F.lit("0").alias("old"), F.lit("zero").alias("new"))
    return edits_module.locate(wanted, texts.withColumn("content", F.encode("content", "UTF-8"))).select("file", "status", "start")


@query("SELECT file, regexp_replace(content, '\\bend\\b', 'stop', 'g') AS content, CAST((length(content) - length(replace(content, '/end', ''))) / 4 AS INT) AS n FROM v_texts")
def rename_words(texts):
    done = edits_module.rename_words(texts.withColumn("content", F.encode("content", "UTF-8")), texts, "end", "stop")
    return done.select("file", F.decode("content", "UTF-8").alias("content"), F.col("n").cast("int").alias("n"))


@query(f"WITH {_APPLY} SELECT file, CASE WHEN status = 'ok' THEN spliced ELSE content END AS after, content FROM b")
def undo_transaction(texts, edits):
    store = texts.withColumn("content", F.encode("content", "UTF-8"))
    changed = edits_module.apply(store, edits).where("status = 'ok'").unionByName(store.select(F.concat(F.lit("new/"), "file").alias("file"), "content", F.lit("ok").alias("status")))
    after, log = edits_module.commit(store, changed, 7)
    back = edits_module.undo(after, log)
    text = F.decode("content", "UTF-8")
    return after.select("file", text.alias("after")).join(back.select("file", text.alias("content")), "file")


@query("WITH l AS (SELECT c_custkey, CAST(floor(c_custkey / 4) AS BIGINT) AS tx_id FROM customer) SELECT tx_id, 'k' || c_custkey AS file FROM l WHERE tx_id > (SELECT max(tx_id) FROM l) - 50")
def pruned_transactions(snap_old):
    key = F.substring("file", 2, 20).cast("bigint")
    return edits_module.prune(snap_old.select(F.floor(key / 4).alias("tx_id"), "file"))


@query("SELECT location AS key, arg_max(message, sev_ord * 1000000000000 + CAST(substr(message, 2) AS BIGINT)) AS message, max(sev_ord) AS layer FROM v_findings GROUP BY location")
def layered_settings(findings):
    layers = findings.select(F.col("location").alias("key"), F.col("sev_ord").alias("layer"), F.substring("message", 2, 20).cast("bigint").alias("n"))
    return config.last_wins(layers, ["key"]).select("key", F.concat(F.lit("e"), "n").alias("message"), "layer")


@query("SELECT DISTINCT name FROM v_deps UNION SELECT DISTINCT name FROM v_imports")
def united_settings(deps, imports):
    return config.united(deps.select("name"), imports.select("name"), deps.select("name"))


@query("SELECT name, lower(replace(replace(name, '_', '-'), '.', '-')) || '-x' AS dep FROM v_deps")
def dep_names(deps):
    return deps.select("name", T.dep_name(F.concat(F.lit("  "), F.upper("name"), F.lit("_X[extra]>=1.0; python_version < '4'"))).alias("dep"))


@query("SELECT (SELECT count(*) FROM v_files) AS files, (SELECT count(*) FROM v_declarations) AS declarations, (SELECT count(*) FROM v_refs) AS refs, (SELECT count(*) FROM v_imports) AS imports, (SELECT count(*) FROM (SELECT path FROM v_declarations UNION SELECT name FROM v_refs UNION SELECT name FROM v_imports)) AS strings")
def index_stats(files, declarations, refs, imports):
    return metrics.index_stats(files, declarations, refs, imports)


@query("SELECT file, regexp_replace(file, '^[^/]*/', '') AS inner_path, string_split(file, '/')[-1] AS base, array_to_string(string_split(file, '/')[1:2], '/') AS package, starts_with(string_split(file, '/')[-1], 'd') AND file LIKE 'src1%/en/%' AS chosen FROM v_files")
def path_parts(files):
    f = F.col("file")
    return files.select("file", F.regexp_replace(f, "^[^/]*/", "").alias("inner_path"), paths.basename(f).alias("base"), paths.package_at(f, 2).alias("package"), paths.in_scope(f, ["src1*/en/d*"]).alias("chosen"))

