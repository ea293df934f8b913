"""A virtual project over the driver's tables: each view is one SQL text that Spark and DuckDB both take, over whole tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import reports

_SEVERITY = "CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'warning' WHEN 'signup' THEN 'info' WHEN 'click' THEN 'debug' ELSE 'skip' END"
_ORDER = "CASE event_type WHEN 'error' THEN 3 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 1 WHEN 'click' THEN 0 ELSE -1 END"
_HALF, _THIRD = "CAST(floor(c_custkey / 2) AS BIGINT)", "CAST(floor(c_custkey / 3) AS BIGINT)"
#: A source tree, generated from whole tables: a Python file for each customer, which imports that of half its number; a package for each nation and region; a file that uses a
#: package, a pair of files that import each other, a Go package and a file of another language for each supplier; and manifests for each nation.
_PY = """SELECT a.c_custkey AS k, a.c_nationkey AS n, na.n_regionkey AS r, b.c_custkey AS h, b.c_nationkey AS hn, nb.n_regionkey AS hr, a.c_custkey % 4 AS more, a.c_custkey % 11 = 10 AS broken,
        25 + 2 * (a.c_custkey % 4) AS last, 'src/r' || na.n_regionkey || '/n' || a.c_nationkey || '/c' || a.c_custkey || '.py' AS file, 'r' || na.n_regionkey || '.n' || a.c_nationkey || '.c' || a.c_custkey AS module,
        'src/r' || nb.n_regionkey || '/n' || b.c_nationkey || '/c' || b.c_custkey || '.py' AS to_file, 'r' || nb.n_regionkey || '.n' || b.c_nationkey || '.c' || b.c_custkey AS to_module
        FROM {customer} AS a JOIN {nation} AS na ON a.c_nationkey = na.n_nationkey JOIN {customer} AS b ON b.c_custkey = CAST(floor(a.c_custkey / 2) AS BIGINT) JOIN {nation} AS nb ON b.c_nationkey = nb.n_nationkey"""
_INIT = "SELECT n, r, min(k) AS k FROM (SELECT c_custkey AS k, c_nationkey AS n, n_regionkey AS r FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey WHERE c_custkey % 11 <> 10) AS c GROUP BY n, r"
_TOOLS = """SELECT s_suppkey AS s, 'tools/s' || s_suppkey || CASE s_suppkey % 12 WHEN 0 THEN '/Makefile' WHEN 1 THEN '/run' WHEN 2 THEN '/x.h' WHEN 3 THEN '/x.js' WHEN 4 THEN '/x.rs' WHEN 5 THEN '/old' WHEN 6 THEN '/x.xsd' WHEN 7 THEN '/x.unknown'
        WHEN 8 THEN '/x.1' WHEN 9 THEN '/x.txt' WHEN 10 THEN '/x.md' ELSE '/x.dat' END AS file,
        CASE s_suppkey % 12 WHEN 1 THEN '#!/usr/bin/env -S VAR=1 bash' || chr(10) WHEN 5 THEN '#!/usr/bin/perl -w' || chr(10) WHEN 7 THEN '<?xml version="1.0"?>' || chr(10) WHEN 9 THEN '-*- mode: ruby -*-' || chr(10) ELSE 'text' || chr(10) END AS content FROM {supplier}"""
_LINES = """'import json' || chr(10) || CASE WHEN k > 0 THEN 'from ' || to_module || ' import C' || h || ', f' || h ELSE 'import logging' END || chr(10) || 'LIMIT = ' || k || chr(10)
        || CASE k % 5 WHEN 1 THEN 'prepare()' WHEN 2 THEN 'logging.info(LIMIT)' ELSE '' END || chr(10) || chr(10) || 'class C' || k || ':' || chr(10) || '    size: int = 0' || chr(10) || chr(10)
        || '    def m' || k || '(self, item: str, n=1) -> int:' || chr(10) || '        if n > LIMIT and item:' || chr(10) || '            return f' || h || '(n)' || chr(10) || '        return json.dumps(item)' || chr(10) || chr(10) || chr(10)
        || 'def f' || k || '(x):' || chr(10) || '    try:' || chr(10) || '        return C' || k || '().m' || k || '(x)' || chr(10) || '    except ' || CASE WHEN k % 2 = 0 THEN 'ValueError' ELSE 'Exception' END || ':' || chr(10) || '        pass' || chr(10) || chr(10) || chr(10)
        || 'def g' || k || '(x):' || chr(10) || '    if x == 0:' || chr(10) || '        x = 1' || chr(10) || repeat('    elif x == 9:' || chr(10) || '        x = 2' || chr(10), CAST(more AS INT)) || '    return x' || chr(10)
        || CASE WHEN k % 3 = 0 THEN chr(10) || chr(10) || 'if __name__ == "__main__":' || chr(10) || '    f' || k || '(1)' || chr(10) ELSE '' END"""
_GO = """'package model' || chr(10) || chr(10) || 'import "' || CASE WHEN s > 0 THEN 'example.com/svc/s' || h ELSE 'fmt' END || '"' || chr(10) || chr(10) || 'type User' || s || ' struct' || chr(123) || ' Name string ' || chr(125) || chr(10) || chr(10)
        || 'func (u *User' || s || ') Greet() string ' || chr(123) || chr(10) || chr(9) || 'return u.Name' || chr(10) || chr(125) || chr(10)
        || CASE WHEN s % 2 = 0 THEN chr(10) || 'func (u *User' || s || ') Save() error ' || chr(123) || ' return nil ' || chr(125) || chr(10) ELSE '' END"""
VIEWS = {
    "py": _PY,
    "inits": _INIT,
    "tools": _TOOLS,
    "uses": "SELECT s_suppkey AS s, n_nationkey AS n, n_regionkey AS r FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey",
    "sources": f"""SELECT file, CASE WHEN broken THEN 'def f(:' || chr(10) ELSE {_LINES} END AS content FROM ({_PY}) AS py
        UNION ALL SELECT 'src/r' || r || '/n' || n || '/__init__.py', 'from r' || r || '.n' || n || '.c' || k || ' import C' || k || chr(10) || 'N' || n || ' = ' || n || chr(10) FROM ({_INIT}) AS inits
        UNION ALL SELECT 'src/r' || r_regionkey || '/__init__.py', '' FROM {{region}}
        UNION ALL SELECT 'use/u' || s_suppkey || '.py', 'from r' || n_regionkey || '.n' || n_nationkey || ' import N' || n_nationkey || ' as top' || chr(10) || 'total = top' || chr(10) FROM {{supplier}} JOIN {{nation}} ON s_nationkey = n_nationkey
        UNION ALL SELECT 'loops/a' || s_suppkey || '.py', CASE WHEN s_suppkey % 2 = 0 THEN 'from .b' || s_suppkey || ' import y' || chr(10) || 'x = 1' || chr(10) ELSE 'x = 1' || chr(10) || 'from .b' || s_suppkey || ' import y' || chr(10) END FROM {{supplier}}
        UNION ALL SELECT 'loops/b' || s_suppkey || '.py', 'from typing import TYPE_CHECKING' || chr(10) || 'from loops.a' || s_suppkey || ' import x' || chr(10) || 'y = 1' || chr(10) || 'if TYPE_CHECKING:' || chr(10) || '    import r0' || chr(10) FROM {{supplier}}
        UNION ALL SELECT 'svc/s' || s || '/model.go', {_GO} FROM (SELECT s_suppkey AS s, CAST(floor(s_suppkey / 2) AS BIGINT) AS h FROM {{supplier}}) AS go
        UNION ALL SELECT 'svc/go.mod', '// a module' || chr(10) || chr(10) || 'module example.com/svc' || chr(10) || chr(10) || 'go 1.22' || chr(10) FROM {{region}} WHERE r_regionkey = 0
        UNION ALL SELECT file, content FROM ({_TOOLS}) AS tools""",
    "manifests": """SELECT 'n' || n_nationkey || '/pyproject.toml' AS path, '[project]' || chr(10) || 'dependencies = ["r' || n_nationkey || '>=1", "Common_Lib[x]~=2"]' || chr(10) || '[project.optional-dependencies]' || chr(10) || 'x = ["opt' || n_nationkey || '"]' || chr(10) || '[dependency-groups]' || chr(10) || 'dev = ["grp' || n_nationkey || '"]' || chr(10) || '[tool.poetry.dependencies]' || chr(10) || 'python = "3"' || chr(10) || 'poe' || n_nationkey || ' = "1"' || chr(10) AS content FROM {nation}
        UNION ALL SELECT 'n' || n_nationkey || '/requirements.txt', '# c' || chr(10) || 'req' || n_nationkey || '==1  # d' || chr(10) || '-r x' || chr(10) || 'Common-lib' || chr(10) FROM {nation}
        UNION ALL SELECT 'n' || n_nationkey || '/setup.cfg', '[options]' || chr(10) || 'install_requires =' || chr(10) || '    cfg' || n_nationkey || ' > 1' || chr(10) FROM {nation}
        UNION ALL SELECT 'n' || n_nationkey || '/Pipfile', '[packages]' || chr(10) || 'pip' || n_nationkey || ' = "*"' || chr(10) FROM {nation}""",
    "files": "SELECT source || '/' || lang || '/d' || doc_id || '.txt' AS file, lang AS language, text AS content FROM {documents}",
    "declarations": """
        WITH m AS (SELECT 'c' || c_custkey AS id, 'n' || c_nationkey AS parent, r_name || '.' || n_name || '.' || c_name AS path, r_name || '.py' AS file, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey, c_custkey) AS rn, r_regionkey AS rk, n_nationkey AS nk, r_name, n_name
                   FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey)
        SELECT id, parent, 'method' AS kind, path, file, CAST(10 * rn AS BIGINT) AS s_line, CAST(10 * rn + 8 AS BIGINT) AS e_line FROM m
        UNION ALL SELECT 'n' || nk, 'r' || rk, 'class', r_name || '.' || n_name, file, CAST(min(10 * rn) AS BIGINT), CAST(max(10 * rn + 8) AS BIGINT) FROM m GROUP BY nk, rk, r_name, n_name, file
        UNION ALL SELECT 'r' || rk, CAST(NULL AS STRING), 'module', r_name, file, CAST(min(10 * rn) AS BIGINT), CAST(max(10 * rn + 8) AS BIGINT) FROM m GROUP BY rk, r_name, file""",
    "refs": "SELECT DISTINCT 'c' || o_custkey AS source_id, 'p' || l_partkey AS name, CASE WHEN l_returnflag = 'N' THEN 'name' ELSE 'attr' END AS kind, l_linenumber AS line FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey",
    "calls": "SELECT DISTINCT 'c' || o_custkey AS source_id, n_name AS name, 'name' AS kind, l_linenumber AS line FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {supplier} ON l_suppkey = s_suppkey JOIN {nation} ON s_nationkey = n_nationkey",
    "imports": "SELECT DISTINCT 'c' || o_custkey AS source_id, 'p' || l_partkey AS name, o_orderstatus AS source, l_linenumber AS line FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey WHERE l_returnflag = 'R'",
    "dense": "SELECT DISTINCT src, dst FROM (SELECT p_partkey % n AS src, (p_partkey * 7 + p_size) % n AS dst FROM {part} CROSS JOIN (SELECT count(*) AS n FROM {supplier}) AS s) AS e WHERE src <> dst",
    "edges": "SELECT src, dst FROM (SELECT s_suppkey AS src, CASE WHEN s_suppkey % 3 = 0 THEN CAST(floor(s_suppkey / 2) AS BIGINT) ELSE (s_suppkey * s_suppkey + 3 * s_suppkey + 7) % n END AS dst FROM {supplier} CROSS JOIN (SELECT count(*) AS n FROM {supplier}) AS c) AS e WHERE src <> dst",
    "needs": "SELECT n_name AS interface, n_name AS name FROM {nation} UNION SELECT a.n_name, b.n_name FROM {nation} AS a JOIN {nation} AS b ON b.n_nationkey = (a.n_nationkey + 1) % 25",
    "dag": f"SELECT c_custkey AS src, {_HALF} AS dst FROM {{customer}} WHERE c_custkey <> {_HALF} UNION SELECT c_custkey, {_THIRD} FROM {{customer}} WHERE c_custkey <> {_THIRD}",
    "file_edges": f"SELECT file AS src, to_file AS dst FROM ({_PY}) AS py WHERE k > 0",
    "findings": f"SELECT event_type AS section, 'e' || event_id AS message, props AS detail, {_SEVERITY} AS severity, {_ORDER} AS sev_ord, 'u' || user_id AS location FROM {{events}}",
    "deps": "SELECT 'part-' || p_partkey AS name, p_brand AS category FROM {part}",
    "used": "SELECT DISTINCT 'part_' || CAST(floor(o_totalprice / 200) AS BIGINT) || '.core' AS module FROM {orders}",
    "snap_old": "SELECT 'k' || c_custkey AS file, CAST(c_nationkey AS BIGINT) AS mtime FROM {customer}",
    "snap_new": "SELECT 'k' || c_custkey AS file, CAST(c_nationkey + CASE WHEN max(o_totalprice) > 400000 THEN 1 ELSE 0 END AS BIGINT) AS mtime FROM {orders} JOIN {customer} ON o_custkey = c_custkey GROUP BY c_custkey, c_nationkey UNION ALL SELECT 's' || s_suppkey, CAST(s_nationkey AS BIGINT) FROM {supplier}",
    "read_log": "SELECT event_id AS read_id, 'f' || user_id AS file, CAST(floor(value) AS BIGINT) AS start, CAST(floor(value) + length(props) + length(event_type) * 10 AS BIGINT) AS \"end\", ts AS served_at, CAST(length(event_type) AS BIGINT) AS served_mtime FROM {events}",
    "asked": "SELECT o_orderkey AS query, 'f' || CAST(floor(o_custkey / 10) AS BIGINT) AS file, CAST(floor(o_totalprice / 1000) AS BIGINT) AS first, CAST(floor(o_totalprice / 1000) + length(o_orderpriority) AS BIGINT) AS last FROM {orders}",
    "texts": "SELECT 'k' || c_custkey AS file, c_name || '/' || c_mktsegment || repeat('/end', 1 + c_nationkey % 3) AS content FROM {customer}",
    "edits": "SELECT 'k' || c_custkey AS file, 0 AS k, CAST(2 AS BIGINT) AS start, CAST(5 AS BIGINT) AS \"end\", '<' || c_custkey || '>' AS new FROM {customer} UNION ALL SELECT 'k' || c_custkey, 1, CAST(c_nationkey AS BIGINT), CAST(c_nationkey + 3 AS BIGINT), '[' || c_mktsegment || ']' FROM {customer}",
    "comments": "SELECT 'u' || user_id || '/e' || event_id AS file, 'x = 1  # ' || CASE event_type WHEN 'error' THEN 'FIXME: ' WHEN 'purchase' THEN 'todo ' WHEN 'click' THEN 'Hack: ' ELSE 'note ' END || props AS content FROM {events}",
}


def duckdb(name: str) -> str:
    """The text of a view for DuckDB."""
    return re.sub(r"\{(\w+)\}", r"\1", VIEWS[name])


def spark_text(name: str) -> str:
    return VIEWS[name].replace('"end"', "`end`")


_BUILT: dict[tuple, dict[str, DataFrame]] = {}


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The tables of the generated tree, whose files are scanned once in a session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _BUILT:
        files = view(spark, sf_dir, "sources").select("file", F.encode("content", "UTF-8").alias("content"))
        _BUILT[key] = reports.build_tables(files)
    return _BUILT[key]


#: Rows that a task of a DISTINCT over lineitem holds: partitions follow the table, since AQE only ever joins them.
DISTINCT_ROWS = 500_000


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view over the Parquet tables of a folder."""
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in set(re.findall(r"\{(\w+)\}", VIEWS[name]))}
    text = spark_text(name)
    if text.startswith("SELECT DISTINCT") and "lineitem" in used and (n := -(-used["lineitem"].count() // DISTINCT_ROWS)) > spark.sparkContext.defaultParallelism:
        rows = spark.sql(text.replace("SELECT DISTINCT", "SELECT", 1), **used)
        return rows.repartition(n, *rows.columns).distinct()
    return spark.sql(text, **used)
