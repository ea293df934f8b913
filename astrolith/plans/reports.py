"""Whole reports over a source tree: tables, findings, maps, line counts and per-file dumps, and their JSON sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph, lookup, metrics, rules, simulate
from ..operators.config import ProjectConfig
from ..session import written
from ..sources import corpus, python_scan

#: Prefixes of calls, and how bad it is when they run on import.
PACKAGE_ROLES = [("logging", "debug"), ("warnings", "debug"), ("sys.path", "info"), ("os.environ", "info"), ("django.setup", "warning"), ("load_dotenv", "info"), ("requests", "error"), ("urllib.request", "error"), ("subprocess", "error"), ("os.system", "error"), ("socket", "error")]
PACKAGES = [("flask", "web"), ("django", "web"), ("fastapi", "web"), ("celery", "tasks"), ("rq", "tasks"), ("sqlalchemy", "data"), ("psycopg", "data"), ("pandas", "data"), ("numpy", "data"), ("pyspark", "data"), ("pytest", "test"), ("hypothesis", "test"), ("ruff", "quality"), ("mypy", "quality"), ("requests", "network"), ("httpx", "network")]
IMPORT_NAMES = [("pillow", "PIL"), ("pyyaml", "yaml"), ("scikit-learn", "sklearn"), ("beautifulsoup4", "bs4"), ("python-dateutil", "dateutil"), ("opencv-python", "cv2"), ("psycopg2-binary", "psycopg2"), ("python-dotenv", "dotenv")]
#: Files that say how a project is built and run.
CONFIG_FILES = {"Dockerfile": "container", "docker-compose.yml": "container", "tox.ini": "test", "pytest.ini": "test", ".pre-commit-config.yaml": "quality", "alembic.ini": "data", "Makefile": "build", "setup.py": "build", "pyproject.toml": "build", "uv.lock": "lock", "poetry.lock": "lock"}
VENDORED = r"(^|/)(node_modules|vendor|third_party|bower_components|dist|\.venv|site-packages)/|\.min\.(js|css)$|(^|/)jquery[^/]*\.js$"
DOCUMENTATION = r"(?i)(^|/)(docs?|documentation|examples?|man)/|(^|/)(readme|changelog|contributing|license)[^/]*$"


def vendored(file: F.Column) -> F.Column:
    return file.rlike(VENDORED)


def documentation(file: F.Column) -> F.Column:
    return file.rlike(DOCUMENTATION)


def config_files(files: DataFrame) -> DataFrame:
    """(file, role) of the known files among files(file)."""
    roles = F.create_map(*[F.lit(x) for kv in CONFIG_FILES.items() for x in kv])
    role = F.try_element_at(roles, F.element_at(F.split("file", "/"), -1))
    return files.select("file", role.alias("role")).where("role IS NOT NULL").distinct()


def build_tables(files: DataFrame) -> dict[str, DataFrame]:
    """Tables of files(file, content binary): classified files and the scan (each written once, read by all others), declarations, refs, imports, raw and resolved edges, modules."""
    # scanning takes long for the bytes it reads, so that rows are spread by number, whatever the plan of files says
    spread = 4 * files.sparkSession.sparkContext.defaultParallelism
    classified = written(corpus.classify(files.repartition(spread, "file")), "files")
    scan = written(python_scan.scan(classified), "scan")
    names = ("path", "leaf", "kind", "s_line", "e_line", "s_byte", "e_byte", "col", "body_byte", "indent", "signature", "preview", "refs")
    parent = F.when(F.col("s.parent") >= 0, F.concat_ws("#", "file", "s.parent"))
    declarations = scan.select("file", "language", F.explode("declarations").alias("s")).select(F.concat_ws("#", "file", "s.idx").alias("id"), parent.alias("parent"), "file", "language", *[f"s.{n}" for n in names])
    raw = scan.select("file", F.explode("edges").alias("e")).select("file", "e.*")
    modules = graph.module_map(scan.where("language = 'Python'").select("file")).union(graph.package_map(scan)).groupBy("module").agg(F.max("file").alias("file"))
    return {
        "files": classified, "scan": scan, "declarations": declarations.drop("refs"), "refs": declarations.select(F.col("id").alias("source_id"), F.explode("refs").alias("r")).select("source_id", "r.*"),
        "imports": scan.select("file", F.explode("imports").alias("i")).select("file", "i.*"), "edges_raw": raw, "modules": modules, "edges": graph.resolve_imports(raw, modules),
    }


def audit(spark: SparkSession, tables: dict[str, DataFrame], deps: DataFrame, config: ProjectConfig | None = None, packages: DataFrame | None = None) -> DataFrame:
    """Findings of all rules at the project's least severities. packages(name, category) are the known ones, those of PACKAGES if None."""
    c = config or ProjectConfig()
    roles = spark.createDataFrame(PACKAGE_ROLES, "prefix string, severity string")
    known = packages if packages is not None else spark.createDataFrame(PACKAGES, "name string, category string")
    found = rules.run(spark, tables | {"deps": deps, "package_roles": roles, "packages": known}, c.disabled)
    return rules.at_least(found, c.min_severity, c.severity)


def project_map(tables: dict[str, DataFrame], config: ProjectConfig | None = None, target: str | None = None) -> dict[str, DataFrame]:
    """A frame for each section of a map: hotspots, fragile, leaves, coupling, deep chains, cycles, the summary, and with target, a file's path or a part of it, what imports it.

    Sections end at the project's limit, 0 meaning none.
    """
    c = config or ProjectConfig()
    edges, scan = tables["edges"], tables["scan"]
    at = graph.THRESHOLDS | c.thresholds
    sizes = metrics.file_metrics(tables["files"].withColumn("content", F.decode("content", "UTF-8"))).select(F.col("file").alias("node"), F.col("loc").alias("lines"))
    chains = graph.deep_chains(edges, 1, at)
    found = {
        "hotspots": graph.hotspots(edges, at["hotspots"][0]).withColumn("severity", graph.classified(F.col("fan_in"), "hotspots", at)).orderBy(F.desc("fan_in"), "file"),
        "fragile": graph.fragile(edges, scan, at["fragile"][0]).withColumn("severity", graph.classified(F.col("fan_out"), "fragile", at)).orderBy(F.desc("fan_out"), "file"),
        "leaves": graph.leaves(edges, sizes).orderBy("lines", "node"), "coupling": graph.coupling(edges).orderBy("package", "dep"), "deep_chains": chains.where(F.col("length") >= at["deep_chains"][0]).orderBy(F.desc("length"), "node"),
        "cycles": simulate.cycles(scan).withColumn("severity", graph.classified(F.size("chain") - 1, "cycles", at)).orderBy("component", "line", "name"),
    }
    cut = {k: df.limit(c.map_limit) if c.map_limit else df for k, df in found.items()}
    if target is not None:
        hit = lookup.match_files(scan.select("file"), scan.sparkSession.createDataFrame([(target,)], "wanted string")).first()
        if hit and hit["file"]:
            cut["blast"] = graph.blast(edges, hit["file"]).orderBy("reach", "node")
    return cut | {"summary": graph.summary(edges, scan.select(F.col("file").alias("node")), chains)}


def dump(tables: dict[str, DataFrame]) -> DataFrame:
    """One nested row a file: metrics, exports, imports and where its exports are used."""
    scan = tables["scan"]
    measured = metrics.file_metrics(tables["files"].withColumn("content", F.decode("content", "UTF-8")))
    used = metrics.export_usage(scan, tables["modules"]).groupBy("file").agg(F.array_sort(F.collect_list(F.struct("name", "used_by"))).alias("usage"))
    return metrics.per_file(scan, measured).join(scan.select("file", "exports", "imports"), "file").join(used, "file", "left")


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def ignore_config(findings: DataFrame) -> DataFrame:
    """(section, text): a settings block that ignores the findings there are."""
    quoted = F.transform(F.array_sort(F.collect_set("detail")), lambda x: F.concat(F.lit('"'), F.regexp_replace(x, '(["\\\\])', r"\\$1"), F.lit('"')))
    return findings.groupBy("section").agg(F.concat(F.lit("ignore = ["), F.array_join(quoted, ", "), F.lit("]")).alias("text"))


def audit_layout(findings: DataFrame) -> DataFrame:
    """A row for each section: section, worst severity, counts by severity, and its findings, worst first, then by location and message."""
    order = F.struct((-F.col("sev_ord")).alias("o"), F.coalesce("location", F.lit("")).alias("location"), "message", "detail", "severity")
    rows = findings.groupBy("section").agg(F.array_sort(F.collect_list(order)).alias("rows"), F.max_by("severity", "sev_ord").alias("worst"), F.count("*").alias("total"))
    counts = findings.groupBy("section", "severity").agg(F.count("*").alias("n")).groupBy("section").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("severity", "n")))).alias("counts"))
    return rows.join(counts, "section").select("section", "worst", "total", "counts", F.transform("rows", lambda x: F.struct(x["severity"].alias("severity"), x["message"].alias("message"), x["detail"].alias("detail"), x["location"].alias("location"))).alias("findings"))


def loc_layout(measured: DataFrame) -> DataFrame:
    """One row: totals, and languages by lines of code with their shares, of file_metrics() rows."""
    stats = metrics.shares(metrics.language_stats(measured))
    languages = stats.agg(F.array_sort(F.collect_list(F.struct((-F.col("sloc")).alias("o"), "language", "files", "loc", "sloc", "size", "share_bp"))).alias("l"))
    total = metrics.totals(measured)
    return total.crossJoin(languages).select(F.struct(*total.columns).alias("total"), F.transform("l", lambda x: F.struct(*[x[c].alias(c) for c in ("language", "files", "loc", "sloc", "size", "share_bp")])).alias("languages"))


def map_layout(sections: dict[str, DataFrame]) -> DataFrame:
    """A row for each section of a map: section, and its rows as JSON texts, in the order that the section has. Sections are limited or few."""
    out = None
    for name, df in sections.items():
        one = df.select(F.to_json(F.struct(*df.columns)).alias("j")).withColumn("k", F.monotonically_increasing_id()).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "j"))), lambda x: x["j"]).alias("rows")).select(F.lit(name).alias("section"), "rows")
        out = one if out is None else out.union(one)
    return out


def analysis_layout(tables: dict[str, DataFrame], target: str) -> DataFrame | None:
    """The dump() row of the file that target names, as a path or the end of one, with the names that it imports and their files; None if there is no such file."""
    hit = lookup.match_files(tables["scan"].select("file"), tables["scan"].sparkSession.createDataFrame([(target,)], "wanted string"), loose=False).first()
    if hit is None or hit["file"] is None:
        return None
    names = graph.import_names(tables["edges_raw"].where(F.col("file") == hit["file"]), tables["modules"]).groupBy("file").agg(F.array_sort(F.collect_list(F.struct("source_module", "name", "source_file", "scope"))).alias("imported"))
    return dump(tables).where(F.col("file") == hit["file"]).join(names, "file", "left")
