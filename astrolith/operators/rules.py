"""Rules over source tables, and the findings that they make."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths
from ..functions import text as T
from ..schemas import FINDING, SEVERITY
from . import metrics

SCRIPT_FILES = ["manage.py", "setup.py", "conftest.py", "main.py", "app.py", "wsgi.py", "asgi.py", "__main__.py", "**/manage.py", "**/conftest.py", "**/main.py", "**/app.py", "**/__main__.py", "**/__init__.py", "__init__.py"]
SAFE_CALLS = ["getLogger", "TypeVar", "namedtuple", "dataclass", "filterwarnings", "simplefilter", "register", "setdefault"]
FILE_ROLES = {"settings.py": "info", "conftest.py": "info", "manage.py": "skip", "__main__.py": "skip"}


def severity_order(severity: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv]), severity), F.lit(-1))


def finding(df: DataFrame, section: str, message: Column, detail: Column, severity: Column, location: Column) -> DataFrame:
    return df.select(F.lit(section).alias("section"), message.alias("message"), detail.alias("detail"), severity.alias("severity"), severity_order(severity).alias("sev_ord"), location.alias("location"))


def at_least(findings: DataFrame, general: str, by_section: dict[str, str] | None = None) -> DataFrame:
    """Findings at or over the least severity of their section, or the general one."""
    least = reduce(lambda c, kv: F.when(F.col("section") == kv[0], SEVERITY[kv[1]]).otherwise(c), (by_section or {}).items(), F.lit(SEVERITY[general]))
    return findings.where(F.col("sev_ord") >= least)


def severity_counts(findings: DataFrame) -> DataFrame:
    """(section, severity, n) of findings."""
    return findings.groupBy("section", "severity").agg(F.count("*").alias("n"))


def exit_code(findings: DataFrame) -> DataFrame:
    """One row: 1 if some finding is an error or critical, else 0."""
    return findings.agg((F.coalesce(F.max("sev_ord"), F.lit(-1)) >= SEVERITY["error"]).cast("int").alias("exit_code"))


def worst_by(findings: DataFrame, key: str = "location", top: int = 3) -> DataFrame:
    """(key, worst, n, messages) with the first top messages by severity, then text."""
    first = F.slice(F.array_sort(F.collect_set(F.struct((-F.col("sev_ord")).alias("o"), "message"))), 1, top)
    return findings.groupBy(key).agg(F.max("sev_ord").alias("worst"), F.count("*").alias("n"), F.transform(first, lambda x: x["message"]).alias("messages"))


def todos(files: DataFrame, content: str = "content") -> DataFrame:
    """(file, line, tag, text) of marked comments, one a line: FIXME first, then TODO, then the rest."""
    rows = files.select("file", F.posexplode(T.lines(F.col(content))).alias("k", "one")).where(F.col("one").rlike(T.TODO))
    return rows.select("file", (F.col("k") + 1).alias("line"), T.todo_tag(F.col("one")).alias("tag"), T.todo_text(F.col("one")).alias("text")).orderBy(F.col("tag") != "FIXME", F.col("tag") != "TODO", "file", "line")


def entrypoints(scan: DataFrame) -> DataFrame:
    """(file, line, call) under main guards; call is null where a guard calls nothing."""
    return scan.select("file", F.explode("guards").alias("g")).select("file", "g.line", "g.call")


def swallowed(scan: DataFrame) -> DataFrame:
    """(file, line, type, context) of handlers that do nothing."""
    return scan.select("file", F.explode("handlers").alias("h")).select("file", "h.line", "h.type", "h.context")


def orphans(files: DataFrame, edges: DataFrame, entries: DataFrame, skip: list[str] = SCRIPT_FILES) -> DataFrame:
    """(file, reason) of files that nothing imports, that are no entry point, and whose path fits no pattern of skip."""
    free = files.select("file").distinct().join(edges.select(F.col("dst").alias("file")), "file", "left_anti").join(entries.select("file"), "file", "left_anti")
    low = F.lower("file")
    return free.where(~paths.matches_any(F.col("file"), skip)).withColumn("reason", F.when(low.contains("script"), "script").when(low.contains("test"), "test").otherwise("dead code"))


def unused_deps(deps: DataFrame, imports: DataFrame, import_names: DataFrame | None = None, ignore: Iterable[str] = ()) -> DataFrame:
    """Names of deps(name) of which no import(module) has the top segment. import_names(name, import_name) says what differs."""
    own = deps.select("name").distinct().where(~F.col("name").isin(*ignore)) if list(ignore) else deps.select("name").distinct()
    if import_names is not None:
        own = own.join(import_names, "name", "left")
    plain = F.translate("name", "-", "_")
    key = F.coalesce("import_name", plain) if import_names is not None else plain
    top = imports.select(F.split("module", r"\.")[0].alias("key")).distinct()
    return own.withColumn("key", key).join(top, "key", "left_anti").select("name").distinct()


def side_effects(scan: DataFrame, package_roles: DataFrame, known_errors: Iterable[str] = (), safe: Iterable[str] = SAFE_CALLS, ignore: Iterable[str] = ()) -> DataFrame:
    """(file, line, call, severity) of calls at the top of modules.

    Safe last segments go; private and capitalised ones too unless the whole name is a known error. Severity is the largest of
    package_roles(prefix, severity) whose prefix the name is or begins with, else the file's role by its name, else warning.
    """
    calls = scan.select("file", F.explode("calls").alias("c")).select("file", "c.line", "c.call", "c.leaf").where(~F.col("leaf").isin(*safe))
    odd = F.col("leaf").rlike("^(_|[A-Z])")
    calls = calls.where(~odd | F.col("call").isin(*known_errors)) if list(known_errors) else calls.where(~odd)
    if ignore:
        calls = calls.where(~paths.matches_any(F.concat("call", F.lit("()")), list(ignore)))
    # prefixes of a dotted name are few: an equi-join on each of them stands for the prefix test
    parts = F.split("call", r"\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "."))
    roles = package_roles.select("prefix", severity_order(F.col("severity")).alias("o"))
    hit = calls.withColumn("prefix", F.explode(prefixes)).join(roles, "prefix").groupBy("file", "line", "call").agg(F.max("o").alias("o"))
    by_order = F.create_map(*[F.lit(x) for k, v in SEVERITY.items() for x in (v, k)])
    by_file = F.try_element_at(F.create_map(*[F.lit(x) for kv in FILE_ROLES.items() for x in kv]), paths.basename(F.col("file")))
    return calls.drop("leaf").join(hit, ["file", "line", "call"], "left").select("file", "line", "call", F.coalesce(F.try_element_at(by_order, F.col("o")), by_file, F.lit("warning")).alias("severity"))


def stack(deps: DataFrame, packages: DataFrame) -> DataFrame:
    """(category, name) of deps that packages(name, category) knows, by the name or without -binary, -python3 or -py."""
    tries = F.array(F.col("name"), F.regexp_replace("name", "-(binary|python3|py)$", ""))
    rows = deps.select("name").distinct().select("name", F.posexplode(tries).alias("k", "key")).join(packages.select(F.col("name").alias("key"), "category"), "key")
    return rows.groupBy("name").agg(F.min_by("category", "k").alias("category")).select("category", "name")


def collapsed(found: DataFrame) -> DataFrame:
    """(category, family, name): of the names with one first part before -, the shortest."""
    family = F.split("name", "-")[0]
    return found.groupBy("category", family.alias("family")).agg(F.min_by("name", F.struct(F.length("name"), "name")).alias("name"))


Rule = Callable[[dict[str, DataFrame]], DataFrame]
RULES: dict[str, tuple[int, Rule, tuple[str, ...]]] = {}
#: Further frames that rules show beside their findings, by rule and name.
VIEWS: dict[str, dict[str, Rule]] = {}


def rule(name: str, priority: int, needs: tuple[str, ...] = ()) -> Callable[[Rule], Rule]:
    """Registers a function of tables that returns findings; without the tables that it needs it is left out. Further rules of a project do the same."""

    def add(f: Rule) -> Rule:
        RULES[name] = (priority, f, needs)
        return f

    return add


def rule_view(name: str, label: str) -> Callable[[Rule], Rule]:
    """Registers a function of tables that returns a frame to look at, for the rule of that name."""

    def add(f: Rule) -> Rule:
        VIEWS.setdefault(name, {})[label] = f
        return f

    return add


@rule("stack", 10, ("deps", "packages"))
def _stack_findings(t: dict[str, DataFrame]) -> DataFrame:
    found = collapsed(stack(t["deps"], t["packages"]))
    return finding(found, "stack", F.concat_ws(": ", "category", "name"), F.col("name"), F.lit("info"), F.lit(""))


@rule("code_structure", 20)
def _structure_findings(t: dict[str, DataFrame]) -> DataFrame:
    s = metrics.structure(t["scan"])
    said = F.format_string("%d functions, %d methods, %d classes, %d lines each, %s%% typed", "functions", "methods", "classes", F.col("avg_lines").cast("bigint"), F.col("overall_pct").cast("string"))
    return finding(s, "code_structure", said, F.lit(""), F.lit("debug"), F.lit(""))


@rule("todos", 60, ("files",))
def _todo_findings(t: dict[str, DataFrame]) -> DataFrame:
    text = t["files"].where("language IS NOT NULL").select("file", F.decode("content", "UTF-8").alias("content"))
    severity = F.when(F.col("tag") == "FIXME", "warning").otherwise("info")
    return finding(todos(text), "todos", F.concat_ws(": ", "tag", "text"), F.col("text"), severity, F.concat_ws(":", "file", "line"))


@rule("entrypoints", 30)
def _entry_findings(t: dict[str, DataFrame]) -> DataFrame:
    return finding(entrypoints(t["scan"]), "entrypoints", F.lit("entry point"), F.coalesce("call", F.lit("")), F.lit("debug"), F.concat_ws(":", "file", "line"))


@rule("orphans", 40)
def _orphan_findings(t: dict[str, DataFrame]) -> DataFrame:
    found = orphans(t["scan"].select("file"), t["edges"], entrypoints(t["scan"]))
    return finding(found, "orphans", F.lit("nothing imports this file"), F.col("reason"), F.lit("warning"), F.col("file"))


@rule("unused_deps", 41, ("deps",))
def _unused_findings(t: dict[str, DataFrame]) -> DataFrame:
    used = t["scan"].select(F.explode("edges").alias("e")).where("e.level = 0").select(F.col("e.module").alias("module"))
    return finding(unused_deps(t["deps"], used), "unused_deps", F.lit("no file imports this dependency"), F.col("name"), F.lit("warning"), F.lit(""))


@rule("side_effects", 50, ("package_roles",))
def _effect_findings(t: dict[str, DataFrame]) -> DataFrame:
    found = side_effects(t["scan"], t["package_roles"]).where(severity_order(F.col("severity")) >= SEVERITY["warning"])
    return finding(found, "side_effects", F.concat("call", F.lit("() runs on import")), F.col("call"), F.col("severity"), F.concat_ws(":", "file", "line"))


@rule("swallowed", 70)
def _swallowed_findings(t: dict[str, DataFrame]) -> DataFrame:
    severity = F.when(F.col("type").isin("bare except", "Exception", "BaseException"), "warning").otherwise("info")
    return finding(swallowed(t["scan"]), "swallowed", F.concat(F.col("type"), F.lit(" is swallowed")), F.col("context"), severity, F.concat_ws(":", "file", "line"))


@rule_view("stack", "by_category")
def _stack_view(t: dict[str, DataFrame]) -> DataFrame:
    return collapsed(stack(t["deps"], t["packages"])).groupBy("category").agg(F.array_sort(F.collect_set("name")).alias("names"))


@rule_view("code_structure", "coverage")
def _structure_view(t: dict[str, DataFrame]) -> DataFrame:
    return metrics.structure(t["scan"])


@rule_view("todos", "by_tag")
def _todo_view(t: dict[str, DataFrame]) -> DataFrame:
    return todos(t["files"].where("language IS NOT NULL").select("file", F.decode("content", "UTF-8").alias("content"))).groupBy("tag").agg(F.count("*").alias("n"))


def run(spark: SparkSession, tables: dict[str, DataFrame], disabled: Iterable[str] = ()) -> DataFrame:
    """Findings of all rules but the disabled ones, in the order of priorities."""
    order = [f for name, (_, f, needs) in sorted(RULES.items(), key=lambda x: (x[1][0], x[0])) if name not in set(disabled) and set(needs) <= set(tables)]
    return reduce(DataFrame.unionByName, [f(tables) for f in order], spark.createDataFrame([], FINDING))
