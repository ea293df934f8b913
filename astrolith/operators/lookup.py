"""Name search, addresses, outlines and callers over declarations(id, parent, kind, path, file, s_line, e_line) and refs(source_id, name, kind, line)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths
from ..session import cut
from . import ranges as ranges_module


def named(path: Column, pattern: str | Column) -> Column:
    """Whether a dotted path is pattern or ends with a dot and pattern."""
    p = F.lit(pattern) if isinstance(pattern, str) else pattern
    return (path == p) | path.endswith(F.concat(F.lit("."), p))


def search(declarations: DataFrame, patterns: list[str], kind: str | None = None, file: str | None = None, regex: bool = False, fixed: bool = False, ignore_case: bool = False, limit: int | None = 100) -> DataFrame:
    """Declarations whose path fits all patterns: equal or a dotted suffix, a substring with fixed, a Java pattern with regex.

    Rows come in the order of path, then id; limit 0 gives none, None all. Null paths never match.
    """
    path = F.lower("path") if ignore_case else F.col("path")
    fold = str.lower if ignore_case else str

    def test(p: str) -> Column:
        if regex:
            return F.col("path").rlike(("(?i)" if ignore_case else "") + p)
        return path.contains(fold(p)) if fixed else named(path, fold(p))

    tests = [*map(test, patterns), *([F.col("kind") == kind] if kind else []), *([F.col("file") == file] if file else [])]
    found = declarations.where(reduce(lambda a, b: a & b, tests, F.lit(True)))
    return found if limit is None else found.orderBy("path", "id").limit(limit)


def resolve(declarations: DataFrame, wanted: DataFrame, column: str = "wanted") -> DataFrame:
    """(wanted, status, candidates, id) for each wanted address: exact paths win over dotted suffixes; one candidate is found, more are ambiguous.

    An equi-join on the last segment finds candidates, so that no pair of tables is crossed. Repeated addresses count once.
    """
    asked = wanted.select(F.col(column).alias("wanted")).where("wanted IS NOT NULL").distinct()
    pairs = asked.withColumn("leaf", paths.leaf(F.col("wanted"))).join(declarations.select("id", "path", paths.leaf(F.col("path")).alias("leaf")), "leaf").where(named(F.col("path"), F.col("wanted")))
    exact = F.col("path") == F.col("wanted")
    own = pairs.groupBy("wanted").agg(F.count_if(exact).alias("n_exact"), F.count("*").alias("n_all"), F.min(F.when(exact, F.col("id"))).alias("exact_id"), F.min("id").alias("any_id"))
    n = F.when(F.col("n_exact") > 0, F.col("n_exact")).otherwise(F.coalesce("n_all", F.lit(0)))
    status = F.when(n == 0, "not_found").when(n == 1, "found").otherwise("ambiguous")
    return asked.join(own, "wanted", "left").select("wanted", status.alias("status"), n.cast("bigint").alias("candidates"), F.when(n == 1, F.coalesce("exact_id", "any_id")).alias("id"))


def enclosing(declarations: DataFrame, ranges: DataFrame) -> DataFrame:
    """For each of ranges(query, file, first, last): the declaration with exactly that span, else the smallest around it, else a bare slice.

    Columns: query, file, first, last, id, match. Ties go to the smaller id.
    """
    asked = ranges.select("query", "file", "first", "last").distinct()
    found = ranges_module.holding(declarations.select("id", "file", "s_line", "e_line"), asked, "s_line", "e_line", "first", "last")
    exact = (F.col("s_line") == F.col("first")) & (F.col("e_line") == F.col("last"))
    key = ["query", "file", "first", "last"]
    best = found.groupBy(*key).agg(F.min(F.struct((~exact).alias("loose"), (F.col("e_line") - F.col("s_line")).alias("span"), "id")).alias("best"))
    match = F.when(F.col("best").isNull(), "slice").when(F.col("best.loose"), "enclosing").otherwise("exact")
    return asked.join(best, key, "left").select(*key, F.col("best.id").alias("id"), match.alias("match"))


def callers(refs: DataFrame, declarations: DataFrame, names: DataFrame | str) -> DataFrame:
    """(name, id, path, file, line, ref_kind) of the references to the last segment of each name."""
    if isinstance(names, str):
        hits = refs.where(F.col("name") == names.rsplit(".", 1)[-1])
    else:
        # names that come as a table may be as many as the declarations: neither goes through the driver
        hits, declarations = refs.join(names.select(paths.leaf(F.col("name")).alias("name")).distinct().hint("merge"), "name", "left_semi"), declarations.hint("merge")
    return hits.join(declarations, F.col("source_id") == F.col("id")).select("name", "id", "path", "file", F.col("line"), refs["kind"].alias("ref_kind"))


def caller_counts(refs: DataFrame) -> DataFrame:
    """(name, n_refs, n_callers) of all names."""
    return refs.groupBy("name").agg(F.count("*").alias("n_refs"), F.countDistinct("source_id").alias("n_callers"))


def grouped_refs(refs: DataFrame) -> DataFrame:
    """(source_id, name, kind, line, lines): the first line and all lines of each name that a declaration uses."""
    return refs.groupBy("source_id", "name", "kind").agg(F.min("line").alias("line"), F.array_sort(F.collect_set("line")).alias("lines"))


def imports_used(imports: DataFrame, refs: DataFrame) -> DataFrame:
    """Imports of a declaration whose local name its body uses."""
    return imports.join(refs.where("kind = 'name'").select("source_id", "name"), ["source_id", "name"], "left_semi")


def payload(declarations: DataFrame, refs: DataFrame, imports: DataFrame) -> DataFrame:
    """declarations with their grouped refs and used imports as arrays, sorted by line and name; empty where there are none."""
    r = grouped_refs(refs).groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("line", "name", "kind", "lines"))).alias("refs"))
    i = imports_used(imports, refs).groupBy("source_id").agg(F.array_sort(F.collect_set(F.struct("line", "name", "source"))).alias("imports"))
    out = declarations.join(r.withColumnRenamed("source_id", "id"), "id", "left").join(i.withColumnRenamed("source_id", "id"), "id", "left")
    return out.withColumns({c: F.coalesce(c, F.array().cast(out.schema[c].dataType)) for c in ("refs", "imports")})


def descendants(declarations: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """(root, id, depth) of all declarations under each root (a row of declarations itself, depth 0, included). One join a level of nesting."""
    level = (declarations if roots is None else declarations.join(roots.select("id").distinct(), "id", "left_semi")).select(F.col("id").alias("root"), "id", F.lit(0).alias("depth"))
    edges = declarations.where("parent IS NOT NULL").select(F.col("id").alias("child"), F.col("parent").alias("id"))
    out = level = cut(level)
    while True:
        level = cut(level.join(edges, "id").select("root", F.col("child").alias("id"), (F.col("depth") + 1).alias("depth")))
        if level.isEmpty():
            return out
        out = out.union(level)


def outline(declarations: DataFrame) -> DataFrame:
    """declarations with depth and position: the order, within a file, in which a tree is read."""
    depth = descendants(declarations, declarations.where("parent IS NULL")).select("id", "depth")
    place = F.row_number().over(Window.partitionBy("file").orderBy("s_line", "depth", "id"))
    return declarations.join(depth, "id").withColumn("position", place)


def owners(declarations: DataFrame, refs: DataFrame) -> DataFrame:
    """(name, path, id) of the declarations that declare each referenced name."""
    return declarations.withColumn("name", paths.leaf(F.col("path"))).join(refs.select("name").distinct(), "name", "left_semi").select("name", "path", "id")


def rename_candidates(declarations: DataFrame, refs: DataFrame, imports: DataFrame, name: str) -> DataFrame:
    """(file, why) of the files that declare, use or import a name."""
    files = declarations.select("id", "file")
    declares = declarations.where(paths.leaf(F.col("path")) == name).select("file", F.lit("declares").alias("why"))
    tied = lambda df, why: df.where(F.col("name") == name).select(F.col("source_id").alias("id")).join(files, "id").select("file", F.lit(why).alias("why"))
    return declares.union(tied(refs, "uses")).union(tied(imports, "imports")).distinct()


def delete_guard(declarations: DataFrame, refs: DataFrame) -> DataFrame:
    """(id, n_callers, blocked): callers of each declaration's last segment, but for the declaration itself."""
    own = declarations.select("id", paths.leaf(F.col("path")).alias("name"))
    hits = own.join(refs.select("name", "source_id").distinct(), "name").where("source_id <> id").groupBy("id").agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0)).cast("bigint")
    return own.join(hits, "id", "left").select("id", n.alias("n_callers"), (n > 0).alias("blocked"))


def interface_impact(methods: DataFrame, interfaces: DataFrame) -> DataFrame:
    """(interface, type) pairs where methods(type, name) holds every name of interfaces(interface, name)."""
    need = interfaces.distinct().groupBy("interface").agg(F.count("*").alias("need"))
    have = interfaces.distinct().join(methods.select("type", "name").distinct(), "name").groupBy("interface", "type").agg(F.count("*").alias("have"))
    return have.join(need, "interface").where("have = need").select("interface", "type")


def match_files(files: DataFrame, wanted: DataFrame, loose: bool = True) -> DataFrame:
    """(wanted, file) for each of wanted(wanted), a few names that a user gives: the file of that path, else the one that ends with it, else, if loose, the one that holds it.

    Of several files that end with a name, the first is taken, or if loose the first that holds it; none gives null. The names are sent to every task, so that they have to be few.
    """
    asked = wanted.select("wanted").where("wanted IS NOT NULL").distinct()
    rank = F.when(F.col("file") == F.col("wanted"), 0).when(F.col("file").endswith(F.col("wanted")), 1).when(F.contains("file", "wanted") & F.lit(loose), 2)
    hits = files.select("file").distinct().join(F.broadcast(asked), F.contains("file", "wanted")).withColumn("rank", rank).where("rank IS NOT NULL")
    best = hits.groupBy("wanted").agg(F.min(F.when(F.col("rank") == 0, F.col("file"))).alias("exact"), F.count_if(F.col("rank") <= 1).alias("n"), F.min(F.when(F.col("rank") == 1, F.col("file"))).alias("ends"), F.min("file").alias("holds"))
    file = F.coalesce("exact", F.when((F.col("n") == 1) | F.lit(not loose), F.col("ends")).otherwise(F.col("holds")))
    return asked.join(best.select("wanted", file.alias("file")), "wanted", "left")
