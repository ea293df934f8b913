"""Import graphs as edges(src, dst): degrees, closure, chains, coupling, components.

Closures and strong components of graphs whose edges a task can hold are one job of kernels; larger ones grow by frontier joins to a fixpoint. Each round ends with a reliable
checkpoint, so that a lost executor costs one round. Joins of rounds are merged and never broadcast: rounds are many, and the driver would gather a table in each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths
from ..session import cut
from . import reach as kernels

THRESHOLDS = {"hotspots": (5, 15, 25), "fragile": (8, 15, 25), "deep_chains": (7, 12, 18), "cycles": (3, 5, 8)}


def classified(value: Column, metric: str, thresholds: dict[str, tuple[int, int, int]] = THRESHOLDS) -> Column:
    info, warning, error = thresholds[metric]
    return F.when(value >= error, "error").when(value >= warning, "warning").when(value >= info, "info").otherwise("debug")


def module_map(files: DataFrame) -> DataFrame:
    """(module, file): names under which a Python file can be imported; of several files with a name, the last path has it."""
    path = F.regexp_replace("file", r"(^|/)__init__\.py$", "")
    whole = F.translate(F.regexp_replace(path, r"\.py$", ""), "/", ".")
    short = F.regexp_replace(whole, r"(^|\.)src\.", r"$1")
    after = F.regexp_replace(whole, r"^.*?(^|\.)src\.", "")
    names = files.select("file", F.explode(F.array_distinct(F.array(whole, short, after))).alias("module")).where("module <> ''")
    return names.groupBy("module").agg(F.max("file").alias("file"))


def package_map(scan: DataFrame) -> DataFrame:
    """(module, file): import paths of Go packages and, of each, the last of its files."""
    return scan.where("language = 'Go' AND module <> ''").groupBy("module").agg(F.max("file").alias("file"))


def resolve_imports(edges_raw: DataFrame, modules: DataFrame) -> DataFrame:
    """Distinct edges(src, dst) of edges_raw(file, ord, module, names, scope): names that are modules lead to their files, other names to the module."""
    live = edges_raw.where("scope <> 'type_checking'").select("file", "ord", "module", "names")
    each = live.select("file", "ord", "module", F.explode_outer("names").alias("name"))
    full = F.when(F.col("module") == "", F.col("name")).otherwise(F.concat_ws(".", "module", "name"))
    sub = modules.select(F.col("module").alias("full"), F.col("file").alias("sub_file"))
    tried = each.withColumn("full", F.when(F.col("name").isNotNull(), full)).join(sub, "full", "left")
    direct = tried.where("sub_file IS NOT NULL").select(F.col("file").alias("src"), F.col("sub_file").alias("dst"))
    rest = tried.where("sub_file IS NULL").select("file", "module").distinct().join(modules.withColumnRenamed("file", "dst"), "module").select(F.col("file").alias("src"), "dst")
    return direct.union(rest).where("src <> dst").distinct()


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def fan_in(edges: DataFrame) -> DataFrame:
    """(node, fan_in, severity) of all nodes that something imports."""
    return edges.distinct().groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("fan_in")).withColumn("severity", classified(F.col("fan_in"), "hotspots"))


def hotspots(edges: DataFrame, least: int = THRESHOLDS["hotspots"][0]) -> DataFrame:
    """(file, fan_in): importers of a file, and those of its package's __init__ where that imports the file. __init__ files aren't listed."""
    own = edges.distinct()
    counts = own.groupBy(F.col("dst").alias("file")).agg(F.count("*").alias("n"))
    given = own.where(paths.is_init(F.col("src")) & (paths.folder(F.col("src")) == paths.folder(F.col("dst")))).join(counts.withColumnRenamed("file", "src"), "src").select(F.col("dst").alias("file"), "n")
    total = counts.union(given).where(~paths.is_init(F.col("file"))).groupBy("file").agg(F.sum("n").alias("fan_in"))
    return total.where(F.col("fan_in") >= least)


def fan_out(edges: DataFrame) -> DataFrame:
    """(node, fan_out, severity) of all nodes that import something."""
    return edges.groupBy(F.col("src").alias("node")).agg(F.countDistinct("dst").alias("fan_out")).withColumn("severity", classified(F.col("fan_out"), "fragile"))


def fragile(edges: DataFrame, files: DataFrame, least: int = THRESHOLDS["fragile"][0]) -> DataFrame:
    """(file, fan_out) from least on; an __init__ that only hands on names (files.init_code is false) is left out."""
    own = fan_out(edges).select(F.col("node").alias("file"), "fan_out").where(F.col("fan_out") >= least)
    hands_on = files.where(paths.is_init(F.col("file")) & ~F.col("init_code")).select("file")
    return own.join(hands_on, "file", "left_anti")


def leaves(edges: DataFrame, sizes: DataFrame, most_lines: int = 100) -> DataFrame:
    """(node, importer, lines): nodes that exactly one imports, shorter than most_lines. sizes has node and lines."""
    one = edges.distinct().groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n"), F.min("src").alias("importer")).where("n = 1")
    return one.join(sizes.select("node", "lines"), "node").where((F.col("lines") < most_lines) & ~paths.is_init(F.col("node").cast("string"))).select("node", "importer", "lines")


def mutual(edges: DataFrame) -> DataFrame:
    """(a, b), a < b, that import each other."""
    return edges.intersect(reverse(edges)).where("src < dst").select(F.col("src").alias("a"), F.col("dst").alias("b"))


def coupling(edges: DataFrame, depth: int = 1) -> DataFrame:
    """(package, dep, mutual) between the packages of file edges, without those within a package."""
    own = edges.select(paths.package_at(F.col("src"), depth).alias("package"), paths.package_at(F.col("dst"), depth).alias("dep")).where("package <> dep").distinct()
    back = own.select(F.col("dep").alias("package"), F.col("package").alias("dep"), F.lit(True).alias("_back"))
    return own.join(back, ["package", "dep"], "left").select("package", "dep", F.coalesce("_back", F.lit(False)).alias("mutual"))


def closure(edges: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """Distinct (src, dst) such that a path of one or more edges leads from src to dst; starts(src) keeps only those sources.

    A node on a cycle reaches itself. Blocks of sources are searched side by side, each over a copy of the edges, so that work follows the pairs found; over HELD_EDGES edges the pairs
    that the last round found are joined again, and each round writes no more than them.
    """
    e = cut(edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct())
    n = e.count()
    if n <= kernels.HELD_EDGES:
        return kernels.closure(e, n, starts)
    new = e if starts is None else cut(e.join(starts.select("src").distinct(), "src", "left_semi"))
    out = new
    step = e.select(F.col("src").alias("dst"), F.col("dst").alias("next"))
    while True:
        found = new.join(step.hint("merge"), "dst").select("src", F.col("next").alias("dst")).distinct()
        new = cut(found.join(out.hint("merge"), ["src", "dst"], "left_anti"))
        if new.isEmpty():
            return out
        out = out.union(new)


def reaching(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """(node) of targets(node) and of all nodes from which a path leads to one of them. One join a round, over the nodes that the last one found."""
    back = cut(edges.select(F.col("dst").alias("node"), F.col("src").alias("next")).where("node IS NOT NULL AND next IS NOT NULL").distinct())
    out = new = cut(targets.select("node").distinct())
    while True:
        new = cut(new.join(back.hint("merge"), "node").select(F.col("next").alias("node")).distinct().join(out.hint("merge"), "node", "left_anti"))
        if new.isEmpty():
            return out
        out = out.union(new)


def blast(edges: DataFrame, target: object) -> DataFrame:
    """(node, reach) of what imports target directly, or transitively but not directly."""
    back = reverse(edges)
    all_of = closure(back, edges.sparkSession.createDataFrame([(target,)], back.select("src").schema))
    direct = edges.where(F.col("dst") == F.lit(target)).select(F.col("src").alias("node")).distinct().withColumn("reach", F.lit("direct"))
    rest = all_of.select(F.col("dst").alias("node")).join(direct, "node", "left_anti").withColumn("reach", F.lit("transitive"))
    return direct.union(rest)


def importer_counts(edges: DataFrame, reach: DataFrame | None = None) -> DataFrame:
    """(node, direct, transitive) importers; __init__ files are passed through but count in neither."""
    not_init = ~paths.is_init(F.col("src").cast("string"))
    direct = edges.distinct().where(not_init).groupBy("dst").agg(F.count("*").alias("direct"))
    total = (closure(edges) if reach is None else reach).where(not_init & (F.col("src") != F.col("dst"))).groupBy("dst").agg(F.count("*").alias("total"))
    own = total.join(direct, "dst", "left")
    n = F.coalesce("direct", F.lit(0)).cast("bigint")
    return own.select(F.col("dst").alias("node"), n.alias("direct"), (F.col("total") - n).alias("transitive"))


def _acyclic_rounds(e: DataFrame, first: DataFrame, best: Column) -> DataFrame:
    """first(node, r, b), and for each r from 1 on the nodes from which a path of exactly r edges of e leads, with the least of best, a column of the node src and the b of its successor.

    A round reads and writes only the nodes that have such a path, so that all rounds together cost one row for each node and length of its paths. e has no cycle.
    """
    out = now = first
    while True:
        now = cut(e.join(now.withColumnRenamed("node", "dst").hint("merge"), "dst").groupBy(F.col("src").alias("node"), (F.col("r") + 1).alias("r")).agg(F.min(best).alias("b")))
        if now.isEmpty():
            return out
        out = out.union(now)


def longest_chains(edges: DataFrame) -> DataFrame:
    """(node, length): edges on the longest path from each node; nodes that only end edges have 0. Files of one cycle count as one, as in deep_chains()."""
    group, e = condensed(edges)
    first = group.select(F.col("component").alias("node")).distinct().select("node", F.lit(0).alias("r"), F.lit(0).alias("b"))
    best = _acyclic_rounds(e, first, F.lit(0)).groupBy("node").agg(F.max("r").alias("length"))
    return group.join(best.withColumnRenamed("node", "component"), "component").select("node", "length")


def strong(e: DataFrame) -> DataFrame:
    """(node, component) of the nodes on cycles of two or more, component being the least node of those that reach each other. e has distinct edges without nulls and loops.

    While a task can't hold the edges, nodes that no cycle runs through are peeled off from both ends. If that ends with too many, pairs of nodes are formed within what is left.
    """
    core, n = e, e.count()
    while n > kernels.HELD_EDGES:
        left = cut(core.join(core.select(F.col("dst").alias("src")).distinct().hint("merge"), "src", "left_semi").join(core.select(F.col("src").alias("dst")).distinct().hint("merge"), "dst", "left_semi").select("src", "dst"))
        m = left.count()
        if m == n:
            reach = closure(core)
            return reach.intersect(reverse(reach)).groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("component"))
        core, n = left, m
    return kernels.strong(core)


def condensed(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((node, component), edges between components): component is the least node of those that reach each other."""
    e = cut(edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst").distinct())
    nodes = e.select(F.col("src").alias("node")).union(e.select("dst")).distinct()
    tied = cut(strong(e).withColumnRenamed("component", "m"))
    if tied.isEmpty():
        return nodes.withColumn("component", F.col("node")), e
    group = cut(nodes.join(tied, "node", "left").select("node", F.coalesce("m", "node").alias("component")))
    name = lambda x: tied.select(F.col("node").alias(x), F.col("m").alias(f"{x}_c"))
    ends = e.join(name("src"), "src", "left").join(name("dst"), "dst", "left").select(F.coalesce("src_c", "src").alias("src"), F.coalesce("dst_c", "dst").alias("dst"))
    return group, cut(ends.where("src <> dst").distinct())


def deep_chains(edges: DataFrame, least: int = THRESHOLDS["deep_chains"][0], thresholds: dict[str, tuple[int, int, int]] = THRESHOLDS) -> DataFrame:
    """(node, length, chain, severity) of the longest import chain from each node that imports something, from least on.

    __init__ files are passed through but neither counted nor listed. Files of one cycle count once, as the least of them. Of chains of one length the first in the order of names is
    taken; a node has one chain.
    """
    group, e = condensed(edges)
    own = lambda c: F.when(paths.is_init(c), F.array().cast("array<string>")).otherwise(F.array(c))
    first = group.select(F.col("component").cast("string").alias("node")).distinct().select("node", F.lit(0).alias("r"), F.struct((-F.size(own(F.col("node")))).alias("n"), own(F.col("node")).alias("chain")).alias("b"))
    longer = F.struct((F.col("b.n") - F.size(own(F.col("src")))).alias("n"), F.concat(own(F.col("src")), F.col("b.chain")).alias("chain"))
    e = e.select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"))
    best = _acyclic_rounds(e, first, longer).groupBy("node").agg(F.min("b").alias("b")).select(F.col("node").alias("component"), (-F.col("b.n")).alias("length"), F.col("b.chain").alias("chain"))
    starts = edges.select(F.col("src").cast("string").alias("node")).distinct()
    found = group.select(F.col("node").cast("string").alias("node"), F.col("component").cast("string").alias("component")).join(starts, "node", "left_semi").join(best, "component").where(F.col("length") >= least)
    return found.select("node", "length", "chain", classified(F.col("length"), "deep_chains", thresholds).alias("severity"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of weak components, component being the least node. Labels jump along pointers: rounds grow with the logarithm."""
    both = cut(edges.union(reverse(edges)).distinct())
    label = cut(both.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("m")).select("node", F.least("node", "m").alias("component")))
    while True:
        near = both.join(label.withColumnRenamed("node", "dst").hint("merge"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("component").alias("near"))
        step = label.join(near.hint("merge"), "node").select("node", "component", F.least("component", "near").alias("now"))
        jump = step.join(label.select(F.col("node").alias("now"), F.col("component").alias("far")).hint("merge"), "now", "left").select("node", "component", F.coalesce(F.least("far", "now"), F.col("now")).alias("now"))
        jump = cut(jump)
        same = jump.where("now <> component").isEmpty()
        label = jump.select("node", F.col("now").alias("component"))
        if same:
            return label


def propagate(edges: DataFrame) -> DataFrame:
    """edges, and a -> b wherever a imports the __init__ of a package that imports b, to a fixpoint."""
    inits = edges.where(paths.is_init(F.col("src"))).select(F.col("src").alias("dst"), F.col("dst").alias("next"))
    out = new = cut(edges.select("src", "dst").distinct())
    inits = cut(inits)
    while True:
        found = new.join(inits.hint("merge"), "dst").where("src <> next").select("src", F.col("next").alias("dst")).distinct()
        new = cut(found.join(out.hint("merge"), ["src", "dst"], "left_anti"))
        if new.isEmpty():
            return out
        out = cut(out.union(new))


def on_cycles(edges: DataFrame) -> DataFrame:
    """(node, size) of nodes that reach themselves, with the size of their strongly connected group."""
    e = cut(edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct())
    tied = cut(strong(e.where("src <> dst")))
    sizes = tied.groupBy("component").agg(F.count("*").alias("size"))
    loops = e.where("src = dst").select(F.col("src").alias("node")).join(tied, "node", "left_anti").withColumn("size", F.lit(1).cast("bigint"))
    return tied.join(sizes, "component").select("node", "size").union(loops)


def summary(edges: DataFrame, nodes: DataFrame, chains: DataFrame | None = None) -> DataFrame:
    """One row: total, connected and orphan nodes, and distinct edges; with deep_chains() rows, the length of the longest too. nodes has node."""
    tied = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct().withColumn("tied", F.lit(1))
    counts = nodes.select("node").distinct().join(tied, "node", "left").agg(F.count("*").alias("total"), F.count("tied").alias("connected"))
    one = counts.crossJoin(edges.distinct().agg(F.count("*").alias("edges"))).select("total", "connected", (F.col("total") - F.col("connected")).alias("orphans"), "edges")
    return one if chains is None else one.crossJoin(chains.agg(F.coalesce(F.max("length"), F.lit(0)).alias("longest_chain")))


def chain_heads(chains: DataFrame, least: int = THRESHOLDS["deep_chains"][0]) -> DataFrame:
    """(node, length, severity) of chains from least on, one a head."""
    best = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("length")))
    return chains.withColumn("_k", best).where((F.col("_k") == 1) & (F.col("length") >= least)).select("node", "length", classified(F.col("length"), "deep_chains").alias("severity"))


def import_names(edges_raw: DataFrame, modules: DataFrame) -> DataFrame:
    """(file, name, source_module, source_file, scope) of each name that an import asks for: the file of the submodule that the name is, else of the module, else an empty one.

    An import without names stands for its module's last segment.
    """
    each = edges_raw.select("file", "module", "scope", F.explode_outer(F.when(F.size("names") > 0, F.col("names"))).alias("asked"))
    sub = F.when(F.col("asked").isNotNull(), F.when(F.col("module") == "", F.col("asked")).otherwise(F.concat_ws(".", "module", "asked")))
    found = each.withColumn("sub", sub).join(modules.select(F.col("module").alias("sub"), F.col("file").alias("sub_file")), "sub", "left").join(modules.withColumnRenamed("file", "own_file"), "module", "left")
    return found.select("file", F.coalesce("asked", paths.leaf(F.col("module"))).alias("name"), F.col("module").alias("source_module"), F.coalesce("sub_file", "own_file", F.lit("")).alias("source_file"), "scope")
