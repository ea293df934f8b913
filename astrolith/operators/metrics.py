"""Line counts by language, code structure and type coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def file_metrics(files: DataFrame, content: str = "content") -> DataFrame:
    """files with loc, sloc and size in bytes of the text in content."""
    t = F.col(content)
    return files.withColumns({"loc": T.loc(t), "sloc": T.sloc(t), "size": F.coalesce(F.octet_length(t), F.lit(0)).cast("bigint")})


def language_stats(measured: DataFrame) -> DataFrame:
    """(language, files, loc, sloc, size) of file_metrics() rows; files without a language form none."""
    return measured.where("language IS NOT NULL").groupBy("language").agg(F.count("*").alias("files"), *[F.sum(c).alias(c) for c in ("loc", "sloc", "size")])


def shares(stats: DataFrame, counted: Column | None = None) -> DataFrame:
    """language_stats() with the share of counted languages' sloc in basis points, rounded down; others have none."""
    c = F.lit(True) if counted is None else counted
    total = F.sum(F.when(c, F.col("sloc"))).over(Window.partitionBy())
    return stats.withColumn("share_bp", F.when(c & (total > 0), F.floor(F.col("sloc") * 10000 / total)))


def totals(measured: DataFrame) -> DataFrame:
    """One row: files, languages, loc, sloc, size."""
    return measured.agg(F.count("*").alias("files"), F.countDistinct("language").alias("languages"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("loc", "sloc", "size")])


def biggest(measured: DataFrame, k: int = 10) -> DataFrame:
    """The k files of most lines; ties go by path."""
    return measured.orderBy(F.desc("loc"), "file").limit(k)


def bar_widths(stats: DataFrame, width: int = 60) -> DataFrame:
    """(language, width) of a bar of width signs: at least 1 each, the last language takes what is left."""
    order = Window.orderBy(F.desc("sloc"), "language")
    total = F.sum("sloc").over(Window.partitionBy())
    sized = stats.withColumns({"_k": F.row_number().over(order), "_n": F.count("*").over(Window.partitionBy()), "_w": F.greatest(F.lit(1), F.round(F.col("sloc") * width / F.greatest(total, F.lit(1)))).cast("bigint")})
    before = F.coalesce(F.sum("_w").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return sized.withColumn("width", F.when(F.col("_k") == F.col("_n"), F.greatest(F.lit(width) - before, F.lit(1))).otherwise(F.col("_w"))).select("language", "width")


def structure(scan: DataFrame) -> DataFrame:
    """One row of sums over a scan table's counters, with average lines and coverage in percent to one place."""
    names = ("functions", "methods", "classes", "callable_lines", "typed_functions", "args", "typed_args", "attrs", "typed_attrs", "vars", "typed_vars")
    sums = scan.agg(*[F.coalesce(F.sum(f"counters.{n}"), F.lit(0)).cast("bigint").alias(n) for n in names])
    callables = F.col("functions") + F.col("methods")
    percent = lambda a, b: F.when(b == 0, 0.0).otherwise(F.round(a * 100 / b, 1))
    return sums.withColumns({
        "avg_lines": F.when(callables > 0, F.floor(F.col("callable_lines") / callables)).otherwise(0), "return_pct": percent(F.col("typed_functions"), callables), "arg_pct": percent(F.col("typed_args"), F.col("args")), "attr_pct": percent(F.col("typed_attrs"), F.col("attrs")),
        "overall_pct": percent(F.col("typed_functions") + F.col("typed_args") + F.col("typed_attrs"), callables + F.col("args") + F.col("attrs")),
    })


def per_file(scan: DataFrame, measured: DataFrame) -> DataFrame:
    """(file, loc, sloc, classes, functions, complexity, max_depth, typed_pct) of each scanned file."""
    e = lambda f: F.coalesce(F.aggregate("exports", F.lit(0), f), F.lit(0))
    c = F.col("counters")
    callables = c["functions"] + c["methods"]
    own = scan.select("file", c["classes"].alias("classes"), callables.alias("functions"), e(lambda a, x: a + x["complexity"]).alias("complexity"), e(lambda a, x: F.greatest(a, x["max_depth"])).alias("max_depth"), F.when(callables == 0, 0.0).otherwise(F.round(c["typed_functions"] * 100 / callables, 1)).alias("typed_pct"))
    return own.join(measured.select("file", "loc", "sloc"), "file")


def export_usage(scan: DataFrame, modules: DataFrame) -> DataFrame:
    """(file, name, used_by): for each export, the files that import it by name or by *. Type checking imports, the file itself and the __init__ files above it don't count."""
    exports = scan.select("file", F.explode("exports.name").alias("name")).distinct()
    uses = scan.select(F.col("file").alias("importer"), F.explode("edges").alias("e")).where("e.scope <> 'type_checking'").select("importer", F.col("e.module").alias("module"), F.explode("e.names").alias("used")).join(modules, "module").select("importer", "file", "used").distinct()
    above = (F.element_at(F.split("importer", "/"), -1) == "__init__.py") & F.col("file").startswith(F.regexp_replace("importer", "__init__\\.py$", ""))
    hits = exports.join(uses, "file").where(((F.col("used") == F.col("name")) | (F.col("used") == "*")) & (F.col("importer") != F.col("file")) & ~above)
    return exports.join(hits.groupBy("file", "name").agg(F.array_sort(F.collect_set("importer")).alias("used_by")), ["file", "name"], "left").withColumn("used_by", F.coalesce("used_by", F.array().cast("array<string>")))


def index_stats(files: DataFrame, declarations: DataFrame, refs: DataFrame, imports: DataFrame) -> DataFrame:
    """One row of counts: files, declarations, refs, imports, and distinct strings among paths and names."""
    strings = declarations.select("path").union(refs.select("name")).union(imports.select("name")).distinct()
    parts = [df.agg(F.count("*").alias(n)) for n, df in (("files", files), ("declarations", declarations), ("refs", refs), ("imports", imports), ("strings", strings))]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)
    return out
