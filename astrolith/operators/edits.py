"""Edits as data: byte-range splices grouped by file, transactions and undo.

edits has file, k (order within the file), start, end (bytes) and new (text); files has file and content (binary). Of a file either all edits
are applied or none.
"""

from __future__ import annotations

import ast
import textwrap
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from .. import session
from ..functions import text as T
from ..sources import go_scan
from . import incremental

KEEP_TRANSACTIONS = 50


def _order() -> WindowSpec:
    return Window.partitionBy("file").orderBy("start", "end", "k")


def locate(edits: DataFrame, files: DataFrame) -> DataFrame:
    """edits with start and end of those that name their place by old text; status says not_found or ambiguous (overlapping matches count) where there isn't exactly one.

    edits has file, k, start, end, old, new; either start and end or old is null.
    """
    text = F.decode("content", "UTF-8")
    rows = edits.join(files.select("file", "content"), "file", "left")
    first = F.instr(text, F.col("old"))
    again = F.expr("locate(old, decode(content, 'UTF-8'), instr(decode(content, 'UTF-8'), old) + 1)")
    by_old = F.col("old").isNotNull()
    status = F.when(F.col("content").isNull(), "no_file").when(by_old & (F.col("start").isNotNull()), "bad_edit").when(by_old & ((F.col("old") == "") | (first == 0)), "not_found").when(by_old & (again > 0), "ambiguous").when(
        ~by_old & ((F.col("start") < 0) | (F.col("end") < F.col("start")) | (F.col("end") > F.octet_length("content"))), "bad_range").otherwise("ok")
    begin = F.octet_length(F.expr("substring(decode(content, 'UTF-8'), 1, instr(decode(content, 'UTF-8'), old) - 1)"))
    ok = by_old & (status == "ok")
    return rows.select("file", "k", F.when(ok, begin).otherwise(F.col("start")).cast("bigint").alias("start"), F.when(ok, begin + F.octet_length("old")).otherwise(F.col("end")).cast("bigint").alias("end"), "new", status.alias("status"))


def overlaps(edits: DataFrame) -> DataFrame:
    """(file, k) of edits that begin before an earlier one of their file has ended."""
    reach = F.max("end").over(_order().rowsBetween(Window.unboundedPreceding, -1))
    return edits.withColumn("_r", reach).where("start < _r").select("file", "k")


def shifted(edits: DataFrame) -> DataFrame:
    """edits with new_start and new_end: where each replacement lies once all of its file are applied."""
    delta = F.octet_length("new") - (F.col("end") - F.col("start"))
    before = F.coalesce(F.sum(delta).over(_order().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    start = F.col("start") + before
    return edits.withColumn("new_start", start).withColumn("new_end", F.col("new_start") + F.octet_length("new"))


def apply(files: DataFrame, edits: DataFrame) -> DataFrame:
    """(file, content, status) of the files that have edits: ok with the new content, overlap or bad_range with the old one.

    A null replacement deletes. Files without edits, and edits of files that aren't there, have no row.
    """
    e = edits.select("file", "k", "start", "end", F.coalesce("new", F.lit("")).alias("new"))
    bad = overlaps(e).select("file").distinct().withColumn("_overlap", F.lit(True))
    # pieces of the old content between edits and the replacements, put together in one pass over the sorted edits
    lists = e.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("start", "end", "k", "new"))).alias("e"))
    rows = files.select("file", "content").join(lists, "file").join(bad, "file", "left")
    part = lambda a, z: f"substring(content, CAST({a} + 1 AS INT), CAST({z} - {a} AS INT))"
    spliced = F.expr(f"aggregate(e, named_struct('at', 0L, 'out', X''), (s, x) -> named_struct('at', x.end, 'out', concat(s.out, {part('s.at', 'x.start')}, encode(x.new, 'UTF-8'))), s -> concat(s.out, substring(content, CAST(s.at + 1 AS INT))))")
    wrong = F.exists("e", lambda x: (x["start"] < 0) | (x["end"] < x["start"]) | (x["end"] > F.octet_length("content")))
    status = F.when(wrong, "bad_range").when(F.col("_overlap"), "overlap").otherwise("ok")
    return rows.withColumn("status", status).select("file", F.when(F.col("status") == "ok", spliced).otherwise(F.col("content")).alias("content"), "status")


def line_ranges(files: DataFrame) -> DataFrame:
    """(file, line, start, end): the bytes of each line, without the end of line."""
    lines = files.select("file", F.posexplode(F.split(F.decode("content", "UTF-8"), "\n")).alias("k", "one"))
    w = Window.partitionBy("file").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.octet_length("one") + 1).over(w), F.lit(0))
    return lines.withColumn("start", start).select("file", (F.col("k") + 1).alias("line"), "start", (F.col("start") + F.octet_length("one")).alias("end"))


def _edit(declarations: DataFrame, start: Column, end: Column, new: Column) -> DataFrame:
    return declarations.select("file", F.lit(0).alias("k"), start.cast("bigint").alias("start"), end.cast("bigint").alias("end"), new.alias("new"))


def insert(anchors: DataFrame, where: str, text: str) -> DataFrame:
    """edits that put text before or after each of anchors, or at the start or end of its body, on lines of its own and at the indent of what is there.

    anchors has file, s_byte, e_byte, col, body_byte, indent as declarations have; a body on its head's line takes nothing at its start or end. Two blank lines part definitions at the top of a
    file, one those within another.
    """
    level = F.coalesce("indent" if where in ("start", "end") else "col", F.lit(0))
    new = F.rtrim(T.reindent(F.lit(text), F.repeat(F.lit(" "), level)))
    new = F.regexp_replace(new, r"\n+$", "")
    gap = F.when(level == 0, "\n\n\n").otherwise("\n\n")
    if where == "before":
        return _edit(anchors, F.col("s_byte"), F.col("s_byte"), F.concat(new, gap))
    if where == "after":
        return _edit(anchors, F.col("e_byte"), F.col("e_byte"), F.concat(gap, new))
    if where == "start":
        own = anchors.where("body_byte IS NOT NULL")
        return _edit(own, F.col("body_byte"), F.col("body_byte"), F.concat(new, F.lit("\n\n")))
    if where == "end":
        own = anchors.where("body_byte IS NOT NULL")
        return _edit(own, F.col("e_byte"), F.col("e_byte"), F.concat(F.lit("\n\n"), new))
    raise ValueError(f"where is before, after, start or end, not {where}")


def delete(targets: DataFrame, guard: DataFrame | None = None) -> DataFrame:
    """edits that remove each of targets(id, file, s_byte, e_byte); with guard(id, blocked), only those that aren't blocked."""
    free = targets if guard is None else targets.join(guard.where("blocked").select("id"), "id", "left_anti")
    return _edit(free, F.col("s_byte"), F.col("e_byte"), F.lit(""))


def replace(targets: DataFrame, new: str) -> DataFrame:
    """edits that put new, at each target's indent, in the place of targets(file, s_byte, e_byte, col)."""
    text = F.regexp_replace(T.reindent(F.lit(new), F.repeat(F.lit(" "), F.coalesce("col", F.lit(0)))), r"\n+$", "")
    return _edit(targets, F.col("s_byte"), F.col("e_byte"), text)


def described(text: str, language: str = "Python") -> tuple[str, str | None, str | None]:
    """(status, kind, name) of a text that is to be one definition: parse_error, not_one, or ok."""
    if language == "Go":
        row = go_scan.scan_go("x.go", b"package x\n" + text.encode())
        found = [(d["kind"], d["leaf"]) for d in row["declarations"]]
        if row["parse_error"]:
            return "parse_error", None, None
    else:
        try:
            body = ast.parse(textwrap.dedent(text)).body
        except (SyntaxError, ValueError):
            return "parse_error", None, None
        kinds = {ast.FunctionDef: "function", ast.AsyncFunctionDef: "async_function", ast.ClassDef: "class"}
        found = [(kinds.get(type(x)), getattr(x, "name", None)) for x in body]
    if len(found) != 1 or found[0][0] is None:
        return "not_one", None, None
    return "ok", *found[0]


def checked_replace(declarations: DataFrame, targets: DataFrame, new: str, language: str = "Python") -> tuple[DataFrame, DataFrame]:
    """(edits, (id, status)) of the replacement of targets, rows of declarations, by one definition new.

    Refused with parse_error and not_one is every target, with kind_mismatch one of another kind (a method counts as a function), and with collision one whose parent has the new name
    already. The others are ok.
    """
    status, kind, name = described(new, language)
    if status != "ok":
        return replace(targets.where("false"), new), targets.select("id", F.lit(status).alias("status"))
    plain = F.regexp_replace("kind", "method$", "function") if language == "Python" else F.col("kind")
    beside = F.concat(F.regexp_replace("path", r"[^.]*$", ""), F.lit(name))
    taken = declarations.select(F.col("path").alias("_new"), F.col("id").alias("_id")).distinct()
    hits = targets.withColumn("_new", beside).join(taken, "_new").where("_id <> id").select("id").distinct().withColumn("_taken", F.lit(True))
    said = targets.join(hits, "id", "left").withColumn("status", F.when(plain != kind, "kind_mismatch").when(F.col("_taken"), "collision").otherwise("ok"))
    return replace(said.where("status = 'ok'"), new), said.select("id", "status")


def checked_insert(anchors: DataFrame, where: str, text: str, language: str = "Python") -> tuple[DataFrame, DataFrame]:
    """(edits, (id, status)) of insert(): parse_error and not_one as in checked_replace(), not_a_container for the start or end of what is no class, no_body for a body on its head's line."""
    status, _, _ = described(text, language)
    if status != "ok":
        return insert(anchors.where("false"), where, text), anchors.select("id", F.lit(status).alias("status"))
    inside = F.lit(where in ("start", "end"))
    said = anchors.withColumn("status", F.when(inside & (F.col("kind") != "class"), "not_a_container").when(inside & F.col("body_byte").isNull(), "no_body").otherwise("ok"))
    return insert(said.where("status = 'ok'"), where, text), said.select("id", "status")


def rename_words(files: DataFrame, candidates: DataFrame, old: str, new: str) -> DataFrame:
    """(file, content, n) of the candidate files that hold old as a whole word, with new in its place. Strings and comments count as well."""
    pattern = rf"\b\Q{old}\E\b"
    text = F.decode("content", "UTF-8")
    own = files.join(candidates.select("file").distinct(), "file", "left_semi").withColumn("n", F.regexp_count(text, F.lit(pattern)))
    return own.where("n > 0").select("file", F.encode(F.regexp_replace(text, pattern, new), "UTF-8").alias("content"), "n")


def commit(store: DataFrame, changed: DataFrame, tx_id: int) -> tuple[DataFrame, DataFrame]:
    """(store after, log rows) of a transaction: all of changed(file, content) or nothing. The log has tx_id, file and pre_image, null for a new file."""
    new = changed.select("file", F.col("content").alias("_new"), F.lit(True).alias("_c"))
    joined = store.select("file", "content").join(new, "file", "full")
    after = joined.select("file", F.when(F.col("_c"), F.col("_new")).otherwise(F.col("content")).alias("content"))
    return after, joined.where("_c").select(F.lit(tx_id).cast("bigint").alias("tx_id"), "file", F.col("content").alias("pre_image"))


def prune(log: DataFrame, keep: int = KEEP_TRANSACTIONS) -> DataFrame:
    """Log rows of the newest keep transactions."""
    return log.join(log.select("tx_id").distinct().orderBy(F.desc("tx_id")).limit(keep), "tx_id", "left_semi")


def undo(store: DataFrame, log: DataFrame) -> DataFrame:
    """store before the latest transaction of log: pre-images come back, files that it made go."""
    last = log.agg(F.max("tx_id").alias("tx_id"))
    images = log.join(F.broadcast(last), "tx_id").select("file", "pre_image", F.lit(True).alias("_u"))
    joined = store.select("file", "content").join(images, "file", "full")
    return joined.where("_u IS NULL OR pre_image IS NOT NULL").select("file", F.when(F.col("_u"), F.col("pre_image")).otherwise(F.col("content")).alias("content"))


def transact(spark: SparkSession, path: str, changed: DataFrame, verify: Callable[[DataFrame], bool] | None = None, keep: int = KEEP_TRANSACTIONS) -> tuple[str, int | None]:
    """(status, tx_id) of a transaction on a stored project: changed(file, content) becomes part of it, with its log, or nothing does.

    The store is an index of the tables store(file, content) and log; verify(the store after) may turn the transaction down, and an error on the way leaves the last save as it was. The newest
    keep transactions stay in the log.
    """
    had = incremental.load_index(spark, path, path)
    store = had["store"] if had else spark.createDataFrame([], "file string, content binary")
    log = had["log"] if had else spark.createDataFrame([], "tx_id bigint, file string, pre_image binary")
    tx = (log.agg(F.max("tx_id")).first()[0] or 0) + 1
    after, rows = commit(store, changed, tx)
    after = session.cut(after)
    if verify is not None and not verify(after):
        return "rejected", None
    incremental.save_index({"store": after, "log": prune(log.unionByName(rows), keep)}, path, path)
    return "ok", tx


def undo_last(spark: SparkSession, path: str) -> tuple[str, int | None]:
    """(status, tx_id) of taking back the newest transaction of a stored project, which leaves the log; nothing_to_undo without one."""
    had = incremental.load_index(spark, path, path)
    tx = had["log"].agg(F.max("tx_id")).first()[0] if had else None
    if tx is None:
        return "nothing_to_undo", None
    incremental.save_index({"store": undo(had["store"], had["log"]), "log": had["log"].where(F.col("tx_id") < tx)}, path, path)
    return "ok", tx
