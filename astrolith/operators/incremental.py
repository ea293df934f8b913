"""Snapshots of a tree, what changed between them, refresh of tables, and the log of reads."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import session
from .ranges import holding

REBUILD_CHANGES, COMPACT_DEAD, COMPACT_SHARE = 200, 100, 0.3


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(file, change) of snapshots(file, mtime): added, deleted, modified or same."""
    a, b = old.select("file", F.col("mtime").alias("old"), F.lit(True).alias("_o")), new.select("file", F.col("mtime").alias("new"), F.lit(True).alias("_n"))
    change = F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "deleted").when(F.col("old").eqNullSafe(F.col("new")), "same").otherwise("modified")
    return a.join(b, "file", "full").select("file", change.alias("change"))


def is_clean(changes: DataFrame) -> DataFrame:
    """One row: whether nothing changed."""
    return changes.agg((F.count_if(F.col("change") != "same") == 0).alias("clean"))


def policy(changes: DataFrame, live: int, dead: int) -> DataFrame:
    """One row: what to do. Nothing changed: load; over 200 changes: rebuild; at least 100 dead rows and 30 percent: compact; else refresh."""
    n = F.col("changes")
    own = changes.agg(F.count_if(F.col("change") != "same").alias("changes"))
    compact = dead >= COMPACT_DEAD and dead >= COMPACT_SHARE * (live + dead)
    return own.select("changes", F.when(n == 0, "load").when(n > REBUILD_CHANGES, "rebuild").otherwise("compact" if compact else "refresh").alias("action"))


def refresh(rows: DataFrame, changes: DataFrame, rescanned: DataFrame, key: str = "file") -> DataFrame:
    """rows without those of changed and deleted files, and the rescanned ones in their place."""
    gone = changes.where("change IN ('deleted', 'modified')").select(F.col("file").alias(key)).distinct()
    return rows.join(gone, key, "left_anti").unionByName(rescanned)


def to_scan(changes: DataFrame) -> DataFrame:
    return changes.where("change IN ('added', 'modified')").select("file")


def covering(log: DataFrame, asked: DataFrame) -> DataFrame:
    """The latest read that covers each of asked(query, file, first, last): query, file, start, end, served_at, served_mtime.

    log has read_id, file, start, end, served_at, served_mtime. Queries that nothing covers have no row; ties go to the larger read_id.
    """
    own = holding(log, asked, "start", "end", "first", "last")
    best = F.max(F.struct("served_at", "read_id", "start", "end", "served_mtime")).alias("b")
    return own.groupBy("query", "file").agg(best).select("query", "file", F.col("b.read_id").alias("read_id"), F.col("b.start").alias("start"), F.col("b.end").alias("end"), F.col("b.served_at").alias("served_at"), F.col("b.served_mtime").alias("served_mtime"))


def latest_reads(log: DataFrame) -> DataFrame:
    """The last row of each (file, start, end): what a store that is updated in place would hold."""
    last = F.row_number().over(Window.partitionBy("file", "start", "end").orderBy(F.desc("served_at"), F.desc("read_id")))
    return log.withColumn("_k", last).where("_k = 1").drop("_k")


def preflight(asked: DataFrame, log: DataFrame, current: DataFrame, force: bool = False) -> DataFrame:
    """(query, status): ok if forced, or if a covering read saw the file's current(file, mtime); else needs_read_confirmation."""
    if force:
        return asked.select("query", F.lit("ok").alias("status"))
    fresh = log.join(current.withColumnRenamed("mtime", "served_mtime"), ["file", "served_mtime"], "left_semi")
    seen = holding(fresh.select("file", "start", "end"), asked, "start", "end", "first", "last")
    return asked.select("query").distinct().join(seen.select("query", F.lit(1).alias("hit")).distinct(), "query", "left").select("query", F.when(F.col("hit").isNotNull(), "ok").otherwise("needs_read_confirmation").alias("status"))


def save_index(tables: dict[str, DataFrame], path: str, root: str, version: int = 1) -> None:
    """Tables as Parquet in a folder of their own, and then a meta row that names it: until that is written, load_index() takes the tables of the last save whole.

    The folders of earlier saves but the last one are removed afterwards. One writer at a time.
    """
    spark = next(iter(tables.values())).sparkSession
    save = f"save-{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    for name, df in tables.items():
        df.write.option("compression", "zstd").parquet(f"{path}/{save}/{name}")
    spark.createDataFrame([(version, root, sorted(tables), save)], _META).coalesce(1).write.mode("append").parquet(f"{path}/_meta")
    saves = sorted(p for p in session.listed(spark, path) if p.startswith("save-"))
    for old in saves[:-2]:
        session.removed(spark, f"{path}/{old}")


_META = "version int, root string, tables array<string>, save string"


def load_index(spark: SparkSession, path: str, root: str, version: int = 1) -> dict[str, DataFrame] | None:
    """Tables of the last whole save_index(), or None if version or root differ or nothing is there."""
    try:
        meta = spark.read.schema(_META).parquet(f"{path}/_meta").orderBy(F.desc("save")).first()
    except AnalysisException:
        return None
    if meta is None or meta["version"] != version or meta["root"] != root:
        return None
    return {name: spark.read.parquet(f"{path}/{meta['save']}/{name}") for name in meta["tables"]}


def ensure_fresh(spark: SparkSession, path: str, root: str, current: DataFrame, rebuild: Callable[[], dict[str, DataFrame]], rescan: Callable[[DataFrame], dict[str, DataFrame]], stamps: str = "stamps") -> tuple[str, dict[str, DataFrame]]:
    """(action, tables) of a saved index brought up to current(file, mtime).

    Without a save, or after more changes than policy() bears, rebuild() makes all tables; else rescan(files) gives the new rows of added and modified files, which take the place of the
    old ones in each table by its file column. The table named stamps keeps (file, mtime). What changed is saved; a clean index is only loaded.
    """
    had = load_index(spark, path, root)
    if had is None:
        action, new = "build", rebuild()
    else:
        changes = session.cut(diff(had[stamps], current))
        action = policy(changes, 0, 0).first()["action"]
        if action == "load":
            return action, had
        fresh = rebuild() if action == "rebuild" else rescan(to_scan(changes))
        new = fresh if action == "rebuild" else {name: refresh(df, changes, fresh[name]) if name in fresh else df for name, df in had.items()}
    save_index(new | {stamps: current.select("file", "mtime")}, path, root)
    return action, load_index(spark, path, root)


class ReadLog:
    """A log of reads, READ rows, in memory or, with folder, in Parquet files that outlive the session. It answers which read covers a range."""

    READ = "read_id bigint, file string, start bigint, end bigint, served_at double, served_mtime double"

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark, self.folder, self._rows = spark, folder, spark.createDataFrame([], self.READ)

    def rows(self) -> DataFrame:
        if self.folder is None:
            return self._rows
        found = [x for x in session.listed(self.spark, self.folder) if x.startswith("r-")]
        return self.spark.read.schema(self.READ).parquet(*[f"{self.folder}/{x}" for x in found]) if found else self.spark.createDataFrame([], self.READ)

    def _put(self, rows: DataFrame) -> None:
        half = f"{self.folder}/_half-{uuid.uuid4().hex}"
        rows.write.parquet(half)
        session.renamed(self.spark, half, f"{self.folder}/r-{time.time_ns():020d}-{uuid.uuid4().hex[:8]}")

    def add(self, rows: DataFrame) -> None:
        own = rows.select("read_id", "file", "start", "end", "served_at", "served_mtime")
        if self.folder is None:
            self._rows = session.cut(self._rows.unionByName(own))
        else:
            self._put(own)

    def _replace(self, rows: DataFrame) -> None:
        if self.folder is None:
            self._rows = session.cut(rows)
            return
        old = [x for x in session.listed(self.spark, self.folder) if x.startswith("r-")]
        self._put(rows)
        for x in old:
            session.removed(self.spark, f"{self.folder}/{x}")

    def invalidate(self, files: DataFrame) -> None:
        """Forgets the reads of files(file), after they were written to."""
        self._replace(self.rows().join(files.select("file").distinct(), "file", "left_anti").select(*self.rows().columns))

    def clear(self) -> None:
        self._replace(self.rows().where("false"))

    def covering(self, asked: DataFrame) -> DataFrame:
        return covering(self.rows(), asked)


class Warm:
    """A saved index held in memory for as long as its save is the last one."""

    def __init__(self, spark: SparkSession, path: str, root: str):
        self.spark, self.path, self.root, self._save, self._tables = spark, path, root, None, None

    def tables(self) -> dict[str, DataFrame] | None:
        saves = [x for x in session.listed(self.spark, self.path) if x.startswith("save-")]
        last = saves[-1] if saves else None
        if last != self._save or self._tables is None:
            self.drop()
            found = load_index(self.spark, self.path, self.root)
            self._save, self._tables = last, {n: df.persist() for n, df in found.items()} if found else None
        return self._tables

    def drop(self) -> None:
        for df in (self._tables or {}).values():
            df.unpersist()
        self._tables = None
