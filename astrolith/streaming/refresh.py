"""Streams of file changes and reads: micro-batches that refresh the touched parts of a table, and aggregates kept by key or window."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import session

#: Parts of a refreshed table.
PARTS = 64


def read_changes(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """A stream of the Parquet files that come into a folder."""
    return spark.readStream.schema(schema).parquet(folder)


def refresh_table(changes: DataFrame, table: str, checkpoint: str, scan: Callable[[DataFrame], DataFrame], key: str = "file", parts: int = PARTS) -> StreamingQuery:
    """Keeps a Parquet table of scanned files up to date. Its rows lie in parts by a hash of key; a batch writes only the parts that its files belong to.

    changes has file, change and what scan() reads. A commit names the version of each part; it appears under its final name once all it names is written, so that readers see a batch as a whole or
    not at all. A batch that runs again after its commit is left out, and before it writes a version that nobody knows of yet. A new checkpoint goes on from the table as it is. Of several
    changes of a file within a batch, deletion wins. parts can't change once the table is there. Versions that neither of the last two commits names are removed.
    """

    def upsert(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        last, state, done = _last_commit(spark, table)
        if done.get(checkpoint, -1) >= n:
            return
        part = F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")
        batch = batch.withColumn("part", part).persist()
        touched = [r[0] for r in batch.select("part").distinct().collect()]  # at most parts
        gone = batch.where("change = 'deleted'").select(key).distinct()
        live = batch.where("change <> 'deleted'").dropDuplicates([key]).join(gone, key, "left_anti").drop("part")
        out = scan(live).withColumn("part", part)
        paths = [f"{table}/{state[p]}/part={p}" for p in touched if p in state]
        if paths:
            old = spark.read.schema(out.drop("part").schema).parquet(*paths).withColumn("part", part)
            out = old.join(batch.select(key).distinct(), key, "left_anti").select(*out.columns).unionByName(out)
        version = f"v-{last + 1:012d}-{uuid.uuid4().hex[:8]}"
        out.repartition("part").write.partitionBy("part").parquet(f"{table}/{version}")
        batch.unpersist()
        have = {int(x.split("=")[1]) for x in session.listed(spark, f"{table}/{version}") if x.startswith("part=")}
        state = {p: v for p, v in state.items() if p not in touched} | {p: version for p in touched if p in have}
        _commit(spark, table, last + 1, state, done | {checkpoint: n})

    return changes.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


_COMMIT = "state map<int,string>, done map<string,bigint>"


def _commits(spark: SparkSession, table: str) -> list[str]:
    return [x for x in session.listed(spark, f"{table}/_commits") if x.startswith("c-")]


def _last_commit(spark: SparkSession, table: str) -> tuple[int, dict[int, str], dict[str, int]]:
    found = _commits(spark, table)
    if not found:
        return 0, {}, {}
    row = spark.read.schema(_COMMIT).parquet(f"{table}/_commits/{found[-1]}").first()
    return int(found[-1][2:]), dict(row["state"]), dict(row["done"])


def _commit(spark: SparkSession, table: str, n: int, state: dict[int, str], done: dict[str, int]) -> None:
    half = f"{table}/_commits/_half-{uuid.uuid4().hex}"
    spark.createDataFrame([(state, done)], _COMMIT).coalesce(1).write.parquet(half)
    session.renamed(spark, half, f"{table}/_commits/c-{n:020d}")
    found = _commits(spark, table)
    for old in found[:-2]:
        session.removed(spark, f"{table}/_commits/{old}")
    named = {v for c in found[-2:] for v in (spark.read.schema(_COMMIT).parquet(f"{table}/_commits/{c}").first()["state"] or {}).values()}
    for v in session.listed(spark, table):
        if v.startswith("v-") and v not in named:
            session.removed(spark, f"{table}/{v}")


def latest_version(spark: SparkSession, table: str) -> DataFrame | None:
    """The table as the last commit has it; None before the first, or if it has no rows."""
    _, state, _ = _last_commit(spark, table)
    return spark.read.parquet(*[f"{table}/{v}/part={p}" for p, v in sorted(state.items())]) if state else None


def latest_reads(reads: DataFrame) -> DataFrame:
    """The latest read of each (file, start, end) and how often it was read; on a stream in update mode, as changed rows."""
    return reads.groupBy("file", "start", "end").agg(F.max("served_at").alias("served_at"), F.count("*").alias("n"))


def activity(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(window_start, section, n) of events(ts, section), by windows with a watermark; works on streams and tables alike."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "section").agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "section", "n")
