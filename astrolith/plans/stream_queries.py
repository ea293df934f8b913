"""Queries that run as streams over whole tables, each read to its end."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import incremental
from ..session import shared_dir
from ..streaming import refresh
from .queries import query


def _folder(df: DataFrame, name: str) -> str:
    return f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"


def _stream_of(df: DataFrame, name: str) -> DataFrame:
    """A stream of the rows of a table, by way of files in the shared folder."""
    path = _folder(df, name)
    df.write.parquet(path)
    return refresh.read_changes(df.sparkSession, path, df.schema)


def _collected(stream: DataFrame, mode: str, name: str) -> DataFrame:
    """What a stream puts out until its source ends, one folder v=n a batch. A batch that runs again writes its own folder again."""
    path = _folder(stream, name)

    def save(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/v={n}")

    stream.writeStream.outputMode(mode).foreachBatch(save).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.parquet(f"{path}/out")


@query("SELECT date_trunc('hour', served_at) AS window_start, file AS section, count(*) AS n FROM v_read_log GROUP BY 1, 2")
def stream_activity(read_log):
    events = _stream_of(read_log.select(F.col("served_at").alias("ts"), F.col("file").alias("section")), "activity")
    out = _collected(refresh.activity(events), "complete", "activity")
    last = out.agg(F.max("v").alias("v"))
    return out.join(F.broadcast(last), "v").select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "section", "n")


@query('SELECT file, start, "end", max(served_at) AS served_at, count(*) AS n FROM v_read_log GROUP BY file, start, "end"')
def stream_latest_reads(read_log):
    out = _collected(refresh.latest_reads(_stream_of(read_log.select("file", "start", "end", "served_at"), "reads")), "update", "reads")
    return out.groupBy("file", "start", "end").agg(F.max("served_at").alias("served_at"), F.max("n").alias("n"))


@query("SELECT n.file, n.mtime FROM v_snap_new AS n LEFT JOIN v_snap_old AS o ON n.file = o.file WHERE o.mtime IS DISTINCT FROM n.mtime")
def stream_refresh(snap_old, snap_new):
    changes = incremental.diff(snap_old, snap_new).where("change <> 'same'").join(snap_new, "file", "left")
    path = _folder(changes, "refresh")
    refresh.refresh_table(_stream_of(changes, "changes"), f"{path}/table", f"{path}/state", lambda df: df.select("file", "mtime")).awaitTermination()
    return refresh.latest_version(changes.sparkSession, f"{path}/table")
