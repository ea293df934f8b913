"""Session helpers: the package on workers, and lineage cut in the folder that executors share."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


#: Rows in an Arrow batch, and Spark's own number: with texts of some kilobytes the latter makes batches of tens of MB, held by the JVM and by a worker, for each task.
BATCH_ROWS, SPARK_BATCH_ROWS = 2048, 10000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship(spark: SparkSession) -> None:
    """Lets Python workers of a local master import this package. On a cluster it is installed or comes with --py-files.

    Also sets Arrow batches to BATCH_ROWS, unless the session has a number of its own.
    """
    if int(spark.conf.get(_BATCH)) == SPARK_BATCH_ROWS:
        spark.conf.set(_BATCH, BATCH_ROWS)
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "").split(":")
    if spark.sparkContext.master.startswith("local") and ROOT not in have:
        env["PYTHONPATH"] = ":".join([ROOT, *filter(None, have)])


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; unset, one in the warehouse, or a temporary one under a local master."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if spark.sparkContext.master.startswith("local["):
            named = "file://" + tempfile.mkdtemp(prefix="astrolith-")
        else:
            named = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_astrolith_checkpoints"
        spark.conf.set("spark.checkpoint.dir", named)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and with its lineage cut by a reliable checkpoint."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet into the application's part of the shared folder and read again; clean() removes it."""
    path = f"{shared_dir(df.sparkSession)}/{_own(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _filesystem(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def listed(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if there is no such folder."""
    fs, p = _filesystem(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []


def removed(spark: SparkSession, path: str) -> None:
    """Removes a file or folder, if it is there."""
    fs, p = _filesystem(spark, path)
    fs.delete(p, True)


def renamed(spark: SparkSession, old: str, new: str) -> None:
    """Moves a file or folder to a name that isn't in use, in one step where the file system has one."""
    fs, p = _filesystem(spark, old)
    if not fs.rename(p, spark.sparkContext._jvm.org.apache.hadoop.fs.Path(new)):
        raise FileExistsError(new)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small file whole: under another name first, which then takes the place of the old one."""
    fs, p = _filesystem(spark, path)
    half = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.part")
    out = fs.create(half)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()
    if fs.exists(p):
        fs.delete(p, False)
    if not fs.rename(half, p):
        raise OSError(f"can't write {path}")


def clean(spark: SparkSession) -> None:
    """Removes what this application has written into the shared folder. Frames that read from it are of no use afterwards."""
    removed(spark, f"{shared_dir(spark)}/{_own(spark)}")


def _own(spark: SparkSession) -> str:
    return f"astrolith-{spark.sparkContext.applicationId}"
