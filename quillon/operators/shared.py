"""Lineage cuts: tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """This session's folder in spark.checkpoint.dir. Only a local session may do without the setting; its folder goes when Python ends."""
    base, session = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.applicationId
    if base:
        return f"{base.rstrip('/')}/quillon-{session}"
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir is not set; a cluster needs a folder that all executors share")
    if session not in _own:
        _own[session] = tempfile.mkdtemp(prefix="quillon-")
        atexit.register(shutil.rmtree, _own[session], ignore_errors=True)
    return _own[session]


def cut(df: DataFrame) -> DataFrame:
    """The rows as a table. Lost executors lose nothing of it, and a plan that reads it again and again has the size of its files:
    a checkpoint hands on its plan's estimate, which joins multiply until the driver does nothing else. The shuffle files that
    made the table go with the job."""
    spark, path = df.sparkSession, f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._quillon_table = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def drop(*frames: DataFrame) -> None:
    """Deletes the tables of frames that `cut` returned and that nothing reads any more."""
    for df in frames:
        _delete(df.sparkSession, df._quillon_table)


def clear(spark: SparkSession) -> None:
    """Deletes all tables that this session's operators have cut; no frame that was made from them can be read any more."""
    _delete(spark, shared_folder(spark))
