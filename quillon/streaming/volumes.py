"""Exactly-once writing of planned files, a volume at a time: a ledger says which batches of which run count.

A batch is written under its run and number, then entered in the ledger with the volumes it closes and the last index of
each; readers see entered batches only. A batch that was written but not entered is written anew when it is repeated, one
that was entered is left alone, so a killed run leaves every row once. Volumes close where the numbers go on in the next one
or end; rows of a volume that is still open count as written, but a run that is taken up begins with that volume's rest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators.sync import flushes

ENTRY = "epoch long, volume long, rows long, first_idx long, last_idx long, closed boolean"


def _there(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def _enter(entries: DataFrame, path: str) -> None:
    """The ledger's file of a batch; Spark's commit makes its marker the last thing that appears."""
    entries.coalesce(1).write.mode("overwrite").parquet(path)


def commit(rows: DataFrame, out: str, run: str, epoch: int) -> bool:
    """Writes a batch of planned rows (idx, volume, ...) of a run; False if the ledger has it already."""
    spark, ledger = rows.sparkSession, f"{out}/ledger/{run}/{epoch}"
    if _there(spark, f"{ledger}/_SUCCESS"):
        return False
    at = f"{out}/rows/{run}/{epoch}"
    flushes(rows).write.mode("overwrite").parquet(at)
    written = spark.read.parquet(at).groupBy(F.col("volume").cast("long").alias("volume"))
    entries = written.agg(F.count(F.lit(1)).alias("rows"), F.min("idx").cast("long").alias("first_idx"), F.max("idx").cast("long").alias("last_idx"), F.bool_or("flush").alias("closed"))
    _enter(entries.select(F.lit(epoch).cast("long").alias("epoch"), "volume", "rows", "first_idx", "last_idx", "closed"), ledger)
    return True


def write_volumes(rows: DataFrame, out: str, run: str, checkpoint: str):
    """Starts a stream of planned rows into out, each batch committed once."""

    def write(batch: DataFrame, epoch: int) -> None:
        commit(batch, out, run, epoch)

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ledger(spark: SparkSession, out: str, run: str) -> DataFrame:
    """The entries of a run: epoch, volume, rows, first_idx, last_idx, closed."""
    return spark.read.schema(ENTRY).parquet(f"{out}/ledger/{run}/*") if _there(spark, f"{out}/ledger/{run}") else spark.createDataFrame([], ENTRY)


def committed(spark: SparkSession, out: str, run: str) -> DataFrame | None:
    """The rows of the batches that are in the ledger; None before the first."""
    epochs = [r["epoch"] for r in ledger(spark, out, run).select("epoch").distinct().collect()]  # one number a batch
    return spark.read.parquet(*[f"{out}/rows/{run}/{e}" for e in sorted(epochs)]) if epochs else None


def remaining(plan: DataFrame, out: str, run: str) -> DataFrame:
    """The rows of a plan (idx, volume, ...) that a taken up run still has to write."""
    done = committed(plan.sparkSession, out, run)
    return plan if done is None else plan.join(done.select("idx"), "idx", "left_anti")
