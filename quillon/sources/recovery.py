"""Granular recovery: only what is missing, broken or unfinished is copied again, and the checkpoint follows."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators import state as T
from quillon.operators.guards import recovery_plan
from quillon.operators.shared import cut
from quillon.sources.copying import _tried, copied


def _removed(path: str | None) -> None:
    if path and os.path.exists(path):
        os.unlink(path)


def recovered(checkpoint: DataFrame, candidates: DataFrame, root: str, sources: DataFrame, busy: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Carries out the plan for candidates (idx) of a checkpoint (idx, name, path) on the target at root; sources has the paths that are
    there, busy the indices (idx) whose media need more than a copy, which are left to a transcoder and fail.

    Returns what was done (idx, name, action, sha, error) and the rows' new state (idx, name, status, checksum, error): renamed,
    then completed with the hash of what was copied, or failed. Doing it again copies the same bytes to the same places.
    """
    spark = checkpoint.sparkSession
    plan = recovery_plan(candidates, checkpoint, sources)
    busy = spark.createDataFrame([], "idx long") if busy is None else busy.select("idx").distinct()
    plan = cut(plan.join(busy.withColumn("_busy", F.lit(True)), "idx", "left"))
    at = lambda c: F.concat(F.lit(f"{root}/"), c)
    todo = plan.where("action = 'copy' AND _busy IS NULL").select("idx", "path", at(F.col("target")).alias("target"), at(F.col("old")).alias("old"))
    done = copied(todo.select(F.col("path").alias("source"), "target"), root)
    done = cut(_tried(todo.join(done.select("target", "sha", "error"), "target").select("idx", "old", "sha", "error"), ["old"], _removed))
    rows = plan.join(done.select("idx", "sha", F.col("error").alias("_failed")), "idx", "left")
    why = F.when(F.col("action") == "unknown", "is not in the checkpoint").when(F.col("action") == "missing", F.concat(F.lit("source is gone: "), "path")).when(F.col("_busy"), "needs transcoding")
    rows = cut(rows.select("idx", "path", "name", "action", "sha", F.coalesce(why, "_failed").alias("error")))
    known = rows.where("action <> 'unknown'")
    event = lambda seq, kind, of: of.select("idx", F.lit(seq).cast("long").alias("seq"), F.lit(kind).alias("kind"), "name", F.col("sha").alias("checksum"), "error")
    events = event(1, "start", known).unionByName(event(2, "completed", known.where("error IS NULL"))).unionByName(event(2, "failed", known.where("error IS NOT NULL")))
    return rows.drop("path"), T.checkpoint_state(events).drop("rejected")
