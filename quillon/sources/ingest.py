"""Ingestion of audio files into a flat staging folder."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import names as N
from quillon.functions import sanitize as S
from quillon.functions.paths import contained
from quillon.operators import reports as R
from quillon.operators.catalog import numbered
from quillon.operators.collisions import resolve
from quillon.operators.shared import cut
from quillon.sources.copying import copied


def ingest_plan(files: DataFrame) -> DataFrame:
    """files (path, name, ...) with idx, staged (clean, valid, its own among all, in path order) and problem (null where it may be copied)."""
    clean = files.withColumn("_clean", S.transferred(F.col("name")))
    rows = resolve(numbered(clean, R.path_order()), "_clean", "idx", "staged").drop("_clean")
    unsafe = F.when(~contained("staging", F.col("staged")), "escape")
    return rows.withColumn("problem", F.coalesce(N.filename_problem(F.col("staged")), unsafe))


def ingest(spark: SparkSession, files: DataFrame, root: str, to: str) -> DataFrame:
    """Copies the audio files below root (files: path, name, size, as the scan gives them) into to.

    idx, path, staged, bytes, sha, error, and the progress line of each file. No files at all, or a name that stays dangerous
    after cleaning, is an error before anything is copied.
    """
    plan = cut(ingest_plan(files.select("path", "name")))
    if plan.isEmpty():
        raise ValueError(f"no audio files below {root}")
    bad = plan.where("problem IS NOT NULL").first()
    if bad:
        raise ValueError(f"dangerous name ({bad['problem']}): {bad['path']} as {bad['staged']}")
    os.makedirs(to, exist_ok=True)
    done = copied(plan.select(F.concat(F.lit(f"{root}/"), "path").alias("source"), F.concat(F.lit(f"{to}/"), "staged").alias("target")), to)
    done = done.select(F.substring("target", len(to) + 2, 1 << 30).alias("staged"), "bytes", "sha", "error")
    total = plan.count()
    line = R.progress_event(F.col("idx"), F.lit(total), F.col("name"), F.lit(0))
    return plan.join(done, "staged").select("idx", "path", "staged", "bytes", "sha", "error", line.alias("progress"))
