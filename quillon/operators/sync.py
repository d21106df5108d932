"""The sync difference in full, and what is planned from it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions import names as N
from quillon.operators.catalog import numbered, sync_diff


def complying(target: DataFrame) -> DataFrame:
    """target (path, folder, name, ...) with volume, idx and complies."""
    rows = target.withColumn("volume", N.volume_index(F.col("folder"))).withColumn("idx", N.lenient_index(F.col("name")))
    return rows.withColumn("complies", F.col("volume").isNotNull() & F.col("idx").isNotNull() & N.safe_name(F.col("name")))


def untracked(target: DataFrame, moved: DataFrame, known: DataFrame) -> DataFrame:
    """Target paths nobody asks for: strays that are not planned to move (moved: path), and complying files that the checkpoint
    does not name (known: name), if it names any at all."""
    rows = complying(target)
    strays = rows.where("NOT complies").join(moved.select("path").distinct(), "path", "left_anti")
    names = known.select("name").where("name IS NOT NULL").distinct()
    if names.isEmpty():
        return strays.select("path")
    lost = rows.where("complies").join(names, "name", "left_anti")
    return strays.select("path").unionByName(lost.select("path"))


def volume_counts(target: DataFrame) -> DataFrame:
    return complying(target).where("complies").groupBy("volume").agg(F.count(F.lit(1)).alias("files"))


def summary(source: DataFrame, target: DataFrame, known: DataFrame) -> DataFrame:
    """One row: skipped, to_process, displaced, untracked, max_index, volumes, next_index."""
    tagged = sync_diff(source, target).where("action <> 'untracked'")
    moved = tagged.where("action = 'displaced'").select(F.col("displaced_from").alias("path"))
    return summed(tagged, target, untracked(target, moved, known), known)


def summed(tagged: DataFrame, target: DataFrame, lost: DataFrame, known: DataFrame) -> DataFrame:
    """The counts of `summary` from tagged source rows (path, action) and untracked target rows."""
    counts = tagged.agg(
        F.count_if(F.col("action") == "skip").alias("skipped"), F.count_if(F.col("action") != "skip").alias("to_process"), F.count_if(F.col("action") == "displaced").alias("displaced")
    )
    held = complying(target).where("complies").agg(F.coalesce(F.max("idx"), F.lit(0)).alias("max_index"), F.count_distinct("volume").alias("volumes"))
    lost = lost.agg(F.count(F.lit(1)).alias("untracked"))
    named = known.agg(F.coalesce(F.max(N.lenient_index(F.col("name"))), F.lit(0)).alias("_named"))
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (counts, held, lost, named))  # one row each
    whole = whole.agg(*[F.max(c).alias(c) for c in whole.columns])
    return whole.withColumn("next_index", F.greatest("_named", "max_index") + 1).drop("_named")


def prefix_widths(names: DataFrame) -> DataFrame:
    """One row: the next free strict index, and whether three and four digits are mixed. names: name."""
    digits = N.strict_digits(F.col("name"))
    return names.agg(
        F.greatest(F.coalesce(F.max(digits.try_cast("bigint")), F.lit(0)) + 1, F.lit(1)).alias("next_index"),
        (F.coalesce(F.bool_or(F.length(digits) == 3), F.lit(False)) & F.coalesce(F.bool_or(F.length(digits) == 4), F.lit(False))).alias("mixed"),
    )


def incremental_plan(files: DataFrame, counts: DataFrame, order: list, start: int = 1) -> DataFrame:
    """files with idx and volume (number): on from the last existing volume (counts: volume, files), earlier gaps stay."""
    last = counts.agg(F.max(F.struct("volume", "files")).alias("l")).first()["l"]  # one row
    volume, filled = (last["volume"], last["files"]) if last else (1, 0)
    if filled >= N.PER_VOLUME:
        volume, filled = volume + 1, 0
    rows = numbered(files, order, start)
    return rows.withColumn("volume", N.planned_volume(F.col("idx") - (start - 1), volume, filled).cast("long"))


def displaced_winners(tagged: DataFrame) -> DataFrame:
    """tagged (path, action, displaced_from) with moves: of equal sources one takes the displaced file, the first by path components."""
    key = F.struct(F.split("path", "/"), "path")
    first = tagged.where("action = 'displaced'").groupBy("displaced_from").agg(F.min_by("path", key).alias("_first"))
    return tagged.join(first, "displaced_from", "left").withColumn("moves", F.coalesce(F.col("path") == F.col("_first"), F.lit(False))).drop("_first")


def flushes(rows: DataFrame) -> DataFrame:
    """rows (idx, volume): whether state is kept after the row: at the end of a volume's run of numbers, and at the last row."""
    following = rows.select((F.col("idx") - 1).alias("idx"), F.col("volume").alias("_next"))
    return rows.join(following, "idx", "left").withColumn("flush", F.col("_next").isNull() | (F.col("_next") != F.col("volume"))).drop("_next")
