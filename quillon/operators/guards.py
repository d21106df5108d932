"""Guards before a run: paths that are the same or lie in one another, and the space that a plan needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import names as N
from quillon.functions.paths import resolved
from quillon.functions.sanitize import as_mp3
from quillon.operators.verify import expected_path


def canonical(path: Column) -> Column:
    """An absolute path without empty components, `.` and `..`; links are not followed. Null stays null."""
    return F.concat(F.lit("/"), F.array_join(resolved(path), "/"))


def _within(inner: Column, outer: Column) -> Column:
    return (outer == "/") | inner.startswith(F.concat(outer, F.lit("/")))


def path_problem(target: Column, source: Column, staging: Column) -> Column:
    """Why a run is refused, or null: `same`, `source_inside` and `staging_inside` the target. Null paths are no problem."""
    target, source, staging = canonical(target), canonical(source), canonical(staging)
    return F.when(target == source, "same").when(_within(source, target), "source_inside").when((staging == target) | _within(staging, target), "staging_inside")


def containments(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """inner, outer, levels: which paths (path) lie in which others (path), 0 levels down if they are the same.

    A path has as many holders as components, so each looks its own up by equality: no path meets another pair by pair. Equal
    rows count once; nulls are in nothing.
    """
    rows = inner.select(F.col("path").alias("inner"), resolved(F.col("path")).alias("_parts")).where("inner IS NOT NULL").distinct()
    depth = F.size("_parts")
    rows = rows.select("inner", depth.alias("_depth"), "_parts", F.explode(F.sequence(F.lit(0), depth)).alias("_n"))
    rows = rows.select("inner", (F.col("_depth") - F.col("_n")).alias("levels"), F.concat(F.lit("/"), F.array_join(F.slice("_parts", F.lit(1), F.col("_n")), "/")).alias("_holder"))
    holders = outer.select(F.col("path").alias("outer"), canonical(F.col("path")).alias("_holder")).where("outer IS NOT NULL").distinct()
    return rows.join(holders, "_holder").select("inner", "outer", "levels")


def required_bytes(plan: DataFrame) -> DataFrame:
    """kind, files, bytes of a plan (kind, source_size, target_size): a file needs the size of its source, else of what lies on the target."""
    return plan.groupBy("kind").agg(F.count(F.lit(1)).alias("files"), F.sum(F.coalesce("source_size", "target_size", F.lit(0))).alias("bytes"))


def space_problem(required: Column, available: Column) -> Column:
    """How many bytes are missing, or null where there is room."""
    return F.when(available < required, required - available)


def planned_volumes(plan: DataFrame, per: int) -> DataFrame:
    """One row: files, volumes that a plan (volume) writes to, and fewest that would do."""
    return plan.agg(F.count(F.lit(1)).alias("files"), F.count_distinct("volume").alias("volumes"), F.ceil(F.count(F.lit(1)) / per).alias("fewest"))


def retained(untracked: DataFrame, there: DataFrame) -> DataFrame:
    """The untracked paths (path) that still exist."""
    return untracked.join(there.select("path").distinct(), "path", "left_semi")


def recovery_plan(candidates: DataFrame, checkpoint: DataFrame, sources: DataFrame) -> DataFrame:
    """idx, path, name, target, old, action: what is done for each index (idx) that must be recovered.

    A row of the checkpoint (idx, name, path) whose source (sources: path) is there is copied anew, as .mp3 whatever it was
    called; `old` is where it lay under its former name. Without a source it is `missing`; an index that the checkpoint does not
    know is `unknown`.
    """
    rows = candidates.select("idx").distinct().join(checkpoint.select("idx", F.col("name").alias("_name"), "path"), "idx", "left")
    there = sources.select("path", F.lit(True).alias("_there")).distinct()
    rows = rows.join(there, "path", "left").withColumn("name", F.when(F.lower("_name").endswith(".mp3"), F.col("_name")).otherwise(as_mp3(F.col("_name"))))
    action = F.when(F.col("_name").isNull(), "unknown").when(F.col("_there").isNull(), "missing").otherwise("copy")
    old = F.when(F.col("name") != F.col("_name"), expected_path(F.col("idx"), F.col("_name")))
    return rows.select("idx", "path", "name", expected_path(F.col("idx"), F.col("name")).alias("target"), old.alias("old"), action.alias("action"))


def device_layout(root: str, key: Column) -> Column:
    """Where a device's state lies below root: backup, checkpoint_dir, checkpoint, manifest, journal. The same key gives the same places."""
    slug = N.slug_with_hash(key)
    at = lambda *parts: F.concat(F.lit(f"{root}/"), *[F.lit(p) if isinstance(p, str) else p for p in parts])
    places = {
        "backup": at("backups/usb_backup_", slug), "checkpoint_dir": at("checkpoints/", slug), "checkpoint": at("checkpoints/", slug, "/.provisioning_checkpoint"),
        "manifest": at("manifests/manifest_", slug, ".json"), "journal": at("journals/journal_", slug, ".json"),
    }
    return F.struct(*[v.alias(k) for k, v in places.items()])
