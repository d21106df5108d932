"""Audits of a target: topology, content against checkpoint, parity, journal, recovery."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import names as N
from quillon.operators.catalog import mismatch_runs

# Fixed values.
ROOT_ALLOWED = (
    ".legacy_quarantine", ".provisioning_checkpoint", ".provisioning_checkpoint.tmp", ".lap_provisioning.lock", ".fat32_dirty_test",
    "System Volume Information", "$RECYCLE.BIN", "LOST.DIR",
)
ROOT_MANAGED = (".legacy_quarantine", ".provisioning_checkpoint", ".provisioning_checkpoint.tmp")
EXAMPLES = 5


def hidden(path: Column) -> Column:
    """Whether a file or a folder on its way is hidden."""
    return F.exists(F.split(path, "/"), lambda s: s.startswith(".") | s.isin("System Volume Information", "$RECYCLE.BIN") | s.startswith("FOUND."))


def depth(path: Column) -> Column:
    """Folders above a file below the root."""
    return F.size(F.split(path, "/")) - 1


def allowed_root(name: Column) -> Column:
    return name.startswith("VOL_") | name.isin(*ROOT_ALLOWED)


def root_entries(files: DataFrame) -> DataFrame:
    return files.select(F.split("path", "/")[0].alias("name")).distinct()


def root_policy(files: DataFrame) -> DataFrame:
    """One row: what the root is (managed, empty or a user's), and its entries outside the allowed ones, sorted."""
    name = F.col("name")
    row = root_entries(files).agg(
        F.coalesce(F.bool_or(name.startswith("VOL_") | name.isin(*ROOT_MANAGED)), F.lit(False)).alias("managed"),
        F.sort_array(F.collect_list(F.when(~allowed_root(name), name))).alias("entries"),
    )
    return row.select(F.when(F.col("managed"), "managed").when(F.size("entries") == 0, "empty").otherwise("user_content").alias("policy"), "entries")


def topology_findings(files: DataFrame) -> DataFrame:
    """severity, code, subject: what is wrong with the layout of files (path)."""
    parts = F.split("path", "/")
    rows = files.select("path", parts[0].alias("root"), F.size(parts).alias("n"), F.get(parts, F.lit(1)).alias("sub"))
    rows = rows.where(~F.col("root").startswith(".") & ~F.col("root").startswith("System Volume"))
    vol = rows.where(F.col("root").startswith("VOL_") & (F.col("n") > 1))
    flat = vol.where("n = 2")

    def found(part: DataFrame, severity: str, code: str, subject: str) -> DataFrame:
        return part.select(F.lit(severity).alias("severity"), F.lit(code).alias("code"), F.expr(subject).alias("subject"))

    full = flat.groupBy("root").agg(F.count(F.lit(1)).alias("files")).where(F.col("files") > N.PER_VOLUME)
    return reduce(DataFrame.unionByName, [
        found(rows.where("n = 1"), "warning", "root_orphan", "root"),
        found(rows.where(~F.col("root").startswith("VOL_") & (F.col("n") > 1)).select("root").distinct(), "warning", "other_folder", "root"),
        found(vol.where("n > 2").select("root", "sub").distinct(), "error", "nesting", "concat(root, '/', sub)"),
        found(flat.where(F.octet_length("sub") > N.NAME_BYTES), "error", "long_name", "path"),
        found(flat.where(F.octet_length("sub") != F.length("sub")), "error", "not_ascii", "path"),
        found(full, "error", "overfull", "root"),
    ])


def expected_path(idx: Column, name: Column) -> Column:
    return F.concat(F.format_string("VOL_%02d/", F.floor(idx / N.PER_VOLUME) + 1), name)


def integrity(checkpoint: DataFrame, disk: DataFrame) -> DataFrame:
    """idx, path, status of completed rows: missing, no_hash, bad_hash, mismatch or ok.

    checkpoint: idx, name, status, checksum, error; disk: path, sha.
    """
    rows = checkpoint.where("status = 'completed'").withColumn("path", expected_path(F.col("idx"), F.col("name")))
    held = disk.select("path", "sha", F.lit(True).alias("_there"))
    status = (
        F.when(F.col("_there").isNull(), "missing")
        .when(F.col("checksum").isNull(), "no_hash")
        .when(~N.is_sha256(F.col("checksum")), "bad_hash")
        .when(F.col("checksum") != F.col("sha"), "mismatch")
        .otherwise("ok")
    )
    return rows.join(held, "path", "left").select("idx", "path", status.alias("status"))


def integrity_summary(found: DataFrame) -> DataFrame:
    """One row: present, errors, state (ok, incomplete or corrupted)."""
    bad, gone = F.col("status").isin("mismatch", "no_hash", "bad_hash"), F.col("status") == "missing"
    state = F.when(F.count_if(bad) > 0, "corrupted").when(F.count_if(gone) > 0, "incomplete").otherwise("ok")
    return found.agg(F.count_if(~gone).alias("present"), F.count_if(F.col("status") != "ok").alias("errors"), state.alias("state"))


def fraud_runs(found: DataFrame, least: int = 5) -> DataFrame:
    """Runs of mismatches; rows without a comparison neither count nor end a run."""
    checks = found.where("status IN ('ok', 'mismatch')").select(F.lit(0).alias("device"), "idx", (F.col("status") == "ok").alias("ok"))
    return mismatch_runs(checks, least).drop("device")


def pre_eject(files: DataFrame, checkpoint: DataFrame, disk: DataFrame) -> DataFrame:
    """Findings of the topology, and of the contents where the topology has no errors."""
    layout = topology_findings(files)
    if not layout.where("severity = 'error'").isEmpty():
        return layout
    inner = integrity(checkpoint, disk).where("status <> 'ok'").select(F.lit("error").alias("severity"), F.col("status").alias("code"), F.col("path").alias("subject"))
    return layout.unionByName(inner)


def recovery_candidates(checkpoint: DataFrame, disk: DataFrame) -> DataFrame:
    """idx of rows to be made again: not finished, without a valid hash or with an error, or corrupt on disk (by file name, the first of that name)."""
    rows = checkpoint.where("NOT (error <=> 'Skipped_DRM')")
    unfinished = (F.col("status") != "completed") | F.col("checksum").isNull() | ~N.is_sha256(F.col("checksum")) | F.col("error").isNotNull()
    corrupt = integrity(checkpoint, disk).where("status NOT IN ('ok', 'missing')").select(F.regexp_extract("path", r"([^/]*)\z", 1).alias("name")).distinct()
    first = checkpoint.groupBy("name").agg(F.min("idx").alias("idx"))
    return rows.where(unfinished).select("idx").unionByName(first.join(corrupt, "name", "left_semi").select("idx")).distinct()


def zero_byte_orphans(files: DataFrame, checkpoint: DataFrame) -> DataFrame:
    """Empty files of volumes that no row of the checkpoint expects. files: path, size."""
    there = files.where("size = 0").where(F.col("path").rlike(r"^VOL_[^/]*/[^/]+\z"))
    return there.join(checkpoint.select(expected_path(F.col("idx"), F.col("name")).alias("path")), "path", "left_anti").select("path")


def empty_roots(folders: DataFrame, files: DataFrame) -> DataFrame:
    """Root folders (name) without a file that are neither allowed nor hidden."""
    full = files.where(F.size(F.split("path", "/")) > 1).select(F.split("path", "/")[0].alias("name")).distinct()
    return folders.where(~allowed_root(F.col("name")) & ~F.col("name").startswith(".")).join(full, "name", "left_anti")


def parity_missing(source: DataFrame, manifest: DataFrame) -> DataFrame:
    """The first EXAMPLES source paths whose contents the manifest does not list."""
    return source.join(manifest.select("sha").distinct(), "sha", "left_anti").select("path").orderBy("path").limit(EXAMPLES)


def parity_drift(manifest: DataFrame, disk: DataFrame) -> DataFrame:
    """The first EXAMPLES manifest paths that are missing on disk or hold something else."""
    rows = manifest.select("path", F.col("sha").alias("_want")).join(disk.select("path", "sha"), "path", "left")
    status = F.when(F.col("sha").isNull(), "missing").when(F.col("sha") != F.col("_want"), "hash_mismatch")
    return rows.select("path", status.alias("status")).where("status IS NOT NULL").orderBy("path").limit(EXAMPLES)


def backup_valid(recorded: DataFrame, disk: DataFrame) -> DataFrame:
    """One row: whether every recorded file is on disk with its hash; nothing recorded is valid."""
    rows = recorded.select("path", F.col("sha").alias("_want")).join(disk.select("path", "sha"), "path", "left")
    return rows.agg(F.coalesce(F.bool_and(F.coalesce(F.col("sha") == F.col("_want"), F.lit(False))), F.lit(True)).alias("valid"), F.count(F.lit(1)).alias("files"))


def identical(source: DataFrame, target: DataFrame) -> DataFrame:
    """source (name, size, sha) with same: whether target holds the same name with the same bytes; sizes are compared first."""
    there = target.select("name", F.col("size").alias("_size"), F.col("sha").alias("_sha")).dropDuplicates(["name"])
    same = F.coalesce((F.col("size") == F.col("_size")) & (F.col("sha") == F.col("_sha")), F.lit(False))
    return source.join(there, "name", "left").withColumn("same", same).drop("_size", "_sha")


def resumable(plan: DataFrame, done: DataFrame, disk: DataFrame) -> DataFrame:
    """plan (idx, path) with skip: completed rows (done: idx, sha) whose file still has its hash."""
    kept = done.select("idx", F.col("sha").alias("_want"))
    rows = plan.join(kept, "idx", "left").join(disk.select("path", "sha"), "path", "left")
    return rows.select("idx", "path", F.coalesce(F.col("sha") == F.col("_want"), F.lit(False)).alias("skip"))
