"""Plans and reports over catalogs: totals, in-place plan, progress, events, errors, traceability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import names as N
from quillon.functions import sanitize as S
from quillon.functions.paths import contained
from quillon.operators.catalog import numbered

# Fixed values.
ERROR_CODES = {
    "UnsupportedJsonMode": "UNSUPPORTED_JSON_MODE",
    "MissingUsbMountForResume": "MISSING_USB_MOUNT",
    "ConcurrencyError": "CONCURRENCY_ERROR",
    "ReadOnlyFilesystem": "FILESYSTEM_READ_ONLY",
    "StorageFull": "ENOSPC_ERROR",
    "HardwareFraudDetected": "HARDWARE_FRAUD_DETECTED",
    "DrmProtected": "DRM_PROTECTED",
    "ProvisioningFailed": "PROVISIONING_FAILED",
    "InvalidConfig": "INVALID_CONFIG",
}

# What the user is told to do about each code.
REMEDIES = {
    "UNSUPPORTED_JSON_MODE": "Use --json solo con --usb/--source o con --resume.",
    "MISSING_USB_MOUNT": "Agregue --usb <PATH> cuando utilice --resume.",
    "CONCURRENCY_ERROR": "Cierre la otra instancia activa o espere a que termine.",
    "FILESYSTEM_READ_ONLY": "Repare la USB con 'sudo fsck.fat -a <dispositivo>' y reintente.",
    "ENOSPC_ERROR": "Libere espacio en el disco local del host.",
    "HARDWARE_FRAUD_DETECTED": "Deseche esta memoria USB (NAND Spoofing detectado).",
    "DRM_PROTECTED": "Elimine los archivos con DRM de la carpeta de origen.",
    "PROVISIONING_FAILED": "Revise el mensaje de error y reintente con --resume.",
    "INVALID_CONFIG": "Corrija los paths de entrada: el origen y el destino no pueden ser iguales ni estar anidados.",
}


def remedy(kind: Column) -> Column:
    """What is to be done about an error."""
    table = F.create_map(*[F.lit(x) for pair in REMEDIES.items() for x in pair])
    return F.element_at(table, error_code(kind))


def first_known(chain: Column) -> Column:
    """The first kind in a chain of causes that has a code of its own, or null."""
    return F.get(F.filter(chain, lambda k: k.isin(*ERROR_CODES)), F.lit(0))


def error_code(kind: Column) -> Column:
    """The code of an error; any other error is a failed provisioning."""
    table = F.create_map(*[F.lit(x) for pair in ERROR_CODES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, kind), F.lit(ERROR_CODES["ProvisioningFailed"]))


def path_order(path: str = "path") -> list[Column]:
    """Order by components, in which a folder's contents stand together."""
    return [F.split(path, "/"), F.col(path)]


def in_place_plan(files: DataFrame) -> DataFrame:
    """idx (from 0), path, name, volume, destination of files (path) in path order."""
    rows = numbered(files.select("path"), path_order(), 1)
    name = S.prefixed(S.sanitized(S.base_name(F.col("path"))), F.col("idx"))
    volume = F.format_string("VOL_%02d", N.planned_volume(F.col("idx")).cast("long"))
    rows = rows.select((F.col("idx") - 1).alias("idx"), "path", name.alias("name"), volume.alias("volume"))
    return rows.withColumn("destination", F.concat_ws("/", "volume", "name")).where(contained("", F.col("destination")))


def plan_summary(tagged: DataFrame, untracked: DataFrame) -> DataFrame:
    """action, files, bytes of what a plan does: skip, move, provision, quarantine. tagged: action, size; untracked: size."""
    action = F.when(F.col("action") == "skip", "skip").when(F.col("action") == "displaced", "move").otherwise("provision")
    rows = tagged.select(action.alias("action"), "size").unionByName(untracked.select(F.lit("quarantine").alias("action"), "size"))
    return rows.groupBy("action").agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def folder_sizes(files: DataFrame) -> DataFrame:
    """folder, bytes, files of every folder with all below it. files: path, size."""
    parts = F.split("path", "/")
    rows = files.select("size", F.explode(F.sequence(F.lit(0), F.size(parts) - 1)).alias("_n"), parts.alias("_p"))
    return rows.groupBy(F.array_join(F.slice("_p", F.lit(1), F.col("_n")), "/").alias("folder")).agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("files"))


def eta_seconds(elapsed: Column, done: Column, total: Column) -> Column:
    """Whole seconds a row so far, times the rows that remain; 0 before the first row."""
    return F.when(done > 0, F.try_divide(elapsed - elapsed % F.nullif(done, F.lit(0)), done).cast("bigint") * F.greatest(total - done, F.lit(0))).otherwise(0)


def progress_event(done: Column, total: Column, current: Column, eta: Column) -> Column:
    payload = F.struct(
        done.alias("files_processed"), total.alias("total_files"), (done * 100.0 / total).alias("percentage"), current.alias("current_file"), eta.alias("eta_seconds")
    )
    return F.to_json(F.struct(F.lit("PROGRESS").alias("event"), payload.alias("payload")))


def session_id(kind: str, *paths: Column) -> Column:
    return F.concat(F.lit(f"{kind}_"), F.substring(F.sha2(F.concat_ws("|", *paths), 256), 1, 12))


def traceability(requirements: DataFrame, anchors: DataFrame, exempt: DataFrame) -> DataFrame:
    """id, issue, severity: requirements (id, status) without an anchor (id) in the code, and anchors of unknown requirements."""
    live = requirements.where("status <> 'DEPRECATED'").join(exempt.select("id"), "id", "left_anti")
    severity = F.when(F.col("status") == "PROPOSED", "warning").otherwise("error")
    bare = live.join(anchors.select("id"), "id", "left_anti").select("id", F.lit("no_anchor").alias("issue"), severity.alias("severity"))
    unknown = anchors.select("id").distinct().join(requirements.select("id"), "id", "left_anti")
    return bare.unionByName(unknown.select("id", F.lit("no_requirement").alias("issue"), F.lit("error").alias("severity")))


def requirement_rows(lines: DataFrame) -> DataFrame:
    """id, status from lines (value) of a table of requirements."""
    row = r"^\| (R-[0-9]{2}-[0-9]{3}) \| (PROPOSED|IMPLEMENTED|VERIFIED|DEPRECATED) \|"
    return lines.where(F.col("value").rlike(row)).select(F.regexp_extract("value", row, 1).alias("id"), F.regexp_extract("value", row, 2).alias("status"))


def anchors_in(lines: DataFrame) -> DataFrame:
    """id of every anchor in lines (value) of source text."""
    return lines.select(F.explode(F.regexp_extract_all("value", F.lit(r"\[(R-[0-9]{2}-[0-9]{3})\]"), F.lit(1))).alias("id"))


def wear(files: Column, syncs: Column, limit: float = 0.1) -> Column:
    """Whether there are at most `limit` syncs a file; null without files."""
    return F.try_divide(syncs.cast("double"), files) <= limit
