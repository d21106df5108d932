"""JSON state documents: strict and tolerant readers, and a writer that replaces atomically on the driver."""

from __future__ import annotations

import errno
import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

JOURNAL = "version int, transactions array<struct<source_rel string, target_rel string, expected_hash string, status string, last_error string>>"


_FILE = "struct<original_path: string, normalized_name: string, status: string, original_checksum: string, usb_checksum: string, start_time: timestamp, end_time: timestamp, error_message: string>"
CHECKPOINT = f"version int, total_files bigint, last_completed_index bigint, operation_status string, session_id string, processed_files map<string,{_FILE}>"
MANIFEST = "version int, entries array<struct<name string, sha string, size bigint, path string, seq bigint>>"


class StorageFull(OSError):
    """There is no room left for a state document."""


class StateError(ValueError):
    """A state document of another version, or one that cannot be read."""


def _strict(spark: SparkSession, path: str, schema: str, version: int) -> DataFrame:
    doc = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    try:
        found = [r.version for r in doc.select("version").collect()]  # one document
    except Exception as e:
        raise StateError(f"{path} cannot be read") from e
    if found != [version]:
        raise StateError(f"{path} has version {found}, not {version}")
    return doc


def read_journal(spark: SparkSession, path: str, version: int = 1) -> DataFrame:
    """Transactions of a journal; another version or broken JSON is an error."""
    return _strict(spark, path, JOURNAL, version).select(F.explode("transactions").alias("t")).select("t.*")


def read_or_create_journal(spark: SparkSession, path: str, version: int = 1) -> DataFrame:
    """As read_journal(); a journal that is not there is begun, empty."""
    if not os.path.exists(path):
        write_json(path, {"version": version, "transactions": []})
    return read_journal(spark, path, version)


def read_checkpoint(spark: SparkSession, path: str, version: int = 1) -> tuple[DataFrame, DataFrame]:
    """The head of a checkpoint and its rows by idx; another version or broken JSON is an error."""
    doc = _strict(spark, path, CHECKPOINT, version)
    rows = doc.select(F.explode("processed_files").alias("idx", "f")).select(F.col("idx").cast("bigint").alias("idx"), "f.*")
    return doc.drop("processed_files"), rows


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a manifest; one that is not there is empty, and so is a broken one, which is put aside."""
    empty = spark.createDataFrame([], "name string, sha string, size bigint, path string, seq bigint")
    if not os.path.exists(path):
        return empty
    try:
        doc = _strict(spark, path, MANIFEST, 1)
    except StateError:
        os.replace(path, f"{path}.corrupt")
        return empty
    return doc.select(F.explode("entries").alias("e")).select("e.*")


def clear(path: str) -> None:
    """Removes a state document, if it is there."""
    if os.path.exists(path):
        os.unlink(path)


def write_json(path: str, document: dict) -> None:
    """Temporary file, sync, rename, sync of the folder: readers see the old document or the new one."""
    temporary = f"{path}.{os.getpid()}.tmp"
    try:
        with open(temporary, "w", encoding="utf-8") as f:
            json.dump(document, f, indent=2)
            f.flush()
            os.fsync(f.fileno())
        os.replace(temporary, path)
    except OSError as e:
        if os.path.exists(temporary):
            os.unlink(temporary)
        if e.errno == errno.ENOSPC:
            raise StorageFull(path) from e
        raise
    folder = os.open(os.path.dirname(os.path.abspath(path)), os.O_RDONLY)
    try:
        os.fsync(folder)
    finally:
        os.close(folder)
