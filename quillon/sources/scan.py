"""A recursive file scan, level by level: the folders of a level are dealt over tasks, each lists its own, and what they find are
the next level's folders. So no task has more than a share of a level's folders, however the tree is shaped, and none holds
more than one folder's list; a level is kept as a table, so a lost executor costs its own lists only. The root's own level is
a data source.

Unlike Spark's own file sources it lists names that begin with an underscore and files without bytes. Hidden entries are
left out with all below them, unreadable ones silently; a root that is no folder is an error. The root must be visible to
all executors under the same path.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quillon.functions import names as N
from quillon.operators.shared import cut

FOLDERS = 1000  # that one task lists
SCHEMA = "path string, name string, extension string, size bigint, depth int, folder boolean"


def _hidden(name: str) -> bool:
    return name.startswith((".", "FOUND.")) or name in ("System Volume Information", "$RECYCLE.BIN")


def _listed(root: str, folder: str, hidden: bool) -> Iterator[tuple]:
    """The entries of a folder below root, by name; an unreadable folder has none."""
    try:
        found = sorted(os.scandir(os.path.join(root, folder)), key=lambda e: e.name)
    except OSError:
        return
    for entry in found:
        if not hidden and _hidden(entry.name):
            continue
        try:
            is_folder, size = entry.is_dir(follow_symlinks=False), entry.stat(follow_symlinks=False).st_size
        except OSError:
            continue
        path = f"{folder}/{entry.name}" if folder else entry.name
        stem, dot, ext = entry.name.rpartition(".")
        yield path, entry.name, ext.lower() if dot and stem else None, 0 if is_folder else size, path.count("/"), is_folder


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"]
        self.all = options.get("hidden", "false") == "true"

    def partitions(self):
        if not os.path.isdir(self.root):
            raise ValueError(f"{self.root} is no folder")
        return [InputPartition(0)]

    def read(self, partition: InputPartition):
        yield from _listed(self.root, "", self.all)


class CatalogSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "quillon_scan"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def entries(spark: SparkSession, root: str, depth: int | None = None, hidden: bool = False) -> DataFrame:
    """Every file and folder below root, at most `depth` folders down."""
    spark.dataSource.register(CatalogSource)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("path", pa.string()), ("name", pa.string()), ("extension", pa.string()), ("size", pa.int64()), ("depth", pa.int32()), ("folder", pa.bool_())])
        for batch in batches:
            for folder in batch.column("path").to_pylist():
                rows = list(_listed(root, folder, hidden))
                for at in range(0, len(rows), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[at : at + 10_000]), kinds)], schema=kinds)

    level = cut(spark.read.format("quillon_scan").option("hidden", str(hidden).lower()).load(root))
    levels, down = [level], 0
    while depth is None or down < depth:
        folders = level.where("folder").select("path")
        n = folders.count()
        if not n:
            break
        parts = min(n, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // FOLDERS)))
        level, down = cut(folders.repartition(parts, "path").mapInArrow(run, SCHEMA)), down + 1
        levels.append(level)
    return reduce(DataFrame.unionByName, levels)


def audio_files(spark: SparkSession, root: str, depth: int | None = None) -> DataFrame:
    """path, name, extension, size, depth of the audio files below root; order them by reports.path_order()."""
    return entries(spark, root, depth).where(~F.col("folder") & F.col("extension").isin(*N.AUDIO_EXTENSIONS)).drop("folder")


def scan_report(spark: SparkSession, root: str, depth: int | None = None) -> DataFrame:
    """One row: files, bytes, average_mb of the audio files; max_depth and folders (the root too) of all that was visited."""
    rows = entries(spark, root, depth)
    audio = ~F.col("folder") & F.coalesce(F.col("extension").isin(*N.AUDIO_EXTENSIONS), F.lit(False))
    return rows.agg(
        F.count_if(audio).alias("files"), F.coalesce(F.sum(F.when(audio, F.col("size"))), F.lit(0)).alias("bytes"),
        F.coalesce(F.avg(F.when(audio, F.col("size"))) / float(1 << 20), F.lit(0.0)).alias("average_mb"),
        F.coalesce(F.max(F.col("depth") + 1), F.lit(0)).alias("max_depth"), (F.count_if("folder") + 1).alias("folders"),
    )


def volume_files(spark: SparkSession, root: str) -> DataFrame:
    """path, name, size, idx, sha of the files straight in VOL_ folders, contents hashed where they lie."""

    def hashed(batches):
        import hashlib

        for batch in batches:
            sums = []
            for path in batch.column("path").to_pylist():
                with open(os.path.join(root, path), "rb") as f:
                    sums.append(hashlib.file_digest(f, "sha256").hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sums, pa.string())], [*batch.schema.names, "sha"])

    rows = entries(spark, root, 1).where(~F.col("folder") & F.col("path").rlike(r"^VOL_[^/]*/[^/]+\z")).select("path", "name", "size")
    return rows.mapInArrow(hashed, "path string, name string, size bigint, sha string").withColumn("idx", N.lenient_index(F.col("name")))
