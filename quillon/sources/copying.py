"""Copies and quarantine, carried out by the executors from a plan; rows that fail are reported, none ends the run.

Copying is a data source's write. Each attempt of a task copies into a folder of its own, beside the targets, and lists what
it did; an attempt that fails takes its folder with it. Spark lets one attempt of each task commit, and the job's commit
names these; what other attempts left, speculative ones too, goes. Only then a second job puts the committed files in their
places, by renaming, so a target appears whole or not at all, and a repeated task finds what is done. If the job fails, its
abort removes everything. The folders must be visible to driver and executors under the same paths.
"""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from quillon.operators.collisions import backed_up, beside
from quillon.operators.shared import cut
from quillon.sources.scan import entries

RESULT = "source string, target string, bytes long, sha string, error string"


def _copied(source: str, part: str) -> tuple[int, str]:
    """Copies in one pass, synced before it counts."""
    digest, size = hashlib.sha256(), 0
    try:
        with open(source, "rb") as a, open(part, "wb") as b:
            while block := a.read(1 << 16):
                digest.update(block)
                b.write(block)
                size += len(block)
            b.flush()
            os.fsync(b.fileno())
    except OSError:
        if os.path.exists(part):
            os.unlink(part)
        raise
    return size, digest.hexdigest()


@dataclass
class _Attempt(WriterCommitMessage):
    folder: str


class _CopyWriter(DataSourceWriter):
    def __init__(self, options: dict):
        self.stage = options["path"]

    def write(self, rows: Iterator) -> _Attempt:
        task = TaskContext.get()
        folder = f"{self.stage}/{task.partitionId()}-{task.taskAttemptId()}"
        os.makedirs(folder, exist_ok=True)
        try:
            with open(f"{folder}/list", "w") as out:
                for i, row in enumerate(rows):
                    done = {"source": row["source"], "target": row["target"], "part": None, "bytes": None, "sha": None, "error": None}
                    try:
                        done["bytes"], done["sha"] = _copied(row["source"], f"{folder}/{i}")
                        done["part"] = f"{folder}/{i}"
                    except OSError as e:
                        done["error"] = str(e)
                    out.write(json.dumps(done) + "\n")
        except BaseException:
            shutil.rmtree(folder, ignore_errors=True)
            raise
        return _Attempt(folder)

    def commit(self, messages: list) -> None:
        kept = {m.folder for m in messages if m}
        os.makedirs(self.stage, exist_ok=True)
        for name in os.listdir(self.stage):
            if f"{self.stage}/{name}" not in kept:
                shutil.rmtree(f"{self.stage}/{name}", ignore_errors=True)
        with open(f"{self.stage}/committed.part", "w") as out:
            json.dump(sorted(kept), out)
        os.replace(f"{self.stage}/committed.part", f"{self.stage}/committed")

    def abort(self, messages: list) -> None:
        shutil.rmtree(self.stage, ignore_errors=True)


class CopySink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "quillon_copy"

    def schema(self) -> str:
        return "source string, target string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _CopyWriter(self.options)


def _tried(rows: DataFrame, names: list[str], work: Callable[..., None]) -> DataFrame:
    """rows with error: what work(the named columns) raised; rows that have an error already are left alone."""
    at = rows.columns.index("error")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            errors = []
            for error, *values in zip(batch.column("error").to_pylist(), *[batch.column(n).to_pylist() for n in names]):
                try:
                    if error is None:
                        work(*values)
                    errors.append(error)
                except OSError as e:
                    errors.append(str(e))
            yield batch.set_column(at, "error", pa.array(errors, pa.string()))

    return rows.mapInArrow(run, kinds)


def _put(part: str, target: str) -> None:
    if not os.path.exists(part) and os.path.exists(target):
        return  # an earlier try of this task did it
    os.makedirs(os.path.dirname(target) or ".", exist_ok=True)
    os.replace(part, target)


def copied(plan: DataFrame, stage: str | None = None) -> DataFrame:
    """Carries out plan (source, target): source, target, bytes, sha, error. stage: a folder on the targets' file system."""
    spark = plan.sparkSession
    if stage is None:
        first = plan.select("target").first()
        if first is None:
            return spark.createDataFrame([], RESULT)
        stage = os.path.dirname(first["target"]) or "."
        while not os.path.isdir(stage):
            stage = os.path.dirname(stage) or "."
    stage = f"{stage}/.quillon-{uuid.uuid4().hex}"
    spark.dataSource.register(CopySink)
    plan.select("source", "target").write.format("quillon_copy").mode("append").save(stage)
    with open(f"{stage}/committed") as f:
        folders = json.load(f)  # one a task
    listed = spark.createDataFrame([(f,) for f in folders], "folder string").repartition(max(len(folders), 1), "folder")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("source", pa.string()), ("target", pa.string()), ("part", pa.string()), ("bytes", pa.int64()), ("sha", pa.string()), ("error", pa.string())])
        for batch in batches:
            for folder in batch.column("folder").to_pylist():
                with open(f"{folder}/list") as lines:
                    yield pa.RecordBatch.from_pylist([json.loads(line) for line in lines], kinds)

    rows = listed.mapInArrow(read, "source string, target string, part string, bytes long, sha string, error string")
    done = cut(_tried(rows, ["part", "target"], _put).drop("part"))
    shutil.rmtree(stage, ignore_errors=True)
    return done


def _hashed(rows: DataFrame, path: str) -> DataFrame:
    """rows (of strings) with sha: the hash of each file, null where it can't be read."""
    kinds = ", ".join(f"`{c}` string" for c in rows.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for p in batch.column(path).to_pylist():
                try:
                    with open(p, "rb") as f:
                        out.append(hashlib.file_digest(f, "sha256").hexdigest())
                except OSError:
                    out.append(None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], [*batch.schema.names, "sha"])

    return rows.mapInArrow(run, f"{kinds}, sha string")


def _names_in(spark: SparkSession, folder: str) -> DataFrame:
    if not os.path.isdir(folder):
        return spark.createDataFrame([], "name string")
    return entries(spark, folder, 0, hidden=True).select("name")


def _moved(source: str, target: str) -> None:
    if not os.path.exists(source) and os.path.exists(target):
        return  # an earlier try of this task did it
    if os.path.lexists(target):
        raise FileExistsError(f"{target} is there already")
    os.makedirs(os.path.dirname(target) or ".", exist_ok=True)
    shutil.move(source, target)


def quarantined(files: DataFrame, folder: str, backup: str) -> DataFrame:
    """Backs up each file (source), then moves it into folder: source, target, backup, bytes, sha, error.

    Names that are taken, there or by another file of the plan, get a number; what the backup holds under the file's very name
    already is not copied again. A file whose backup fails stays where it is.
    """
    spark = files.sparkSession
    rows = files.select("source", F.regexp_extract("source", r"([^/]*)/*\z", 1).alias("name"))
    rows = cut(_hashed(rows, "source"))
    there = _names_in(spark, backup)
    same = _hashed(there.join(rows.select("name").distinct(), "name", "left_semi").withColumn("path", F.concat(F.lit(f"{backup}/"), "name")), "path")
    rows = cut(backed_up(rows, there.join(same.select("name", "sha"), "name", "left"), "name", "source", "sha", "stored"))
    plan = rows.where("stored IS NOT NULL").select("source", F.concat(F.lit(f"{backup}/"), "stored").alias("target"))
    os.makedirs(backup, exist_ok=True)
    copies = copied(plan, backup).select("source", F.col("target").alias("backup"), "bytes", F.col("error").alias("_failed"))
    rows = rows.join(copies, "source", "left").withColumn("backup", F.coalesce("backup", F.concat(F.lit(f"{backup}/"), "name")))
    gone = F.when(F.col("sha").isNull(), F.concat(F.lit("can not be read: "), "source"))
    rows = cut(rows.select("source", "name", "backup", "bytes", "sha", F.coalesce("_failed", gone).alias("error")))
    named = beside(rows.where("error IS NULL"), _names_in(spark, folder), "name", "source", "_to").unionByName(rows.where("error IS NOT NULL").withColumn("_to", F.lit(None).cast("string")))
    named = cut(named.select("source", F.concat(F.lit(f"{folder}/"), "_to").alias("target"), "backup", "bytes", "sha", "error"))
    return cut(_tried(named, ["source", "target"], _moved))


def quarantined_roots(spark: SparkSession, root: str, names: DataFrame, folder: str, backup: str) -> DataFrame:
    """Moves root entries (names: name), files and whole folders, into folder: name, target, files, error.

    All files of an entry are backed up first, under their paths below root; if one of them fails, or can not be read, the entry
    stays where it is with the first error. An entry that is not there is an error.
    """
    found = entries(spark, root, hidden=True)
    top = F.split("path", "/")[0]
    names = names.select("name").distinct()
    own = cut(found.select("path", "folder", top.alias("name")).join(names, "name", "left_semi"))
    plan = own.where("NOT folder").select(F.concat(F.lit(f"{root}/"), "path").alias("source"), F.concat(F.lit(f"{backup}/"), "path").alias("target"))
    os.makedirs(backup, exist_ok=True)
    copies = copied(plan, backup).select(F.substring("source", len(root) + 2, 1 << 30).alias("path"), "error")
    told = copies.groupBy(top.alias("name")).agg(F.count(F.lit(1)).alias("files"), F.min_by("error", F.when(F.col("error").isNotNull(), F.col("path"))).alias("error"))
    there = own.where("NOT contains(path, '/')").select("name", F.lit(True).alias("_there"))
    rows = names.join(told, "name", "left").join(there, "name", "left")
    rows = cut(rows.select("name", F.coalesce("files", F.lit(0)).alias("files"), F.when(F.col("_there").isNull(), F.concat(F.lit("is not there: "), "name")).otherwise(F.col("error")).alias("error")))
    named = beside(rows.where("error IS NULL"), _names_in(spark, folder), "name", "name", "_to").unionByName(rows.where("error IS NOT NULL").withColumn("_to", F.lit(None).cast("string")))
    named = cut(named.select("name", F.concat(F.lit(f"{root}/"), "name").alias("source"), F.concat(F.lit(f"{folder}/"), "_to").alias("target"), "files", "error"))
    return cut(_tried(named, ["source", "target"], _moved)).drop("source")
