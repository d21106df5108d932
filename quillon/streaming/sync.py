"""Sync difference over a stream of source files: the target's index is kept as state, once; the end is merged from what was written.

A file is keyed by the first eight digits of its content hash, as complying target names carry these alone, and by one of
SALTS, so that files of one content are not one task's. The index (which hashes comply, and the first path of each content
that does not) goes into the state store with the first batch and is looked up from there; a restarted stream finds it there
too. Rows go to a Parquet sink under the stream's checkpoint, so each is there once, whatever is repeated.

What needs all of the source is left to the end of the stream: which of equal files takes a displaced one, which target
files nobody asked for, and the counts. These come from the written rows, so the order in which files arrived shows nowhere.
Source rows whose hash has fewer than eight hex digits are an error, as in the batch form; a null path is a path like others.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from quillon.functions import names as N
from quillon.operators import catalog as C
from quillon.operators import sync as Y

SALTS = 4
ROWS = "path string, action string, displaced_from string"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Lookup(StatefulProcessor):
    """State of a key: whether a complying file holds the eight digits, and the first other file of each whole hash."""

    def init(self, handle) -> None:
        self.held = handle.getValueState("held", StructType([StructField("held", BooleanType())]))
        self.strays = handle.getMapState("strays", StructType([StructField("sha", StringType())]), StructType([StructField("path", StringType())]))

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        for sha, path in zip(initialState["sha"], initialState["path"]):
            if sha is None:
                self.held.update((True,))
            else:
                self.strays.updateValue((sha,), (path,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.held.exists()
        for batch in rows:
            found: dict = {}
            for sha in set(batch["sha"]) if not held else ():
                found[sha] = self.strays.getValue((sha,))[0] if self.strays.containsKey((sha,)) else None
            stray = [found.get(sha) for sha in batch["sha"]]
            yield pd.DataFrame({"path": batch["path"], "action": ["skip" if held else "new" if s is None else "displaced" for s in stray], "displaced_from": stray})

    def close(self) -> None:
        pass


def target_index(target: DataFrame, salts: int = SALTS) -> DataFrame:
    """h8, salt, sha, path: a row without sha for every complying hash, one with the first path for every other content."""
    target = C.with_compliance(target)
    short = target.where("compliant").select(N.hash8_of_name(F.col("name")).alias("h8")).where("h8 IS NOT NULL").distinct()
    whole = target.where("NOT compliant").groupBy("sha").agg(C.first_path().alias("path"))
    rows = short.withColumns({"sha": F.lit(None).cast("string"), "path": F.lit(None).cast("string")})
    rows = rows.unionByName(whole.select(N.hash8(F.col("sha")).alias("h8"), "sha", "path"))
    return rows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).select("h8", "salt", "sha", "path")


def tagged_stream(source: DataFrame, target: DataFrame, salts: int = SALTS) -> DataFrame:
    """path, action (skip, displaced, new), displaced_from of a stream of source (path, sha). Needs the store STORE."""
    salt = F.pmod(F.xxhash64("path"), F.lit(salts)).cast("int")
    rows = source.select("path", "sha", C.required_hash8(F.col("sha"), F.col("path")).alias("h8"), salt.alias("salt"))
    index = target_index(target, salts).groupBy("h8", "salt")
    return rows.groupBy("h8", "salt").transformWithStateInPandas(_Lookup(), ROWS, "Append", "None", initialState=index)


def stream_sync_diff(source: DataFrame, target: DataFrame, out: str, checkpoint: str, salts: int = SALTS):
    """Starts the stream over what is there now; its rows are added to out. With the same checkpoint it goes on where it ended, and
    then the target is that of the first start."""
    spark = source.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    rows = tagged_stream(source, target, salts)
    return rows.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)


def drained(spark: SparkSession, out: str, target: DataFrame, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The end of the stream: all rows as the batch form gives them (untracked target files too), with moves, and one row of counts."""
    tagged = spark.read.schema(ROWS).parquet(out)
    moved = tagged.where("action = 'displaced'").select(F.col("displaced_from").alias("path"))
    known = spark.createDataFrame([], "name string") if known is None else known
    lost = Y.untracked(target, moved, known).select("path", F.lit("untracked").alias("action"), F.lit(None).cast("string").alias("displaced_from"))
    return Y.displaced_winners(tagged.unionByName(lost)), Y.summed(tagged, target, lost, known)
