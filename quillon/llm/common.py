"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators.shared import cut, drop, shared_folder  # noqa: F401  for the operators here

WORD = r"[^\x20\x09-\x0D]+"
#: A key with more than 1/HEAVY of the rows is heavy, so at most HEAVY keys are: a proven bound for a broadcast.
HEAVY = 1000
#: Rows a table of short rows may have to be broadcast whole; larger ones are joined by a shuffle.
SMALL_ROWS = 20_000
SMALL_KEYS = 20_000
SALTS = 32
SLICE = 4_000_000  # bytes of text that are worked on at once
FAN_IN = 64  # blocks that one task adds up


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def join_counted(big: DataFrame, small: DataFrame, key: str, n: str, how: str = "inner") -> DataFrame:
    """Join many rows to one row per key, where column n of small counts the rows of big by key.

    Up to SMALL_KEYS keys are broadcast whole. Beyond that heavy keys (at most HEAVY of them) are, all others are dealt by key.
    """
    rest = small.drop(n)
    if small.limit(SMALL_KEYS + 1).count() <= SMALL_KEYS:
        return big.join(F.broadcast(rest), key, how)
    total = small.agg(F.sum(n)).first()[0] or 0
    at_least = max(total / HEAVY, 8)
    heavy = [r[0] for r in small.where((F.col(n) > at_least) & F.col(key).isNotNull()).select(key).collect()]
    if not heavy:
        return big.join(rest, key, how)
    hot = F.coalesce(F.col(key).isin(heavy), F.lit(False))
    return big.where(~hot).join(rest.where(~hot), key, how).unionByName(big.where(hot).join(F.broadcast(rest.where(hot)), key, how))


def join_groups(big: DataFrame, groups: DataFrame, keys: list[str], most: int = SMALL_ROWS) -> DataFrame:
    """Left join of rows to one row per group, nulls equal: `most` groups are broadcast at most, more are salted."""
    few = most and groups.limit(most + 1).count() <= most
    renamed = reduce(lambda d, k: d.withColumnRenamed(k, f"_g_{k}"), keys, groups)
    on = reduce(lambda a, b: a & b, [big[k].eqNullSafe(renamed[f"_g_{k}"]) for k in keys])
    drop = [f"_g_{k}" for k in keys]
    if few:
        return big.join(F.broadcast(renamed), on, "left").drop(*drop)
    own = F.xxhash64(*[F.col(f"`{f.name}`") for f in big.schema if "map<" not in f.dataType.simpleString()])
    big = big.withColumn("_salt", F.pmod(own, F.lit(SALTS)).cast("int"))  # the same whenever a task runs again
    renamed = renamed.withColumn("_gsalt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    on = reduce(lambda a, b: a & b, [big[k].eqNullSafe(renamed[f"_g_{k}"]) for k in keys])
    return big.join(renamed, on & (big["_salt"] == renamed["_gsalt"]), "left").drop("_salt", "_gsalt", *drop)


def crc_of_id(col: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary"))


def text_slices(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each holds one row or at most about SLICE bytes of text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, ends = utf8(batch.column(text))
        at = 0
        while at < batch.num_rows:
            stop = max(at + 1, int(np.searchsorted(ends, ends[at] + SLICE, side="right")) - 1)
            yield batch.slice(at, min(stop, batch.num_rows) - at)
            at = stop


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of a string column, and the offsets between them; nulls are empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    _, at, data = texts.buffers()
    ends = np.frombuffer(at, dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, dtype=np.uint8)
    return raw, ends - ends[0]


def added_up(rows: DataFrame, kind: str, levels: int) -> dict[int, np.ndarray]:
    """Sums of the blocks v by b (rows: b int, v binary of `kind` numbers), in a tree: no task gets more than FAN_IN blocks of a key
    while the tasks number at most FAN_IN ** (levels + 1). The number of keys and their width are fixed, so few bytes reach the driver."""

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        total = np.frombuffer(frame["v"].iloc[0], dtype=kind).copy()
        for v in frame["v"].iloc[1:]:
            total += np.frombuffer(v, dtype=kind)
        return pd.DataFrame({"b": frame["b"].iloc[:1], "part": frame["part"].iloc[:1], "v": [total.tobytes()]})

    rows = rows.select("b", "v", F.spark_partition_id().alias("part"))
    for _ in range(levels):
        rows = rows.withColumn("part", F.expr(f"part div {FAN_IN}").cast("int")).groupBy("b", "part").applyInPandas(add, "b int, part int, v binary")
    rows = rows.withColumn("part", F.lit(0)).groupBy("b", "part").applyInPandas(add, "b int, part int, v binary")
    return {r["b"]: np.frombuffer(r["v"], dtype=kind) for r in rows.collect()}
