"""The stateful sync difference and exactly-once writing, against their batch forms."""

import random

import pytest
from pyspark.sql import functions as F

from quillon.operators import catalog as C
from quillon.operators import sync as Y
from quillon.streaming import sync, volumes

SOURCE = "path string, sha string"


def sha(i):
    return f"{i * 2654435761 % 2**32:08x}" * 8


def tables(spark):
    rng = random.Random(8)
    source = [(f"lib/{rng.choice('abc')}/{i} t.mp3", sha(i % 60)) for i in range(150)] + [(f"hot/{i}", sha(7)) for i in range(80)]
    target = [(f"VOL_01/{i:04d}_s_{sha(i)[:8]}.mp3", "VOL_01", f"{i:04d}_s_{sha(i)[:8]}.mp3", "-") for i in range(0, 60, 3)]
    target += [(f"old/{k}/{i}.mp3", "old", f"{i}.mp3", sha(i)) for i in range(1, 60, 4) for k in range(1 + i % 3)]
    target += [("old/nobody.mp3", "old", "nobody.mp3", sha(999)), ("VOL_02/0500_x_00000000.mp3", "VOL_02", "0500_x_00000000.mp3", "-")]
    return source, spark.createDataFrame(target, "path string, folder string, name string, sha string")


def rows(df):
    return sorted((str(r.path), r.action, str(r.displaced_from)) for r in df.collect())


def test_stream_over_shuffled_batches_with_a_restart_equals_the_batch_form(spark, tmp_path):
    source, target = tables(spark)
    at = lambda n: str(tmp_path / n)
    shuffled = random.Random(2).sample(source, len(source))
    stream = lambda: spark.readStream.schema(SOURCE).option("maxFilesPerTrigger", 1).parquet(at("in"))
    for k in range(2):  # two files for the first run, two more after a restart
        spark.createDataFrame(shuffled[k * 60 : k * 60 + 60], SOURCE).coalesce(1).write.mode("append").parquet(at("in"))
    sync.stream_sync_diff(stream(), target, at("out"), at("check")).awaitTermination()
    assert spark.read.schema(sync.ROWS).parquet(at("out")).count() == 120
    spark.createDataFrame(shuffled[120:], SOURCE).coalesce(2).write.mode("append").parquet(at("in"))
    # the target as it is now is not looked at again: the index is in the state
    sync.stream_sync_diff(stream(), target.where("false"), at("out"), at("check")).awaitTermination()
    whole = spark.createDataFrame(source, SOURCE)
    got, counts = sync.drained(spark, at("out"), target)
    want = C.sync_diff(whole, target)
    assert rows(got) == rows(want)
    moves = lambda df: sorted(r.path for r in df.where("moves").collect())
    assert moves(got) == moves(Y.displaced_winners(want)) and len(moves(got)) > 5
    assert counts.first().asDict() == Y.summary(whole, target, spark.createDataFrame([], "name string")).first().asDict()


def test_short_hashes_are_an_error(spark):
    _, target = tables(spark)
    for bad in ("zz12345", None):
        with pytest.raises(Exception, match="no eight hex digits in the hash of p"):
            C.sync_diff(spark.createDataFrame([("p", bad)], SOURCE), target).collect()


def plan(spark, a, b):
    return spark.range(a, b).select(F.col("id").alias("idx"), F.expr("(id - 1) div 50 + 1").alias("volume"), F.concat(F.lit("f"), F.col("id").cast("string")).alias("name"))


def test_killed_and_repeated_batches_leave_each_row_once(spark, tmp_path, monkeypatch):
    at, out = str(tmp_path / "in"), str(tmp_path / "out")
    for a, b in ((1, 121), (121, 161)):
        plan(spark, a, b).coalesce(1).write.mode("append").parquet(at)
    stream = lambda: spark.readStream.schema("idx long, volume long, name string").option("maxFilesPerTrigger", 1).parquet(at)
    enter, calls = volumes._enter, []

    def dies(entries, path):
        calls.append(path)
        if len(calls) == 2:
            raise RuntimeError("killed")  # written, not entered
        enter(entries, path)

    monkeypatch.setattr(volumes, "_enter", dies)
    with pytest.raises(Exception, match="killed"):
        volumes.write_volumes(stream(), out, "run", str(tmp_path / "check")).awaitTermination()
    seen = {r.idx for r in volumes.committed(spark, out, "run").collect()}
    assert {r.idx for r in volumes.remaining(plan(spark, 1, 161), out, "run").collect()} == set(range(1, 161)) - seen
    volumes.write_volumes(stream(), out, "run", str(tmp_path / "check")).awaitTermination()
    done = volumes.committed(spark, out, "run")
    assert sorted(r.idx for r in done.collect()) == list(range(1, 161))
    entries = volumes.ledger(spark, out, "run")
    assert entries.agg(F.sum("rows")).first()[0] == 160 and {r.volume for r in entries.where("closed").collect()} == {1, 2, 3, 4}
    assert not volumes.commit(plan(spark, 1, 9), out, "run", entries.agg(F.max("epoch")).first()[0])  # it is in the ledger
    assert volumes.committed(spark, out, "other") is None
