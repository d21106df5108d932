import pytest

from pyspark.sql import functions as F
from quillon.functions.paths import contained
from quillon.operators.catalog import sync_diff  # noqa: F401
from quillon.operators.collisions import resolve
from quillon.sources.state import StateError, read_journal, write_json


def test_containment(spark):
    rows = spark.createDataFrame([("a/b/c.mp3",), ("../file.mp3",), ("/etc/passwd",), ("x/../y",), ("../usb/z",)], "p string")
    assert [r[0] for r in rows.select(contained("mnt/usb", F.col("p"))).collect()] == [True, False, False, True, True]


def test_collisions(spark):
    rows = spark.createDataFrame([(1, "a.mp3"), (2, "a_001.mp3"), (3, "a.mp3"), (4, "a.mp3"), (5, None)], "seq long, name string")
    assert {r.seq: r.resolved for r in resolve(rows).collect()} == {1: "a.mp3", 2: "a_001.mp3", 3: "a_002.mp3", 4: "a_003.mp3", 5: None}


def test_journal(spark, tmp_path):
    path = str(tmp_path / "journal.json")
    write_json(path, {"version": 1, "transactions": [{"source_rel": "a", "target_rel": "b", "status": "Pending"}]})
    assert read_journal(spark, path).first().target_rel == "b"
    write_json(path, {"version": 2, "transactions": []})
    with pytest.raises(StateError):
        read_journal(spark, path)
