"""Copies, quarantine and ingestion on real files."""

import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from quillon.sources import copying, ingest, scan

PLAN = "source string, target string"


def fill(root, **files):
    for path, text in files.items():
        at = root / path.replace("__", "/")
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(text)


def everything(root):
    return {str(p.relative_to(root)): p.read_text() for p in root.rglob("*") if p.is_file()}


def test_copies(spark, tmp_path):
    fill(tmp_path, a="a" * 200_000, b="b")
    at = lambda *p: str(tmp_path.joinpath(*p))
    plan = spark.createDataFrame([(at("a"), at("out", "x", "a")), (at("gone"), at("out", "gone")), (at("b"), at("out", "b"))], PLAN)
    got = {os.path.basename(r.source): r for r in copying.copied(plan).collect()}
    assert got["a"].sha == hashlib.sha256(b"a" * 200_000).hexdigest() and got["a"].bytes == 200_000 and got["b"].error is None
    assert got["gone"].error and everything(tmp_path / "out") == {"x/a": "a" * 200_000, "b": "b"}
    assert not [n for n in os.listdir(tmp_path) if n.startswith(".quillon")]
    assert copying.copied(plan.where("false")).collect() == []


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    fill(tmp_path, a="a", b="b")
    (tmp_path / "out").mkdir()
    fails = F.when(F.col("n") == 1, F.raise_error(F.lit("lost"))).otherwise(F.col("target"))
    rows = [(str(tmp_path / n), str(tmp_path / "out" / n), i) for i, n in enumerate("ab")]
    plan = spark.createDataFrame(rows, PLAN + ", n int").repartition(2, "n").select("source", fails.alias("target"))
    with pytest.raises(Exception, match="lost"):
        copying.copied(plan, str(tmp_path / "out"))
    assert everything(tmp_path / "out") == {}


def test_attempts_that_are_not_committed_are_discarded(tmp_path):
    stage = tmp_path / "stage"
    writer = copying._CopyWriter({"path": str(stage)})
    for attempt in ("0-1", "0-2"):
        fill(stage / attempt, **{"0": attempt, "list": "{}"})
    writer.commit([copying._Attempt(f"{stage}/0-2"), None])
    assert json.loads((stage / "committed").read_text()) == [f"{stage}/0-2"] and not (stage / "0-1").exists()
    writer.abort([])
    assert not stage.exists()


def test_quarantine_keeps_every_backup(spark, tmp_path):
    fill(tmp_path, x__t="one", y__t="two", z__t="held", w__u="w")
    fill(tmp_path / "backup", t="held", t_1="other")
    fill(tmp_path / "q", t="old")
    files = spark.createDataFrame([(str(tmp_path / p),) for p in ("x/t", "y/t", "z/t", "w/u", "no/v")], "source string")
    got = {r.source[len(str(tmp_path)) + 1 :]: r for r in copying.quarantined(files, str(tmp_path / "q"), str(tmp_path / "backup")).collect()}
    assert got["no/v"].error and [r.error for k, r in got.items() if k != "no/v"] == [None] * 4
    assert everything(tmp_path / "backup") == {"t": "held", "t_1": "other", "t_2": "one", "t_3": "two", "u": "w"}
    assert everything(tmp_path / "q") == {"t": "old", "t_1": "one", "t_2": "two", "t_3": "held", "u": "w"}
    assert not any((tmp_path / p).exists() for p in ("x/t", "y/t", "z/t", "w/u"))
    copying._moved(str(tmp_path / "x/t"), str(tmp_path / "q" / "t_1"))  # a repeated task finds the file moved


def test_root_entries_are_backed_up_whole(spark, tmp_path):
    root = tmp_path / "usb"
    fill(root, keep__a="a", junk__a="1", junk__sub__b="2", note="n", bad__c="3")
    (root / "bad" / "broken").symlink_to(root / "nowhere")
    (root / "empty").mkdir()
    names = spark.createDataFrame([(n,) for n in ("junk", "note", "bad", "empty", "absent", "note")], "name string")
    fill(tmp_path / "q", note="older")
    got = {r.name: r for r in copying.quarantined_roots(spark, str(root), names, str(tmp_path / "q"), str(tmp_path / "backup")).collect()}
    assert len(got) == 5 and got["bad"].error and "not there" in got["absent"].error
    assert (got["junk"].files, got["junk"].error, got["empty"].files, got["empty"].error) == (2, None, 0, None)
    assert everything(tmp_path / "q") == {"junk/a": "1", "junk/sub/b": "2", "note": "older", "note_1": "n"} and (tmp_path / "q" / "empty").is_dir()
    assert everything(root) == {"keep/a": "a", "bad/c": "3"} and everything(tmp_path / "backup").items() >= {("junk/sub/b", "2"), ("note", "n")}


def test_ingestion(spark, tmp_path):
    fill(tmp_path / "in", **{"a__Óne (1).MP3": "1", "b__one 1.mp3": "22", "c__one-1.mp3": "333", "c__x.txt": "no", "d__ひ.flac": "4444"})
    root = str(tmp_path / "in")
    got = sorted(ingest.ingest(spark, scan.audio_files(spark, root), root, str(tmp_path / "staging")).collect(), key=lambda r: r.idx)
    assert [r.staged for r in got] == ["one_1.mp3", "one_1_001.mp3", "one_1_002.mp3", "hi.flac"] and [r.bytes for r in got] == [1, 2, 3, 4]
    assert everything(tmp_path / "staging") == {"one_1.mp3": "1", "one_1_001.mp3": "22", "one_1_002.mp3": "333", "hi.flac": "4444"}
    assert json.loads(got[3].progress)["payload"]["percentage"] == 100.0
    with pytest.raises(ValueError, match="no audio files"):
        ingest.ingest(spark, scan.audio_files(spark, root).where("false"), root, str(tmp_path / "other"))


def test_recovery(spark, tmp_path):
    from quillon.sources import recovery

    fill(tmp_path, **{"in__1": "one", "in__2": "two", "in__3": "three", "usb__VOL_01__0001_a.flac": "", "usb__VOL_01__0002_b.mp3": "broken"})
    at = lambda p: str(tmp_path / p)
    rows = [(1, "0001_a.flac", at("in/1")), (2, "0002_b.mp3", at("in/2")), (3, "0003_c.mp3", at("in/3")), (60, "0060_d.mp3", at("in/4"))]
    checkpoint = spark.createDataFrame(rows, "idx long, name string, path string")
    lost = spark.createDataFrame([(1,), (2,), (3,), (60,), (9,), (2,)], "idx long")
    sources = checkpoint.where("idx <> 60").select("path")
    for _ in range(2):  # doing it again changes nothing
        done, state = recovery.recovered(checkpoint, lost, at("usb"), sources, lost.where("idx = 3"))
        assert {r.idx: (r.action, r.error and r.error.split(":")[0]) for r in done.collect()} == {1: ("copy", None), 2: ("copy", None), 3: ("copy", "needs transcoding"), 60: ("missing", "source is gone"), 9: ("unknown", "is not in the checkpoint")}
        got = {r.idx: (r.name, r.status, r.checksum) for r in state.collect()}
        assert got == {1: ("0001_a.mp3", "completed", hashlib.sha256(b"one").hexdigest()), 2: ("0002_b.mp3", "completed", hashlib.sha256(b"two").hexdigest()), 3: ("0003_c.mp3", "failed", None), 60: ("0060_d.mp3", "failed", None)}
        assert everything(tmp_path / "usb") == {"VOL_01/0001_a.mp3": "one", "VOL_01/0002_b.mp3": "two"}
