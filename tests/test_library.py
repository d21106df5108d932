import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from quillon.functions import sanitize as S
from quillon.operators import devices as D
from quillon.operators import reports as R
from quillon.operators import state as T
from quillon.operators import sync as Y
from quillon.operators import verify as V
from quillon.operators.catalog import numbered
from quillon.operators.collisions import beside, resolve
from quillon.sources import scan
from quillon.sources import state as documents


def column(spark, values, f):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, v string")
    return [r[0] for r in rows.orderBy("i").select(f(F.col("v"))).collect()]


CLEAN = {
    "Canción.mp3": "cancion.mp3",
    "track+remix=v2.mp3": "track_remix_v2.mp3",
    "normal_file-01.mp3": "normal_file_01.mp3",
    "tanz 🎶.mp3": "tanz_multiple_musical_notes.mp3",
    "Щука и ёж.mp3": "shchuka_i_ezh.mp3",
    "Ρόδο.flac": "rodo.flac",
    "ひかりノオト.ogg": "hikarinooto.ogg",
    "바다 한 잔.mp3": "bada_han_jan.mp3",
    "夜.mp3": "audio.mp3",
    "12 - [x] 34 + +- audiomovil.2020 y ().mp3": "x_34_audiomovil_2020_y.mp3",
    "1 NO ME ENGAÑES NUNCA - yulios kumbia FT. mexicolombialos, los telez-AUDIOMOVIL.2021 (1).mp3": "no_me_enganes_nunca_yulios_kumbia_ft_mexicolombialos_los_telez.mp3",
    "+++ 000 Audiomovil spot.mp3": "audiomovil_spot.mp3",
    "0 Calibre 50 - Mitad Y Mitad.mp3": "calibre_50_mitad_y_mitad.mp3",
    "AUDIOMOVIL.2021 Mi Track - aUdIoMoViL.2021.mp3": "mi_track.mp3",
    "+++ 0000 AUDIOMOVIL INTROMIX-AUDIOMOVIL.2021.mp3": "audiomovil_intromix.mp3",
    "(AUDIOMOVIL2019).mp3": "audio.mp3",
    "a" * 100: "a" * 64,
    "207_barrio_sur______0badcafe.mp3": "207_barrio_sur______0badcafe.mp3",
    "5207_barrio_sur_____0badcafe.mp3": "5207_barrio_sur_____0badcafe.mp3",
    "12345.mp3": "12345.mp3",
    "": "audio",
}


def test_clean_names(spark):
    assert column(spark, [*CLEAN, None], S.sanitized) == [*CLEAN.values(), None]


def test_made_names(spark):
    assert column(spark, ["a" * 40 + ".mp3", "mysong.mp3"], lambda c: S.prefixed(c, F.lit(1))) == ["0001_" + "a" * 23 + ".mp3", "0001_mysong.mp3"]
    assert column(spark, ["archivo_sin_extension_muy_largo_de_verdad", "track.flac"], lambda c: S.prefixed(c, F.lit(999))) == ["0999_archivo_sin_extension_muy_l", "0999_track.flac"]
    got = column(spark, ["faro", "311_lluvia_lenta____0badcafe", ""], lambda c: S.hashed(c, F.lit(3), F.lit("no hash here")))
    assert got[:2] == ["0003_faro" + "_" * 11 + "00000000.mp3", "311_lluvia_lenta____0badcafe.mp3"] and {len(n) for n in got} == {32}
    assert len(column(spark, ["x"], lambda c: S.hashed(c, F.lit(10**18), F.lit("ab" * 32)))[0]) == 32
    assert column(spark, ["¡¡¡###@@@.mp3", "x.y.mp3", "song"], S.transferred) == ["audio.mp3", "x_y.mp3", "song.audio"]
    assert column(spark, ["a.flac", "a", ".b"], S.as_mp3) == ["a.mp3", "a.mp3", ".b.mp3"]


def test_device_functions(spark):
    rows = spark.createDataFrame(
        [("FARO", "Vendor", "Model 7", "S-0042", "11EE-0A0B", "/dev/sdb1", 9), (None, " ", None, None, None, "/dev/sdb1", 9)],
        "label string, vendor string, model string, serial string, uuid string, device string, total long",
    )
    key = D.identity_key(*[F.col(c) for c in rows.columns])
    assert [r[0] for r in rows.select(key).collect()] == ["FARO__Vendor__Model 7__S-0042__11EE-0A0B", "/dev/sdb1__9"]
    sizes = spark.createDataFrame([(512,), (4096,), (1000,), (0,)], "s long")
    assert [r[0] for r in sizes.select(D.sectors_per_cluster(F.col("s"))).collect()] == [64, 8, None, None]
    block = bytearray(512)
    block[11:14], block[510:] = (512).to_bytes(2, "little") + bytes([64]), b"\x55\xaa"
    blocks = spark.createDataFrame([(bytes(block),), (bytes(512),), (b"",), (None,)], "b binary")
    assert [r[0] for r in blocks.select(D.allocation_unit(F.col("b"))).collect()] == [32768, None, None, None]
    there = spark.createDataFrame([("/dev/a", "/mnt/x/", "vfat"), ("/dev/b", "/mnt/y", "vfat")], "device string, mount_point string, fs_type string")
    assert [r.device for r in D.at_mount(there, "/mnt/x").collect()] == ["/dev/a"]


def test_probe_results(spark):
    docs = [
        {"streams": [{"codec_type": "audio", "codec_name": "mp3", "bit_rate": "320000", "sample_rate": "44100", "disposition": {"attached_pic": 1}}]},
        {"streams": [{"codec_type": "video"}, {"codec_type": "audio", "bit_rate": "x"}], "format": {"tags": {"METADATA_block_picture": "y"}}},
        {"streams": []},
    ]
    rows = spark.createDataFrame([(json.dumps(d),) for d in docs], "j string").select(D.parsed_probe(F.col("j")).alias("p"))
    p = F.col("p")
    got = rows.select(D.has_cover(p), D.has_video(p), D.has_tags(p), *D.profile(p).values()).collect()
    assert [tuple(r) for r in got] == [(True, False, False, "mp3", 320000, 44100), (True, True, True, "unknown", 0, 0), (False, False, False, None, None, None)]


def test_sync_cases(spark):
    sha = lambda c: c * 64
    target = spark.createDataFrame(
        [("VOL_01/183_a_aaaaaaaa.mp3", "VOL_01", "183_a_aaaaaaaa.mp3", "-"), ("VOL_01/076_cerca.mp3", "VOL_01", "076_cerca.mp3", "-"), ("VOL_01/077_lejos.mp3", "VOL_01", "077_lejos.mp3", "-"), ("m/b", "m", "b", sha("b"))],
        "path string, folder string, name string, sha string",
    )
    source = spark.createDataFrame([("a", sha("a")), ("b", sha("b")), ("n", sha("c"))], "path string, sha string")
    known = spark.createDataFrame([("076_cerca.mp3",), ("183_a_aaaaaaaa.mp3",)], "name string")
    got = Y.summary(source, target, known).first().asDict()
    assert got == {"skipped": 1, "to_process": 2, "displaced": 1, "max_index": 183, "volumes": 1, "untracked": 1, "next_index": 184}
    none = spark.createDataFrame([], "path string")
    assert {r.path for r in Y.untracked(target, none, known).collect()} == {"VOL_01/077_lejos.mp3", "m/b"}
    assert {r.path for r in Y.untracked(target, none, known.where("false")).collect()} == {"m/b"}
    counts = spark.createDataFrame([(1, 7), (3, 48)], "volume long, files long")
    files = spark.range(105).withColumnRenamed("id", "path")
    plan = Y.incremental_plan(files, counts, [F.col("path")])
    assert sorted(map(tuple, plan.groupBy("volume").count().collect())) == [(3, 2), (4, 50), (5, 50), (6, 3)]
    assert sorted(r.path for r in Y.flushes(plan).where("flush").collect()) == [1, 51, 101, 104]
    full = Y.incremental_plan(files.limit(1), spark.createDataFrame([(2, 50)], "volume long, files long"), [F.col("path")])
    assert full.first().volume == 3 and Y.incremental_plan(files.limit(1), counts.where("false"), [F.col("path")]).first().volume == 1
    widths = Y.prefix_widths(spark.createDataFrame([("002_a",), ("1183_b",), ("x",)], "name string")).first()
    assert (widths.next_index, widths.mixed) == (1184, True)
    assert tuple(Y.prefix_widths(spark.createDataFrame([], "name string")).first()) == (1, False)


def test_audits(spark):
    ck = spark.createDataFrame([(i, f"{i}.mp3", "completed", "0" * 64, None) for i in range(5)] + [(5, "5.mp3", "completed", None, None), (6, "6.mp3", "failed", None, "Skipped_DRM")], "idx long, name string, status string, checksum string, error string")
    disk = spark.createDataFrame([(f"VOL_01/{i}.mp3", "f" * 64) for i in range(6)], "path string, sha string")
    found = V.integrity(ck, disk)
    assert V.integrity_summary(found).first().state == "corrupted" and [tuple(r) for r in V.fraud_runs(found).collect()] == [(5, 0)]
    assert sorted(r.idx for r in V.recovery_candidates(ck, disk).collect()) == [0, 1, 2, 3, 4, 5]
    assert V.integrity_summary(found.where("false")).first().state == "ok"
    empty = spark.createDataFrame([], "path string, sha string")
    assert V.backup_valid(empty, disk).first().valid is True
    files = lambda *p: spark.createDataFrame([(x,) for x in p], "path string")
    assert [V.root_policy(f).first().policy for f in (files("VOL_01/a"), files("LOST.DIR/a"), files("x/a"), spark.createDataFrame([], "path string"))] == ["managed", "empty", "user_content", "empty"]
    got = {(r.code, r.subject) for r in V.topology_findings(files("VOL_01/a/b", "VOL_01/é.mp3", "VOL_01/" + "x" * 33, "top", "other/y", ".z/a", *[f"VOL_02/{i}" for i in range(51)])).collect()}
    assert got == {("nesting", "VOL_01/a"), ("not_ascii", "VOL_01/é.mp3"), ("long_name", "VOL_01/" + "x" * 33), ("root_orphan", "top"), ("other_folder", "other"), ("overfull", "VOL_02")}


def test_state_machines(spark):
    steps = [(1, 7, "start", "a", None, None), (2, 7, "failed", None, None, "bad"), (3, 7, "start", "b", None, None), (4, 7, "renamed", "c", None, None), (5, 7, "completed", None, "h", None), (6, 8, "completed", None, "h", None), (7, 9, "start", "x", None, None)]
    rows = spark.createDataFrame(steps, "seq long, idx long, kind string, name string, checksum string, error string")
    got = {r.idx: tuple(r)[1:] for r in T.checkpoint_state(rows).collect()}
    assert got[7] == ("c", "completed", "h", None, 0) and got[8] == (None, "unknown", None, None, 1) and got[9] == ("x", "in_progress", None, None, 0)
    one = T.checkpoint_progress(T.checkpoint_state(rows), 2).first()
    assert (one.completed, one.percentage, one.recoverable) == (1, 50.0, True)
    assert not T.checkpoint_progress(T.checkpoint_state(rows), 2, "completed").first().recoverable
    none = T.checkpoint_progress(T.checkpoint_state(rows.where("false")), 0).first()
    assert none.percentage == 100.0 and not none.recoverable
    moves = [(1, "t", "ensure"), (2, "t", "committed"), (3, "t", "ensure"), (1, "u", "ensure"), (2, "u", "failed"), (1, "v", "failed"), (1, "w", "ensure"), (2, "w", "failed"), (3, "w", "ensure")]
    journal = spark.createDataFrame([(*m, "e") for m in moves], "seq long, target string, kind string, error string")
    assert {r.target: (r.status, r.error) for r in T.journal_state(journal).collect()} == {"t": ("committed", None), "u": ("failed", "e"), "v": ("unknown", None), "w": ("pending", None)}
    entries = spark.createDataFrame([(1, "a", "h", 1, "p"), (2, "b", "h", 2048, "q")], "seq long, name string, sha string, size long, path string")
    assert [(r.name, r.size) for r in T.manifest(entries).collect()] == [("b", 2048)] and T.manifest_names(entries).count() == 2


def test_collisions_beside_what_is_there(spark):
    rows = spark.createDataFrame([(1, "track01.mp3"), (2, "track01.mp3"), (3, "new"), (4, ""), (5, "")], "seq long, name string")
    there = spark.createDataFrame([("track01.mp3",), ("track01_1.mp3",)], "name string")
    got = {r.seq: r.resolved for r in beside(rows, there).collect()}
    assert got == {1: "track01_2.mp3", 2: "track01_3.mp3", 3: "new", 4: "", 5: "_1"}
    hot = spark.range(5000).select(F.col("id").alias("seq"), F.lit("same.tar.mp3").alias("name"))
    names = {r.seq: r.resolved for r in resolve(hot).collect()}
    assert names[0] == "same.tar.mp3" and names[7] == "same.tar_007.mp3" and names[4999] == "same.tar_4999.mp3"
    assert {r.resolved for r in resolve(rows.where("seq > 3")).collect()} == {"", "_001"}


def test_reports(spark):
    files = spark.createDataFrame([("a/b.mp3",), ("a-b.mp3",), ("Z.flac",)], "path string")
    assert [(r.idx, r.path, r.destination) for r in R.in_place_plan(files).orderBy("idx").collect()] == [(0, "Z.flac", "VOL_01/0001_z.flac"), (1, "a/b.mp3", "VOL_01/0002_b.mp3"), (2, "a-b.mp3", "VOL_01/0003_a_b.mp3")]
    rows = spark.createDataFrame([(10, 3, 8), (10, 0, 8), (10, 9, 8)], "e long, d long, t long")
    assert [r[0] for r in rows.select(R.eta_seconds(F.col("e"), F.col("d"), F.col("t"))).collect()] == [15, 0, 0]


def test_prefixed_names_of_five_digits_keep_the_limit(spark):
    """The stem gives way to a longer number: 32 characters in all, as the reference's add_sequential_prefix has it."""
    rows = spark.createDataFrame([(9999,), (10_000,), (1_000_000,)], "i long").select(S.prefixed(F.lit("207_barrio_sur______0badcafe.mp3"), F.col("i")).alias("n"))
    assert [r.n for r in rows.collect()] == ["9999_207_barrio_sur______0ba.mp3", "10000_207_barrio_sur______0b.mp3", "1000000_207_barrio_sur______.mp3"]


def test_scan(spark, tmp_path):
    for p in ("song.MP3", "_under.flac", "a/b/c/d/deep.mp3", "a/x.mp3", "a/note.txt", ".hid/y.mp3", "FOUND.000/z.mp3", "a/._w.mp3", "VOL_01/0007_q.bin"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_bytes(b"" if p == "_under.flac" else p.encode())
    root = str(tmp_path)
    got = {r.path: (r.extension, r.size, r.depth) for r in scan.audio_files(spark, root).collect()}
    assert got == {"song.MP3": ("mp3", 8, 0), "_under.flac": ("flac", 0, 0), "a/b/c/d/deep.mp3": ("mp3", 16, 4), "a/x.mp3": ("mp3", 7, 1)}
    assert {r.path for r in scan.audio_files(spark, root, 1).collect()} == {"song.MP3", "_under.flac", "a/x.mp3"}
    report = scan.scan_report(spark, root).first()
    assert (report.files, report.bytes, report.max_depth, report.folders) == (4, 31, 5, 6)
    (row,) = scan.volume_files(spark, root).collect()
    assert (row.path, row.idx, row.sha) == ("VOL_01/0007_q.bin", 7, hashlib.sha256(b"VOL_01/0007_q.bin").hexdigest())
    assert scan.entries(spark, root, hidden=True).where("path LIKE '.hid%'").count() == 2
    with pytest.raises(Exception, match="no folder"):
        scan.audio_files(spark, root + "/none").count()


def test_scan_of_one_large_folder_equals_the_walk(spark, tmp_path):
    for i in range(60):
        at = tmp_path / "all" / f"d{i % 20}" / f"e{i}"
        at.mkdir(parents=True)
        for k in range(20):
            (at / f"{k}.mp3").write_bytes(b"x" * k)
    (tmp_path / "all" / "loop").symlink_to(tmp_path)
    (tmp_path / "all" / "closed").mkdir(mode=0)
    walked = {os.path.relpath(os.path.join(d, n), tmp_path) for d, _, names in os.walk(tmp_path) for n in names if n.endswith(".mp3")}
    rows = scan.audio_files(spark, str(tmp_path))
    assert {r.path for r in rows.collect()} == walked and len(walked) == 1200
    assert [r.idx for r in numbered(rows, R.path_order()).where("path = 'all/d0/e0/0.mp3'").collect()] == [1]
    assert scan.entries(spark, str(tmp_path), 1).count() == 23
    level = scan.entries(spark, str(tmp_path)).where("depth = 3")
    assert level.select(F.input_file_name()).distinct().count() > 1  # listed by several tasks


def test_documents(spark, tmp_path):
    at = str(tmp_path / "d.json")
    assert documents.read_or_create_journal(spark, at).count() == 0 and os.path.exists(at)
    documents.clear(at)
    documents.clear(at)
    assert documents.read_manifest(spark, at).count() == 0
    (tmp_path / "d.json").write_text("{invalid-json")
    with pytest.raises(documents.StateError):
        documents.read_checkpoint(spark, at)
    assert documents.read_manifest(spark, at).count() == 0 and os.path.exists(at + ".corrupt")
    documents.write_json(at, {"version": 1, "entries": [{"name": "a", "sha": "h", "size": 1, "path": "p", "seq": 1}]})
    assert documents.read_manifest(spark, at).first().sha == "h"
    documents.write_json(at, {"version": 1, "total_files": 3, "processed_files": {"4": {"status": "Completed", "usb_checksum": "x"}}})
    head, rows = documents.read_checkpoint(spark, at)
    assert head.first().total_files == 3 and [(r.idx, r.usb_checksum) for r in rows.collect()] == [(4, "x")]
