"""Queries of the sync, audit, state, device and report operators over the driver's tables.

Inputs are bound to the tables by expressions that Spark and DuckDB both read, chosen so that rows reach every branch; the
SQL of each query is written apart from its operator.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import headers as H
from quillon.functions import names as N
from quillon.functions import sanitize as S
from quillon.functions.paths import contained
from quillon.operators import catalog as C
from quillon.operators import devices as D
from quillon.operators import guards as G
from quillon.operators import reports as R
from quillon.operators import state as T
from quillon.operators import sync as Y
from quillon.operators import verify as V
from quillon.operators.collisions import backed_up, beside, resolve
from quillon.plans.catalog_queries import query


class Bound:
    """A table's columns by expressions; SHA, BYTES and // are written for either engine."""

    def __init__(self, table: str, where: str = "true", **columns: str):
        self.table, self.where, self.columns = table, where, columns

    def frame(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        own = lambda e: re.sub(r"SHA\(((?:[^()]|\([^()]*\))*)\)", r"sha2(\1, 256)", e).replace("BYTES(", "octet_length(").replace(" // ", " div ")
        rows = spark.read.parquet(f"{sf_dir}/{self.table}.parquet").where(own(self.where))
        return rows.select(*[F.expr(own(e)).alias(a) for a, e in self.columns.items()])

    def __str__(self) -> str:
        own = lambda e: e.replace("SHA(", "sha256(").replace("BYTES(", "strlen(")
        return f"(SELECT {', '.join(f'{own(e)} AS {a}' for a, e in self.columns.items())} FROM {self.table} WHERE {own(self.where)})"


_PATH = """CASE doc_id % 12 WHEN 0 THEN 'VOL_02/sub' || doc_id % 36 || '/' || doc_id || '.mp3' WHEN 1 THEN 'VOL_03/' || repeat('x', 30) || doc_id || '.mp3'
 WHEN 2 THEN 'VOL_03/canción ' || doc_id || '.mp3' WHEN 3 THEN 'orphan' || doc_id || '.txt' WHEN 4 THEN 'musica/' || lang || ' ' || doc_id || '.mp3' WHEN 5 THEN '.Trash/' || doc_id || '.mp3'
 WHEN 6 THEN 'VOL_04/0_zero' || doc_id || '.mp3' ELSE 'VOL_' || printf('%02d', doc_id // 100 + 5) || '/' || printf('%04d', doc_id) || '_song_' || substr(SHA(text), 1, 8) || '.mp3' END"""
TREE = Bound("documents", path=_PATH, size="CASE WHEN doc_id % 12 = 6 THEN 0 ELSE BYTES(text) END", sha="SHA(text)")
SOURCE = Bound("documents", doc_id="doc_id", path="'lib/' || source || '/' || lang || ' ' || doc_id || '.mp3'", name="lang || ' ' || doc_id || '.mp3'", size="BYTES(text)", sha="SHA(text)")
_HELD = "'VOL_' || printf('%02d', doc_id // 50 + 1)"
_HELD_NAME = "printf('%04d', doc_id) || '_song_' || substr(SHA(text), 1, 8) || '.mp3'"
_FOLDER = f"CASE WHEN doc_id % 3 = 0 THEN {_HELD} ELSE 'musica' END"
_NAME = f"CASE WHEN doc_id % 3 = 0 THEN {_HELD_NAME} ELSE lang || ' ' || doc_id || '.mp3' END"
TARGET = Bound("documents", "doc_id % 3 = 0 OR doc_id % 7 = 1", doc_id="doc_id", path=f"{_FOLDER} || '/' || {_NAME}", folder=_FOLDER, name=_NAME, size="BYTES(text)", sha="SHA(text)")
KNOWN = Bound("documents", "doc_id % 3 = 0 AND doc_id % 5 <> 0", name=_HELD_NAME)
_CK_NAME = "CASE WHEN o_orderkey % 50 = 0 THEN 'same.mp3' ELSE printf('%04d', o_orderkey) || '_f.mp3' END"
_DISK_PATH = f"'VOL_' || printf('%02d', o_orderkey // 50 + 1) || '/' || {_CK_NAME}"
_OWN = "SHA(CAST(o_orderkey AS STRING))"
CHECKPOINT = Bound(
    "orders", idx="o_orderkey", name=_CK_NAME, status="CASE o_orderkey % 9 WHEN 0 THEN 'in_progress' WHEN 1 THEN 'failed' ELSE 'completed' END",
    checksum=f"CASE WHEN o_orderkey % 10 = 0 THEN NULL WHEN o_orderkey % 10 = 1 THEN 'xyz' WHEN o_orderkey % 100 BETWEEN 42 AND 58 THEN SHA('wrong') ELSE {_OWN} END",
    error="CASE WHEN o_orderkey % 13 = 0 THEN 'Skipped_DRM' WHEN o_orderkey % 17 = 0 THEN 'x' END",
)
DISK = Bound("orders", "o_orderkey % 7 <> 3", path=_DISK_PATH, sha=_OWN, size="CASE WHEN o_orderkey % 11 = 0 THEN 0 ELSE 5 END")
_ODD = "'/' || CASE p_partkey % 8 WHEN 0 THEN '+++ 000 ' || p_name || ' spot.MP3' WHEN 1 THEN '0 ' || p_name || ' - x (2).mp3' WHEN 2 THEN 'AUDIOMOVIL.2021 ' || p_name || ' - aUdIoMoViL.2021.flac' WHEN 3 THEN '(AUDIOMOVIL2019).mp3' WHEN 4 THEN p_partkey || '.ogg' WHEN 5 THEN p_name || ' [Safari Music].wav' WHEN 6 THEN p_name || '_-_' ELSE '207_barrio_sur______0badcafe.mp3' END"
NAMES = Bound("part", p_partkey="p_partkey", raw=f"'in'||{_ODD}", sha="CASE WHEN p_partkey % 6 = 0 THEN 'not-a-sha' ELSE SHA(p_name) END")
FILE_NAMES = Bound("part", p_partkey="p_partkey", name=f"substr({_ODD}, 2)")
_ALPHABET = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
MIXED_NAMES = Bound("documents", doc_id="doc_id", name="CASE doc_id % 6 WHEN 0 THEN 'A' || doc_id WHEN 1 THEN 'a ' || doc_id WHEN 2 THEN 'a0' || doc_id WHEN 3 THEN 'a-' || doc_id || '.mp3' WHEN 4 THEN 'a!b' || doc_id ELSE 'Ñ' || doc_id || '/' || doc_id % 7 END")
_EXTS = "('mp3','flac','wav','ogg','m4a','alac','aac','wma','opus','aiff')"


def _clean_sql(stem: str) -> str:
    bare = r"regexp_replace(a, '^[\s+\-*_]+', '')"
    short = rf"regexp_replace({bare}, '^[0-9]+(?:[\s+\-*_]+)+', '')"
    step = rf"CASE WHEN trim({short}) = '' THEN {bare} ELSE {short} END"
    for pattern in (S.LEADING_AD, S.TRAILING_AD, S.TRAILING_NOISE):
        step = f"regexp_replace({step}, '{pattern}', '')"
    rounds = f"list_reduce(list_prepend({stem}, list_transform(range(length({stem}) + 1), lambda i: '')), lambda a, b: trim({step}))"
    words = f"trim(regexp_replace({rounds}, '[^a-z0-9]+', '_', 'g'), '_')"
    return f"substr(CASE WHEN {words} = '' THEN 'audio' ELSE {words} END, 1, 64)"


def _sanitized_sql(rows: str, raw: str) -> str:
    """rows with clean: the sanitized base name of raw (ASCII)."""
    return rf"""(SELECT *, CASE WHEN regexp_matches(base, '^[0-9]{{3,4}}_[a-z0-9_]+_[0-9a-fA-F]{{8}}\.mp3$') THEN base ELSE {_clean_sql('stem')} || coalesce('.' || ext, '') END AS clean FROM
 (SELECT *, CASE WHEN ext IS NULL THEN lower(base) ELSE regexp_replace(lower(base), '^(.+)\.[^.]*$', '\1') END AS stem FROM
 (SELECT *, CASE WHEN lower(regexp_extract(base, '^.+\.([^.]*)$', 1)) IN {_EXTS} THEN lower(regexp_extract(base, '^.+\.([^.]*)$', 1)) END AS ext FROM
 (SELECT *, regexp_extract({raw}, '([^/]*)/*$', 1) AS base FROM {rows}))))"""


_CLEAN = _sanitized_sql(str(NAMES), "raw")


@query(f"SELECT p_partkey, raw, clean FROM {_CLEAN}")
def sanitize_names(spark, sf_dir):
    return NAMES.frame(spark, sf_dir).select("p_partkey", "raw", S.sanitized(F.col("raw")).alias("clean"))


_SCRIPTS = "CASE doc_id % 7 WHEN 0 THEN 'Тёплый вечер ' || doc_id || '.mp3' WHEN 1 THEN 'Νύχτα ' || doc_id || '.flac' WHEN 2 THEN 'さくらカゼ' || doc_id WHEN 3 THEN '001 - 🎧 ' || doc_id || '.ogg' WHEN 4 THEN '서울 밤 ' || doc_id || '.mp3' WHEN 5 THEN '夜 ' || doc_id || '.mp3' ELSE 'Œuvre Łódź ñ' || doc_id || '.mp3' END"
SCRIPT_NAMES = Bound("documents", doc_id="doc_id", raw=_SCRIPTS)
_SPELLED = ", ".join(f"'{c}': '{(S.spellings() | S.SPELLED | dict(zip(S._FROM, S._TO)))[c]}'" for c in sorted(set(re.findall(r"[^\x00-\x7f]", _SCRIPTS)) - set("夜")))
_SCRIPT_ROWS = f"(SELECT *, array_to_string(list_transform(string_split(raw, ''), lambda c: coalesce((MAP {{{_SPELLED}}})[c], c)), '') AS spelled FROM {SCRIPT_NAMES})"


@query(f"SELECT doc_id, raw, clean FROM {_sanitized_sql(_SCRIPT_ROWS, 'spelled')}")
def names_in_other_scripts(spark, sf_dir):
    return SCRIPT_NAMES.frame(spark, sf_dir).select("doc_id", "raw", S.sanitized(F.col("raw")).alias("clean"))


_PARTS = rf"(SELECT *, regexp_replace(nm, '^(.+)\.[^.]*$', '\1') AS st, regexp_extract(nm, '^.+\.([^.]*)$', 1) AS ex FROM (SELECT *, regexp_extract(raw, '([^/]*)/*$', 1) AS nm FROM {NAMES}))"
_PARTS = f"(SELECT p_partkey, raw, clean AS cs, ex AS part FROM {_sanitized_sql(_PARTS, 'st')})"


@query(f"SELECT p_partkey, raw, CASE WHEN length(e) >= 32 THEN substr(cs, 1, 32) ELSE substr(cs, 1, (32 - length(e))::INT) || e END AS name FROM (SELECT *, '.' || regexp_replace(clean, '[^A-Za-z0-9_-]', '', 'g') AS e FROM {_sanitized_sql(_PARTS, 'part')})")
def transfer_names(spark, sf_dir):
    return NAMES.frame(spark, sf_dir).select("p_partkey", "raw", S.transferred(F.col("raw")).alias("name"))


@query(rf"""SELECT p_partkey, printf('%04d_', p_partkey) || substr(regexp_replace(clean, '^(.+)\.[^.]*$', '\1'), 1, (32 - length(printf('%04d_', p_partkey)) - length(tail))::INT) || tail AS name
FROM (SELECT *, CASE WHEN regexp_matches(clean, '^.+\.[^.]+$') THEN '.' || regexp_extract(clean, '^.+\.([^.]*)$', 1) ELSE '' END AS tail FROM {_CLEAN})""")
def sequential_prefix(spark, sf_dir):
    return NAMES.frame(spark, sf_dir).select("p_partkey", S.prefixed(S.sanitized(F.col("raw")), F.col("p_partkey")).alias("name"))


@query(rf"""SELECT p_partkey, CASE WHEN regexp_matches(part_stem, '^[0-9]{{3,4}}_[a-z0-9_]+_[0-9a-fA-F]{{8}}$') THEN part_stem || '.mp3'
 ELSE printf('%04d_', p_partkey) || substr(clean || repeat('_', 32), 1, (19 - length(printf('%04d_', p_partkey)))::INT) || '_' || h || '.mp3' END AS name FROM
(SELECT *, CASE WHEN length(regexp_replace(sha, '[^0-9a-fA-F]', '', 'g')) >= 8 THEN lower(substr(regexp_replace(sha, '[^0-9a-fA-F]', '', 'g'), 1, 8)) ELSE '00000000' END AS h
 FROM {_sanitized_sql("(SELECT *, regexp_replace(regexp_extract(raw, '([^/]*)/*$', 1), '^(.+)[.][^.]*$', '" + chr(92) + "1') AS part_stem FROM " + str(NAMES) + ")", "part_stem")})""")
def hashed_legacy_name(spark, sf_dir):
    stem = S.file_stem(S.base_name(F.col("raw")))
    return NAMES.frame(spark, sf_dir).select("p_partkey", S.hashed(stem, F.col("p_partkey"), F.col("sha")).alias("name"))


@query(rf"""SELECT p_partkey, regexp_replace(name, '^(.+)\.[^.]*$', '\1') || '.mp3' AS forced, 'VOL_' || printf('%02d', p_partkey // 50 + 1) || '/' || name AS expected FROM {FILE_NAMES}""")
def forced_and_expected(spark, sf_dir):
    rows = FILE_NAMES.frame(spark, sf_dir)
    return rows.select("p_partkey", S.as_mp3(F.col("name")).alias("forced"), V.expected_path(F.col("p_partkey"), F.col("name")).alias("expected"))


@query(f"""SELECT doc_id, name, row_number() OVER (ORDER BY k, name) AS rank FROM (SELECT *, array_to_string(list_transform(regexp_extract_all(translate(name, {_ALPHABET}), '([0-9]+|[^0-9]+)', 1),
 lambda p: CASE WHEN regexp_matches(p, '^[0-9]') THEN '0' || printf('%04d', length(coalesce(nullif(ltrim(p, '0'), ''), '0'))) || coalesce(nullif(ltrim(p, '0'), ''), '0') || printf('%04d', length(p)) ELSE p END), '') AS k FROM {MIXED_NAMES})""")
def natural_sort_rank(spark, sf_dir):
    return C.numbered(MIXED_NAMES.frame(spark, sf_dir), [N.natural_key(F.col("name")), F.col("name")], 1, "rank")


@query(f"SELECT path, row_number() OVER (ORDER BY string_split(path, '/'), path) AS rank FROM {TREE}")
def path_component_order(spark, sf_dir):
    return C.numbered(TREE.frame(spark, sf_dir).select("path"), R.path_order(), 1, "rank")


@query(f"""SELECT path, regexp_matches(path, '(^|/)[.]') AS hidden, length(path) - length(replace(path, '/', '')) AS depth FROM {TREE} WHERE length(path) - length(replace(path, '/', '')) <= 1""")
def hidden_and_depth(spark, sf_dir):
    rows = TREE.frame(spark, sf_dir).select("path", V.hidden(F.col("path")).alias("hidden"), V.depth(F.col("path")).cast("long").alias("depth"))
    return rows.where("depth <= 1")


@query(f"SELECT count(DISTINCT sha) AS hashes, count(*) AS files, coalesce(avg(size) / 1048576.0, 0.0) AS average_mb FROM {SOURCE}")
def content_totals(spark, sf_dir):
    return SOURCE.frame(spark, sf_dir).agg(
        F.count_distinct("sha").alias("hashes"), F.count(F.lit(1)).alias("files"), F.coalesce(D.megabytes(F.avg("size")), F.lit(0.0)).alias("average_mb"))


@query(f"SELECT folder, sum(size)::BIGINT AS bytes, count(*) AS files FROM (SELECT size, array_to_string(list_slice(p, 1, k), '/') AS folder FROM (SELECT size, p, unnest(range(0, len(p))) AS k FROM (SELECT size, string_split(path, '/') AS p FROM {TREE}))) GROUP BY folder")
def folder_sizes(spark, sf_dir):
    return R.folder_sizes(TREE.frame(spark, sf_dir))


_STRAY = f"(SELECT path FROM {TARGET} WHERE folder = 'musica')"
_TAGGED = f"""(SELECT s.path, s.size, CASE WHEN h.h8 IS NOT NULL THEN 'skip' WHEN w.d IS NOT NULL THEN 'displaced' ELSE 'new' END AS action, CASE WHEN h.h8 IS NULL THEN w.d END AS displaced_from FROM {SOURCE} s
 LEFT JOIN (SELECT DISTINCT substr(sha, 1, 8) AS h8 FROM {TARGET} WHERE folder <> 'musica') h ON substr(s.sha, 1, 8) = h.h8 LEFT JOIN (SELECT sha, min(path) AS d FROM {TARGET} WHERE folder = 'musica' GROUP BY sha) w ON s.sha = w.sha)"""
_UNTRACKED = f"""(SELECT path FROM {_STRAY} WHERE path NOT IN (SELECT displaced_from FROM {_TAGGED} WHERE displaced_from IS NOT NULL)
 UNION ALL SELECT path FROM {TARGET} WHERE folder <> 'musica' AND name NOT IN (SELECT name FROM {KNOWN}))"""


def _tagged(spark, sf_dir) -> DataFrame:
    return C.sync_diff(SOURCE.frame(spark, sf_dir), TARGET.frame(spark, sf_dir)).where("action <> 'untracked'")


@query(f"SELECT path FROM {_UNTRACKED}")
def sync_untracked(spark, sf_dir):
    moved = _tagged(spark, sf_dir).where("displaced_from IS NOT NULL").select(F.col("displaced_from").alias("path"))
    return Y.untracked(TARGET.frame(spark, sf_dir), moved, KNOWN.frame(spark, sf_dir))


@query(f"""SELECT count(*) FILTER (action = 'skip') AS skipped, count(*) FILTER (action <> 'skip') AS to_process, count(*) FILTER (action = 'displaced') AS displaced, (SELECT count(*) FROM {_UNTRACKED}) AS untracked,
 (SELECT max(doc_id) FROM {TARGET} WHERE folder <> 'musica') AS max_index, (SELECT count(DISTINCT folder) FROM {TARGET} WHERE folder <> 'musica') AS volumes, (SELECT max(doc_id) FROM {TARGET} WHERE folder <> 'musica') + 1 AS next_index FROM {_TAGGED}""")
def sync_diff_summary(spark, sf_dir):
    return Y.summary(SOURCE.frame(spark, sf_dir), TARGET.frame(spark, sf_dir), KNOWN.frame(spark, sf_dir))


@query(f"SELECT t.path, t.action, t.displaced_from, coalesce(t.path = f.first, false) AS moves FROM {_TAGGED} t LEFT JOIN (SELECT displaced_from, arg_min(path, (string_split(path, '/'), path)) AS first FROM {_TAGGED} WHERE action = 'displaced' GROUP BY displaced_from) f USING (displaced_from)")
def displaced_winners(spark, sf_dir):
    return Y.displaced_winners(_tagged(spark, sf_dir))


@query(f"SELECT CASE action WHEN 'skip' THEN 'skip' WHEN 'displaced' THEN 'move' ELSE 'provision' END AS action, count(*) AS files, sum(size)::BIGINT AS bytes FROM {_TAGGED} GROUP BY 1 UNION ALL SELECT 'quarantine', count(*), sum(size)::BIGINT FROM {TARGET} WHERE path IN (SELECT path FROM {_UNTRACKED})")
def plan_summary(spark, sf_dir):
    source, target = SOURCE.frame(spark, sf_dir), TARGET.frame(spark, sf_dir)
    tagged = _tagged(spark, sf_dir).join(source.select("path", "size"), "path")
    return R.plan_summary(tagged, target.join(sync_untracked(spark, sf_dir), "path", "left_semi").select("size"))


_COUNTS = f"(SELECT doc_id // 50 + 1 AS volume, count(*) AS files FROM {TARGET} WHERE folder <> 'musica' GROUP BY 1)"
_START = f"(SELECT CASE WHEN files >= 50 THEN volume + 1 ELSE volume END AS v, CASE WHEN files >= 50 THEN 0 ELSE files END AS c FROM {_COUNTS} ORDER BY volume DESC LIMIT 1)"
_PLANNED = f"(SELECT path, row_number() OVER (ORDER BY path) AS r FROM {_TAGGED} WHERE action = 'new')"
_PLAN = f"(SELECT path, r + 699 AS idx, v + (c + r - 1) // 50 AS volume FROM {_PLANNED}, {_START})"


def _incremental(spark, sf_dir) -> DataFrame:
    new = _tagged(spark, sf_dir).where("action = 'new'").select("path")
    return Y.incremental_plan(new, Y.volume_counts(TARGET.frame(spark, sf_dir)), [F.col("path")], 700)


@query(f"SELECT path, idx, volume FROM {_PLAN}")
def plan_volumes_incremental(spark, sf_dir):
    return _incremental(spark, sf_dir)


@query(f"SELECT path, idx, volume, coalesce(lead(volume) OVER (ORDER BY idx) <> volume, true) AS flush FROM {_PLAN}")
def volume_flushes(spark, sf_dir):
    return Y.flushes(_incremental(spark, sf_dir))


@query(f"""SELECT greatest(coalesce(max(try_cast(regexp_extract(name, '^([0-9]{{3,4}})_', 1) AS BIGINT)), 0) + 1, 1) AS next_index,
 coalesce(bool_or(regexp_matches(name, '^[0-9]{{3}}_')), false) AND coalesce(bool_or(regexp_matches(name, '^[0-9]{{4}}_')), false) AS mixed FROM (SELECT name FROM {FILE_NAMES} UNION ALL SELECT name FROM {KNOWN})""")
def prefix_width_mix(spark, sf_dir):
    return Y.prefix_widths(FILE_NAMES.frame(spark, sf_dir).select("name").unionByName(KNOWN.frame(spark, sf_dir)))


_PARTS = f"(SELECT path, string_split(path, '/') AS p FROM {TREE} WHERE path NOT LIKE '.%')"


_FINDINGS = f"""(SELECT 'warning' AS severity, 'root_orphan' AS code, path AS subject FROM {_PARTS} WHERE len(p) = 1
 UNION ALL SELECT DISTINCT 'warning', 'other_folder', p[1] FROM {_PARTS} WHERE len(p) > 1 AND p[1] NOT LIKE 'VOL!_%' ESCAPE '!'
 UNION ALL SELECT DISTINCT 'error', 'nesting', p[1] || '/' || p[2] FROM {_PARTS} WHERE len(p) > 2 AND p[1] LIKE 'VOL!_%' ESCAPE '!'
 UNION ALL SELECT 'error', 'long_name', path FROM {_PARTS} WHERE len(p) = 2 AND p[1] LIKE 'VOL!_%' ESCAPE '!' AND strlen(p[2]) > 32
 UNION ALL SELECT 'error', 'not_ascii', path FROM {_PARTS} WHERE len(p) = 2 AND p[1] LIKE 'VOL!_%' ESCAPE '!' AND regexp_matches(p[2], '[^\\x00-\\x7F]')
 UNION ALL SELECT 'error', 'overfull', p[1] FROM {_PARTS} WHERE len(p) = 2 AND p[1] LIKE 'VOL!_%' ESCAPE '!' GROUP BY p[1] HAVING count(*) > 50)"""


@query(f"SELECT * FROM {_FINDINGS}")
def topology_findings(spark, sf_dir):
    return V.topology_findings(TREE.frame(spark, sf_dir))


@query(f"""SELECT CASE WHEN bool_or(n LIKE 'VOL!_%' ESCAPE '!') THEN 'managed' ELSE 'user_content' END AS policy, array_to_string(list_sort(list(n) FILTER (n NOT LIKE 'VOL!_%' ESCAPE '!')), '|') AS entries FROM (SELECT DISTINCT string_split(path, '/')[1] AS n FROM {TREE})""")
def root_policy(spark, sf_dir):
    return V.root_policy(TREE.frame(spark, sf_dir)).select("policy", F.array_join("entries", "|").alias("entries"))


_INTEGRITY = f"""(SELECT c.idx, c.path, CASE WHEN d.sha IS NULL THEN 'missing' WHEN c.checksum IS NULL THEN 'no_hash' WHEN NOT regexp_matches(c.checksum, '^[0-9a-fA-F]{{64}}$') THEN 'bad_hash' WHEN c.checksum <> d.sha THEN 'mismatch' ELSE 'ok' END AS status
 FROM (SELECT *, 'VOL_' || printf('%02d', idx // 50 + 1) || '/' || name AS path FROM {CHECKPOINT} WHERE status = 'completed') c LEFT JOIN {DISK} d USING (path))"""


@query(f"SELECT * FROM {_INTEGRITY}")
def integrity_check(spark, sf_dir):
    return V.integrity(CHECKPOINT.frame(spark, sf_dir), DISK.frame(spark, sf_dir))


@query(f"SELECT count(*) FILTER (status <> 'missing') AS present, count(*) FILTER (status <> 'ok') AS errors, CASE WHEN bool_or(status IN ('mismatch', 'no_hash', 'bad_hash')) THEN 'corrupted' WHEN bool_or(status = 'missing') THEN 'incomplete' ELSE 'ok' END AS state FROM {_INTEGRITY}")
def integrity_state(spark, sf_dir):
    return V.integrity_summary(integrity_check(spark, sf_dir))


@query(f"""SELECT count(*) AS run, min(idx) AS first_idx FROM (SELECT *, sum((status = 'ok')::INT) OVER (ORDER BY idx) AS island FROM {_INTEGRITY} WHERE status IN ('ok', 'mismatch')) WHERE status = 'mismatch' GROUP BY island HAVING count(*) >= 5""")
def fraud_runs(spark, sf_dir):
    return V.fraud_runs(integrity_check(spark, sf_dir))


@query(f"SELECT * FROM {_FINDINGS} UNION ALL SELECT 'error', status, path FROM {_INTEGRITY} WHERE status <> 'ok' AND NOT EXISTS (SELECT 1 FROM {_FINDINGS} WHERE severity = 'error')")
def pre_eject(spark, sf_dir):
    return V.pre_eject(TREE.frame(spark, sf_dir), CHECKPOINT.frame(spark, sf_dir), DISK.frame(spark, sf_dir))


@query(f"""SELECT idx FROM {CHECKPOINT} WHERE error IS DISTINCT FROM 'Skipped_DRM' AND (status <> 'completed' OR checksum IS NULL OR length(checksum) <> 64 OR error IS NOT NULL)
 UNION SELECT min(idx) FROM {CHECKPOINT} GROUP BY name HAVING name IN (SELECT string_split(path, '/')[2] FROM {_INTEGRITY} WHERE status IN ('mismatch', 'no_hash', 'bad_hash'))""")
def recovery_candidates(spark, sf_dir):
    return V.recovery_candidates(CHECKPOINT.frame(spark, sf_dir), DISK.frame(spark, sf_dir))


@query(f"SELECT path FROM {DISK} WHERE size = 0 AND path NOT IN (SELECT 'VOL_' || printf('%02d', idx // 50 + 1) || '/' || name FROM {CHECKPOINT} WHERE idx % 2 = 0)")
def zero_byte_orphans(spark, sf_dir):
    return V.zero_byte_orphans(DISK.frame(spark, sf_dir), CHECKPOINT.frame(spark, sf_dir).where("idx % 2 = 0"))


FOLDERS = Bound("nation", name="CASE n_nationkey % 4 WHEN 0 THEN 'VOL_' || n_nationkey WHEN 1 THEN '.' || n_name WHEN 2 THEN 'musica' ELSE n_name END")


@query(f"SELECT name FROM {FOLDERS} WHERE name NOT LIKE 'VOL!_%' ESCAPE '!' AND name NOT LIKE '.%' AND name NOT IN (SELECT string_split(path, '/')[1] FROM {TREE} WHERE contains(path, '/'))")
def purge_folders(spark, sf_dir):
    return V.empty_roots(FOLDERS.frame(spark, sf_dir), TREE.frame(spark, sf_dir))


@query(f"SELECT path FROM {SOURCE} WHERE sha NOT IN (SELECT sha FROM {TARGET}) ORDER BY path LIMIT 5")
def strict_parity_source(spark, sf_dir):
    return V.parity_missing(SOURCE.frame(spark, sf_dir), TARGET.frame(spark, sf_dir))


@query(f"""SELECT * FROM (SELECT c.path, CASE WHEN d.sha IS NULL THEN 'missing' WHEN d.sha <> c.sha THEN 'hash_mismatch' END AS status FROM (SELECT 'VOL_' || printf('%02d', idx // 50 + 1) || '/' || name AS path, checksum AS sha FROM {CHECKPOINT} WHERE checksum IS NOT NULL) c LEFT JOIN {DISK} d USING (path)) WHERE status IS NOT NULL ORDER BY path LIMIT 5""")
def strict_parity_drift(spark, sf_dir):
    rows = CHECKPOINT.frame(spark, sf_dir).where("checksum IS NOT NULL")
    return V.parity_drift(rows.select(V.expected_path(F.col("idx"), F.col("name")).alias("path"), F.col("checksum").alias("sha")), DISK.frame(spark, sf_dir))


@query(f"SELECT coalesce(bool_and(coalesce(c.sha = d.sha, false)), true) AS valid, count(*) AS files FROM (SELECT 'VOL_' || printf('%02d', idx // 50 + 1) || '/' || name AS path, checksum AS sha FROM {CHECKPOINT} WHERE status = 'completed') c LEFT JOIN {DISK} d USING (path)")
def backup_valid(spark, sf_dir):
    rows = CHECKPOINT.frame(spark, sf_dir).where("status = 'completed'")
    return V.backup_valid(rows.select(V.expected_path(F.col("idx"), F.col("name")).alias("path"), F.col("checksum").alias("sha")), DISK.frame(spark, sf_dir))


OLD = Bound("documents", "doc_id % 4 = 0", name="lang || ' ' || doc_id || '.mp3'", size="CASE WHEN doc_id % 8 = 0 THEN BYTES(text) ELSE 1 END", sha="CASE WHEN doc_id % 16 = 0 THEN SHA('x') ELSE SHA(text) END")


@query(f"SELECT s.name, coalesce(s.size = o.size AND s.sha = o.sha, false) AS same, CASE WHEN o.name IS NULL THEN s.name ELSE regexp_replace(s.name, '[.]mp3$', '_1.mp3') END AS stored FROM {SOURCE} s LEFT JOIN {OLD} o USING (name)")
def backup_names(spark, sf_dir):
    rows = V.identical(SOURCE.frame(spark, sf_dir).select("doc_id", "name", "size", "sha"), OLD.frame(spark, sf_dir))
    return beside(rows, OLD.frame(spark, sf_dir), "name", "doc_id", "stored").select("name", "same", "stored")


_FAMILY = "'f' || doc_id // 25 || CASE doc_id * 7 % 11 WHEN 0 THEN '_1' WHEN 1 THEN '_2' WHEN 2 THEN '_1_1' WHEN 3 THEN '_001' WHEN 4 THEN '_002' WHEN 5 THEN '_001_001' ELSE '' END || CASE WHEN doc_id % 25 = 24 THEN '' ELSE '.mp3' END"
ARRIVALS = Bound("documents", fam="doc_id // 25", seq="doc_id * 7919 % 104729", name=_FAMILY, sha="'h' || doc_id % 4")
STANDING = Bound("documents", "doc_id % 25 IN (3, 9)", fam="doc_id // 25", name="'f' || doc_id // 25 || CASE WHEN doc_id % 50 = 3 THEN '_3' WHEN doc_id % 25 = 9 THEN '' ELSE '_1' END || '.mp3'", sha="'h' || doc_id % 4")


def _named_sql(standing: str, text: str, same: str) -> str:
    """Names given one after the other, the n-th of every family at once; held maps a family's names to their contents."""
    dot = "(CASE WHEN name LIKE '%.mp3' THEN '.mp3' ELSE '' END)"
    made = f"replace(name, '.mp3', '') || '_' || {text} || {dot}"
    return f"""WITH RECURSIVE q AS (SELECT *, row_number() OVER (PARTITION BY fam ORDER BY seq) AS n FROM {ARRIVALS}),
 b AS (SELECT fam, coalesce(any_value(names), []::VARCHAR[]) AS names, coalesce(any_value(shas), []::VARCHAR[]) AS shas FROM q LEFT JOIN (SELECT fam, list(name) AS names, list(sha) AS shas FROM {standing} GROUP BY fam) USING (fam) GROUP BY fam),
 st AS (SELECT fam, 0::BIGINT AS n, names, shas, NULL::BIGINT AS seq, NULL::VARCHAR AS name, NULL::VARCHAR AS stored FROM b
 UNION ALL SELECT fam, n, CASE WHEN stored IS NULL THEN names ELSE list_append(names, stored) END, CASE WHEN stored IS NULL THEN shas ELSE list_append(shas, sha) END, seq, name, stored FROM
 (SELECT st.fam, q.n, st.names, st.shas, q.seq, q.name, q.sha, CASE WHEN NOT list_contains(st.names, q.name) THEN q.name WHEN {same} THEN NULL ELSE list_filter(list_transform(range(1, 60), lambda k: {made.replace('name', 'q.name')}), lambda c: NOT list_contains(st.names, c))[1] END AS stored
 FROM st JOIN q ON q.fam = st.fam AND q.n = st.n + 1))
 SELECT seq, name, stored FROM st WHERE seq IS NOT NULL"""


@query(_named_sql(f"(SELECT * FROM {ARRIVALS} WHERE false)", "CASE WHEN k < 1000 THEN printf('%03d', k) ELSE k::VARCHAR END", "false"))
def mixed_collision_names(spark, sf_dir):
    return resolve(ARRIVALS.frame(spark, sf_dir).select("seq", "name"), out="stored")


@query(_named_sql(str(STANDING), "k", "list_extract(st.shas, list_position(st.names, q.name)) = q.sha"))
def backup_plan(spark, sf_dir):
    files = ARRIVALS.frame(spark, sf_dir).select("seq", "name", "sha")
    return backed_up(files, STANDING.frame(spark, sf_dir).select("name", "sha")).select("seq", "name", "stored")


@query(f"SELECT p.idx, p.path, coalesce(d.sha = p.checksum AND p.status = 'completed', false) AS skip FROM (SELECT *, 'VOL_' || printf('%02d', idx // 50 + 1) || '/' || name AS path FROM {CHECKPOINT}) p LEFT JOIN {DISK} d USING (path)")
def resume_skip(spark, sf_dir):
    rows = CHECKPOINT.frame(spark, sf_dir)
    plan = rows.select("idx", V.expected_path(F.col("idx"), F.col("name")).alias("path"))
    return V.resumable(plan, rows.where("status = 'completed'").select("idx", F.col("checksum").alias("sha")), DISK.frame(spark, sf_dir))


@query(f"""SELECT idx, path, 'VOL_' || printf('%02d', idx // 50 + 1) AS volume, name, 'VOL_' || printf('%02d', idx // 50 + 1) || '/' || name AS destination FROM (SELECT idx, raw AS path, printf('%04d_', idx + 1) || substr(regexp_replace(clean, '^(.+)\\.[^.]*$', '\\1'), 1, (27 - length(tail))::INT) || tail AS name FROM
 (SELECT *, row_number() OVER (ORDER BY string_split(raw, '/'), raw, p_partkey) - 1 AS idx, CASE WHEN regexp_matches(clean, '^.+\\.[^.]+$') THEN '.' || regexp_extract(clean, '^.+\\.([^.]*)$', 1) ELSE '' END AS tail FROM {_CLEAN}))""")
def in_place_plan(spark, sf_dir):
    return R.in_place_plan(NAMES.frame(spark, sf_dir).select(F.col("raw").alias("path")))


STEPS = Bound("events", seq="event_id", idx="user_id", target="user_id", name="'n' || event_id", checksum="'c' || event_id", error="'e' || event_id",
              kind="CASE event_id % 7 WHEN 0 THEN 'start' WHEN 1 THEN 'completed' WHEN 2 THEN 'failed' WHEN 3 THEN 'renamed' ELSE 'start' END",
              move="CASE event_id % 7 WHEN 0 THEN 'ensure' WHEN 1 THEN 'in_progress' WHEN 2 THEN 'committed' WHEN 3 THEN 'failed' ELSE 'ensure' END")


_CK_STEP = """CASE WHEN e.kind = 'start' THEN {s: 'in_progress', n: e.name, c: NULL::VARCHAR, e: NULL::VARCHAR, r: a.r} WHEN a.s = 'unknown' OR e.kind NOT IN ('completed', 'failed', 'renamed') THEN {s: a.s, n: a.n, c: a.c, e: a.e, r: a.r + 1}
 WHEN e.kind = 'completed' THEN {s: 'completed', n: a.n, c: e.checksum, e: NULL::VARCHAR, r: a.r} WHEN e.kind = 'failed' THEN {s: 'failed', n: a.n, c: a.c, e: e.error, r: a.r} ELSE {s: a.s, n: e.name, c: a.c, e: a.e, r: a.r} END"""
_JOURNAL_STEP = """CASE WHEN e.kind = 'ensure' THEN CASE WHEN a.s = 'committed' THEN a ELSE {s: 'pending', e: NULL::VARCHAR, r: a.r} END WHEN a.s = 'unknown' OR e.kind NOT IN ('in_progress', 'committed', 'failed') THEN {s: a.s, e: a.e, r: a.r + 1}
 ELSE {s: e.kind, e: CASE WHEN e.kind = 'failed' THEN e.error END, r: a.r} END"""


def _fold_sql(rows: str, key: str, first: str, step: str, out: str) -> str:
    """Events taken one after the other, the n-th of every key at once."""
    return f"""WITH RECURSIVE ev AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY seq) AS n FROM {rows}),
 st AS (SELECT DISTINCT {key}, 0::BIGINT AS n, {first} AS a FROM ev UNION ALL SELECT st.{key}, st.n + 1, {step} FROM st JOIN ev e ON e.{key} = st.{key} AND e.n = st.n + 1)
 SELECT {key}, {out} FROM st WHERE n = (SELECT count(*) FROM ev WHERE ev.{key} = st.{key})"""


@query(_fold_sql(str(STEPS), "idx", "{s: 'unknown', n: NULL::VARCHAR, c: NULL::VARCHAR, e: NULL::VARCHAR, r: 0::BIGINT}", _CK_STEP, "a.n AS name, a.s AS status, a.c AS checksum, a.e AS error, a.r AS rejected"))
def checkpoint_latest(spark, sf_dir):
    return T.checkpoint_state(STEPS.frame(spark, sf_dir))


@query(f"SELECT count(*) FILTER (status = 'completed') AS completed, max(idx) FILTER (status = 'completed') AS last_completed, (count(*) FILTER (status = 'completed') * 100.0 / 4096)::FLOAT AS percentage, count(*) > 0 AS recoverable FROM {CHECKPOINT}")
def checkpoint_progress(spark, sf_dir):
    return T.checkpoint_progress(CHECKPOINT.frame(spark, sf_dir), 4096)


@query(_fold_sql(f"(SELECT seq, target, move AS kind, error FROM {STEPS})", "target", "{s: 'unknown', e: NULL::VARCHAR, r: 0::BIGINT}", _JOURNAL_STEP, "a.s AS status, a.e AS error, a.r AS rejected"))
def journal_machine(spark, sf_dir):
    return T.journal_state(STEPS.frame(spark, sf_dir).select("seq", "target", F.col("move").alias("kind"), "error"))


RUNS = Bound("customer", run="c_custkey", total="c_custkey % 40", operation="CASE c_custkey % 3 WHEN 0 THEN 'completed' WHEN 1 THEN 'failed' ELSE 'in_progress' END")
RUN_ROWS = Bound("orders", run="o_custkey", idx="o_orderkey", status="CASE o_orderkey % 9 WHEN 0 THEN 'in_progress' WHEN 1 THEN 'failed' ELSE 'completed' END")


@query(f"""SELECT run, count(*) FILTER (status = 'completed') AS completed, max(idx) FILTER (status = 'completed') AS last_completed,
 (CASE WHEN any_value(total) = 0 THEN 100.0 ELSE count(*) FILTER (status = 'completed') * 100.0 / any_value(total) END)::FLOAT AS percentage, any_value(operation) = 'in_progress' AND count(idx) > 0 AS recoverable
 FROM {RUNS} LEFT JOIN {RUN_ROWS} USING (run) GROUP BY run""")
def checkpoints_progress(spark, sf_dir):
    return T.checkpoints_progress(RUN_ROWS.frame(spark, sf_dir), RUNS.frame(spark, sf_dir))


JOURNAL = Bound("orders", target=_DISK_PATH, source="'in/' || o_orderkey", hash=f"CASE WHEN o_orderkey % 5 = 0 THEN 'other' ELSE {_OWN} END", status="CASE o_orderkey % 4 WHEN 0 THEN 'committed' WHEN 1 THEN 'failed' ELSE 'pending' END", seq="o_orderkey")
INPUTS = Bound("orders", "o_orderkey % 3 = 0", path="'in/' || o_orderkey")


@query(f"SELECT j.target, CASE WHEN j.status = 'committed' OR d.sha = j.hash THEN 'committed' WHEN j.source IN (SELECT path FROM {INPUTS}) THEN 'pending' ELSE 'failed' END AS status FROM {JOURNAL} j LEFT JOIN {DISK} d ON j.target = d.path")
def journal_reconcile(spark, sf_dir):
    return T.journal_reconciled(JOURNAL.frame(spark, sf_dir), DISK.frame(spark, sf_dir), INPUTS.frame(spark, sf_dir))


@query(f"SELECT t.path AS target, j.status FROM {TREE} t LEFT JOIN (SELECT target, arg_min(status, seq) AS status FROM {JOURNAL} GROUP BY target) j ON j.target = t.path UNION ALL SELECT d.path, j.status FROM {DISK} d JOIN {JOURNAL} j ON j.target = d.path")
def journal_lookup(spark, sf_dir):
    targets = TREE.frame(spark, sf_dir).select(F.col("path").alias("target")).unionByName(DISK.frame(spark, sf_dir).select(F.col("path").alias("target")))
    return T.status_for(JOURNAL.frame(spark, sf_dir), targets)


ENTRIES = Bound("events", seq="event_id", name="'f' || event_id % 300", sha="'h' || user_id % 40", size="event_id * 2", path="'VOL_01/f' || event_id")


@query(f"SELECT sha, arg_max(name, seq) AS name, arg_max(size, seq) AS size, arg_max(path, seq) AS path, max(seq) AS seq FROM {ENTRIES} GROUP BY sha")
def manifest_upsert(spark, sf_dir):
    return T.manifest(ENTRIES.frame(spark, sf_dir))


@query(f"SELECT name, arg_max(sha, seq) AS sha FROM {ENTRIES} GROUP BY name")
def manifest_name_index(spark, sf_dir):
    return T.manifest_names(ENTRIES.frame(spark, sf_dir))


WANTED = Bound("nation", sha="'h' || n_nationkey * 3")


@query(f"SELECT w.sha, m.sha IS NOT NULL AS seen, m.name FROM {WANTED} w LEFT JOIN (SELECT sha, arg_max(name, seq) AS name FROM {ENTRIES} GROUP BY sha) m USING (sha)")
def already_processed(spark, sf_dir):
    return T.already_processed(T.manifest(ENTRIES.frame(spark, sf_dir)), WANTED.frame(spark, sf_dir))


_STREAM = """'{"codec_type":"' || CASE p_partkey % 3 WHEN 0 THEN 'video' ELSE 'audio' END || '","codec_name":"' || CASE p_partkey % 2 WHEN 0 THEN 'mp3' ELSE 'flac' END || '","bit_rate":"' || CASE p_partkey % 5 WHEN 0 THEN 'N/A' ELSE CAST(p_size * 8000 AS STRING) END || '","sample_rate":"44100","disposition":{"attached_pic":' || CASE WHEN p_partkey % 7 = 0 THEN 1 ELSE 0 END || '},"tags":{' || CASE WHEN p_partkey % 4 = 0 THEN '"Title":"x"' ELSE '' END || '}}'"""
PROBES = Bound("part", p_partkey="p_partkey", json=f"""'{{"streams":[' || CASE WHEN p_partkey % 11 = 0 THEN '' ELSE {_STREAM} END || CASE WHEN p_partkey % 11 <> 0 AND p_partkey % 3 = 0 AND p_partkey % 2 = 0 THEN ',{{"codec_type":"audio","bit_rate":"128000","sample_rate":"44100"}}' ELSE '' END || '],"format":{{"tags":{{' || CASE WHEN p_partkey % 9 = 0 THEN '"APIC":"y"' ELSE '' END || '}}}}}}'""")
_PROBE_SQL = f"""(SELECT p_partkey, json, list_concat(list_filter(s, lambda x: x->>'codec_type' = 'audio'), s)[1] AS one, s, coalesce(len(list_filter(s, lambda x: coalesce((x->'disposition'->>'attached_pic') = '1', false) OR len(list_filter(json_keys(coalesce(x->'tags', '{{}}'::JSON)), lambda k: lower(k) IN ('apic', 'covr', 'metadata_block_picture'))) > 0)) > 0, false)
 OR len(list_filter(json_keys(json->'format'->'tags'), lambda k: lower(k) IN ('apic', 'covr', 'metadata_block_picture'))) > 0 AS cover, len(list_filter(s, lambda x: x->>'codec_type' = 'video')) > 0 AS video,
 len(list_filter(s, lambda x: len(json_keys(coalesce(x->'tags', '{{}}'::JSON))) > 0)) > 0 OR len(json_keys(json->'format'->'tags')) > 0 AS tags FROM (SELECT p_partkey, json::JSON AS json, (json::JSON->'streams')::JSON[] AS s FROM {PROBES}))"""


@query(f"""SELECT p_partkey, cover, video, tags, CASE WHEN one IS NOT NULL THEN coalesce(one->>'codec_name', 'unknown') END AS codec, CASE WHEN one IS NOT NULL THEN coalesce(try_cast(one->>'bit_rate' AS BIGINT), 0) END AS bitrate, CASE WHEN one IS NOT NULL THEN coalesce(try_cast(one->>'sample_rate' AS BIGINT), 0) END AS sample_rate,
 CASE WHEN one->>'codec_name' = 'mp3' AND one->>'sample_rate' = '44100' AND coalesce(try_cast(one->>'bit_rate' AS BIGINT), 0) BETWEEN 120000 AND 320000 THEN CASE WHEN cover OR video OR tags THEN 'copy_clean' ELSE 'rename' END WHEN one IS NOT NULL THEN 'transcode' END AS decision FROM {_PROBE_SQL}""")
def profile_classify(spark, sf_dir):
    rows = PROBES.frame(spark, sf_dir).select("p_partkey", D.parsed_probe(F.col("json")).alias("p"))
    p = F.col("p")
    rows = rows.select("p_partkey", D.has_cover(p).alias("cover"), D.has_video(p).alias("video"), D.has_tags(p).alias("tags"), *[c.alias(n) for n, c in D.profile(p).items()])
    decision = N.media_decision(F.col("codec"), F.col("sample_rate"), F.col("bitrate"), F.col("cover") | F.col("video") | F.col("tags"))
    return rows.withColumn("decision", F.when(F.col("codec").isNotNull(), decision))


PROTECTED = Bound("part", p_partkey="p_partkey", path="p_partkey || CASE WHEN p_partkey % 5 = 0 THEN '.M4P' ELSE '.m4a' END", said="CASE p_partkey % 4 WHEN 0 THEN 'tag: FairPlay' WHEN 1 THEN 'drm_x' ELSE 'clear' END", complained="CASE WHEN p_partkey % 6 = 0 THEN 'Encrypted stream' END", size="p_partkey * p_partkey * 500")


@query(f"SELECT p_partkey, path ILIKE '%.m4p' OR p_partkey % 4 IN (0, 1) OR p_partkey % 6 = 0 AS protected, CASE WHEN size < 1024 THEN 'too_small' WHEN size > 5242880 THEN 'too_large' END AS problem FROM {PROTECTED}")
def drm_and_size(spark, sf_dir):
    rows = PROTECTED.frame(spark, sf_dir)
    return rows.select("p_partkey", D.protected(F.col("path"), F.col("said"), F.col("complained")).alias("protected"), D.size_problem(F.col("size")).alias("problem"))


_DEVICE = "'/dev/' || CASE s_suppkey % 4 WHEN 0 THEN 'loop' || s_suppkey WHEN 1 THEN 'nvme0n1p' || s_suppkey WHEN 2 THEN 'sda' || s_suppkey ELSE 'mmcblk0p' || s_suppkey END"
LINES = Bound("supplier", value=f"CASE WHEN s_suppkey % 10 = 9 THEN 'broken line' WHEN s_suppkey % 10 = 8 THEN 'tmpfs /run tmpfs rw' ELSE {_DEVICE} || '  /mnt/' || s_suppkey || ' ' || CASE s_suppkey % 3 WHEN 0 THEN 'vfat' WHEN 1 THEN 'ext4' ELSE 'fat32' END || ' rw,relatime 0 0' END")
DEVICES = Bound("supplier", s_suppkey="s_suppkey", fs_type="CASE s_suppkey % 3 WHEN 0 THEN 'vfat' WHEN 1 THEN 'ext4' ELSE 'fat32' END", removable="s_suppkey % 2 = 0", unit="CASE s_suppkey % 4 WHEN 0 THEN 32768 WHEN 1 THEN 4096 END",
                total="s_suppkey * 7000000000", label="CASE WHEN s_suppkey % 5 = 0 THEN ' CAB ' END", vendor="CASE WHEN s_suppkey % 5 = 1 THEN '  ' WHEN s_suppkey % 5 = 2 THEN 'V' END", model="CASE WHEN s_suppkey % 5 = 2 THEN 'M x' END", device="'/dev/sd' || s_suppkey", sector="CASE s_suppkey % 4 WHEN 0 THEN 512 WHEN 1 THEN 4096 WHEN 2 THEN 1000 ELSE 0 END")
BLOCKS = Bound("region", block="CASE r_regionkey WHEN 0 THEN 'nvme0n1' WHEN 1 THEN 'sda' WHEN 2 THEN 'mmcblk0' ELSE 'sd' || r_regionkey END", vendor="r_name")


@query(f"SELECT m.*, b.block, i.vendor FROM (SELECT p[1] AS device, p[2] AS mount_point, p[3] AS fs_type FROM (SELECT regexp_split_to_array(trim(value), '\\s+') AS p FROM {LINES}) WHERE len(p) >= 3 AND p[1] LIKE '/dev/%' AND p[1] NOT LIKE '/dev/loop%') m, LATERAL (SELECT CASE WHEN contains(m.device, 'nvme') THEN 'nvme0n1' WHEN contains(m.device, 'mmc') THEN 'mmcblk0' ELSE 'sda' END AS block) b LEFT JOIN {BLOCKS} i ON i.block = b.block")
def mounted_devices(spark, sf_dir):
    return D.joined_identity(D.mounts(LINES.frame(spark, sf_dir)), BLOCKS.frame(spark, sf_dir)).select("device", "mount_point", "fs_type", "block", "vendor")


@query(f"""SELECT s_suppkey, CASE WHEN fs_type = 'ext4' THEN 'filesystem' WHEN NOT removable THEN 'not_removable' END AS refused, fs_type = 'ext4' OR coalesce(unit <> 32768, false) AS reformat, total / 1073741824.0 > 64 AS confirm,
 CASE WHEN label IS NULL AND (vendor IS NULL OR trim(vendor) = '') AND model IS NULL THEN device || '__' || total ELSE concat_ws('__', nullif(trim(label), ''), nullif(trim(vendor), ''), nullif(trim(model), '')) END AS identity, CASE sector WHEN 512 THEN 64 WHEN 4096 THEN 8 END::BIGINT AS sectors FROM {DEVICES}""")
def device_eligibility(spark, sf_dir):
    none = F.lit(None).cast("string")
    key = D.identity_key(F.col("label"), F.col("vendor"), F.col("model"), none, none, F.col("device"), F.col("total"))
    return DEVICES.frame(spark, sf_dir).select(
        "s_suppkey", D.eligibility(F.col("fs_type"), F.col("removable")).alias("refused"), D.needs_reformat(F.col("fs_type"), F.col("unit")).alias("reformat"),
        D.needs_confirmation(F.col("total")).alias("confirm"), key.alias("identity"), D.sectors_per_cluster(F.col("sector")).alias("sectors"))


SECTORS = Bound("supplier", s_suppkey="s_suppkey", sector="CASE s_suppkey % 3 WHEN 0 THEN 512 WHEN 1 THEN 4096 ELSE 0 END", per="s_suppkey % 128", magic="CASE WHEN s_suppkey % 5 = 0 THEN '0000' ELSE '55AA' END")


@query(f"SELECT s_suppkey, CASE WHEN magic = '55AA' AND sector * per > 0 THEN sector * per END::BIGINT AS unit FROM {SECTORS}")
def boot_sectors(spark, sf_dir):
    rows = SECTORS.frame(spark, sf_dir)
    low, high = F.format_string("%02X", F.col("sector") % 256), F.format_string("%02X", F.expr("sector div 256"))
    block = F.unhex(F.concat(F.lit("00" * 11), low, high, F.format_string("%02X", F.col("per")), F.lit("00" * 496), F.col("magic")))
    return rows.select("s_suppkey", D.allocation_unit(block).alias("unit"))


TICKS = Bound("events", event_id="event_id", done="event_id % 8", total="CAST(8 AS BIGINT)", elapsed="event_id % 100", current="'f' || event_id || '.mp3'")


@query(f"SELECT event_id, CASE WHEN done > 0 THEN (elapsed // done) * (total - done) ELSE 0 END AS eta_seconds FROM {TICKS}")
def eta_progress(spark, sf_dir):
    return TICKS.frame(spark, sf_dir).select("event_id", R.eta_seconds(F.col("elapsed"), F.col("done"), F.col("total")).alias("eta_seconds"))


@query(f"""SELECT event_id, '{{"event":"PROGRESS","payload":{{"files_processed":' || done || ',"total_files":8,"percentage":' || (done * 100.0 / 8)::DOUBLE || ',"current_file":"' || current || '","eta_seconds":' || elapsed || '}}}}' AS line FROM {TICKS}""")
def ipc_events(spark, sf_dir):
    rows = TICKS.frame(spark, sf_dir)
    done, total = F.col("done"), F.col("total")
    line = R.progress_event(done, total, F.col("current"), F.col("elapsed"))
    return rows.select("event_id", line.alias("line"))


KINDS = Bound("nation", n_name="n_name", kind="CASE n_nationkey % 6 WHEN 0 THEN 'StorageFull' WHEN 1 THEN 'DrmProtected' WHEN 2 THEN 'InvalidConfig' WHEN 3 THEN 'ConcurrencyError' WHEN 4 THEN 'MissingUsbMountForResume' ELSE 'other' END", a="'/a/' || n_name", b="'/b'")


@query(f"""SELECT n_name, CASE kind WHEN 'StorageFull' THEN 'ENOSPC_ERROR' WHEN 'DrmProtected' THEN 'DRM_PROTECTED' WHEN 'InvalidConfig' THEN 'INVALID_CONFIG' WHEN 'ConcurrencyError' THEN 'CONCURRENCY_ERROR' WHEN 'MissingUsbMountForResume' THEN 'MISSING_USB_MOUNT' ELSE 'PROVISIONING_FAILED' END AS code, 'journal_' || substr(sha256(a || '|' || b), 1, 12) AS session FROM {KINDS}""")
def error_codes(spark, sf_dir):
    return KINDS.frame(spark, sf_dir).select("n_name", R.error_code(F.col("kind")).alias("code"), R.session_id("journal", F.col("a"), F.col("b")).alias("session"))


REQUIREMENTS = Bound("nation", value="CASE WHEN n_nationkey % 8 = 7 THEN '| other |' ELSE '| R-' || printf('%02d', n_nationkey % 5) || '-' || printf('%03d', n_nationkey) || ' | ' || CASE n_nationkey % 4 WHEN 0 THEN 'PROPOSED' WHEN 1 THEN 'VERIFIED' WHEN 2 THEN 'DEPRECATED' ELSE 'IMPLEMENTED' END || ' | x |' END")
CODE = Bound("nation", value="'/// [R-' || printf('%02d', n_nationkey % 5) || '-' || printf('%03d', n_nationkey * 2) || '] and [R-09-' || printf('%03d', n_nationkey % 3) || ']'")
_REQ = f"(SELECT regexp_extract(value, '(R-[0-9]{{2}}-[0-9]{{3}})', 1) AS id, trim(string_split(value, '|')[3]) AS status FROM {REQUIREMENTS} WHERE value LIKE '| R-%')"
_ANCHORS = f"(SELECT DISTINCT unnest(regexp_extract_all(value, '(R-[0-9]{{2}}-[0-9]{{3}})', 1)) AS id FROM {CODE})"


@query(f"""SELECT id, 'no_anchor' AS issue, CASE WHEN status = 'PROPOSED' THEN 'warning' ELSE 'error' END AS severity FROM {_REQ} WHERE status <> 'DEPRECATED' AND id <> 'R-01-001' AND id NOT IN (SELECT id FROM {_ANCHORS})
 UNION ALL SELECT id, 'no_requirement', 'error' FROM {_ANCHORS} WHERE id NOT IN (SELECT id FROM {_REQ})""")
def traceability(spark, sf_dir):
    exempt = spark.createDataFrame([("R-01-001",)], "id string")
    return R.traceability(R.requirement_rows(REQUIREMENTS.frame(spark, sf_dir)), R.anchors_in(CODE.frame(spark, sf_dir)), exempt)


WEAR = Bound("nation", n_name="n_name", files="CASE WHEN n_nationkey % 5 = 0 THEN 0 ELSE n_nationkey * 10 END", syncs="n_nationkey * n_nationkey")


@query(f"SELECT n_name, CASE WHEN files > 0 THEN syncs::DOUBLE / files <= 0.1 END AS fits FROM {WEAR}")
def sync_wear(spark, sf_dir):
    return WEAR.frame(spark, sf_dir).select("n_name", R.wear(F.col("files"), F.col("syncs")).alias("fits"))


CANDIDATES = Bound("part", p_partkey="p_partkey", path="CASE p_partkey % 6 WHEN 0 THEN '../x/' || p_partkey WHEN 1 THEN 'a/../../b' WHEN 2 THEN '/etc/' || p_partkey WHEN 3 THEN 'a/./b/../c' WHEN 4 THEN '../usb/' || p_partkey ELSE p_name END",
                   name="CASE p_partkey % 6 WHEN 0 THEN '' WHEN 1 THEN 'a/b' WHEN 2 THEN 'a..b' WHEN 3 THEN 'a;b' WHEN 4 THEN repeat('é', 130) ELSE p_name END")


@query(f"SELECT p_partkey, p_partkey % 6 IN (3, 4, 5) AS contained, CASE p_partkey % 6 WHEN 0 THEN 'empty' WHEN 1 THEN 'traversal' WHEN 2 THEN 'traversal' WHEN 3 THEN 'shell' WHEN 4 THEN 'long' END AS problem FROM {CANDIDATES}")
def name_and_path_checks(spark, sf_dir):
    return CANDIDATES.frame(spark, sf_dir).select("p_partkey", contained("mnt/usb", F.col("path")).alias("contained"), N.filename_problem(F.col("name")).alias("problem"))


GUARDED = Bound("documents", doc_id="doc_id", target="'/mnt/' || source || CASE WHEN doc_id % 4 = 0 THEN '/./' ELSE '' END",
                origin="CASE doc_id % 5 WHEN 0 THEN '/mnt//' || source || '/' WHEN 1 THEN '/mnt/' || source || '/music/../in' WHEN 2 THEN '/mnt/' || source || 'x/in' WHEN 3 THEN '/mnt/' || source || '/../other' ELSE '/home/' || doc_id END",
                staging="CASE doc_id % 3 WHEN 0 THEN '/tmp/stage' WHEN 1 THEN '/mnt/' || source || '/a/../.stage' ELSE '/mnt/x/../' || source END")


@query(f"""SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'same' WHEN doc_id % 5 = 1 THEN 'source_inside' WHEN doc_id % 3 IN (1, 2) THEN 'staging_inside' END AS problem FROM {GUARDED}""")
def path_guards(spark, sf_dir):
    return GUARDED.frame(spark, sf_dir).select("doc_id", G.path_problem(F.col("target"), F.col("origin"), F.col("staging")).alias("problem"))


INNER = Bound("documents", path="'/lib/' || source || '/' || CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN lang WHEN 2 THEN lang || '/' || doc_id ELSE '../' || source || '/./' || lang || '/x/' || doc_id END")
OUTER = Bound("documents", path="CASE doc_id % 3 WHEN 0 THEN '/lib/' || source WHEN 1 THEN '/lib//' || source || '/' || lang || '/' ELSE '/li' END")
_CLEAN_PATH = r"'/' || array_to_string(list_reduce(list_prepend([]::VARCHAR[], list_transform(string_split(path, '/'), lambda x: [x])), lambda a, b: CASE WHEN b[1] IN ('', '.') THEN a WHEN b[1] = '..' THEN a[1:len(a) - 1] ELSE a || b END), '/')"


@query(f"""WITH i AS (SELECT DISTINCT path, {_CLEAN_PATH} AS c FROM {INNER}), o AS (SELECT DISTINCT path, {_CLEAN_PATH} AS c FROM {OUTER})
SELECT i.path AS inner, o.path AS outer, (length(i.c) - length(replace(i.c, '/', '')) - length(o.c) + length(replace(o.c, '/', '')))::INT AS levels FROM i JOIN o ON i.c = o.c OR starts_with(i.c, o.c || '/')""".replace(" AS inner", ' AS "inner"').replace(" AS outer", ' AS "outer"'))
def paths_inside_paths(spark, sf_dir):
    return G.containments(INNER.frame(spark, sf_dir), OUTER.frame(spark, sf_dir))


NEEDS = Bound("lineitem", kind="CASE l_linenumber % 3 WHEN 0 THEN 'root' WHEN 1 THEN 'new' ELSE 'untracked' END", source_size="CASE WHEN l_orderkey % 4 <> 0 THEN l_partkey END", target_size="CASE WHEN l_orderkey % 8 <> 0 THEN l_suppkey END")


@query(f"SELECT kind, count(*) AS files, sum(coalesce(source_size, target_size, 0))::BIGINT AS bytes, CASE WHEN sum(coalesce(source_size, target_size, 0)) > 8000000 THEN sum(coalesce(source_size, target_size, 0))::BIGINT - 8000000 END AS missing FROM {NEEDS} GROUP BY kind")
def space_needed(spark, sf_dir):
    return G.required_bytes(NEEDS.frame(spark, sf_dir)).withColumn("missing", G.space_problem(F.col("bytes"), F.lit(8000000).cast("bigint")))


@query(f"WITH c AS (SELECT max(o_orderkey // 50 + 1) AS v, arg_max(n, v) AS f FROM (SELECT o_orderkey // 50 + 1 AS v, count(*) AS n, any_value(o_orderkey) AS o_orderkey FROM orders WHERE o_orderkey < 1000 GROUP BY 1)), n AS (SELECT count(*) AS n FROM {SOURCE}), p AS (SELECT CASE WHEN f >= 50 THEN v + 1 ELSE v END AS v, CASE WHEN f >= 50 THEN 0 ELSE f END AS f FROM c) SELECT n AS files, (f + n - 1) // 50 - f // 50 + 1 AS volumes, ceil(n / 50.0)::BIGINT AS fewest FROM n, p")
def planned_volume_count(spark, sf_dir):
    counts = spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_orderkey < 1000").groupBy(F.expr("o_orderkey div 50 + 1").alias("volume")).agg(F.count(F.lit(1)).alias("files"))
    plan = Y.incremental_plan(SOURCE.frame(spark, sf_dir).select("path"), counts, [F.col("path")])
    return G.planned_volumes(plan, N.PER_VOLUME)


LOST = Bound("orders", "o_orderkey % 5 IN (1, 2) OR o_orderkey % 9 = 0", idx="CASE WHEN o_orderkey % 27 = 0 THEN -o_orderkey ELSE o_orderkey END")
ROWS_LEFT = Bound("orders", idx="o_orderkey", name="printf('%04d', o_orderkey) || CASE o_orderkey % 4 WHEN 0 THEN '_f.flac' WHEN 1 THEN '_f.MP3' WHEN 2 THEN '_f' ELSE '_f.mp3' END", path="'in/' || o_orderkey")
HERE = Bound("orders", "o_orderkey % 6 <> 1", path="'in/' || o_orderkey")


@query(f"""SELECT idx, path, name, 'VOL_' || printf('%02d', idx // 50 + 1) || '/' || name AS target, CASE WHEN name <> was THEN 'VOL_' || printf('%02d', idx // 50 + 1) || '/' || was END AS old, action FROM
 (SELECT l.idx, r.path, r.name AS was, CASE WHEN lower(r.name) LIKE '%.mp3' THEN r.name ELSE regexp_replace(r.name, '^(.+)\\.[^.]*$', '\\1') || '.mp3' END AS name, CASE WHEN r.name IS NULL THEN 'unknown' WHEN h.path IS NULL THEN 'missing' ELSE 'copy' END AS action
 FROM (SELECT DISTINCT idx FROM {LOST}) l LEFT JOIN {ROWS_LEFT} r USING (idx) LEFT JOIN {HERE} h ON h.path = r.path)""")
def recovery_actions(spark, sf_dir):
    return G.recovery_plan(LOST.frame(spark, sf_dir), ROWS_LEFT.frame(spark, sf_dir), HERE.frame(spark, sf_dir))


CAUSES = Bound("customer", c_custkey="c_custkey", outer_kind=f"CASE c_custkey % 3 WHEN 0 THEN 'io' ELSE {"CASE c_custkey % 9 " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(R.ERROR_CODES)) + " END"} END", inner_kind="CASE c_custkey % 5 WHEN 0 THEN 'DrmProtected' WHEN 1 THEN 'StorageFull' ELSE 'os' END")
_CODES_SQL = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in R.ERROR_CODES.items()) + "}"
_REMEDIES_SQL = "MAP {" + ", ".join(f"'{k}': '{v.replace(chr(39), chr(39) * 2)}'" for k, v in R.REMEDIES.items()) + "}"


@query(f"SELECT c_custkey, coalesce(({_CODES_SQL})[outer_kind], ({_CODES_SQL})[inner_kind], 'PROVISIONING_FAILED') AS code, ({_REMEDIES_SQL})[coalesce(({_CODES_SQL})[outer_kind], ({_CODES_SQL})[inner_kind], 'PROVISIONING_FAILED')] AS remedy FROM {CAUSES}")
def error_remedies(spark, sf_dir):
    kind = R.first_known(F.array("outer_kind", "inner_kind"))
    return CAUSES.frame(spark, sf_dir).select("c_custkey", R.error_code(kind).alias("code"), R.remedy(kind).alias("remedy"))


_SLUG_SQL = "CASE WHEN s = '' THEN 'device' ELSE s END || '_' || substr(sha256(s_name), 1, 8)"


@query(f"SELECT s_suppkey, '/state/backups/usb_backup_' || g AS backup, '/state/checkpoints/' || g AS checkpoint_dir, '/state/checkpoints/' || g || '/.provisioning_checkpoint' AS checkpoint, '/state/manifests/manifest_' || g || '.json' AS manifest, '/state/journals/journal_' || g || '.json' AS journal FROM (SELECT *, {_SLUG_SQL} AS g FROM (SELECT s_suppkey, s_name, trim(regexp_replace(lower(s_name), '[^a-z0-9]+', '_', 'g'), '_') AS s FROM supplier))")
def device_places(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", G.device_layout("/state", F.col("s_name")).alias("_l")).select("s_suppkey", "_l.*")


HEADS = Bound("part", p_partkey="p_partkey", kind="p_partkey % 4", step="p_partkey % 16", pace="p_partkey % 17 % 4", version="p_partkey % 7 % 4", layer="p_partkey % 11 % 4", mode="p_partkey % 5 % 4", rate="8000 + p_size * 3500", channels="p_partkey % 6 + 1", bits="CASE WHEN p_partkey % 2 = 0 THEN 16 ELSE 24 END", samples="CASE WHEN p_partkey % 12 = 3 THEN 0 ELSE p_partkey * 20000 END", size="p_partkey * 9000")
_KBPS_SQL = "MAP {" + ", ".join(f"'{k}': {list(v)}" for k, v in H.KBPS.items()) + "}"


@query(f"""SELECT p_partkey, CASE WHEN kind = 0 AND fits THEN 'mp' || (4 - layer) WHEN kind = 1 THEN CASE WHEN channels = 3 THEN 'wav85' ELSE 'pcm' END WHEN kind = 3 THEN 'flac' END AS codec,
 CASE WHEN kind = 0 AND fits THEN ([44100, 48000, 32000])[pace + 1] // CASE version WHEN 3 THEN 1 WHEN 2 THEN 2 ELSE 4 END WHEN kind IN (1, 3) THEN rate END::INT AS sample_rate,
 CASE WHEN kind = 0 AND fits THEN CASE WHEN mode = 3 THEN 1 ELSE 2 END WHEN kind IN (1, 3) THEN channels END::INT AS channels, CASE WHEN kind IN (1, 3) THEN bits END::INT AS sample_bits,
 CASE WHEN kind = 0 AND fits THEN ({_KBPS_SQL})[CASE WHEN version = 3 THEN '1' || (4 - layer) WHEN layer = 3 THEN '21' ELSE '22' END][step + 1] * 1000 WHEN kind = 1 THEN rate * channels * bits WHEN kind = 3 AND samples > 0 THEN size * 8 * rate // samples END::BIGINT AS bitrate
 FROM (SELECT *, version <> 1 AND layer <> 0 AND step <> 15 AND pace <> 3 AS fits FROM {HEADS})""")
def header_profiles(spark, sf_dir):
    rows = HEADS.frame(spark, sf_dir)
    hexed = lambda c, n: F.format_string(f"%0{n}X", c.cast("bigint"))
    low = lambda c, n: F.concat(*[F.substring(hexed(c, 2 * n), 2 * (n - k) - 1, 2) for k in range(n)])
    bit = lambda c, k: c.cast("bigint") * (1 << k)
    c = F.col
    frame = hexed(F.lit(0xFFE10000) + bit(c("version"), 19) + bit(c("layer"), 17) + bit(c("step"), 12) + bit(c("pace"), 10) + bit(c("mode"), 6), 8)
    frame = F.concat(F.when(c("p_partkey") % 8 == 0, F.concat(F.lit("49443304000000000003"), F.lit("AABBCC"))).otherwise(""), frame)
    form = F.when(c("channels") == 3, 85).otherwise(1)
    wave = F.concat(F.lit("5249464600000000" + "57415645666D742010000000"), low(form, 2), low(c("channels"), 2), low(c("rate"), 4), low(F.expr("rate * channels * bits div 8"), 4), low(F.expr("channels * bits div 8"), 2), low(c("bits"), 2))
    packed = bit(c("rate"), 44 - 24) + bit(c("channels") - 1, 41 - 24) + bit(c("bits") - 1, 36 - 24) + F.expr("samples div 16777216")
    stream = F.concat(F.lit("664C6143" + "00000022" + "00" * 10), hexed(packed, 10), hexed(c("samples") % 16777216, 6))
    block = F.unhex(F.when(c("kind") == 0, frame).when(c("kind") == 1, wave).when(c("kind") == 3, stream).otherwise(F.lit("4F67675300")))
    return rows.select("p_partkey", H.stream_info(block, c("size")).alias("i")).select("p_partkey", "i.*")
