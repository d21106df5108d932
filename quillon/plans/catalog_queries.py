"""Catalog queries over the driver's tables.

A library of files is read out of documents: text is the content, and path, name and hash follow from the columns. Every
third document is already held on the target under a complying name, every seventh lies there under a stray folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import names as N
from quillon.functions.paths import contained, relative
from quillon.operators import catalog as C
from quillon.operators.collisions import resolve


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    ext = F.element_at(F.array(*[F.lit(e) for e in ("mp3", "FLAC", "txt", "ogg", "wav")]), (F.col("doc_id") % 5 + 1).cast("int"))
    name = F.concat(F.col("lang"), F.lit(" "), F.col("doc_id").cast("string"), F.lit("."), ext)
    return _t(spark, sf_dir, "documents").select(
        "doc_id", F.concat(F.lit("lib/"), F.col("source"), F.lit("/"), name).alias("path"), name.alias("name"), "source",
        F.octet_length("text").cast("long").alias("size_bytes"), F.sha2("text", 256).alias("sha"),
    )


_FILES_SQL = """files AS (SELECT doc_id, 'lib/' || source || '/' || lang || ' ' || doc_id || '.' || (['mp3','FLAC','txt','ogg','wav'])[doc_id % 5 + 1] AS path,
 lang || ' ' || doc_id || '.' || (['mp3','FLAC','txt','ogg','wav'])[doc_id % 5 + 1] AS name, source, strlen(text)::BIGINT AS size_bytes, sha256(text) AS sha FROM documents)"""
_TARGET_SQL = """target AS (SELECT 'VOL_' || printf('%02d', doc_id // 50 + 1) || '/' || printf('%04d', doc_id) || '_song_' || substr(sha, 1, 8) || '.mp3' AS path,
 'VOL_' || printf('%02d', doc_id // 50 + 1) AS folder, printf('%04d', doc_id) || '_song_' || substr(sha, 1, 8) || '.mp3' AS name, sha FROM files WHERE doc_id % 3 = 0
 UNION ALL SELECT 'musica/' || name, 'musica', name, sha FROM files WHERE doc_id % 7 = 1 AND doc_id % 3 <> 0)"""


def _target(files: DataFrame) -> DataFrame:
    name = F.concat(F.format_string("%04d", "doc_id"), F.lit("_song_"), N.hash8(F.col("sha")), F.lit(".mp3"))
    folder = F.format_string("VOL_%02d", F.expr("doc_id div 50 + 1"))
    held = files.where("doc_id % 3 = 0").select(F.concat(folder, F.lit("/"), name).alias("path"), folder.alias("folder"), name.alias("name"), "sha")
    stray = files.where("doc_id % 7 = 1 AND doc_id % 3 <> 0").select(F.concat(F.lit("musica/"), "name").alias("path"), F.lit("musica").alias("folder"), "name", "sha")
    return held.unionByName(stray)


QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query(f"""WITH {_FILES_SQL}, {_TARGET_SQL}, s AS (SELECT f.path, substr(f.sha, 1, 8) AS h8, f.sha FROM files f),
h AS (SELECT DISTINCT substr(name, -12, 8) AS h8 FROM target WHERE folder <> 'musica'),
w AS (SELECT sha, min(path) AS d FROM target WHERE folder = 'musica' GROUP BY sha),
r AS (SELECT s.path, CASE WHEN h.h8 IS NOT NULL THEN 'skip' WHEN w.d IS NOT NULL THEN 'displaced' ELSE 'new' END AS action,
 CASE WHEN h.h8 IS NULL THEN w.d END AS displaced_from FROM s LEFT JOIN h USING (h8) LEFT JOIN w USING (sha))
SELECT * FROM r UNION ALL SELECT path, 'untracked', NULL FROM target WHERE folder = 'musica' AND path NOT IN (SELECT displaced_from FROM r WHERE displaced_from IS NOT NULL)""")
def sync_diff(spark, sf_dir):
    files = _files(spark, sf_dir)
    return C.sync_diff(files.select("path", "sha"), _target(files))


@query(f"WITH {_FILES_SQL} SELECT path, lower(regexp_extract(name, '^.+\\.([^.]*)$', 1)) AS extension, size_bytes FROM files WHERE lower(regexp_extract(name, '^.+\\.([^.]*)$', 1)) IN ('mp3','flac','wav','ogg')")
def catalog_scan(spark, sf_dir):
    files = _files(spark, sf_dir).withColumn("extension", N.extension(F.col("name")))
    return files.where(F.col("extension").isin(*N.AUDIO_EXTENSIONS)).select("path", "extension", "size_bytes")


@query(f"WITH {_FILES_SQL} SELECT lower(regexp_extract(name, '^.+\\.([^.]*)$', 1)) AS extension, count(*) AS files, sum(size_bytes)::BIGINT AS bytes, max(size_bytes) AS largest FROM files GROUP BY 1")
def scan_totals(spark, sf_dir):
    return _files(spark, sf_dir).groupBy(N.extension(F.col("name")).alias("extension")).agg(
        F.count(F.lit(1)).alias("files"), F.sum("size_bytes").alias("bytes"), F.max("size_bytes").alias("largest"))


@query(f"WITH {_FILES_SQL} SELECT sha, min(path) AS first_path, count(*) AS copies FROM files GROUP BY sha")
def first_per_hash(spark, sf_dir):
    return _files(spark, sf_dir).groupBy("sha").agg(F.min("path").alias("first_path"), F.count(F.lit(1)).alias("copies"))


@query(f"WITH {_FILES_SQL} SELECT path, row_number() OVER (ORDER BY path) AS idx, 'VOL_' || printf('%02d', (row_number() OVER (ORDER BY path) - 1) // 50 + 1) AS volume FROM files")
def volume_plan(spark, sf_dir):
    rows = C.numbered(_files(spark, sf_dir).select("path"), [F.col("path")])
    return rows.select("path", "idx", F.format_string("VOL_%02d", N.planned_volume(F.col("idx")).cast("long")).alias("volume"))


@query(f"""WITH {_FILES_SQL}, n AS (SELECT path, row_number() OVER (ORDER BY path) AS idx, sha, trim(regexp_replace(lower(name), '[^a-z0-9]+', '_', 'g'), '_') AS stem FROM files)
SELECT path, printf('%04d_', idx) || substr(stem || repeat('_', 32), 1, 19 - length(printf('%04d_', idx))) || '_' || substr(sha, 1, 8) || '.mp3' AS compact FROM n""")
def compact_names(spark, sf_dir):
    rows = C.numbered(_files(spark, sf_dir).select("path", "name", "sha"), [F.col("path")])
    return rows.select("path", N.hashed_name(N.simple_stem(F.col("name")), F.col("idx"), F.col("sha")).alias("compact"))


@query("""SELECT page_id, CASE WHEN url = '' THEN 'empty' WHEN contains(url, '..') OR contains(url, '/') OR contains(url, '\\') THEN 'traversal' END AS problem,
regexp_matches(url, '[;|&$()<>`''"\\\\\\n\\r]') AS unsafe FROM pages""")
def name_checks(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", N.filename_problem(F.col("url")).alias("problem"), N.shell_unsafe(F.col("url")).alias("unsafe"))


@query("""WITH c AS (SELECT user_id, event_id, event_type <> 'error' AS ok FROM events), i AS (SELECT *, sum(ok::INT) OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM c)
SELECT user_id AS device, count(*) AS run, min(event_id) AS first_idx FROM i WHERE NOT ok GROUP BY user_id, island HAVING count(*) >= 2""")
def mismatch_runs(spark, sf_dir):
    checks = _t(spark, sf_dir, "events").select(F.col("user_id").alias("device"), F.col("event_id").alias("idx"), (F.col("event_type") != "error").alias("ok"))
    return C.mismatch_runs(checks, 2)


_STATE = "CASE WHEN event_type = 'purchase' THEN 'committed' WHEN event_type = 'error' THEN 'failed' ELSE 'pending' END"


@query(f"SELECT user_id, CASE WHEN bool_or(s = 'committed') THEN 'committed' ELSE max_by(s, event_id) END AS state FROM (SELECT user_id, event_id, {_STATE} AS s FROM events) GROUP BY user_id")
def journal_state(spark, sf_dir):
    events = _t(spark, sf_dir, "events").select("user_id", "event_id", F.expr(_STATE).alias("s"))
    return C.last_state(events, "user_id", "event_id", "s")


@query(f"SELECT count(*) AS total, count(*) FILTER (s = 'committed') AS committed, count(*) FILTER (s = 'pending') AS pending, count(*) FILTER (s = 'failed') AS failed, count(*) > 0 AND coalesce(bool_and(s = 'committed'), false) AS all_committed FROM (SELECT {_STATE} AS s FROM events)")
def journal_summary(spark, sf_dir):
    s = _t(spark, sf_dir, "events").select(F.expr(_STATE).alias("s"))
    return s.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("s") == k).alias(k) for k in ("committed", "pending", "failed")], F.coalesce(F.bool_and(F.col("s") == "committed"), F.lit(False)).alias("all_committed"))


@query("SELECT s_suppkey, trim(regexp_replace(lower(s_name), '[^a-z0-9]+', '_', 'g'), '_') || '_' || substr(sha256(s_name), 1, 8) AS slug, substr(upper(regexp_replace(s_name, '[^A-Za-z0-9_]', '', 'g')), 1, 11) AS label FROM supplier")
def device_keys(spark, sf_dir):
    return _t(spark, sf_dir, "supplier").select("s_suppkey", N.slug_with_hash(F.col("s_name")).alias("slug"), N.fat_label(F.col("s_name")).alias("label"))


@query("""SELECT p_partkey, CASE WHEN p_size % 3 = 0 AND p_size % 2 = 0 AND p_size * 8000 BETWEEN 120000 AND 320000 THEN CASE WHEN p_size % 4 = 0 THEN 'copy_clean' ELSE 'rename' END ELSE 'transcode' END AS decision FROM part""")
def media_decisions(spark, sf_dir):
    s = F.col("p_size")
    codec, rate = F.when(s % 3 == 0, "mp3").otherwise("flac"), F.when(s % 2 == 0, 44100).otherwise(48000)
    return _t(spark, sf_dir, "part").select("p_partkey", N.media_decision(codec, rate, s * 8000, s % 4 == 0).alias("decision"))


@query("""SELECT o_orderkey, l_linenumber, CASE WHEN l_orderkey IS NULL THEN 'missing' WHEN l_returnflag = 'R' THEN 'hash_mismatch' ELSE 'ok' END AS status
FROM orders LEFT JOIN (SELECT * FROM lineitem WHERE l_linestatus = 'F') ON o_orderkey = l_orderkey""")
def manifest_parity(spark, sf_dir):
    held = _t(spark, sf_dir, "lineitem").where("l_linestatus = 'F'").select("l_orderkey", "l_linenumber", "l_returnflag")
    status = F.when(F.col("l_orderkey").isNull(), "missing").when(F.col("l_returnflag") == "R", "hash_mismatch").otherwise("ok")
    orders = _t(spark, sf_dir, "orders").select("o_orderkey")
    return orders.join(held, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", "l_linenumber", status.alias("status"))


@query("SELECT o_custkey, count(*) AS files FROM orders GROUP BY o_custkey HAVING count(*) > 12")
def overfull_volumes(spark, sf_dir):
    return _t(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("files")).where("files > 12")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'O' UNION SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R'")
def recovery_indices(spark, sf_dir):
    bad = _t(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return _t(spark, sf_dir, "orders").where("o_orderstatus <> 'O'").select("o_orderkey").unionByName(bad).distinct()


@query("SELECT user_id, event_id, 100.0 * row_number() OVER w / count(*) OVER (PARTITION BY user_id) AS percentage FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def running_progress(spark, sf_dir):
    events = _t(spark, sf_dir, "events").select("user_id", "event_id")
    rows = C.ranked(events, ["user_id"], ["event_id"]).join(events.groupBy("user_id").agg(F.count(F.lit(1)).alias("total")), "user_id")
    return rows.select("user_id", "event_id", (F.lit(100.0) * F.col("rank") / F.col("total")).alias("percentage"))


@query("""WITH o AS (SELECT o_orderkey AS seq, lower(o_orderpriority) || '.mp3' AS name FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY seq) - 1 AS k FROM o)
SELECT seq, name, CASE WHEN k = 0 THEN name ELSE regexp_replace(name, '\\.mp3$', '') || '_' || CASE WHEN k < 1000 THEN printf('%03d', k) ELSE k::VARCHAR END || '.mp3' END AS resolved FROM r""")
def collision_names(spark, sf_dir):
    rows = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), F.concat(F.lower("o_orderpriority"), F.lit(".mp3")).alias("name"))
    return resolve(rows)


@query("SELECT page_id, NOT starts_with(regexp_extract(url, '://[^/]*(.*)$', 1), '/') AS contained, CASE WHEN starts_with(url, 'https:/') THEN substr(url, 8) ELSE url END AS rel FROM pages")
def path_containment(spark, sf_dir):
    path = F.regexp_extract("url", r"://[^/]*(.*)$", 1)
    return _t(spark, sf_dir, "pages").select("page_id", contained("mnt/usb", path).alias("contained"), relative(F.col("url"), "https:/").alias("rel"))
