from quillon.functions import names as N
from quillon.operators import catalog as C
from pyspark.sql import functions as F


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v"))).first()[0]


def test_names(spark):
    assert one(spark, "+0417_tarde.ogg", N.lenient_index) == 417
    assert one(spark, "a_DEADBEEF.MP3", N.hash8_of_name) == "deadbeef"
    assert one(spark, "VOL_07", N.volume_index) == 7
    assert one(spark, "nvme0n1p1", N.parent_device) == "nvme0n1"
    assert one(spark, "sdb1", N.parent_device) == "sdb"
    assert one(spark, "faro_del sur nº 12", N.fat_label) == "FARO_DELSUR"
    assert one(spark, "***", N.fat_label) is None
    assert one(spark, "rio", lambda c: N.hashed_name(c, F.lit(12), F.lit("zz-11"))) == "0012_rio____________00000000.mp3"
    assert one(spark, "x`date`", N.shell_unsafe) is True and one(spark, "x-y_z.mp3", N.shell_unsafe) is False


def test_natural_order(spark):
    rows = spark.createDataFrame([(n,) for n in ["30 b", "4 b", "Q07", "q6"]], "v string")
    odd = spark.createDataFrame([(n,) for n in ["a1.mp3", "a 1.mp3", "a!b.mp3", "a-2.mp3", "a01.mp3", "a001.mp3", "ab.mp3", "", "Ñ1"]], "v string")
    assert [r.v for r in odd.orderBy(N.natural_key(F.col("v"))).collect()] == ["", "a 1.mp3", "a!b.mp3", "a-2.mp3", "a1.mp3", "a01.mp3", "a001.mp3", "ab.mp3", "Ñ1"]
    assert [r.v for r in rows.orderBy(N.natural_key(F.col("v"))).collect()] == ["4 b", "30 b", "q6", "Q07"]


def test_sync_diff(spark):
    sha = lambda c: c * 64
    source = spark.createDataFrame([("a", sha("a")), ("b", sha("b")), ("c", sha("c"))], "path string, sha string")
    target = spark.createDataFrame(
        [("VOL_01/1_x_aaaaaaaa.mp3", "VOL_01", "1_x_aaaaaaaa.mp3", "-"), ("m/b", "m", "b", sha("b")), ("m/z", "m", "z", sha("f"))], "path string, folder string, name string, sha string"
    )
    assert {(r.path, r.action) for r in C.sync_diff(source, target).collect()} == {("a", "skip"), ("b", "displaced"), ("c", "new"), ("m/z", "untracked")}


def test_numbered_keeps_every_row_of_a_wide_table(spark):
    n = 2_000_000
    rows = spark.range(n).select(F.xxhash64("id").alias("key"), F.repeat(F.col("id").cast("string"), 8).alias("wide"))
    got = C.numbered(rows, [F.col("key")])
    assert tuple(got.agg(F.count("idx"), F.count_distinct("idx"), F.min("idx"), F.max("idx")).first()) == (n, n, 1, n)
    pairs = got.select("key", "idx").where("idx % 1000 < 2").orderBy("idx").collect()
    assert all(a.key <= b.key for a, b in zip(pairs, pairs[1:]))


def test_numbers_within_keys_and_runs(spark):
    rows = spark.createDataFrame([(k, i) for k in ("a", None, "b") for i in range(50)], "k string, i long")
    assert all(r["rank"] == r.i + 1 for r in C.ranked(rows, ["k"], ["i"]).collect())
    ok = [True, False, False, True, False, False, False, False, False, True]
    checks = spark.createDataFrame([(d, i, o) for d in (1, 2) for i, o in enumerate(ok)], "device long, idx long, ok boolean")
    assert sorted(map(tuple, C.mismatch_runs(checks, 2).collect())) == [(1, 2, 1), (1, 5, 4), (2, 2, 1), (2, 5, 4)]
    assert C.mismatch_runs(checks.where("false")).count() == 0


def test_numbered(spark):
    rows = C.numbered(spark.range(100), [F.col("id")], 5).orderBy("id").collect()
    assert [r.idx for r in rows] == list(range(5, 105))


def test_oracle(spark):
    import duckdb
    import glob
    import os

    import quillon.plans.library_queries  # noqa: F401  registers its queries
    from quillon.plans.catalog_queries import ORACLE_SQL, QUERIES

    assert len(ORACLE_SQL) == len(QUERIES)
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for f in glob.glob(d + "/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    flat = lambda rows: sorted(tuple("" if v is None else round(v, 6) if isinstance(v, float) else str(v) for v in r) for r in rows)
    for name, sql in ORACLE_SQL.items():
        got = QUERIES[name](spark, d)
        cols = ", ".join(got.columns)
        assert flat(got.collect()) == flat(con.execute(f"SELECT {cols} FROM ({sql})").fetchall()), name
