"""Collision-free names against files named one after the other."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quillon.operators import catalog
from quillon.operators import collisions as K


def form(name, k, text):
    m = re.fullmatch(r"(?s)(.+)(\.[^.]*)", name)
    stem, ext = m.groups() if m else (name, "")
    return f"{stem}_{text % k}{ext}"


def one_by_one(files, existing, text, content=False):
    """files: (seq, name, sha); existing: {name: sha}."""
    held, out = dict(existing), {}
    for seq, name, sha in sorted(files, key=lambda f: f[0]):
        if name is None:
            out[seq] = None
        elif name not in held:
            held[name] = sha
            out[seq] = name
        elif content and sha is not None and held[name] == sha:
            out[seq] = None
        else:
            k = 1
            while form(name, k, text) in held:
                k += 1
            out[seq] = form(name, k, text)
            held[out[seq]] = sha
    return out


def drawn(seed, width, n):
    rng = random.Random(seed)
    number = lambda: width % rng.choice([1, 1, 2, 2, 3, 4, 5, 7, 12])
    odd = ["", ".hidden", "a.", "..", "x.tar.gz", "a_0.mp3", "a_01.mp3", "a_000.mp3", "ü.mp3", "a b.mp3", None]

    def name():
        if rng.random() < 0.1:
            return rng.choice(odd)
        tail = "".join(f"_{number()}" for _ in range(rng.choice([0, 0, 0, 1, 1, 2, 3])))
        return rng.choice(["a", "a", "a", "b"]) + tail + rng.choice([".mp3", ".mp3", ""])

    return [(i, name(), rng.choice("xyz")) for i in rng.sample(range(10 * n), n)], name


@pytest.mark.parametrize("seed", range(2))
def test_resolve_equals_one_by_one(spark, uncoalesced, seed, monkeypatch):
    monkeypatch.setattr(catalog, "WINDOW_ROWS", 1000 * seed)  # by ranges, and by windows
    monkeypatch.setattr(K, "BLOCK", 3)
    files, _ = drawn(seed, "%03d", 150)
    got = {r.seq: r.resolved for r in K.resolve(spark.createDataFrame(files, "seq long, name string, sha string")).collect()}
    assert got == one_by_one(files, {}, "%03d")


@pytest.mark.parametrize("seed", range(1))
def test_names_beside_others_equal_one_by_one(spark, seed, monkeypatch):
    monkeypatch.setattr(K, "BLOCK", 2)
    files, name = drawn(seed, "%d", 120)
    rows = spark.createDataFrame(files, "seq long, name string, sha string")
    there = {n: "x" for n in (name() for _ in range(40)) if n is not None}
    existing = spark.createDataFrame([*there.items(), *list(there.items())[:5]], "name string, sha string")
    assert {r.seq: r.resolved for r in K.beside(rows, existing).collect()} == one_by_one(files, there, "%d")
    assert {r.seq: r.stored for r in K.backed_up(rows, existing).collect()} == one_by_one(files, there, "%d", content=True)


def test_one_name_of_many_rows(spark, uncoalesced, monkeypatch):
    monkeypatch.setattr(catalog, "WINDOW_ROWS", 1000)
    n = 300_000
    rows = spark.range(n).select(F.col("id").alias("seq"), F.lit("same.mp3").alias("name"))
    existing = spark.range(0, n, 3).select(F.concat(F.lit("same_"), F.col("id").cast("string"), F.lit(".mp3")).alias("name"))
    got = K.beside(rows, existing).selectExpr("seq", "try_cast(regexp_extract(resolved, 'same_([0-9]+)', 1) as long) AS k", "resolved")
    # numbers 1, 2, 4, 5, 7 ... are free below n
    free = F.when(F.col("seq") <= 199_999, F.col("seq") + F.expr("(seq - 1) div 2")).otherwise(F.col("seq") + 99_999)
    assert got.where("seq = 0").first()["resolved"] == "same.mp3"
    assert got.where(F.col("seq") > 0).where(~F.col("k").eqNullSafe(free)).count() == 0


def test_no_rows_clashing_columns_and_ties(spark):
    rows = spark.createDataFrame([(1, "a", "k", 5), (1, "a", "l", 6)], "seq long, name string, _name string, resolved int")
    assert K.resolve(rows.where("false")).collect() == []
    got = K.resolve(rows)
    assert got.columns == ["seq", "name", "_name", "resolved"] and {r.resolved for r in got.collect()} == {"a", "a_001"}
    nothing = rows.select("name").where("false")
    assert {r.resolved for r in K.beside(rows, nothing).collect()} == {"a", "a_1"}


def test_many_contested_names_are_no_group_each(spark, monkeypatch):
    """A pandas group a name has a fixed cost a name, whatever its rows."""
    plans, made = [], K.cut
    monkeypatch.setattr(K, "cut", lambda df: plans.append(df._jdf.queryExecution().toString()) or made(df))
    tails = ["", "", "_1", "_2", "_1_1", "_1"]
    files = [(7 * i + (j * 5 + i) % 6, f"n{i}{tail}.mp3", "x") for i in range(2000) for j, tail in enumerate(tails)]
    rows = spark.createDataFrame(files, "seq long, name string, sha string")
    assert {r.seq: r.resolved for r in K.beside(rows, rows.limit(0)).collect()} == one_by_one(files, {}, "%d")
    assert any("MapInPandas" in p for p in plans) and not any("GroupsInPandas" in p for p in plans)
