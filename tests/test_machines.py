"""State machines and running sums against events taken one after the other."""

import random

import pytest
from pyspark.sql import functions as F

from quillon.operators import catalog as C
from quillon.operators import state as T

JOURNAL = "seq long, target string, kind string, error string"
STEPS = "seq long, idx long, kind string, name string, checksum string, error string"


def journal(events):
    out = {}
    for _, target, kind, error in sorted(events, key=lambda e: e[0]):
        status, held, bad = out.get(target, ("unknown", None, 0))
        if kind == "ensure":
            out[target] = (status, held, bad) if status == "committed" else ("pending", None, bad)
        elif status == "unknown" or kind not in ("in_progress", "committed", "failed"):
            out[target] = (status, held, bad + 1)
        else:
            out[target] = (kind, error if kind == "failed" else None, bad)
    return out


def checkpoint(events):
    out = {}
    for _, idx, kind, name, checksum, error in sorted(events, key=lambda e: e[0]):
        row = out.get(idx, (None, "unknown", None, None, 0))
        if kind == "start":
            row = (name, "in_progress", None, None, row[4])
        elif row[1] == "unknown" or kind not in ("completed", "failed", "renamed"):
            row = (*row[:4], row[4] + 1)
        elif kind == "completed":
            row = (row[0], "completed", checksum, None, row[4])
        elif kind == "failed":
            row = (row[0], "failed", row[2], error, row[4])
        else:
            row = (name, *row[1:])
        out[idx] = row
    return out


@pytest.mark.parametrize("rows", [10**6, 0])
def test_machines_equal_events_one_by_one(spark, uncoalesced, monkeypatch, rows):
    monkeypatch.setattr(C, "WINDOW_ROWS", rows)
    monkeypatch.setattr(T, "FAN", 3)
    rng = random.Random(5)
    moves = ["ensure", "in_progress", "committed", "failed", "odd", None]
    events = [(i, rng.choice("abcdefgh") if rng.random() < 0.7 else "hot", rng.choices(moves, [3, 3, 1, 3, 1, 1])[0], rng.choice([None, f"e{i}"])) for i in rng.sample(range(4000), 400)]
    events += [(9001, "late", "committed", "x"), (9002, "late", "ensure", None), (9003, "never", "failed", "y")]
    got = {r.target: tuple(r)[1:] for r in T.journal_state(spark.createDataFrame(events, JOURNAL)).collect()}
    assert got == journal(events) and got["late"] == ("pending", None, 1) and got["never"] == ("unknown", None, 1)
    kinds = ["start", "completed", "failed", "renamed", "odd"]
    steps = [(i, rng.choice([1, 2, 3, 4, 4, 4, 4]), rng.choices(kinds, [1, 3, 3, 3, 1])[0], f"n{i}", f"c{i}", f"e{i}") for i in range(300)]
    assert {r.idx: tuple(r)[1:] for r in T.checkpoint_state(spark.createDataFrame(steps, STEPS)).collect()} == checkpoint(steps)


def test_functions_compose_in_any_split(spark):
    kinds = ["failed", "ensure", "committed", "in_progress", None]
    names = spark.createDataFrame([(k,) for k in kinds], "k string")
    rows = names.select(F.col("k").alias("a")).crossJoin(names.select(F.col("k").alias("b"))).crossJoin(names.select(F.col("k").alias("c"))).withColumn("error", F.lit("e"))
    a, b, c = (T.JOURNAL.function(F.col(x)) for x in "abc")
    same = T.composed(T.composed(a, b), c) == T.composed(a, T.composed(b, c))
    assert rows.where(~same).count() == 0 and rows.count() == 125


@pytest.mark.parametrize("most", [10**6, 0])
def test_running_sums_of_hot_keys(spark, uncoalesced, monkeypatch, most):
    monkeypatch.setattr(C, "WINDOW_ROWS", most)
    rows = spark.range(20_000).select((F.when(F.col("id") % 3 == 0, F.col("id") % 7)).alias("k"), (F.col("id") * 7919 % 20_011).alias("o"), (F.col("id") % 5).alias("v"), F.lit(1).alias("_rg"))
    got = C.running(rows, ["k"], ["o"], total=F.col("v"), n=F.lit(1))
    assert got.columns == ["k", "o", "v", "_rg", "total", "n"]
    seen, want = {}, {}
    for r in sorted(rows.collect(), key=lambda r: r.o):
        t, n = seen.get(r.k, (0, 0))
        seen[r.k] = want[r.o] = (t + r.v, n + 1)
    assert {r.o: (r.total, r.n) for r in got.collect()} == want


def test_equal_rows_in_order_spread_over_ranges(spark, uncoalesced):
    rows = spark.range(40_000).select(F.lit("same").alias("path"), F.col("id").alias("payload"))
    got = C.numbered(rows, [F.col("path")])
    assert got.select("idx").distinct().count() == 40_000 and got.agg(F.max("idx")).first()[0] == 40_000
    assert C._ranged(rows, [F.col("path")]).select(F.shiftright("_rg_at", 33)).distinct().count() > 1
