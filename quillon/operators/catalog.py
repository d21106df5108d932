"""Catalog operators: difference, numbering, volumes, verification, recovery, state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import names as N
from quillon.operators.shared import cut

WINDOW_ROWS = 500_000  # rows of one key that a single task may sort


def required_hash8(sha: Column, path: Column) -> Column:
    """The first eight hex digits of a content hash, in lower case; an error where there are fewer."""
    digits = N.hash8(sha)
    problem = F.concat(F.lit("no eight hex digits in the hash of "), F.coalesce(path, F.lit("a file")))
    return F.when(F.length(digits) == 8, digits).otherwise(F.raise_error(problem).cast("string"))


def with_compliance(target: DataFrame) -> DataFrame:
    """target (path, folder, name, ...) with compliant: a numbered safe name in a volume."""
    return target.withColumn("compliant", N.volume_index(F.col("folder")).isNotNull() & N.lenient_index(F.col("name")).isNotNull() & N.safe_name(F.col("name")))


def first_path() -> Column:
    return F.min_by("path", F.struct(F.split("path", "/"), "path"))


def sync_diff(source: DataFrame, target: DataFrame) -> DataFrame:
    """source (path, sha) against target (path, folder, name, sha): one row per path with its action.

    Targets that comply are known by the eight hash digits in their names; the others by their whole content hash. A source
    hash with fewer than eight hex digits is an error.
    """
    target = with_compliance(target)
    short = target.where("compliant").select(N.hash8_of_name(F.col("name")).alias("h8")).where("h8 IS NOT NULL").groupBy("h8").agg(F.lit(True).alias("held"))
    whole = target.where("NOT compliant").groupBy("sha").agg(first_path().alias("displaced_from"))
    rows = source.withColumn("h8", required_hash8(F.col("sha"), F.col("path"))).join(short, "h8", "left").join(whole, "sha", "left")
    action = F.when(F.col("held"), "skip").when(F.col("displaced_from").isNotNull(), "displaced").otherwise("new")
    rows = rows.select("path", action.alias("action"), F.when(F.col("held").isNull(), F.col("displaced_from")).alias("displaced_from"))
    moved = rows.where("displaced_from IS NOT NULL").select(F.col("displaced_from").alias("path")).distinct()
    stray = target.where("NOT compliant").join(moved, "path", "left_anti").select("path", F.lit("untracked").alias("action"), F.lit(None).cast("string").alias("displaced_from"))
    return rows.unionByName(stray)


def _tie(rows: DataFrame) -> Column:
    """Tells apart rows that are equal in order, the same way whenever they are read again."""
    return F.xxhash64(*[F.col(f"`{f.name}`") for f in rows.schema if "map<" not in f.dataType.simpleString()])


def _ranged(rows: DataFrame, order: list[Column]) -> DataFrame:
    """Sorted ranges, kept, with _rg_at: the range in the upper bits, the row's place in it in the lower 33."""
    rows = rows.withColumn("_rg_tie", _tie(rows))
    sorted_ = rows.repartitionByRange(*order, "_rg_tie").sortWithinPartitions(*order, "_rg_tie")
    return cut(sorted_.withColumn("_rg_at", F.monotonically_increasing_id()).drop("_rg_tie"))


def numbered(files: DataFrame, order: list[Column], start: int = 1, out: str = "idx") -> DataFrame:
    """Global numbers in order, without one task for all rows: ranges are sorted apart, kept, and offset by their counts.

    The sorted rows are kept before they are counted, so counts and rows come from the same ranges. Rows that are equal in
    order get different numbers; a hash of the whole row tells them apart, so they spread over ranges too.
    """
    kept = _ranged(files, order)
    sizes = kept.groupBy(F.shiftright("_rg_at", 33).alias("_rg_p")).agg(F.count(F.lit(1)).alias("_c"))
    before = Window.orderBy("_rg_p").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    base = sizes.select(F.col("_rg_p").alias("_rg_q"), F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_b"))
    number = F.col("_b") + F.col("_rg_at").bitwiseAND((1 << 33) - 1) + start
    return kept.join(F.broadcast(base), F.shiftright("_rg_at", 33) == F.col("_rg_q")).withColumn(out, number.cast("long")).drop("_rg_at", "_rg_q", "_b")


def running(rows: DataFrame, keys: list[str], order: list[str], **values: Column) -> DataFrame:
    """Running sums of the values within each key, in order, the row's own value included; no key with many rows is one task's.

    Up to WINDOW_ROWS rows a key a window does. Beyond, rows are sorted by ranges. What a range adds up of a key is its own; what earlier ranges hold of the key is carried to it.
    Only a range's first key can begin earlier, so there are at most as many carries as ranges.
    """
    most = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n")).first()[0] or 0
    if most <= WINDOW_ROWS:
        whole = Window.partitionBy(*keys).orderBy(*order, _tie(rows)).rowsBetween(Window.unboundedPreceding, 0)
        return rows.withColumns({n: F.sum(v.cast("long")).over(whole) for n, v in values.items()})
    kept = _ranged(rows.withColumns({f"_v_{n}": v.cast("long") for n, v in values.items()}), [F.col(k) for k in (*keys, *order)])
    kept = kept.withColumn("_rg_p", F.shiftright("_rg_at", 33))
    own = Window.partitionBy("_rg_p", *keys).orderBy("_rg_at").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*keys).orderBy("_rg_p").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    totals = kept.groupBy("_rg_p", *keys).agg(*[F.sum(f"_v_{n}").alias(f"_v_{n}") for n in values])
    carry = totals.select(F.col("_rg_p").alias("_rg_q"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[F.sum(f"_v_{n}").over(earlier).alias(f"_c_{n}") for n in values])
    carry = carry.where(" OR ".join(f"_c_{n} IS NOT NULL" for n in values))
    same = F.col("_rg_p") == F.col("_rg_q")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    kept = kept.withColumns({n: F.sum(f"_v_{n}").over(own) for n in values}).join(F.broadcast(carry), same, "left")
    kept = kept.withColumns({n: F.col(n) + F.coalesce(f"_c_{n}", F.lit(0)) for n in values})
    return kept.drop("_rg_at", "_rg_p", "_rg_q", *[f"_k{i}" for i in range(len(keys))], *[f"{x}{n}" for n in values for x in ("_v_", "_c_")])


def ranked(rows: DataFrame, keys: list[str], order: list[str], out: str = "rank") -> DataFrame:
    """Numbers from 1 within each key, in order."""
    return running(rows, keys, order, **{out: F.lit(1)})


def mismatch_runs(checks: DataFrame, least: int = 5) -> DataFrame:
    """Runs of at least `least` mismatches in index order; a match ends a run. checks: device, idx, ok.

    The number of matches before is the same throughout a run, and only there.
    """
    rows = running(checks.select("device", "idx", "ok"), ["device"], ["idx"], island=F.when(F.col("ok"), 1).otherwise(0))
    runs = rows.where("NOT ok").groupBy("device", "island").agg(F.count(F.lit(1)).alias("run"), F.min("idx").alias("first_idx"))
    return runs.where(F.col("run") >= least).drop("island")


def last_state(events: DataFrame, key: str, seq: str, state: str) -> DataFrame:
    """Last state per key; committed stays committed."""
    return events.groupBy(key).agg(F.max_by(state, seq).alias("last"), F.bool_or(F.col(state) == "committed").alias("_done")).select(
        key, F.when(F.col("_done"), "committed").otherwise(F.col("last")).alias("state")
    )
