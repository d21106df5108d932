"""Collision-free names, as if files came one after the other: each takes its name, or the first free one with a number.

Numbers go between stem and extension (`resolve`: _001, _002 ..., `beside`: _1, _2 ...). Whatever was taken stays taken, so
the files that find their name taken get rising numbers, and the j-th of them gets the j-th number that is free for them:
its rank, pushed on by the taken numbers below it. Ranks, taken numbers and what they push come from running counts over
sorted ranges, so one name may have any share of all rows.

A number is taken if the name stands already, or if a file whose own name looks like that (a_001.mp3) came before the count
got there. Names are therefore worked through by how many numbers they end in: the files called a.mp3 first, then, knowing
what those took, the ones called a_001.mp3. Where names of both kinds came in turns, only the contested numbers are walked
through in order, a block at a time, two numbers each: which of them the files of that name reach before their owner.

Null names stay null and take nothing; rows of equal order count in any order; names that end in a dot keep it behind the
number; empty tables give no rows; columns of any name are kept, but one named as the added column is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.operators.catalog import running
from quillon.operators.shared import cut

BLOCK = 100_000  # contested numbers that one task walks through


class Form(NamedTuple):
    number: str  # what the numbers look like
    text: str  # how they are written


THREE = Form(r"(?:00[1-9]|0[1-9][0-9]|[1-9][0-9]{2,17})", "%03d")
PLAIN = Form(r"[1-9][0-9]{0,17}", "%d")


def extension_of(name: Column) -> Column:
    """What stands from the last dot on, the dot too; a leading dot begins none."""
    return F.regexp_extract(name, r"(?s)^.+(\.[^.]*)\z", 1)


def _stem(name: Column) -> Column:
    return name.substr(F.lit(1), F.length(name) - F.length(extension_of(name)))


def _numbered(name: Column, k: Column, form: Form) -> Column:
    return F.concat(_stem(name), F.lit("_"), F.format_string(form.text, k), extension_of(name))


def _parent(name: Column, form: Form) -> tuple[Column, Column]:
    """The name that this one is a numbered form of (null if of none), and the number."""
    pattern = rf"(?s)\A(.*)_({form.number})\z"
    stem = _stem(name)
    k = F.regexp_extract(stem, pattern, 2)
    return F.when(k != "", F.concat(F.regexp_extract(stem, pattern, 1), extension_of(name))), k.try_cast("bigint")


def _numbers_at_end(name: Column, form: Form) -> Column:
    found = F.regexp_extract(_stem(name), rf"((?:_{form.number})+)\z", 1)
    return F.length(found) - F.length(F.replace(found, F.lit("_"), F.lit("")))


def _walked(contested: DataFrame) -> DataFrame:
    """contested (_name, _k, _child, _c, _m, _e, _block) with _won: whether the files of _name reach the number first.

    In the order of _e, the number's place among those that do not stand already: x of _m files are placed so far; the numbers
    between two contested ones are free for them; a contested one is theirs if fewer than _c are placed, as the _c-th file came
    before the owner did. A task walks through its sorted blocks one after the other, as rows, so a name costs no more than its
    rows. Names of several blocks have these walked side by side, each from where the last round left the block before it, until
    that no longer changes: at the latest after as many rounds as a name has blocks.
    """
    contested = contested.select("_name", "_k", "_child", "_c", "_m", "_e", "_block")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in contested.schema)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, x, last = None, 0, 0
        for rows in batches:
            won, placed = [], []
            for name, block, c, most, e, entry_x, entry_e in zip(*[rows[n].tolist() for n in ("_name", "_block", "_c", "_m", "_e", "_entry_x", "_entry_e")]):
                if at != (name, block):
                    at, x, last = (name, block), entry_x, entry_e
                x = min(most, x + e - last - 1)
                won.append(x < c)
                x, last = x + (x < c), e
                placed.append(x)
            yield rows.drop(columns=["_entry_x", "_entry_e"]).assign(_won=pd.Series(won, dtype=bool, index=rows.index), _x=pd.Series(placed, dtype="int64", index=rows.index))

    def walked(rows: DataFrame) -> DataFrame:
        blocks = rows.repartition("_name", "_block").sortWithinPartitions("_name", "_block", "_e")
        return cut(blocks.mapInPandas(walk, f"{kinds}, _won boolean, _x long"))

    first = contested.withColumns({"_entry_x": F.lit(0).cast("long"), "_entry_e": F.lit(0).cast("long")})
    several = cut(contested.where("_block > 0").select("_name").distinct())
    if several.isEmpty():
        return walked(first).drop("_x")
    entries = contested.select("_name", "_block").limit(0).selectExpr("*", "0L AS _x", "0L AS _last")
    out = walked(first)
    while True:
        ends = out.join(several, "_name", "left_semi").groupBy("_name", "_block").agg(F.max_by(F.struct("_x", "_e"), "_e").alias("_end"))
        found = cut(ends.select("_name", (F.col("_block") + 1).alias("_block"), F.col("_end._x").alias("_x"), F.col("_end._e").alias("_last")))
        if found.exceptAll(entries).isEmpty():
            return out.drop("_x")
        entries = found
        from_entry = {"_entry_x": F.coalesce("_x", F.lit(0)), "_entry_e": F.coalesce("_last", F.lit(0))}
        out = walked(contested.join(entries, ["_name", "_block"], "left").withColumns(from_entry).drop("_x", "_last"))


def _placed(files: DataFrame, name: str, order: str, out: str, form: Form, existing: DataFrame | None, content: str | None) -> DataFrame:
    """files with `out`; with content, null where the file that has the very name holds the same. existing: _there, _content."""
    spark, kept = files.sparkSession, [c for c in files.columns if c != out]
    rows = files.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_row"), F.col(name).alias("_name"), F.col(order).alias("_order"), (F.col(content) if content else F.lit(None)).cast("string").alias("_content"))
    unnamed = rows.where("_name IS NULL").select("_row", F.lit(None).cast("string").alias("_out"))
    rows = cut(rows.where("_name IS NOT NULL").withColumn("_depth", _numbers_at_end(F.col("_name"), form)))
    there = spark.createDataFrame([], "_there string, _content string") if existing is None else existing.where("_there IS NOT NULL")
    there = cut(there.withColumns(dict(zip(("_of", "_k"), _parent(F.col("_there"), form)))))
    depths = sorted(r[0] for r in rows.select("_depth").distinct().collect())  # at most half a name's characters
    done, given = [unnamed], None
    for depth in depths:
        own = rows.where(F.col("_depth") == depth).drop("_depth")
        names = own.select("_name").distinct()
        marks = there.select(F.col("_there").alias("_name"), "_content").join(names, "_name", "left_semi")
        marks = marks if given is None else marks.unionByName(given)
        merged = own.withColumn("_kind", F.lit(1)).unionByName(marks.withColumn("_kind", F.lit(0)), allowMissingColumns=True)
        merged = running(merged, ["_name"], ["_kind", "_order"], _rank=F.lit(1))
        done.append(merged.where("_kind = 1 AND _rank = 1").select("_row", F.col("_name").alias("_out")))
        over = merged.where("_kind = 1 AND _rank > 1")
        if content:
            merged = cut(merged)
            holder = merged.where("_rank = 1").select("_name", F.col("_content").alias("_held"))
            over = merged.where("_kind = 1 AND _rank > 1").join(holder, "_name")
            same = F.col("_content").eqNullSafe(F.col("_held")) & F.col("_content").isNotNull()
            done.append(over.where(same).select("_row", F.lit(None).cast("string").alias("_out")))
            over = running(over.where(~same).drop("_rank", "_held"), ["_name"], ["_order"], _j=F.lit(1))
        else:
            over = over.withColumn("_j", F.col("_rank") - 1)
        over = cut(over.select("_row", "_name", "_order", "_content", "_j"))
        if over.isEmpty():
            given = None
            continue
        names = over.select("_name").distinct()
        taken = there.select(F.col("_of").alias("_name"), "_k").join(names, "_name", "left_semi").distinct()
        contested = None
        if depth + 1 in depths:
            contested = _contested(over, rows.where(F.col("_depth") == depth + 1), there, taken, names, form)
            taken = taken.unionByName(contested.where("NOT _won").select("_name", "_k"))
        taken = cut(taken)
        if taken.isEmpty():
            over = over.withColumn("_slot", F.col("_j"))
        else:
            # free numbers below the taken one: the files of these ranks come before it, each of the others is pushed on by one
            taken = running(taken, ["_name"], ["_k"], _i=F.lit(1)).select("_name", (F.col("_k") - F.col("_i")).alias("_j"), F.lit(1).alias("_kind"))
            over = running(over.withColumn("_kind", F.lit(0)).unionByName(taken, allowMissingColumns=True), ["_name"], ["_j", "_kind"], _slot=F.lit(1)).where("_kind = 0")
        placed = over.select("_row", _numbered(F.col("_name"), F.col("_slot"), form).alias("_out"), "_content")
        given = None
        if contested is not None:
            given = contested.where("_won").select(F.col("_child").alias("_name"))
            given = cut(given.join(placed.select(F.col("_out").alias("_name"), "_content"), "_name") if content else given.withColumn("_content", F.lit(None).cast("string")))
        done.append(placed.drop("_content"))
    return reduce(DataFrame.unionByName, done).select("_row.*", F.col("_out").alias(out))


def _contested(over: DataFrame, literal: DataFrame, there: DataFrame, taken: DataFrame, names: DataFrame, form: Form) -> DataFrame:
    """The numbers of names that files ask for by name, with _won. literal: those files; what stands already is no contest."""
    first = literal.groupBy(F.col("_name").alias("_child")).agg(F.min("_order").alias("_order"))
    first = first.join(there.select(F.col("_there").alias("_child")), "_child", "left_anti").withColumns(dict(zip(("_name", "_k"), _parent(F.col("_child"), form))))
    first = first.join(names, "_name", "left_semi")
    # _c: files of the name that came before the number's owner
    before = over.select("_name", "_order", F.lit(0).alias("_kind")).unionByName(first.withColumn("_kind", F.lit(1)), allowMissingColumns=True)
    before = running(before, ["_name"], ["_order", "_kind"], _c=1 - F.col("_kind")).where("_kind = 1").select("_name", "_k", "_child", "_c")
    below = before.withColumn("_kind", F.lit(1)).unionByName(taken.withColumn("_kind", F.lit(0)), allowMissingColumns=True)
    below = running(below, ["_name"], ["_k"], _below=1 - F.col("_kind"), _nth=F.col("_kind")).where("_kind = 1")
    counts = over.groupBy("_name").agg(F.count(F.lit(1)).alias("_m"))
    rows = below.join(counts, "_name").select("_name", "_k", "_child", "_c", "_m", (F.col("_k") - F.col("_below")).alias("_e"), F.expr(f"(_nth - 1) div {BLOCK}").alias("_block"))
    return _walked(cut(rows))


def resolve(files: DataFrame, name: str = "name", order: str = "seq", out: str = "resolved") -> DataFrame:
    """Adds `out`: the name, or the first free name_NNN, in arrival order; generated names occupy the space too."""
    return _placed(files, name, order, out, THREE, None, None)


def beside(files: DataFrame, existing: DataFrame, name: str = "name", order: str = "seq", out: str = "resolved") -> DataFrame:
    """Adds `out`: the name, or the first name_N that neither stands in existing (name) nor was given before."""
    there = existing.select(F.col(name).alias("_there"), F.lit(None).cast("string").alias("_content")).distinct()
    return _placed(files, name, order, out, PLAIN, there, None)


def backed_up(files: DataFrame, existing: DataFrame, name: str = "name", order: str = "seq", content: str = "sha", out: str = "stored") -> DataFrame:
    """Adds `out`: where each file is backed up beside existing (name, content), null where the file under its very name, one that
    stood there or one that came before, holds the same and nothing is copied."""
    there = existing.groupBy(F.col(name).alias("_there")).agg(F.min(F.col(content).cast("string")).alias("_content"))
    return _placed(files, name, order, out, PLAIN, there, content)
