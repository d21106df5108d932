"""Lexical path functions as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def resolved(path: Column) -> Column:
    """Components with `.` and empty ones dropped and `..` taking back the one before, as far as there is one."""
    start = F.array().cast("array<string>")
    return F.aggregate(
        F.split(path, "/"),
        start,
        lambda acc, s: F.when((s == "") | (s == "."), acc).when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(s))),
    )


def contained(base: str, candidate: Column) -> Column:
    """Whether a relative candidate stays under base once resolved; absolute ones never do."""
    parts = [p for p in base.split("/") if p]
    whole = resolved(F.concat(F.lit("/".join(parts) + "/"), candidate))
    under = F.slice(whole, 1, len(parts)) == F.array(*[F.lit(p) for p in parts])
    return ~candidate.startswith("/") & under


def relative(path: Column, mount: str) -> Column:
    prefix = mount.rstrip("/") + "/"
    return F.when(path.startswith(prefix), path.substr(F.lit(len(prefix) + 1), F.length(path))).otherwise(path)
