"""Checkpoint, journal and manifest as tables: their state machines, folded over events in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.operators.catalog import running
from quillon.operators.shared import cut

FAN = 512  # functions that one row composes


class Machine:
    """A state machine with registers, as data.

    moves: (state, event) to the next state; a pair that is not listed is rejected and changes nothing. writes: for an event, the
    registers it sets, each from a column of the events or to null; they are set with every accepted move, or with the listed
    states' moves only. The first state is the one that keys begin in.
    """

    def __init__(self, states: list[str], moves: dict[tuple[str, str], str], writes: dict[str, dict[str, str | None]], unless: dict[str, set[str]] | None = None):
        self.states, self.moves, self.writes, self.unless = states, moves, writes, unless or {}
        self.registers = sorted({r for w in writes.values() for r in w})

    def function(self, kind: Column) -> Column:
        """What an event does, from each state: next state, moves rejected, and each register's new value, if it is set."""
        events = sorted({e for _, e in self.moves})
        out = []
        for i, state in enumerate(self.states):
            go, bad = F.lit(i), F.lit(1)
            sets = {r: (F.lit(False), F.lit(None).cast("string")) for r in self.registers}
            for event in events:
                if (state, event) not in self.moves:
                    continue
                go = F.when(kind == event, self.states.index(self.moves[state, event])).otherwise(go)
                bad = F.when(kind == event, 0).otherwise(bad)
                for r, column in self.writes.get(event, {}).items() if state not in self.unless.get(event, ()) else ():
                    value = F.lit(None).cast("string") if column is None else F.col(column).cast("string")
                    sets[r] = (F.when(kind == event, F.lit(True)).otherwise(sets[r][0]), F.when(kind == event, value).otherwise(sets[r][1]))
            registers = F.array(*[F.struct(s.alias("set"), v.alias("value")) for s, v in sets.values()])
            out.append(F.struct(go.alias("go"), bad.cast("long").alias("bad"), registers.alias("regs")))
        return F.array(*out)


def composed(first: Column, second: Column) -> Column:
    """The function that does the first, then the second."""

    def step(f: Column) -> Column:
        g = F.get(second, f["go"])
        registers = F.zip_with(f["regs"], g["regs"], lambda a, b: F.struct((a["set"] | b["set"]).alias("set"), F.when(b["set"], b["value"]).otherwise(a["value"]).alias("value")))
        return F.struct(g["go"].alias("go"), (f["bad"] + g["bad"]).alias("bad"), registers.alias("regs"))

    return F.transform(first, step)


def folded(events: DataFrame, machine: Machine, key: str, seq: str = "seq", kind: str = "kind") -> DataFrame:
    """key, status, the registers, and rejected (moves the machine refused) after all of a key's events in order.

    An event is a function from states to states, and so are events one after the other. These compose in any split: FAN events
    of a key make one, FAN of these make one, and so on, so a key with any share of the events is shared by many tasks. Null
    kinds are rejected; events of equal order are taken in any order; a key without events has no row.
    """
    rows = running(events.select(key, seq, machine.function(F.col(kind)).alias("_f")), [key], [seq], _at=F.lit(1)).select(F.col(key).alias("_key"), "_at", "_f")
    most = rows.agg(F.max("_at")).first()[0] or 1
    rows = rows.withColumn("_at", F.col("_at") - 1)
    one = F.array(*[F.struct(F.lit(i).alias("go"), F.lit(0).cast("long").alias("bad"), F.array(*[F.struct(F.lit(False).alias("set"), F.lit(None).cast("string").alias("value")) for _ in machine.registers]).alias("regs")) for i in range(len(machine.states))])
    while True:
        some = F.array_sort(F.collect_list(F.struct("_at", "_f")))  # FAN at most
        rows = rows.groupBy("_key", F.expr(f"_at div {FAN}").alias("_at")).agg(some.alias("_all"))
        rows = rows.select("_key", "_at", F.aggregate("_all", one, lambda done, e: composed(done, e["_f"])).alias("_f"))
        most = -(-most // FAN)
        if most <= 1:
            break
        rows = cut(rows)
    end = F.col("_f")[0]
    status = F.element_at(F.array(*[F.lit(s) for s in machine.states]), end["go"] + 1)
    return rows.select(F.col("_key").alias(key), status.alias("status"), *[end["regs"][i]["value"].alias(r) for i, r in enumerate(machine.registers)], end["bad"].alias("rejected"))


_ROWS = ("in_progress", "completed", "failed")
CHECKPOINT = Machine(
    ["unknown", *_ROWS],
    {(s, "start"): "in_progress" for s in ("unknown", *_ROWS)} | {(s, e): e for s in _ROWS for e in ("completed", "failed")} | {(s, "renamed"): s for s in _ROWS},
    {"start": {"name": "name", "checksum": None, "error": None}, "completed": {"checksum": "checksum", "error": None}, "failed": {"error": "error"}, "renamed": {"name": "name"}},
)
_KNOWN = ("pending", "in_progress", "committed", "failed")
JOURNAL = Machine(
    ["unknown", *_KNOWN],
    {(s, "ensure"): "committed" if s == "committed" else "pending" for s in ("unknown", *_KNOWN)} | {(s, e): e for s in _KNOWN for e in ("in_progress", "committed", "failed")},
    {"ensure": {"error": None}, "in_progress": {"error": None}, "committed": {"error": None}, "failed": {"error": "error"}},
    unless={"ensure": {"committed"}},
)


def checkpoint_state(events: DataFrame) -> DataFrame:
    """idx, name, status, checksum, error, rejected from events (seq, idx, kind, name, checksum, error).

    A start opens a row anew; completed sets the hash and clears the error; failed sets the error; renamed changes the name
    alone. Events of a row that was not started are rejected: while it has no start, its status is `unknown`.
    """
    return folded(events, CHECKPOINT, "idx").select("idx", "name", "status", "checksum", "error", "rejected")


def checkpoint_progress(rows: DataFrame, total: int, operation: str = "in_progress") -> DataFrame:
    """One row: completed, last_completed, percentage of the declared total (100 if that is none), and whether it can be taken up: if
    the operation is in progress and has rows at all."""
    done = F.count_if(F.col("status") == "completed")
    share = F.lit(100.0) if total == 0 else done * 100.0 / total
    return rows.agg(
        done.alias("completed"), F.max(F.when(F.col("status") == "completed", F.col("idx"))).alias("last_completed"), share.cast("float").alias("percentage"),
        ((F.count(F.lit(1)) > 0) & F.lit(operation == "in_progress")).alias("recoverable"),
    )


def checkpoints_progress(rows: DataFrame, runs: DataFrame) -> DataFrame:
    """run, completed, last_completed, percentage, recoverable of many checkpoints: rows (run, idx, status), runs (run, total, operation)."""
    done = F.col("status") == "completed"
    found = rows.groupBy("run").agg(F.count_if(done).alias("completed"), F.max(F.when(done, F.col("idx"))).alias("last_completed"), F.count(F.lit(1)).alias("_rows"))
    share = F.when(F.col("total") == 0, 100.0).otherwise(F.coalesce("completed", F.lit(0)) * 100.0 / F.nullif("total", F.lit(0)))
    recoverable = (F.col("operation") == "in_progress") & (F.coalesce("_rows", F.lit(0)) > 0)
    return runs.join(found, "run", "left").select("run", F.coalesce("completed", F.lit(0)).alias("completed"), "last_completed", share.cast("float").alias("percentage"), F.coalesce(recoverable, F.lit(False)).alias("recoverable"))


def journal_state(events: DataFrame) -> DataFrame:
    """target, status, error, rejected from events (seq, target, kind, error): ensure, in_progress, committed, failed.

    Ensure sets what is not committed back to pending; events of a target that was not ensured before are rejected, and while
    it has no ensure it is `unknown`.
    """
    return folded(events, JOURNAL, "target").select("target", "status", "error", "rejected")


def journal_reconciled(journal: DataFrame, disk: DataFrame, sources: DataFrame) -> DataFrame:
    """target, status of journal (target, source, hash, status) after looking at disk (path, sha) and sources (path)."""
    there = disk.select(F.col("path").alias("target"), F.col("sha").alias("_sha"))
    source = sources.select(F.col("path").alias("source"), F.lit(True).alias("_source")).distinct()
    rows = journal.join(there, "target", "left").join(source, "source", "left")
    status = F.when((F.col("status") == "committed") | (F.col("_sha") == F.col("hash")), "committed").when(F.col("_source"), "pending").otherwise("failed")
    return rows.select("target", status.alias("status"))


def status_for(journal: DataFrame, targets: DataFrame) -> DataFrame:
    """targets (target) with the status of the journal's first row (seq) for each; null where it has none."""
    return targets.join(journal.groupBy("target").agg(F.min_by("status", "seq").alias("status")), "target", "left")


def manifest(entries: DataFrame) -> DataFrame:
    """The last entry of each hash, from entries (seq, name, sha, size, path)."""
    return entries.groupBy("sha").agg(F.max_by(F.struct("name", "size", "path", "seq"), "seq").alias("_e")).select("sha", "_e.*")


def manifest_names(entries: DataFrame) -> DataFrame:
    """name, sha: every name ever entered keeps the hash it last stood for."""
    return entries.groupBy("name").agg(F.max_by("sha", "seq").alias("sha"))


def already_processed(manifest_rows: DataFrame, hashes: DataFrame) -> DataFrame:
    """hashes (sha) with seen and the manifest's name."""
    held = manifest_rows.select("sha", "name", F.lit(True).alias("_seen"))
    return hashes.join(held, "sha", "left").select("sha", F.coalesce("_seen", F.lit(False)).alias("seen"), "name")
