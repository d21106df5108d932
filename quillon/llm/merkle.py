"""Merkle manifest of a dataset: a tree over the rows of every source, a tree over the sources' roots, a proof for every row.

A row's leaf is the hash of its columns, each `-` if null, else its length in UTF-8 bytes, a colon and its value. Digests are
lowercase hex sha256 and are hashed as text. FANOUT consecutive nodes become one, until one is left. Rows get their places
by ranges in order, counted apart, so that no source is one task's. Aligned blocks of FANOUT ** LEVELS nodes are contiguous
matrices of 64 bytes a digest: rows of a block are hashed level by level, siblings come from the places alone. Blocks' nodes
are the next tree's leaves, so a tree of any size takes a few rounds, each over FANOUT ** LEVELS fewer rows, and one more
round down gives every block the siblings above it.

Nulls in any column are part of the leaf; a null source is a tree of its own and comes first, as null keys do; repeated rows
take a place each, equal ones in any order, which shows nowhere; an empty table gives no rows; a text of any length is hashed
where it is read and does not travel. Only `columns` count; other columns, and any names of theirs, are left alone.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SMALL_ROWS, crc_of_id, cut

FANOUT = 16
LEVELS = 3
BLOCK = FANOUT**LEVELS
HEX = 64
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
_PATH = "array<struct<l: string, r: string>>"


def leaf_of(values: list[Column]) -> Column:
    parts = [F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-")) for v in values]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def placed(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """rows with _pos, their place from 0 in their group, and _n, the group's rows. Equal rows are told apart by where they were read,
    so any number of them spreads over ranges."""
    by = [F.col(c).asc_nulls_first() for c in (*group, *order)] + [F.col("_tie")]
    ranges = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by)
    kept = cut(ranges.drop("_tie").withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)))
    sizes = kept.groupBy("_part", *group).agg(F.count(F.lit(1)).alias("_c"), F.min("_at").alias("_first"))
    whole = Window.partitionBy(*group)  # at most one row a range
    sizes = sizes.withColumn("_n", F.sum("_c").over(whole)).withColumn("_before", F.sum("_c").over(whole.orderBy("_part")) - F.col("_c"))
    sizes = cut(sizes.select(F.col("_part").alias("_p"), *[F.col(c).alias(f"_g_{c}") for c in group], "_n", (F.col("_before") - F.col("_first")).alias("_shift")))
    same = F.col("_part") == F.col("_p")
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    few = sizes.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS
    kept = kept.join(F.broadcast(sizes) if few else sizes, same)
    return kept.withColumn("_pos", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_p", "_shift", *[f"_g_{c}" for c in group])


def rounds(n: int) -> int:
    """Levels above n nodes."""
    r = 0
    while n > 1:
        n, r = -(-n // FANOUT), r + 1
    return r


def matrices(digests: np.ndarray, levels: int) -> list[np.ndarray]:
    """The nodes of each level of a block, 64 bytes a row, from its leaves up to its top."""
    out = [digests]
    for _ in range(levels):
        flat = out[-1].tobytes()
        above = b"".join(sha256(flat[at : at + HEX * FANOUT]).hexdigest().encode() for at in range(0, len(flat), HEX * FANOUT))
        out.append(np.frombuffer(above, dtype=np.uint8).reshape(-1, HEX))
    return out


def siblings(flats: list[bytes], at: int) -> list[tuple[bytes, bytes]]:
    """What stands left and right of a leaf's ancestor in its run, at each level of a block (the levels' matrices as bytes)."""
    out = []
    for flat in flats:
        here, run = at * HEX, at // FANOUT * FANOUT * HEX
        out.append((flat[run:here], flat[here + HEX : run + FANOUT * HEX]))
        at //= FANOUT
    return out


def folded(leaf: bytes, path: list[tuple[bytes, bytes]]) -> bytes:
    for left, right in path:
        leaf = sha256(left + leaf + right).hexdigest().encode()
    return leaf


def _block(nodes: pa.Table) -> tuple[np.ndarray, list[np.ndarray]]:
    """The order of a block's rows by place, and its levels; how many there are depends on the whole tree."""
    order = np.argsort(nodes.column("_pos").to_numpy(), kind="stable")
    digests = np.frombuffer("".join(nodes.column("_digest").to_pylist()).encode(), dtype=np.uint8).reshape(-1, HEX)[order]
    return order, matrices(digests, min(LEVELS, rounds(nodes.column("_n")[0].as_py())))


def _up(nodes: DataFrame) -> DataFrame:
    """The nodes that blocks become: _tree, _pos, _n, _digest again."""

    def run(table: pa.Table) -> pa.Table:
        _, levels = _block(table)
        n = -(-table.column("_n")[0].as_py() // BLOCK)
        return pa.table({"_tree": table.column("_tree")[:1], "_pos": pa.array([table.column("_pos")[0].as_py() // BLOCK], pa.int64()), "_n": pa.array([n], pa.int64()), "_digest": [levels[-1].tobytes().decode()]})

    nodes = nodes.select("_tree", "_pos", "_n", "_digest", F.expr(f"_pos div {BLOCK}").alias("_block"))
    return nodes.groupBy("_tree", "_block").applyInArrow(run, "_tree long, _pos long, _n long, _digest string")


def _down(nodes: DataFrame, above: DataFrame) -> DataFrame:
    """_tree, _pos, _path (all siblings up to the top of above) of the nodes; above has _tree, _pos (the block's) and _path."""

    def run(table: pa.Table, upper: pa.Table) -> pa.Table:
        order, levels = _block(table)
        flats, rest = [m.tobytes() for m in levels[:-1]], upper.column("_path")[0].as_py()
        paths = [[{"l": a.decode(), "r": b.decode()} for a, b in siblings(flats, at)] + rest for at in range(len(order))]
        return pa.table({"_tree": table.column("_tree"), "_pos": table.column("_pos").take(pa.array(order)), "_path": pa.array(paths, pa.list_(pa.struct([("l", pa.string()), ("r", pa.string())])))})

    nodes = nodes.withColumn("_block", F.expr(f"_pos div {BLOCK}"))
    return nodes.groupBy("_tree", "_block").cogroup(above.groupBy("_tree", "_pos")).applyInArrow(run, f"_tree long, _pos long, _path {_PATH}")


def grown(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The nodes below each round of blocks, and the trees' roots (_tree, _pos, _n, _digest). A round has BLOCK times fewer nodes."""
    below = []
    while True:
        below.append(nodes)
        nodes = cut(_up(nodes))
        if nodes.where("_n > 1").isEmpty():
            return below, nodes


def _proofs(leaves: DataFrame, above: DataFrame, changed: str | None) -> DataFrame:
    """leaves with proof (the hash of all siblings) and folded (the root that the changed, else the own leaf leads to)."""
    names = [c for c in leaves.columns if c not in ("_tree", "_pos", "_n", "_digest", "_block", changed)]
    kinds = ", ".join(f"`{c}` {leaves.schema[c].dataType.simpleString()}" for c in names)

    def run(table: pa.Table, upper: pa.Table) -> pa.Table:
        order, levels = _block(table)
        flats = [m.tobytes() for m in levels[:-1]]
        rest = [(p["l"].encode(), p["r"].encode()) for p in upper.column("_path")[0].as_py()]
        tail = b"".join(a + b for a, b in rest)
        table = table.take(pa.array(order))
        new = table.column(changed).to_pylist() if changed else [None] * len(order)
        own, proof, fold = levels[0].tobytes(), [], []
        for at, leaf in enumerate(new):
            path = siblings(flats, at)
            proof.append(sha256(b"".join(a + b for a, b in path) + tail).hexdigest())
            fold.append(folded(leaf.encode() if leaf else own[at * HEX : (at + 1) * HEX], path + rest).decode())
        n = len(order)
        return pa.table({c: table.column(c) for c in names} | {"leaf": table.column("_digest"), "subroot": [upper.column("_digest")[0].as_py()] * n, "proof_sha256": proof, "folded_root": fold})

    out = leaves.groupBy("_tree", "_block").cogroup(above.groupBy("_tree", "_pos"))
    return out.applyInArrow(run, f"{kinds}, leaf string, subroot string, proof_sha256 string, folded_root string")


def manifest(docs: DataFrame, columns: tuple[str, ...] = COLUMNS, key: str = "doc_id", source: str = "source", tampered: tuple[Column, dict[str, Column]] | None = None) -> DataFrame:
    """key, source, leaf, subroot, root, proof_sha256, folded_root and verified for every row.

    tampered: a condition, and the columns that change where it holds; these rows fold the changed leaf with the siblings of the
    original ones. Without it every row must verify.
    """
    leaves = docs.select(F.col(key).alias("_key"), F.col(source).alias("_source"), leaf_of([F.col(c) for c in columns]).alias("_digest"), (
        F.when(tampered[0], leaf_of([tampered[1].get(c, F.col(c)) for c in columns])) if tampered else F.lit(None).cast("string")
    ).alias("_changed"))
    leaves = placed(cut(leaves), ["_source"], ["_key", "_digest"])
    sources = placed(leaves.select("_source").distinct(), [], ["_source"])
    sources = cut(sources.select(F.col("_source").alias("_name"), F.col("_pos").alias("_tree"), F.col("_n").alias("_trees")))
    few = sources.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS
    names = sources.select("_name", "_tree")
    if few:
        leaves = leaves.join(F.broadcast(names), F.col("_source").eqNullSafe(F.col("_name")))
    else:  # a source's rows are dealt over as many parts as it has blocks
        parts = leaves.groupBy(F.col("_source").alias("_s"), F.expr(f"_pos div {BLOCK}").alias("_b")).agg(F.count(F.lit(1)).alias("_c"))
        names = cut(parts.join(names, F.col("_s").eqNullSafe(F.col("_name"))).select("_name", "_b", "_tree"))
        leaves = leaves.join(names, F.col("_source").eqNullSafe(F.col("_name")) & (F.expr(f"_pos div {BLOCK}") == F.col("_b"))).drop("_b")
    leaves = cut(leaves.drop("_name").withColumn("_block", F.expr(f"_pos div {BLOCK}")))
    below, roots = grown(leaves)
    trees = sources.agg(F.max("_trees").alias("n")).first()["n"] or 0
    tops = cut(roots.select(F.lit(0).cast("long").alias("_tree"), F.col("_tree").alias("_pos"), F.lit(trees).cast("long").alias("_n"), "_digest"))
    above, root = grown(tops)
    # down again: the sources' siblings, then those of the blocks of each round
    paths = root.select("_tree", "_pos", F.array().cast(_PATH).alias("_path"))
    for nodes in reversed(above):
        paths = cut(_down(nodes, paths))
    paths = paths.select(F.col("_pos").alias("_tree"), F.lit(0).cast("long").alias("_pos"), "_path")
    for nodes in reversed(below[1:]):
        paths = cut(_down(nodes, paths))
    subroots = roots.select("_tree", "_digest")
    found = _proofs(leaves, paths.join(subroots, "_tree"), "_changed")
    name = root.first()  # one digest
    found = found.withColumn("root", F.lit(name["_digest"] if name else None).cast("string")).withColumn("verified", F.col("folded_root") == F.col("root"))
    return found.select(F.col("_key").alias(key), F.col("_source").alias(source), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def merkle_report(docs: DataFrame) -> DataFrame:
    """The manifest with every fifth row, by its id's crc32, tampered with: its text's A-Z in lower case."""
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = manifest(docs.select(*COLUMNS), tampered=(F.pmod(crc_of_id(), F.lit(5)) == 0, {"text": low}))
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def _sql() -> str:
    field = lambda c: f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"
    leaf = lambda text: "sha256(" + " || ".join([field(c) for c in COLUMNS[:-1]] + [f"coalesce(strlen({text})::VARCHAR || ':' || {text}, '-')"]) + ")"
    bits = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[], lambda v, z: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)"
    crc = f"xor(4294967295, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ord(x)::UBIGINT)), lambda c, b: {bits}))"
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    ctes = [
        f"d AS (SELECT *, {leaf('text')} AS leaf, CASE WHEN coalesce({crc}, 0) % 5 = 0 THEN {leaf(low)} END AS changed FROM documents)",
        "s0 AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n, leaf AS h FROM d)",
    ]
    up = "sha256(string_agg(h, '' ORDER BY i))"
    for k in range(5):  # sources of up to 16 ** 5 rows
        ctes.append(f"s{k + 1} AS (SELECT source, i // 16 AS i, (max(n) + 15) // 16 AS n, CASE WHEN max(n) > 1 THEN {up} ELSE max(h) END AS h FROM s{k} GROUP BY source, i // 16)")
    ctes.append("t0 AS (SELECT source, h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM s5)")
    for k in range(3):  # up to 16 ** 3 sources
        ctes.append(f"t{k + 1} AS (SELECT i // 16 AS i, (max(n) + 15) // 16 AS n, CASE WHEN max(n) > 1 THEN {up} ELSE max(h) END AS h FROM t{k} GROUP BY i // 16)")
    last = "SELECT s0.doc_id, s0.leaf, t0.h AS subroot, t0.i AS ti, s0.source, s0.i AS si, '' AS p, coalesce(changed, leaf) AS f FROM s0 JOIN t0 ON s0.source IS NOT DISTINCT FROM t0.source"
    ctes.append(f"f0 AS ({last})")
    steps = [(f"s{k}", "si", k, "x.source IS NOT DISTINCT FROM f.source AND ") for k in range(5)] + [(f"t{k}", "ti", k, "") for k in range(3)]
    for j, (level, at, k, own) in enumerate(steps):
        here = f"{at} // {16**k}"
        side = lambda sign: f"coalesce((SELECT string_agg(x.h, '' ORDER BY x.i) FROM {level} x WHERE {own}x.i // 16 = f.{here} // 16 AND x.i {sign} f.{here}), '')"  # noqa: E731, B023
        more = f"(SELECT max(x.n) FROM {level} x WHERE {own}true) > 1" if own else f"(SELECT max(x.n) FROM {level} x) > 1"
        ctes.append(f"g{j} AS (SELECT f.*, {side('<')} AS l, {side('>')} AS r, {more} AS m FROM f{j} f)")
        ctes.append(f"f{j + 1} AS (SELECT doc_id, leaf, subroot, ti, source, si, CASE WHEN m THEN p || l || r ELSE p END AS p, CASE WHEN m THEN sha256(l || f || r) ELSE f END AS f FROM g{j})")
    tail = "SELECT doc_id, leaf, subroot, (SELECT h FROM t3) AS root, sha256(p) AS proof_sha256, f AS folded_root, f = (SELECT h FROM t3) AS verified"
    return "WITH " + ",\n".join(ctes) + f"\n{tail} FROM f{len(steps)}"


MERKLE_SQL = _sql()
