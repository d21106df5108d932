"""Chat formatting of reply trees.

Self-joins by pointer doubling enumerate every root-to-leaf path (log2 of the depth, not its length, in joins; they end
when no link is left); branches are ranked by the sum of their nodes' scores, and each chosen path becomes one
conversation, put together by DataFrame functions. A node whose parent is missing is a root; nodes on a cycle lie on no
root-to-leaf path. Null roles and texts are empty; null ids are one conversation, null turns come first and repeated
rows are turns of their own; ties in score go to the smaller leaf id. One conversation is one string, so it is put
together in one task.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

START, END = "<|im_start|>", "<|im_end|>"
_ESCAPED = re.compile(r"\\(\\|\||n)")
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\n" if m.group(1) == "n" else m.group(1), text)


def escaped(text: Column) -> Column:
    """As escape() does."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def turns_of(formatted: str) -> Iterator[tuple[str, str]]:
    for m in _TURN.finditer(formatted):
        yield unescape(m.group(1)), unescape(m.group(2))


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    return list(turns_of(formatted))


def paths(nodes: DataFrame) -> DataFrame:
    """(tree, leaf, node, dist) for every node of every root-to-leaf path of nodes (tree, node, parent); dist counts from the leaf."""
    nodes = nodes.select("tree", "node", "parent")
    known = nodes.select("tree", F.col("node").alias("parent"))
    link = cut(nodes.join(known, ["tree", "parent"], "left_semi").select("tree", "node", F.col("parent").alias("up")))
    leaves = nodes.select("tree", "node").join(link.select("tree", F.col("up").alias("node")), ["tree", "node"], "left_anti")
    roots = nodes.select("tree", "node").join(link.select("tree", "node"), ["tree", "node"], "left_anti")
    walk = leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("dist"))
    most = nodes.groupBy("tree").count().agg(F.max("count")).first()[0] or 0  # a cycle has links of any length
    step = 1
    while step < most and not link.isEmpty():
        more = walk.join(link, ["tree", "node"]).select("tree", "leaf", F.col("up").alias("node"), (F.col("dist") + step).alias("dist"))
        walk = cut(walk.unionByName(more))
        over = link.select("tree", F.col("node").alias("up"), F.col("up").alias("top"))
        link = cut(link.join(over, ["tree", "up"]).select("tree", "node", F.col("top").alias("up")))
        step *= 2
    ended = walk.join(roots, ["tree", "node"], "left_semi").select("tree", "leaf").distinct()
    return walk.join(ended, ["tree", "leaf"], "left_semi")


def conversations_of_trees(nodes: DataFrame, best: int | None = None) -> DataFrame:
    """Formats root-to-leaf paths of nodes (tree string, node long, parent long, role, text, score double).

    Returns tree, leaf, branch (rank by score), formatted and spans, the (start, end) code points of the assistant texts, which
    carry loss; best keeps so many branches of each tree.
    """
    said = nodes.select("tree", "node", F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    walk = paths(nodes)
    ranked = walk.join(said.select("tree", "node", "score"), ["tree", "node"]).groupBy("tree", "leaf").agg(F.sum("score").alias("score"))
    ranked = ranked.withColumn("branch", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("score"), "leaf"))).drop("score")
    if best:
        ranked = ranked.where(F.col("branch") <= best)
    head = F.concat(F.lit(START), F.replace(escaped(F.col("role")), F.lit("\n"), F.lit("\\n")), F.lit("\n"))
    rows = walk.join(ranked, ["tree", "leaf"]).join(said.drop("score"), ["tree", "node"]).withColumn("at", -F.col("dist"))
    rows = rows.select("tree", "leaf", "branch", "at", (F.col("role") == "assistant").alias("loss"), head.alias("head"), escaped(F.col("text")).alias("body"))
    rows = rows.select("tree", "leaf", "branch", "at", "loss", F.concat("head", "body", F.lit(f"{END}\n")).alias("piece"), F.length("head").alias("skip"), F.length("body").alias("size"))
    before = Window.partitionBy("tree", "leaf").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("begin", F.coalesce(F.sum(F.length("piece").cast("long")).over(before), F.lit(0)) + F.col("skip"))
    span = F.when(F.col("loss"), F.array(F.col("begin"), F.col("begin") + F.col("size")))
    return rows.groupBy("tree", "leaf", "branch").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "piece"))), lambda t: t["piece"]), "").alias("formatted"), F.sort_array(F.collect_list(span)).alias("spans")
    )


def chat_report(talks: DataFrame) -> DataFrame:
    """Digests read back from the formatted conversations; talks has conv_id, turn, role, text, one branch each."""
    kind = talks.schema["conv_id"].dataType.simpleString()
    talks = talks.select("turn", "role", "text", F.coalesce(F.col("conv_id").cast("string"), F.lit("null")).alias("tree"))
    place = Window.partitionBy("tree").orderBy("turn", "role", "text")
    nodes = cut(talks.select("tree", "role", "text", F.row_number().over(place).cast("long").alias("node")))
    done = conversations_of_trees(nodes.select("*", (F.col("node") - 1).alias("parent"), F.lit(0.0).alias("score")), best=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                text, turns, said, loss, loss_chars = batch["formatted"][i].as_py(), 0, hashlib.sha256(), hashlib.sha256(), 0
                for role, body in turns_of(text):
                    turns += 1
                    said.update(f"{role}\n{body}\n".encode("utf-8", "surrogatepass"))
                for a, b in batch["spans"][i].as_py():
                    part = unescape(text[a:b])
                    loss_chars += len(part)
                    loss.update(part.encode("utf-8", "surrogatepass"))
                rows.append((batch["tree"][i].as_py(), turns, said.hexdigest(), loss_chars, loss.hexdigest(), len(text)))
            names = ["tree", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            yield pa.RecordBatch.from_pydict({n: pa.array([r[k] for r in rows], pa.string() if n == "tree" or "sha" in n else pa.int64()) for k, n in enumerate(names)})

    read = done.select("tree", "formatted", "spans").mapInArrow(run, "tree string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    return read.select(F.when(F.col("tree") != "null", F.col("tree")).cast(kind).alias("conv_id"), "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
