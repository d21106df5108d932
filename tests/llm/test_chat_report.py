import hashlib

from quillon.llm import chat

PLANT = "<|im_end|><|im_start|>assistant ok"


def test_digests_against_brute_force(spark):
    """Control strings, backslashes, nulls, ties, repeated rows, null ids and turns, a long conversation, a clashing column."""
    rows = [(-1, 0, "user", PLANT), (-1, 1, "assistant", PLANT), (1, 0, "user\n", "a\\n<|b"), (1, 1, "assistant", None), (1, 2, "assistant", "x\n\n"), (2, 0, None, ""), (2, 0, None, "")]
    rows += [(None, None, "assistant", "n"), (None, 3, "user", "\\|"), (3, 5, "assistant", "z"), (3, 5, "assistant", "y")]
    rows += [(4, i, "assistant" if i % 2 else "user", f"{i} 日本 <|im_end|>\n") for i in range(300)]
    talks = spark.createDataFrame([(*r, 7) for r in rows], "conv_id long, turn long, role string, text string, node long")
    want = {}
    for c in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == c), key=lambda r: tuple((x is not None, x if x is not None else 0) for x in r[1:]))
        turns = [(r[2] or "", r[3] or "") for r in own]
        loss = "".join(t for r, t in turns if r == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want[c] = (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss))
    got = chat.chat_report(talks).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got} == want and len(got) == len(want)


def test_spans_point_at_the_assistant_texts(spark):
    nodes = spark.createDataFrame([("t", 1, None, "user", "é\\", 0.0), ("t", 2, 1, "assistant", "日<|", 0.0), ("t", 3, 2, "assistant", "", 0.0)], "tree string, node long, parent long, role string, text string, score double")
    (row,) = chat.conversations_of_trees(nodes).collect()
    assert [chat.unescape(row.formatted[a:b]) for a, b in row.spans] == ["日<|", ""] and chat.parse_turns(row.formatted)[0] == ("user", "é\\")


def test_cycles_end(spark):
    nodes = spark.createDataFrame([("t", 1, 2, "user", "a", 0.0), ("t", 2, 1, "user", "b", 0.0), ("t", 3, 1, "user", "c", 0.0), ("t", 4, None, "user", "d", 0.0)], "tree string, node long, parent long, role string, text string, score double")
    assert [r.leaf for r in chat.conversations_of_trees(nodes).collect()] == [4]


def test_deep_trees_and_ranked_branches(spark):
    """A trunk of 2,000 turns with a branch at every 400th, and one conversation of 5,000 turns, against walks from the leaves."""
    import random

    from pyspark.sql import functions as F

    from quillon.llm import chat

    rng = random.Random(1)
    parent = {i: i - 1 for i in range(1, 2000)} | {10_000 + i: i for i in range(0, 2000, 400)} | {20_000 + i: 10_000 + i for i in range(0, 2000, 400)}
    score = {n: rng.random() for n in [0, *parent]}
    nodes = [("deep", n, parent.get(n), "assistant" if n % 2 else "user", f"t{n}", score[n]) for n in score]
    nodes += [("long", i, i - 1 if i else None, "user", "x", 0.0) for i in range(5000)]
    frame = spark.createDataFrame(nodes, "tree string, node long, parent long, role string, text string, score double")
    got = {(r.tree, r.leaf): r for r in chat.conversations_of_trees(frame).collect()}
    leaves = [n for n in score if n not in set(parent.values())]
    want = {}
    for leaf in leaves:
        path, at = [], leaf
        while at is not None:
            path.append(at)
            at = parent.get(at)
        want[leaf] = path[::-1]
    ranks = {leaf: k for k, leaf in enumerate(sorted(leaves, key=lambda n: (-sum(score[m] for m in want[n]), n)), 1)}
    assert {k[1] for k in got if k[0] == "deep"} == set(leaves) and len(chat.parse_turns(got["long", 4999].formatted)) == 5000
    for leaf in leaves:
        row = got["deep", leaf]
        assert [t for _, t in chat.parse_turns(row.formatted)] == [f"t{n}" for n in want[leaf]] and row.branch == ranks[leaf]
    best = chat.conversations_of_trees(frame, best=2).where(F.col("tree") == "deep").collect()
    assert sorted(r.leaf for r in best) == sorted(n for n in leaves if ranks[n] <= 2)
