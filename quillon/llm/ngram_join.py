"""Exact similarity join on word shingles by T-occurrence search.

Equal sets are one class. Shingles are ordered by a sketch of their counts, then by hash, rare ones first. Two sets of a and
b shingles link from T common ones on, T depending on both sizes. As DivideSkip does, the lists of a pair are divided: its
short lists, the first a - T + k and b - T + k shingles, are merged, and the pair is dropped unless it is found in k of them;
the other, long lists are not merged but probed by binary search. Before any set travels, PARITY bits of each, one for the
oddness of every residue class of its shingles, bound the pair's overlap from above. Who meets in a short list at all (k = 1) is found by Spark's
sort-merge joins of the lists, in place of one machine's heap; merging on, up to k, and probing are done pair by pair, a
set beside its partners.

Large groups of near copies would make all pairs, so first every set is held against the leader of its lists, one
candidate for each set. The exact search follows for pairs in different components only; one side of it leaves out the
leader's component. Pairs within a component need no link of their own, so no link that matters is lost.
Null, empty and wordless texts have no shingles and link with nothing. Every distinct set has a number of its own, so
repeated and null keys do no harm; a component whose rows all have null keys is named null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import added_up, cut, drop, join_counted, text_slices, utf8

SKETCH = 1 << 18
SKETCH_BLOCKS = 64
BLOCK = 1 << 20  # bytes of text whose words are hashed at once
MEMBERS = 128  # sets verified against one copy of a leader
MERGED = 8  # one in so many of the shingles that a pair must share is to be among its short lists
PARITY = 512  # bits; the sets differ in as many shingles at least as in bits
STAR = 2  # short lists that a set shares with its leader at least
_GAP = np.zeros(256, dtype=bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = np.frombuffer(hashlib.shake_256(b"words").digest(256 * 8), dtype="<u8").copy()
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_ODD = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _power(n: int) -> list[np.ndarray]:
    """Powers of _ODD and of its inverse modulo 2**64, n at least."""
    if len(_powers[0]) < n:
        n = 2 * n
        for k, base in enumerate((_ODD, pow(_ODD, -1, 1 << 64))):
            row = np.full(n, base, dtype=np.uint64)
            row[0] = 1
            _powers[k] = np.cumprod(row)
    return _powers


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def hashed_words(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit polynomial hashes of the folded words of all texts, from prefix sums over their bytes, and each word's text."""
    word = ~_GAP[raw]
    edge = np.zeros(len(raw) + 1, dtype=bool)
    edge[ends] = True  # texts end words
    begins = word & (edge[:-1] | np.append(True, ~word[:-1])[: len(raw)])
    stops = word & (edge[1:] | np.append(~word[1:], True)[: len(raw)])
    first, last = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    out = np.zeros(len(first), dtype=np.uint64)
    at = 0
    while at < len(first):
        stop = max(at + 1, int(np.searchsorted(last, first[at] + BLOCK)))
        a, b = first[at], last[stop - 1]
        up, down = _power(b - a + 1)
        total = np.zeros(b - a + 1, dtype=np.uint64)
        np.cumsum(_BYTE[raw[a:b]] * up[: b - a], out=total[1:])
        f, e = first[at:stop] - a, last[at:stop] - a
        out[at:stop] = _mixed((total[e] - total[f]) * down[f] + (e - f).astype(np.uint64))
        at = stop
    return out, np.searchsorted(ends, first, side="right") - 1


def word_hashes(text: str | None) -> np.ndarray:
    return hashed_words(*utf8(pa.array([text], pa.string())))[0]


def all_shingles(raw: np.ndarray, ends: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit names of the n-word shingles of all texts, with repeats, and where each text's begin; fewer words make one shingle."""
    h, owner = hashed_words(raw, ends)
    words = np.bincount(owner, minlength=len(ends) - 1)
    sizes = np.where(words >= n, words - n + 1, np.minimum(words, 1))
    begin = np.cumsum(sizes) - sizes
    first = np.cumsum(words) - words
    out = np.empty(int(sizes.sum()), dtype=np.uint64)
    for k in range(1, n + 1):
        texts = np.flatnonzero(words >= n if k == n else words == k)
        if len(texts):
            each = sizes[texts]
            at = np.repeat(first[texts] - (np.cumsum(each) - each), each) + np.arange(int(each.sum()))
            name = np.full(len(at), k, dtype=np.uint64)
            for i in range(k):
                name = _mixed((name ^ h[at + i]) * np.uint64(_ODD))
            out[np.repeat(begin[texts] - (np.cumsum(each) - each), each) + np.arange(len(at))] = name
    return out, np.append(begin, len(out))


def distinct_shingles(texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingles of each text."""
    names, begin = all_shingles(*utf8(texts), n)
    for a, b in zip(begin[:-1].tolist(), begin[1:].tolist()):
        s = np.sort(names[a:b])
        yield s[np.append(True, s[1:] != s[:-1])] if b > a else s


def shingles(text: str | None, n: int = 4) -> np.ndarray:
    return next(distinct_shingles(pa.array([text], pa.string()), n))


def needed(a, b, percent: int):
    """Least overlap with 100 * overlap >= percent * union."""
    return -(-percent * (a + b) // (100 + percent))


def overlap(x: np.ndarray, y: np.ndarray, least: int) -> int:
    """Common shingles of two sets in the order of lists, or 0 where the merged short lists show that they are under `least`."""
    k = 1 + (least - 1) // MERGED
    a, b = len(x) - least + k, len(y) - least + k
    if least > min(len(x), len(y)):
        return 0
    short = np.sort(np.concatenate([x[:a], y[:b]]))
    merged = int((short[1:] == short[:-1]).sum())
    return merged + _probed(x[a:], y) + _probed(x[:a], y[b:]) if merged >= k else 0


def _probed(part: np.ndarray, others: np.ndarray) -> int:
    if not len(part) or not len(others):
        return 0
    others = np.sort(others)
    at = np.minimum(np.searchsorted(others, part), len(others) - 1)
    return int((others[at] == part).sum())


def _sketch(docs: DataFrame, n: int) -> np.ndarray:
    """Shingles per bucket, over all rows; SKETCH numbers, whatever the input."""
    width = SKETCH // SKETCH_BLOCKS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SKETCH, dtype=np.int64)
        for batch in text_slices(batches, "text"):
            names, _ = all_shingles(*utf8(batch.column("text")), n)
            total += np.bincount((names & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH)
        blocks = [total[b * width : (b + 1) * width].tobytes() for b in range(SKETCH_BLOCKS)]
        yield pa.RecordBatch.from_pydict({"b": pa.array(range(SKETCH_BLOCKS), pa.int32()), "v": pa.array(blocks, pa.binary())})

    got = added_up(docs.select("text").mapInArrow(run, "b int, v binary"), "<i8", levels=2)
    out = np.concatenate([got[b] for b in range(SKETCH_BLOCKS)]) if got else np.zeros(SKETCH, dtype=np.int64)
    return np.minimum(out, np.iinfo(np.int32).max).astype(np.int32)


def parity(s: np.ndarray) -> list[int]:
    """PARITY bits as 64-bit numbers: whether an odd number of shingles falls into each class."""
    odd = np.bincount((s >> np.uint64(40)).astype(np.int64) % PARITY, minlength=PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def _ranked(s: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    """The sorted set in the order of lists, short ones first; ties stay in the order of hashes."""
    return s[np.argsort(sketch[(s & np.uint64(SKETCH - 1)).astype(np.int64)], kind="stable")]


def _sig(s: np.ndarray) -> bytes | None:
    return xxhash.xxh128_digest(s.data) if len(s) else None


def _short_lists(docs: DataFrame, sketch, n: int, percent: int) -> DataFrame:
    """key, mark (of the text), sig, size, bits and tokens of every row: the short lists it can need with any partner."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            sigs, sizes, lists, bits = [], [], [], []
            for s in distinct_shingles(batch.column("text"), n):
                short = len(s) + percent * len(s) // -100 + 1
                sigs.append(_sig(s))
                sizes.append(len(s))
                bits.append(parity(s))
                lists.append(_ranked(s, sketch.value)[:short].view(np.int64))
            at = np.cumsum([0, *map(len, lists)]).astype(np.int32)
            tokens = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(lists)))
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("mark"), pa.array(sigs, pa.binary()), pa.array(sizes, pa.int32()), pa.array(bits, pa.list_(pa.int64())), tokens], ["key", "mark", "sig", "size", "bits", "tokens"])

    kind = docs.schema["key"].dataType.simpleString()
    return docs.mapInArrow(run, f"key {kind}, mark long, sig binary, size int, bits array<long>, tokens array<long>")


def _packs(docs: DataFrame, wanted: DataFrame, sketch, n: int) -> DataFrame:
    """(sig, pack): the shingles of each wanted set (set, sig, mark) in the order of lists. Texts that are not wanted stay in their scan."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: set[bytes] = set()
        for batch in text_slices(batches, "text"):
            sigs, packs = [], []
            for s in distinct_shingles(batch.column("text"), n):
                sig = _sig(s)
                if sig and sig not in told:
                    told.add(sig)
                    sigs.append(sig)
                    packs.append(_ranked(s, sketch.value).tobytes())
            if len(told) > 200_000:
                told.clear()
            yield pa.RecordBatch.from_arrays([pa.array(sigs, pa.binary()), pa.array(packs, pa.binary())], ["sig", "pack"])

    marks = wanted.groupBy("mark").agg(F.count(F.lit(1)).alias("_n"))
    found = join_counted(docs.select("mark", "text"), marks, "mark", "_n", "left_semi").mapInArrow(run, "sig binary, pack binary")
    return found.groupBy("sig").agg(F.first("pack").alias("pack"))


def _plausible(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (x, y) that may overlap enough by the parity bits of sets (set, size, bits)."""
    for side in ("x", "y"):
        pairs = pairs.join(sets.select(F.col("set").alias(side), F.col("size").alias(f"s{side}"), F.col("bits").alias(f"b{side}")), side)
    differ = sum((F.bit_count(F.col("bx")[i].bitwiseXOR(F.col("by")[i])) for i in range(PARITY // 64)), F.lit(0))
    least = F.expr(f"(({percent} * (sx + sy) + {99 + percent}) div {100 + percent})")
    return pairs.where(F.col("sx") + F.col("sy") - differ >= 2 * least).select("x", "y")


def _verify(pairs: DataFrame, sigs: DataFrame, packs: DataFrame, percent: int) -> DataFrame:
    """Pairs (x, y) that link. A group is one x and about MEMBERS partners at most, however many x has. The small rows that ask for
    a set go to where its pack is (sigs: set, sig; packs: sig, pack), so packs travel once to be told apart and once to be compared."""
    counts = cut(pairs.groupBy("x").agg(F.count(F.lit(1)).alias("_n")).withColumn("_parts", F.ceil(F.col("_n") / MEMBERS)))
    dealt = join_counted(pairs, counts, "x", "_n").withColumn("part", F.pmod(F.xxhash64("y"), F.col("_parts")))
    asked = cut(dealt.select("x", "part", F.col("y").alias("set")).unionByName(dealt.select("x", "part", F.col("x").alias("set")).distinct()))

    def check(frame: pd.DataFrame) -> pd.DataFrame:
        x = frame["x"].iloc[0]
        sets = {i: np.frombuffer(pack, dtype=np.uint64) for i, pack in zip(frame["set"], frame["pack"])}
        own, hit = sets.pop(x), []
        for y, other in sets.items():
            least = needed(len(own), len(other), percent)
            if overlap(own, other, least) >= least:
                hit.append(y)
        return pd.DataFrame({"x": [x] * len(hit), "y": hit}, dtype="int64")

    return asked.join(sigs, "set").join(packs, "sig").select("x", "part", "set", "pack").groupBy("x", "part").applyInPandas(check, "x long, y long")


def components(links: DataFrame) -> DataFrame:
    """(id, comp) of every linked id: the smallest id reachable, by hooking onto the smallest neighbour and pointer jumping."""
    edges = cut(links.select("x", "y").unionByName(links.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct())
    at = None
    while not edges.isEmpty():
        # every component hooks onto the least neighbour; then pointers jump to roots
        parent = cut(edges.groupBy("x").agg(F.min("y").alias("y")).select("x", F.least("x", "y").alias("p")))
        while True:
            up = parent.select(F.col("x").alias("p"), F.col("p").alias("q"))
            jumped = cut(parent.select("x", "p").join(up, "p", "left").select("x", F.coalesce("q", "p").alias("q"), "p"))
            drop(parent)
            parent = cut(jumped.select("x", F.col("q").alias("p")))
            settled = jumped.where("q <> p").isEmpty()
            drop(jumped)
            if settled:
                break
        if at is None:
            at, over = cut(parent.select(F.col("x").alias("id"), F.col("p").alias("comp"))), None
        else:
            at, over = cut(at.join(parent.withColumnRenamed("x", "comp"), "comp", "left").select("id", F.coalesce("p", "comp").alias("comp"))), at
        a = parent.select("x", F.col("p").alias("px"))
        b = parent.select(F.col("x").alias("y"), F.col("p").alias("py"))
        left = cut(edges.join(a, "x").join(b, "y").where("px <> py").select(F.col("px").alias("x"), F.col("py").alias("y")).distinct())
        drop(edges, parent, *([over] if over else []))
        edges = left
    return at if at is not None else links.select(F.col("x").alias("id"), F.col("y").alias("comp"))


def _within(size: str, at: str, least):
    """Whether a shingle at this place of its set is one of the first short lists of the pair: beyond them fewer than `least` are left."""
    return F.col(at) <= F.col(size) - least


def _candidates(open_: DataFrame, comps: DataFrame, percent: int) -> DataFrame:
    """(x, y) of different components that meet in a short list; open_ has token, set, size, at, lead, n (the token's sets)."""
    named = join_counted(open_, comps.withColumn("_n", F.lit(1)).withColumnRenamed("id", "set"), "set", "_n", "left").withColumn("comp", F.coalesce("comp", "set"))
    leads = named.where("set = lead").select("token", F.col("comp").alias("most"), F.col("n").alias("_n"))
    named = cut(join_counted(named.drop("lead", "n"), cut(leads), "token", "_n"))
    y = named.select("token", F.col("set").alias("y"), F.col("size").alias("sy"), F.col("at").alias("ay"), F.col("comp").alias("cy"))
    x = named.where("comp <> most").select("token", F.col("set").alias("x"), F.col("size").alias("sx"), F.col("at").alias("ax"), F.col("comp").alias("cx"), "most")
    least = F.expr(f"(({percent} * (sx + sy) + {99 + percent}) div {100 + percent})")
    fits = (F.col("cx") != F.col("cy")) & ((F.col("cy") == F.col("most")) | (F.col("x") < F.col("y")))
    pairs = x.join(y, "token").where(fits & _within("sx", "ax", least) & _within("sy", "ay", least))
    return pairs.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()


def near_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 4, percent: int = 85) -> DataFrame:
    """key, n_shingles, component_id for every row."""
    docs = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("mark"), F.col(text).alias("text"))
    sketch = docs.sparkSession.sparkContext.broadcast(_sketch(docs, n))  # SKETCH numbers of four bytes
    rows = cut(_short_lists(docs, sketch, n, percent))
    sets = rows.where("sig IS NOT NULL").groupBy("sig").agg(F.count(F.lit(1)).alias("_n"), F.min("key").alias("least"), F.first(F.struct("mark", "size", "bits", "tokens")).alias("_s"))
    sets = cut(sets.select("sig", "_n", "least", "_s.*", F.monotonically_increasing_id().alias("set")))
    rows, whole = cut(rows.select("key", "sig", "size")), rows
    drop(whole)
    lists = sets.select("set", "size", F.posexplode("tokens").alias("at", "token"))
    leads = lists.groupBy("token").agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct(F.col("at") / F.col("size"), "set", "size", "at")).alias("_l")).where("_n > 1")
    leads = cut(leads.select("token", "_n", F.col("_n").alias("n"), F.col("_l.set").alias("lead"), F.col("_l.size").alias("lsize"), F.col("_l.at").alias("lat")))
    open_ = cut(join_counted(lists, leads, "token", "_n"))
    drop(leads)

    def verified(pairs: DataFrame) -> DataFrame:
        asked = pairs.select(F.col("x").alias("set")).unionByName(pairs.select(F.col("y").alias("set"))).distinct().withColumn("_n", F.lit(1))
        wanted = cut(join_counted(sets.select("set", "sig", "mark", "size", "bits"), cut(asked), "set", "_n"))
        pairs = cut(_plausible(pairs, wanted, percent))
        asked = pairs.select(F.col("x").alias("set")).unionByName(pairs.select(F.col("y").alias("set"))).distinct()
        fetched = cut(wanted.select("set", "sig", "mark").join(asked, "set", "left_semi"))
        out = cut(_verify(pairs, fetched.select("set", "sig"), _packs(docs, fetched, sketch, n), percent))
        drop(wanted, pairs, fetched)
        return out

    # 1: each set against the leader of each of its lists, the one most of them share
    least = F.expr(f"(({percent} * (size + lsize) + {99 + percent}) div {100 + percent})")
    stars = open_.where((F.col("set") != F.col("lead")) & _within("size", "at", least) & _within("lsize", "lat", least))
    stars = stars.groupBy(F.col("set").alias("y"), F.col("lead").alias("x")).agg(F.count(F.lit(1)).alias("m")).where(F.col("m") >= STAR)
    stars = stars.groupBy("y").agg(F.max_by("x", F.struct("m", -F.col("x"))).alias("x")).select("x", "y")
    links = verified(cut(stars))

    # 2: the exact merge, across components
    pairs = cut(_candidates(open_.select("token", "set", "size", "at", "lead", "n"), components(links), percent))
    drop(open_)
    if not pairs.isEmpty():
        links = cut(links.unionByName(verified(pairs)))
    comps = components(links)

    linked = join_counted(sets.select("set", "least"), comps.select(F.col("id").alias("set"), "comp", F.lit(1).alias("_n")), "set", "_n")
    linked = cut(linked)
    names = cut(linked.groupBy("comp").agg(F.min("least").alias("name"), F.count(F.lit(1)).alias("_n")))
    named = join_counted(linked, names, "comp", "_n").select("set", "name", F.lit(1).alias("_n"))
    shown = join_counted(sets.select("set", "sig", "_n", "least"), named.withColumnRenamed("_n", "_m"), "set", "_m", "left")
    shown = cut(shown.where("_n > 1 OR name IS NOT NULL").select("sig", "_n", F.coalesce("name", "least").alias("name")))
    out = join_counted(rows.where("sig IS NOT NULL"), shown, "sig", "_n", "left")
    alone = rows.where("sig IS NULL").withColumn("name", F.col("key"))
    return out.unionByName(alone).select(F.col("key").alias(key), F.col("size").cast("long").alias("n_shingles"), F.coalesce("name", "key").alias("component_id"))
