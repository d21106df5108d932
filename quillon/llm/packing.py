"""Best-fit packing of token sequences with swap-based local search.

Documents are cut into pieces no longer than a sequence, the first being the short one. Pieces are dealt into blocks of
bounded size by a hash of their own row; in each block best-fit decreasing makes bins and a local search moves one
piece, swaps one for one or two for one between underfull bins whenever that raises the sum of squared fills, until
no exchange does or the bound is met. Repeated rows are packed once each; a null or empty text is the end id alone; a very
long text is tokenized whole in one task; an empty table gives no pieces; other columns, whatever their names, are not
looked at.

Ids are those of the tokenizers file. Where that file is a plain byte-level BPE whose merges stand in id order, the
same vocabulary is applied by tiktoken, which takes a quarter of the time; texts that hold an added token, or a run
too long for its quadratic merge, and all other files go to tokenizers itself.
"""

from __future__ import annotations

import bisect
import heapq
import json
import os
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

LENGTH = 2048
BLOCK_PIECES = 50_000
#: Fixed value: the split pattern of byte-level BPE files.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_LONG_RUN = re.compile(r"\S{1000}|\s{1000}")


def best_fit(sizes: list[int], room: int) -> list[list[int]]:
    """Best-fit decreasing: lists of item numbers."""
    bins: list[list[int]] = []
    by_room: dict[int, list[int]] = defaultdict(list)
    rooms: list[int] = []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        at = bisect.bisect_left(rooms, sizes[i])
        if at < len(rooms):
            left = rooms[at]
            b = by_room[left].pop()
            if not by_room[left]:
                del rooms[at]
        else:
            left, b = room, len(bins)
            bins.append([])
        bins[b].append(i)
        left -= sizes[i]
        if left:
            if not by_room[left]:
                bisect.insort(rooms, left)
            by_room[left].append(b)
    return bins


def _lower_bound(sizes: list[int], room: int) -> int:
    """Bins needed at least: by volume, and by the items of over half a bin plus what cannot join them."""
    best = -(-sum(sizes) // room)
    s = np.sort(np.asarray(sizes))
    for k in {int(x) for x in s if x <= room // 2}:
        big = int((s > room - k).sum())
        mid = s[(s <= room - k) & (s > room // 2)]
        small = s[(s <= room // 2) & (s >= k)]
        over = int(small.sum()) - int(len(mid) * room - mid.sum())
        best = max(best, big + len(mid) + max(0, -(-over // room)))
    return best


class _Sources:
    """For every single size and every sum of two pieces of one bin, the least filled bin that can give it."""

    def __init__(self, sizes: list[int], room: int):
        self.sizes = sizes
        self.heaps: list[list[list]] = [[[] for _ in range(room + 1)] for _ in range(2)]
        self.least = np.full((2, room + 1), 4 * room, dtype=np.int64)  # that bin's fill less the amount
        self.none = 4 * room
        self.version: Counter = Counter()

    def amounts(self, items: list[int]) -> tuple[list[int], list[int]]:
        """Distinct sizes, and distinct sums of two; a bin holds few distinct sizes, as they add up to its room at most."""
        count = Counter(self.sizes[i] for i in items)
        own = sorted(count)
        return own, sorted({x + y for n, x in enumerate(own) for y in own[n:] if x != y or count[x] > 1})

    def add(self, b: int, items: list[int], fill: int) -> None:
        for kind, qs in enumerate(self.amounts(items)):
            for q in qs:
                heapq.heappush(self.heaps[kind][q], (fill, b, self.version[b]))
                self.least[kind, q] = self.heaps[kind][q][0][0] - q

    def drop(self, b: int, items: list[int]) -> None:
        self.version[b] += 1
        for kind, qs in enumerate(self.amounts(items)):
            for q in qs:
                heap = self.heaps[kind][q]
                while heap and heap[0][2] != self.version[heap[0][1]]:
                    heapq.heappop(heap)
                self.least[kind, q] = heap[0][0] - q if heap else self.none

    def best(self, own: tuple[list[int], list[int]], fill: int, gap: int) -> tuple[int, int, int, int] | None:
        """(growth, kind, amount in, amount out) of the largest exchange that raises the sum of squared fills."""
        found = None
        for kind, outs in ((0, [0]), (0, own[0]), (1, own[0]), (0, own[1])):  # a move, one for one, two for one, one for two
            for out in outs:
                low = out + (found[0] if found else 0)
                fits = np.flatnonzero(self.least[kind, low + 1 : out + gap + 1] < fill - out)
                if len(fits):
                    q = low + 1 + int(fits[-1])
                    found = (q - out, kind, q, out)
                    if found[0] == gap:
                        return found
        return found


def _pick(items: list[int], sizes: list[int], amount: int, two: bool) -> list[int]:
    """The pieces of a bin that make up an amount."""
    by_size: dict[int, list[int]] = defaultdict(list)
    for i in items:
        by_size[sizes[i]].append(i)
    if not two:
        return [by_size[amount][0]] if amount else []
    for x in sorted(by_size):
        rest = [i for i in by_size.get(amount - x, []) if i != by_size[x][0]]
        if rest:
            return [by_size[x][0], rest[0]]
    raise ValueError("no such pieces")


def local_search(bins: list[list[int]], sizes: list[int], room: int) -> list[list[int]]:
    """Exchanges between underfull bins until a whole sweep over them finds none that helps, or the bound is met.

    Each bin, the fullest first, takes what fills it most, from the least filled bin that can give it, until it is stuck.
    """
    floor = _lower_bound(sizes, room)
    live = {b: list(x) for b, x in enumerate(bins)}
    fill = {b: sum(sizes[i] for i in x) for b, x in live.items()}
    sources = _Sources(sizes, room)
    for b in live:
        if fill[b] < room:
            sources.add(b, live[b], fill[b])
    trades, stuck, changed = 0, {}, True
    while changed and len(live) > floor:
        changed = False
        for b in sorted((b for b in live if fill[b] < room), key=lambda b: (-fill[b], b)):
            while b in live and fill[b] < room and len(live) > floor:
                look = tuple(sorted(sizes[i] for i in live[b]))
                if stuck.get(look) == trades:  # a bin of the same sizes found nothing since the last exchange
                    break
                own = sources.amounts(live[b])
                sources.drop(b, live[b])
                got = sources.best(own, fill[b], room - fill[b])
                if got is None:
                    sources.add(b, live[b], fill[b])
                    stuck[look] = trades
                    break
                _, kind, q, out = got
                a = sources.heaps[kind][q][0][1]
                sources.drop(a, live[a])
                give = _pick(live[a], sizes, q, kind == 1)
                back = _pick(live[b], sizes, out, out not in own[0] and out > 0)
                _trade(live, fill, sizes, a, b, give, back)
                for x in (a, b):
                    if not live[x]:
                        del live[x], fill[x]
                    elif fill[x] < room:
                        sources.add(x, live[x], fill[x])
                trades += 1
                changed = True
    return list(live.values())


def _trade(live, fill, sizes, a: int, b: int, out: list[int], back: list[int]) -> None:
    for i in out:
        live[a].remove(i)
    for i in back:
        live[b].remove(i)
    live[a] += back
    live[b] += out
    moved = sum(sizes[i] for i in out) - sum(sizes[i] for i in back)
    fill[a] -= moved
    fill[b] += moved


def _byte_ranks(spec: dict) -> dict[bytes, int] | None:
    """Ranks of a plain byte-level BPE, or None where ranks would not say the same as the merges."""
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    if spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex"):
        return None
    if model.get("type") != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges")):
        return None
    merged = [model["vocab"].get("".join(m.split(" ") if isinstance(m, str) else m)) for m in model["merges"]]
    if merged != list(range(256, 256 + len(merged))) or len(model["vocab"]) != 256 + len(merged):
        return None
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]  # bytes that stand for themselves
    byte_of = {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(sorted(set(range(256)) - set(shown)))}
    return {bytes(byte_of[c] for c in token): i for token, i in model["vocab"].items()}


def encoder(path: str) -> Callable[[str], list[int]]:
    """Text to ids, equal to the tokenizers file without special tokens added."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import tiktoken
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    ranks = _byte_ranks(spec)
    if ranks is None:
        return lambda text: tok.encode(text, add_special_tokens=False).ids
    fast = tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
    added = [t["content"] for t in spec.get("added_tokens", [])]

    def ids(text: str) -> list[int]:
        if any(a in text for a in added) or _LONG_RUN.search(text):
            return tok.encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)

    return ids


def tokenized(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", end_id: int = 0, length: int = LENGTH, keep_ids: bool = False) -> DataFrame:
    """One row per piece: key, row (a number of the document's own row), piece, start, length, ids_crc32; with keep_ids the ids, four bytes each."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(path)
        for batch in batches:
            rows = []
            for k, n, t in zip(batch["_key"], batch["_row"], batch["_text"]):
                ids = np.array([*encode(t or ""), end_id], dtype="<u4")
                first = len(ids) % length or length
                start = 0
                for piece, stop in enumerate(range(first, len(ids) + 1, length)):
                    data = ids[start:stop].tobytes()
                    rows.append((k, n, piece, start, stop - start, zlib.crc32(data), *[data] * keep_ids))
                    start = stop
            yield pd.DataFrame(rows, columns=[key, "row", "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids])

    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"), F.monotonically_increasing_id().alias("_row"))
    return rows.mapInPandas(run, f"{key} {kind}, row long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids)


def pack(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """Pieces with sequence_id and offset. Tokens are made once; only the numbers of pieces are dealt on."""
    return placed(cut(tokenized(docs, path, key, text, length=length)), key, length).drop("row")


def packed_sequences(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """The sequences themselves: sequence_id, ids (four bytes each, little-endian) and the pieces in them, in order."""
    pieces = cut(tokenized(docs, path, key, text, length=length, keep_ids=True))
    rows = placed(pieces.drop("ids"), key, length).join(pieces.select("row", "piece", "ids"), ["row", "piece"])
    held = rows.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", key, "piece", "ids"))).alias("_h"))  # at most `length` pieces
    ids = F.aggregate("_h", F.lit(b"").cast("binary"), lambda acc, h: F.concat(acc, h["ids"]))
    return held.select("sequence_id", ids.alias("ids"), F.transform("_h", lambda h: F.struct(h[key].alias(key), h["piece"].alias("piece"), h["offset"].alias("offset"))).alias("pieces"))


def placed(pieces: DataFrame, key: str, length: int) -> DataFrame:
    """Pieces (key, row, piece, start, length, ids_crc32) with sequence_id and offset."""
    n = pieces.count()
    blocks = max(1, -(-n // BLOCK_PIECES))
    kind = pieces.schema[key].dataType.simpleString()

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "row", "piece"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        sizes = frame["length"].tolist()
        whole = sum(s == length for s in sizes)
        short = sizes[whole:]
        bins = [[i] for i in range(whole)] + [[whole + i for i in b] for b in local_search(best_fit(short, length), short, length)]
        seq = np.zeros(len(frame), dtype=np.int64)
        off = np.zeros(len(frame), dtype=np.int64)
        for b, items in enumerate(bins):
            at = 0
            for i in items:
                seq[i], off[i] = b, at
                at += sizes[i]
        frame["sequence_id"] = int(frame["_block"].iloc[0]) * (1 << 32) + seq if len(frame) else seq
        frame["offset"] = off
        return frame[[key, "row", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]]

    dealt = pieces.withColumn("_block", F.pmod(F.xxhash64("row", "piece"), F.lit(blocks)))
    return dealt.groupBy("_block").applyInPandas(run, f"{key} {kind}, row long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
