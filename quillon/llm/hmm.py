"""Hidden Markov language model over words.

Words fall into classes: each heavy word (over 1/HEAVY_WORDS of all tokens, so at most HEAVY_WORDS of them) is its own,
the others share hashed classes, in which a word's probability is its smoothed share of the class's counts. States emit
classes. A bounded sample (START_DOCS texts of at most START_TOKENS tokens) gives initial values only; then Baum-Welch passes gather
expected counts over all training texts, in partitions, and add them up by block in a tree. They go on until the likelihood a
token rises by less than GAIN, or FULL_STEPS are made. The texts are turned into class numbers once, for all passes.

Long texts are worked on in segments side by side, exactly: first the products of each segment's step matrices, then the
states at the segments' edges from those products, then forward and backward recursion inside with these edges, so
counts and likelihoods are those of whole texts. Null and empty texts are the end token alone; a repeated row is scored
as often as it stands; rows with null ids are training rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import added_up, crc_of_id, cut, text_slices, utf8
from .ngram_join import hashed_words

END = 0  # the end token's hash; no word hashes to it
HEAVY_WORDS, HASHED = 8000, 2048
KNOWN_WORDS = 200_000  # words with over 1/KNOWN_WORDS of all tokens are looked up in the workers, the others by a join
STATES, START_DOCS, START_TOKENS, START_STEPS, FULL_STEPS = 6, 600, 4096, 12, 12
GAIN = 2e-3  # nats a token
SEGMENT = 256
AT_ONCE = 200_000  # tokens in memory at once
PRIOR = 100.0  # tokens' worth of the overall class shares in each state's
BLOCK = 1024  # classes whose counts are added up together


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit names of all texts' tokens, each text's end included, and where each text's begin."""
    raw, ends = utf8(texts)
    h, owner = hashed_words(raw, ends)
    h = h.view(np.int64)
    h[h == END] = 1
    n = np.bincount(owner, minlength=len(ends) - 1)
    begin = np.append(0, np.cumsum(n + 1))
    out = np.zeros(begin[-1], dtype=np.int64)
    out[np.arange(len(h)) + owner] = h
    return out, begin


def word_counts(docs: DataFrame) -> DataFrame:
    """(h, c): how often each token stands in the column text, ends included; combined in slices and tasks before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            h, c = np.unique(tokens(batch.column("text"))[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(c.astype(np.int64))], ["h", "c"])

    return docs.select("text").mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


class Segments:
    """Sequences cut into segments that are worked on side by side, the longest first."""

    def __init__(self, seqs: list[np.ndarray]):
        flat = np.concatenate(seqs) if seqs else np.zeros(0, dtype=np.int64)
        size = np.array([len(s) for s in seqs], dtype=np.int64)
        self.parts = -(-size // SEGMENT)  # segments of each sequence
        self.first = np.cumsum(self.parts) - self.parts
        n = int(self.parts.sum())
        place = np.arange(n) - np.repeat(self.first, self.parts)
        begin = np.repeat(np.cumsum(size) - size, self.parts) + place * SEGMENT
        length = np.minimum(np.repeat(size, self.parts) - place * SEGMENT, SEGMENT)
        self.order = np.argsort(-length, kind="stable")
        self.slot = np.empty(n, dtype=np.int64)  # where each segment stands in the order
        self.slot[self.order] = np.arange(n)
        self.leads = place[self.order] == 0
        length, begin = length[self.order], begin[self.order]
        steps = int(length[0]) if n else 0
        self.live = n - np.searchsorted(length[::-1], np.arange(steps), side="right")
        at = np.arange(steps)[:, None]
        self.x = np.where(at < length[None, :], flat.take(begin[None, :] + at, mode="clip"), 0)

    def emissions(self, model: dict) -> np.ndarray:
        """[state, step, segment]: how likely each state emits what stands there."""
        out = np.empty((len(model["E"]), *self.x.shape))
        for z, row in enumerate(model["E"]):
            row.take(self.x, out=out[z], mode="clip")
        return out

    def products(self, model: dict, emit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each segment, place in its text's order: [from, to] the product of its steps (the first without a move), and the log of its scale."""
        k, n = len(model["pi"]), len(self.slot)
        out, scale, done = np.zeros((n, k, k)), np.zeros(n), n
        moves = np.ascontiguousarray(model["A"].T)
        held = np.zeros((k, k, n))  # [to, from, segment]
        for i in range(k):
            held[i, i] = emit[i, 0]
        log = np.zeros(n)
        for t in range(1, len(self.live) + 1):
            live = self.live[t] if t < len(self.live) else 0
            if live < done:
                out[live:done] = held[:, :, live:done].transpose(2, 1, 0)
                scale[live:done] = log[live:done]
                held, done = np.ascontiguousarray(held[:, :, :live]), live
            if live:
                held = (moves @ held.reshape(k, -1)).reshape(k, k, live)
                held *= emit[:, None, t, :live]
                if t % 16 == 0 or t + 1 == len(self.live):
                    s = held.max((0, 1))
                    held /= s
                    log[:live] += np.log(s)
        return out[self.slot], scale[self.slot]

    def edges(self, model: dict, emit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each segment, in the order: the states before it (scaled; zero at a text's start) and the weights of those at its end; and each text's log likelihood."""
        k, n = len(model["pi"]), len(self.slot)
        before, after = np.zeros((n, k)), np.ones((n, k))
        product, scale = self.products(model, emit)
        total = np.zeros(len(self.parts))
        state = np.tile(model["pi"], (len(self.parts), 1))
        rounds = int(self.parts.max()) if len(self.parts) else 0
        for r in range(rounds):
            who = np.flatnonzero(self.parts > r)
            at = self.first[who] + r
            come = state[who]
            if r:
                before[at] = come
                come = come @ model["A"]
            go = np.einsum("ni,nij->nj", come, product[at])
            s = go.sum(1)
            total[who] += np.log(s) + scale[at]
            state[who] = go / s[:, None]
        weight = np.ones((len(self.parts), k))
        for r in range(rounds - 1, 0, -1):
            who = np.flatnonzero(self.parts > r)
            at = self.first[who] + r
            w = np.einsum("nij,nj->ni", product[at], weight[who]) @ model["A"].T
            weight[who] = after[at - 1] = w / w.sum(1, keepdims=True)
        return before[self.order], after[self.order], total


def groups_of(seqs: list[np.ndarray]) -> Iterator[list[int]]:
    """Numbers of sequences, so many that they hold about AT_ONCE tokens; one at least."""
    part, held = [], 0
    for i, s in enumerate(seqs):
        if part and held + len(s) > AT_ONCE:
            yield part
            part, held = [], 0
        part.append(i)
        held += len(s)
    if part:
        yield part


def forward(model: dict, seqs: list[np.ndarray]) -> np.ndarray:
    """Log10 likelihood of each class sequence by scaled forward recursion."""
    out = np.zeros(len(seqs))
    for part in groups_of(seqs):
        own = [seqs[i] for i in part]
        long = [j for j, s in enumerate(own) if len(s) > SEGMENT]
        short = [j for j, s in enumerate(own) if len(s) <= SEGMENT]
        got = np.zeros(len(own))
        if long:
            cut_ = Segments([own[j] for j in long])
            got[long] = cut_.edges(model, cut_.emissions(model))[2]
        if short:
            cut_ = Segments([own[j] for j in short])
            moves, total, emit = np.ascontiguousarray(model["A"].T), np.zeros(len(short)), cut_.emissions(model)
            for t, n in enumerate(cut_.live):
                a = (np.repeat(model["pi"][:, None], n, 1) if t == 0 else moves @ a[:, :n]) * emit[:, t, :n]
                s = a.sum(0)
                a /= s
                total[:n] += np.log(s)
            got[short] = total[cut_.slot]
        out[part] = got
    return out / np.log(10)


def expected(model: dict, seqs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Baum-Welch counts of whole sequences: first states, moves, emissions; and their log likelihood."""
    k, c = model["E"].shape
    pi, moves, emits, total = np.zeros(k), np.zeros((k, k)), np.zeros((k, c)), 0.0
    A, At = model["A"], np.ascontiguousarray(model["A"].T)
    for part in groups_of(seqs):
        cut_ = Segments([seqs[i] for i in part])
        n, emit = len(cut_.slot), cut_.emissions(model)
        if int(cut_.parts.max()) > 1:
            before, after, _ = cut_.edges(model, emit)
            before, after = np.ascontiguousarray(before.T), np.ascontiguousarray(after.T)
        else:
            before, after = np.zeros((k, n)), np.ones((k, n))
        alpha = np.zeros((k, len(cut_.live), n))
        scale = np.ones((len(cut_.live), n))
        a = np.where(cut_.leads, model["pi"][:, None], At @ before)
        for t, m in enumerate(cut_.live):
            a = (a if t == 0 else At @ a[:, :m]) * emit[:, t, :m]
            s = a.sum(0)
            a /= s
            scale[t, :m] = s
            alpha[:, t, :m] = a
        total += float(np.log(scale).sum())
        beta = after
        for t in range(len(cut_.live) - 1, -1, -1):
            m = cut_.live[t]
            m_next = cut_.live[t + 1] if t + 1 < len(cut_.live) else 0
            if m > m_next:  # segments that end here: what follows must weigh one in all
                own = alpha[:, t, m_next:m]
                beta[:, m_next:m] /= (own * beta[:, m_next:m]).sum(0)
            if m_next:
                ahead = emit[:, t + 1, :m_next] * beta[:, :m_next]
                ahead /= scale[t + 1, :m_next]
                moves += A * (alpha[:, t, :m_next] @ ahead.T)
                beta[:, :m_next] = A @ ahead
            if t == 0:
                ahead = emit[:, 0] * beta / scale[0]
                moves += A * (before @ ahead.T)  # the moves over segments' edges
            alpha[:, t, :m] *= beta[:, :m]
        pi += alpha[:, 0, cut_.leads].sum(1)
        flat = cut_.x.ravel()
        for z in range(k):
            emits[z] += np.bincount(flat, weights=alpha[z].ravel(), minlength=c)
    return pi, moves, emits, total


def settle(pi, moves, emits, shares: np.ndarray) -> dict:
    """Smoothed parameters from counts."""
    e = emits + PRIOR * shares
    a = moves + 1.0
    return {"pi": (pi + 1) / (pi + 1).sum(), "A": a / a.sum(1, keepdims=True), "E": e / e.sum(1, keepdims=True)}


def start(seqs: list[np.ndarray], shares: np.ndarray) -> dict:
    """Begins with each text in a random state's mix, then Baum-Welch steps on the sample."""
    rng = np.random.default_rng(11)
    emits = np.zeros((STATES, len(shares)))
    for s in seqs:
        emits[rng.integers(STATES)] += np.bincount(s, minlength=len(shares))
    model = settle(np.zeros(STATES), np.eye(STATES) * 200, emits, shares)
    for _ in range(START_STEPS if seqs else 0):
        model = settle(*expected(model, seqs)[:3], shares)
    return model


def _unpacked(batch: pa.RecordBatch, column: str) -> list[np.ndarray]:
    unpack = zstandard.ZstdDecompressor()
    return [np.frombuffer(unpack.decompress(v.as_buffer()), dtype="<u2").astype(np.int64) for v in batch.column(column)]


def _few_rows(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def full_pass(codes: DataFrame, model: dict, shares: np.ndarray) -> tuple[dict, float]:
    """One Baum-Welch pass over all training texts (v: packed class numbers), and the log likelihood under the model it began with."""
    shared = codes.sparkSession.sparkContext.broadcast(model)  # fixed size: STATES x (HEAVY_WORDS + HASHED)
    width = len(shares)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        pi, moves, emits, total = np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((STATES, width)), 0.0
        for batch in _few_rows(batches):
            got = expected(model, _unpacked(batch, "v"))
            pi, moves, emits, total = pi + got[0], moves + got[1], emits + got[2], total + got[3]
        blocks = [np.concatenate([[total], pi, moves.ravel()]).tobytes()]
        blocks += [emits[:, at : at + BLOCK].tobytes() for at in range(0, width, BLOCK)]
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, len(blocks) - 1), pa.int32()), pa.array(blocks, pa.binary())], ["b", "v"])

    tasks = codes.rdd.getNumPartitions()  # codes are a checkpoint, so this runs nothing
    levels = max(0, int(np.ceil(np.log(max(tasks, 1)) / np.log(64))) - 1)
    got = added_up(codes.mapInArrow(run, "b int, v binary"), "<f8", levels)
    if -1 not in got:
        return model, 0.0
    emits = np.hstack([got[b].reshape(STATES, -1) for b in range(-(-width // BLOCK))])
    return settle(got[-1][1 : 1 + STATES], got[-1][1 + STATES :].reshape(STATES, STATES), emits, shares), float(got[-1][0])


def held_out():
    return F.pmod(crc_of_id(), F.lit(7)) == 2


class Vocabulary:
    """What the workers know of tokens: counts of the KNOWN_WORDS, classes (0 the end, heavy words, hashed classes) and the sizes of these."""

    def __init__(self, known: np.ndarray, counts: np.ndarray, n: int, v: int, heavy: np.ndarray, size: np.ndarray):
        self.known, self.counts, self.n, self.v, self.size = known, counts, n, v, size
        self.number = np.full(len(known), -1, dtype=np.int64)
        self.number[heavy] = np.arange(len(heavy))
        self.heavy = len(heavy)
        self.width = self.heavy + HASHED

    def look(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Class, count (of known words) and whether the word is known here, of each token."""
        at = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
        here = self.known[at] == h
        number = np.where(here, self.number[at], -1)
        return np.where(number >= 0, number, self.heavy + (h & (HASHED - 1))), np.where(here, self.counts[at], 0), here


def vocabulary(counts: DataFrame) -> Vocabulary:
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    kept = counts.where((F.col("c") > max(n / KNOWN_WORDS, 1)) | (F.col("h") == END)).toArrow()
    h, c = kept.column("h").to_numpy(), kept.column("c").to_numpy()
    if END not in h:
        h, c = np.append(h, END), np.append(c, 0)
    order = np.argsort(h)
    h, c = h[order], c[order]
    heavy = np.flatnonzero((c > max(n / HEAVY_WORDS, 4)) | (h == END))
    heavy = heavy[np.argsort(h[heavy] != END, kind="stable")]
    size = np.zeros((2, HASHED))
    for r in counts.groupBy(F.col("h").bitwiseAND(HASHED - 1).alias("b")).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v")).collect():
        size[:, r["b"]] = r["c"], r["v"]
    np.subtract.at(size, (0, h[heavy] & (HASHED - 1)), c[heavy])
    np.subtract.at(size, (1, h[heavy] & (HASHED - 1)), c[heavy] > 0)
    return Vocabulary(h, c, n, v, heavy, size)


def coded(docs: DataFrame, words: Vocabulary) -> DataFrame:
    """One row per row: doc_id, row, n_tokens, known, base and part (sums over known words), v (packed classes), hs and tfs (other words)."""
    shared = docs.sparkSession.sparkContext.broadcast(words)  # KNOWN_WORDS numbers at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        press = zstandard.ZstdCompressor(level=1)
        within = -np.log10(words.size.sum(0) + 1)
        rest = np.log10(words.n + words.v + 1)
        for batch in text_slices(batches, "text"):
            h, begin = tokens(batch.column("text"))
            number, count, here = words.look(h)
            base = np.log10(count + 1.0)
            part = np.where(number < words.heavy, 0.0, within[(h & (HASHED - 1))] + base)
            sums = [np.add.reduceat(x, begin[:-1]) for x in (base - rest, part, (count > 0).astype(np.int64))]
            packed = number.astype("<u2")
            v = [press.compress(packed[a:b].data) for a, b in zip(begin[:-1].tolist(), begin[1:].tolist())]
            doc = np.repeat(np.arange(len(begin) - 1), np.diff(begin))[~here]
            order = np.lexsort((h[~here], doc))
            doc, left = doc[order], h[~here][order]
            new = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (left[1:] != left[:-1]))[: len(doc)])
            at = pa.array(np.searchsorted(doc[new], np.arange(len(begin))).astype(np.int32))
            hs = pa.ListArray.from_arrays(at, pa.array(left[new]))
            tfs = pa.ListArray.from_arrays(at, pa.array(np.diff(np.append(new, len(doc))).astype(np.int64)))
            columns = [batch.column("doc_id"), batch.column("row"), pa.array(np.diff(begin)), pa.array(sums[2]), pa.array(sums[0]), pa.array(sums[1]), pa.array(v, pa.binary()), hs, tfs]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "row", "n_tokens", "known", "base", "part", "v", "hs", "tfs"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), "text")
    return keyed.mapInArrow(run, f"doc_id {kind}, row long, n_tokens long, known long, base double, part double, v binary, hs array<long>, tfs array<long>")


def lm_report(docs: DataFrame) -> DataFrame:
    """Base and model scores of every whole text; learns from the rows that are not held out."""
    docs = docs.select("doc_id", "text")
    counts = cut(word_counts(docs.where(~held_out())))
    words = vocabulary(counts)
    shares = np.append(words.counts[words.number >= 0][np.argsort(words.number[words.number >= 0])], words.size[0]) + 0.5
    shares /= shares.sum()
    rows = cut(coded(docs, words))
    codes = rows.where(~held_out()).select("v", "n_tokens", "doc_id")
    sample = codes.where(F.col("n_tokens") <= START_TOKENS).orderBy(F.xxhash64("doc_id"), "v").limit(START_DOCS).select("v").toArrow()
    model = start([s for batch in sample.to_batches() for s in _unpacked(batch, "v")], shares)
    codes, last = codes.select("v"), None
    for _ in range(FULL_STEPS):
        model, total = full_pass(codes, model, shares)
        if last is not None and total - last < GAIN * words.n:
            break
        last = total
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _few_rows(batches):
            score = pa.array(forward(shared.value, _unpacked(batch, "v")))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "row", "n_tokens", "known", "base", "part")), score], ["doc_id", "row", "n_tokens", "known", "base", "part", "model"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    done = rows.drop("hs", "tfs").mapInArrow(run, f"doc_id {kind}, row long, n_tokens long, known long, base double, part double, model double")
    terms = rows.select("row", F.explode(F.arrays_zip("hs", "tfs")).alias("t")).select("row", F.col("t.hs").alias("h"), F.col("t.tfs").alias("tf"))
    rare = counts.where(F.col("c") <= max(words.n / KNOWN_WORDS, 1))
    terms = terms.join(rare, "h")  # words with many rows are known to the workers, so no key is hot; words without a row are new and add nothing
    sums = terms.groupBy("row").agg(F.sum(F.col("tf") * F.log10(F.col("c") + 1.0)).alias("logs"), F.sum("tf").alias("found"))
    done = done.join(sums, "row", "left").na.fill(0, ["logs", "found"])
    return done.select(
        "doc_id", held_out().alias("held_out"), "n_tokens", (F.col("known") + F.col("found")).cast("long").alias("n_known"), F.lit(words.n).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("logs")).alias("base_score"), (F.col("part") + F.col("model") + F.col("logs")).alias("score"),
    )
