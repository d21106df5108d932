"""Media columns: payloads as 8-bit mono PCM in WAV form, cut by content, deduplicated and rebuilt.

Gear-hash cuts make chunks. Joins on chunk digests alone (a small table) name one owner for each distinct chunk, and the
store keeps each distinct chunk once: a medium's entry holds the chunks that it owns, compressed together. Its bytes travel
once, a slice of the store at a time; afterwards only given chunks, entries that lack some and facts do. Ordered chunk lists
rebuild every medium from its own chunks and from those that other entries give, and its digest is verified. Null and empty
texts give 64 zero bytes. Equal texts share one medium; hot chunks and media are given in several copies, dealt over
salts. Null and repeated keys are rows like others; a very long text is one payload, cut and rebuilt whole by the task that
has its row; an empty table gives no rows; other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, join_counted

BLOCK = 64
MIN_CHUNK, MAX_CHUNK, MASK_BITS = 512, 16_384, 11
RATE = 8000
SHARE = 128  # takers of one copy of a chunk or of a medium's facts
SLICES = 4  # parts of the store, by the media's digests; the shuffle files of one go before the next is made
_GEAR = np.frombuffer(hashlib.shake_256(b"gear").digest(256 * 4), dtype="<u4").copy()


def payload_of(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + bytes(max(BLOCK, -(-len(raw) // BLOCK) * BLOCK) - len(raw)), len(raw)


def to_wav(payload: bytes) -> bytes:
    """Unsigned 8-bit PCM, one channel; the length is even, so no pad byte follows."""
    n = len(payload)
    return b"RIFF" + struct.pack("<I", 36 + n) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8) + b"data" + struct.pack("<I", n) + payload


def from_wav(media: bytes) -> bytes:
    if media[:4] != b"RIFF" or media[8:16] != b"WAVEfmt ":
        raise ValueError("not a stored medium")
    (n,) = struct.unpack_from("<I", media, 40)
    return media[44 : 44 + n]


def cuts(data: bytes) -> list[int]:
    """End offsets of chunks: positions whose 32-byte rolling gear hash has MASK_BITS zero high bits."""
    h = _GEAR[np.frombuffer(data, dtype=np.uint8)]
    span = 1
    while span < 32:
        moved = h.copy()
        moved[span:] += h[:-span] << np.uint32(span) if len(h) > span else 0
        h, span = moved, span * 2
    ends, last, n = [], 0, len(data)
    for p in np.flatnonzero(h >> np.uint32(32 - MASK_BITS) == 0) + 1:
        p = int(p)
        while p - last > MAX_CHUNK:
            last += MAX_CHUNK
            ends.append(last)
        if p - last >= MIN_CHUNK:
            ends.append(p)
            last = p
    while n - last > MAX_CHUNK:
        last += MAX_CHUNK
        ends.append(last)
    if last < n:
        ends.append(n)
    return ends


def features(payload: bytes) -> str:
    x = np.frombuffer(payload, dtype=np.uint8)
    share = np.bincount(x, minlength=256) / len(x)
    p = share[share > 0]
    wave = (x.astype(np.float64) - 128) / 128
    return json.dumps({
        "entropy": round(float(-(p * np.log2(p)).sum()), 6), "mean": round(float(x.mean()), 6), "rms": round(float(np.sqrt((wave**2).mean())), 6),
        "crossings": int((np.diff(np.signbit(wave).astype(np.int8)) != 0).sum()), "seconds": len(x) / RATE,
    })


def chunk_lists(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row: key, n_bytes, media_id and the ordered digests of its medium's chunks."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, t in zip(batch["_key"], batch["_text"]):
                payload, n = payload_of(t)
                media = to_wav(payload)
                ends = cuts(media)
                digests = [hashlib.sha256(media[a:b]).digest() for a, b in zip([0, *ends], ends)]
                rows.append((k, n, hashlib.sha256(media).digest(), digests))
            yield pd.DataFrame(rows, columns=[key, "n_bytes", "media_id", "digests"])

    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    return rows.mapInPandas(run, f"{key} {kind}, n_bytes long, media_id binary, digests array<binary>")


def containers(docs: DataFrame, text: str = "text", part: int | None = None) -> DataFrame:
    """One row per distinct medium (of one of the SLICES, if told): media_id, the ends of its chunks (32-bit) and its compressed bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pack = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            rows = []
            for t in batch["_text"]:
                media = to_wav(payload_of(t)[0])
                media_id = hashlib.sha256(media).digest()
                if part is None or media_id[0] % SLICES == part:
                    rows.append((media_id, np.array(cuts(media), dtype="<u4").tobytes(), pack.compress(media)))
            yield pd.DataFrame(rows, columns=["media_id", "ends", "pack"])

    rows = docs.select(F.col(text).alias("_text")).mapInPandas(run, "media_id binary, ends binary, pack binary")
    rows = rows.where("media_id IS NOT NULL").groupBy("media_id").agg(F.first(F.struct("ends", "pack")).alias("held"))
    return rows.select("media_id", "held")


def owners(lists: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(own, foreign) of distinct media's lists, for digests with more than one place.

    own: digest, its owner's media_id and seq, copies to give. foreign: media_id, seq, digest, copies: the other places.
    """
    refs = lists.groupBy("media_id").agg(F.first("digests").alias("digests")).select("media_id", F.posexplode("digests").alias("seq", "digest"))
    own = refs.groupBy("digest").agg(F.min(F.struct("media_id", "seq")).alias("_own"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    own = cut(own.withColumn("copies", F.ceil(F.col("_n") / SHARE).cast("int")))
    foreign = join_counted(refs, own, "digest", "_n").where("media_id <> _own.media_id OR seq <> _own.seq")
    return own.select("digest", "_own.*", "copies"), cut(foreign.select("media_id", "seq", "digest", "copies"))


def _chunks(held: dict, missing) -> list[bytes | None]:
    """The chunks of a store entry in order, None where another entry owns one."""
    own = zstandard.ZstdDecompressor().decompress(held["pack"])
    ends = np.frombuffer(held["ends"], dtype="<u4").tolist()
    gone, out, at = set() if missing is None else set(missing), [], 0
    for seq, (a, b) in enumerate(zip([0, *ends], ends)):
        out.append(None if seq in gone else own[at : at + b - a])
        at += 0 if seq in gone else b - a
    return out


def store(docs: DataFrame, foreign: DataFrame, text: str = "text", own: DataFrame | None = None) -> DataFrame:
    """media_id, held (ends of all chunks and the owned ones, compressed), missing (places of the others): each distinct chunk once.
    With own, giving too: the owned chunks that others take.

    Media meet their equals by a shuffle of their bytes. It is made slice by slice, each from all texts anew, so the disk holds the
    store and one slice's shuffle."""
    lists = [foreign.groupBy("media_id").agg(F.collect_list("seq").alias("missing"))]
    kinds = "media_id binary, held struct<ends: binary, pack: binary>, missing array<int>"
    if own is not None:
        lists.append(own.groupBy("media_id").agg(F.collect_list(F.struct("seq", "digest", "copies")).alias("giving")))
        kinds += ", giving array<struct<seq: int, digest: binary, copies: int>>"

    def thin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            held = []
            for h, gone in zip(batch["held"], batch["missing"]):
                if gone is not None:
                    media = zstandard.ZstdDecompressor().decompress(h["pack"])
                    ends, gone = np.frombuffer(h["ends"], dtype="<u4").tolist(), set(gone)
                    h = {"ends": h["ends"], "pack": press.compress(b"".join(media[a:b] for seq, (a, b) in enumerate(zip([0, *ends], ends)) if seq not in gone))}
                held.append(h)
            yield batch.assign(held=held)

    joined = lambda k: reduce(lambda rows, more: rows.join(more, "media_id", "left"), lists, containers(docs, text, k))
    return reduce(DataFrame.unionByName, [cut(joined(k).mapInPandas(thin, kinds)) for k in range(SLICES)])


def rebuilt(docs: DataFrame, lists: DataFrame, text: str = "text") -> DataFrame:
    """One row per distinct medium: media_id, held and missing (its entry of the store), given (the chunks it lacks).

    Only entries that lack chunks travel to what they are given; the others are read where they lie."""
    own, foreign = owners(lists)
    held = store(docs, foreign, text, own)

    def give(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            pack, rows = zstandard.ZstdCompressor(level=3), []
            for h, missing, wanted in zip(batch["held"], batch["missing"], batch["giving"]):
                parts = _chunks(h, missing)
                rows += [(w["digest"], w["copies"], pack.compress(parts[w["seq"]])) for w in wanted]
            yield pd.DataFrame(rows, columns=["digest", "copies", "data"])

    gifts = held.where("giving IS NOT NULL").select("held", "missing", "giving").mapInPandas(give, "digest binary, copies int, data binary")
    gifts = gifts.select("digest", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("salt"), "data")
    takers = foreign.withColumn("salt", F.pmod(F.xxhash64("media_id", "seq"), F.col("copies")).cast("int")).drop("copies")
    given = takers.join(gifts, ["digest", "salt"]).groupBy("media_id").agg(F.collect_list(F.struct("seq", "data")).alias("given"))
    held = held.drop("giving")
    whole = held.where("missing IS NULL").withColumn("given", F.lit(None).cast(given.schema["given"].dataType))
    return held.where("missing IS NOT NULL").join(given, "media_id", "left").unionByName(whole)


def assembled(media_id: bytes, held: dict, missing, given) -> bytes:
    """The medium from the chunks it owns and those given; verified by its digest."""
    parts = _chunks(held, missing)
    unpack = zstandard.ZstdDecompressor()
    for g in given if given is not None else ():
        parts[g["seq"]] = unpack.decompress(g["data"])
    media = b"".join(parts)
    if hashlib.sha256(media).digest() != bytes(media_id):
        raise ValueError("rebuilt medium differs from its digest")
    return media


def media_report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Digests and features of each row's medium, read back from the rebuilt bytes."""
    lists = cut(chunk_lists(docs, key, text))
    counts = lists.groupBy("media_id").agg(F.count(F.lit(1)).alias("_n"))
    counts = cut(counts.withColumn("copies", F.ceil(F.col("_n") / SHARE).cast("int")))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for media_id, held, missing, given in zip(batch["media_id"], batch["held"], batch["missing"], batch["given"]):
                media = assembled(media_id, held, missing, given)
                got = from_wav(media)
                rows.append((media_id, len(got), hashlib.sha256(got).hexdigest(), zlib.crc32(got[-BLOCK:]), len(media), hashlib.sha256(media).hexdigest(), features(got)))
            yield pd.DataFrame(rows, columns=["media_id", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    several = cut(counts.where("copies > 1").select("media_id", "copies"))  # a small table of its own, so facts need not travel to it
    facts = rebuilt(docs, lists, text).mapInPandas(read, "media_id binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    facts = facts.join(several, "media_id", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("copies", F.lit(1)) - 1))).drop("copies")
    rows = join_counted(lists.select(key, "n_bytes", "media_id"), counts, "media_id", "_n")
    rows = rows.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.col("copies")).cast("int"))
    return rows.join(facts, ["media_id", "salt"]).select(key, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
