"""Quality classifier: attention-based multiple-instance learning.

Every passage of a text is encoded from its bytes; gated attention, learned from document labels, weighs the passages,
and a logistic layer scores the weighted mean. Null and empty texts are one empty passage. The model is fitted in one task
on at most FIT_DOCS labelled texts of at most FIT_BYTES (those of smallest hash); the driver gets its parameters alone. It
scores every text in whole, AT_ONCE passages at a time, so a text of any length takes the same memory beside its own bytes.
A column named as the added one is replaced, all others stay; an empty table gives no rows.
Contradicting labels of an id average; repeated rows of an id count as often as they stand; labels without an id or a
quality are not used; without labels every score is one half.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_of_id

FIT_DOCS = 4000
FIT_BYTES = 1 << 17
PASSAGE = 512
AT_ONCE = 2048  # passages that are worked on together
HASHED = 128
DIMS = 256 + HASHED + 3
HIDDEN, GATE = 16, 16
_MIX = np.uint32(2654435761)


def _features(raw: np.ndarray, n: int) -> np.ndarray:
    """One row per passage of PASSAGE bytes of the first n: roots of byte and hashed byte-pair shares, length, repeats, emptiness.
    Pairs and grams belong to the passage that they begin in; raw goes on for three bytes behind n, if the text does."""
    m = -(-n // PASSAGE)
    row = np.arange(n) // PASSAGE
    size = np.bincount(row, minlength=m).astype(np.float32)[:, None]
    single = np.bincount(row * 256 + raw[:n], minlength=m * 256).reshape(m, 256)
    pairs, grams = min(n, len(raw) - 1), max(min(n, len(raw) - 3), 0)
    pair = (raw[:pairs].astype(np.uint32) << np.uint32(8) | raw[1 : pairs + 1]) * _MIX >> np.uint32(25)
    double = np.bincount(row[:pairs] * HASHED + pair, minlength=m * HASHED).reshape(m, HASHED)
    extra = np.zeros((m, 3), dtype=np.float32)
    extra[:, :1] = np.minimum(size / PASSAGE, 1)
    at = [raw[k : grams + k].astype(np.uint32) for k in range(4)]
    gram = np.unique(row[:grams] * (1 << 16) + ((at[0] * 31 + at[1]) * 31 + at[2] * np.uint32(7) + at[3]) % (1 << 16))
    if len(raw) <= 3:
        gram = np.zeros(1, dtype=np.int64)
    extra[:, 1] = np.bincount(gram >> 16, minlength=m)[:m] / size[:, 0]
    return np.hstack([np.sqrt(single / size), np.sqrt(double / size), extra]).astype(np.float32)


def passage_blocks(text: str | None) -> Iterator[np.ndarray]:
    """The passages of a text, AT_ONCE at a time; an empty text has one, which says so."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)
    if not len(raw):
        out = np.zeros((1, DIMS), dtype=np.float32)
        out[0, -1] = 1
        yield out
    for at in range(0, len(raw), AT_ONCE * PASSAGE):
        n = min(AT_ONCE * PASSAGE, len(raw) - at)
        yield _features(raw[at : at + n + 3], n)


def passages(text: str | None) -> np.ndarray:
    return np.vstack(list(passage_blocks(text)))


def _forward(w: dict, x: np.ndarray):
    h = np.tanh((x - w["mu"]) / w["sd"] @ w["E"] + w["e"])
    t, s = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-(h @ w["U"])))
    a = (t * s) @ w["a"]
    a = np.exp(a - a.max())
    a /= a.sum()
    z = a @ h
    return h, t, s, a, z, 1 / (1 + np.exp(-np.clip(z @ w["o"] + w["b"], -30, 30)))


def scored(w: dict, blocks: Iterator[np.ndarray]) -> float:
    """The score of one text, its passages weighed block by block: the weights' sum and the weighed passages' are scaled anew
    whenever a block has a larger attention than all before."""
    most, total, z = -np.inf, 0.0, np.zeros(HIDDEN)
    for x in blocks:
        h = np.tanh((x - w["mu"]) / w["sd"] @ w["E"] + w["e"])
        a = (np.tanh(h @ w["V"]) / (1 + np.exp(-(h @ w["U"])))) @ w["a"]
        top = max(most, float(a.max()))
        a = np.exp(a - top)
        before = np.exp(most - top)
        most, total, z = top, total * before + a.sum(), z * before + a @ h
    return float(1 / (1 + np.exp(-np.clip(z / total @ w["o"] + w["b"], -30, 30)))[0])


def fit(bags: list[np.ndarray], labels: np.ndarray, epochs: int = 12, seed: int = 5, rate: float = 3e-3) -> dict:
    """Adam over the documents; the classes weigh by their share, as the score is a probability."""
    rng = np.random.default_rng(seed)
    n = max(sum(map(len, bags)), 1)
    mu = sum((x.sum(0, dtype=np.float64) for x in bags), np.zeros(DIMS)) / n
    sd = np.sqrt(np.maximum(sum((np.square(x - mu).sum(0) for x in bags), np.zeros(DIMS)) / n, 0))
    w = {
        "mu": mu.astype(np.float32), "sd": (sd + 0.02).astype(np.float32), "E": rng.normal(0, DIMS**-0.5, (DIMS, HIDDEN)), "e": np.zeros(HIDDEN), "V": rng.normal(0, 0.25, (HIDDEN, GATE)),
        "U": rng.normal(0, 0.25, (HIDDEN, GATE)), "a": rng.normal(0, 0.25, GATE), "o": np.zeros(HIDDEN), "b": np.zeros(1),
    }
    names = [k for k in w if k not in ("mu", "sd")]
    m1, m2 = ({k: np.zeros_like(w[k]) for k in names} for _ in range(2))
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), 16):
            g = {k: 1e-4 * w[k] for k in names}
            part = order[at : at + 16]
            for i in part:
                x = bags[i]
                h, t, s, a, z, p = _forward(w, x)
                d = (p - labels[i]) / len(part)
                g["o"] += d * z
                g["b"] += d
                dz = d * w["o"]
                da = h @ dz
                da = a * (da - a @ da)
                g["a"] += (t * s).T @ da
                dts = np.outer(da, w["a"])
                dt, ds = dts * s * (1 - t * t), dts * t * s * (1 - s)
                g["V"] += h.T @ dt
                g["U"] += h.T @ ds
                dh = np.outer(a, dz) + dt @ w["V"].T + ds @ w["U"].T
                dh *= 1 - h * h
                g["E"] += ((x - w["mu"]) / w["sd"]).T @ dh
                g["e"] += dh.sum(0)
            step += 1
            for k in names:
                m1[k] = 0.9 * m1[k] + 0.1 * g[k]
                m2[k] = 0.999 * m2[k] + 0.001 * g[k] ** 2
                w[k] = w[k] - rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
    return w


def held_out():
    return F.pmod(crc_of_id(), F.lit(4)) == 2


def train(docs: DataFrame, labels: DataFrame) -> dict:
    """Fits on labelled rows outside the held-out fold; contradicting labels of an id average.

    The sample is chosen among the labels by a hash of the id, so no text but the chosen ones leaves its scan.
    """
    marks = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").where(~held_out()).groupBy("doc_id").agg(F.avg("quality").alias("_y"))
    n = marks.count()
    share = 0.95 * FIT_DOCS / max(n, 1)
    marks = marks.withColumn("_h", F.xxhash64("doc_id"))
    if share < 1:
        marks = marks.where(F.pmod("_h", F.lit(1_000_003)) < int(share * 1_000_003))
    chosen = marks.orderBy("_h").limit(FIT_DOCS)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").where(F.coalesce(F.octet_length("text"), F.lit(0)) <= FIT_BYTES)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bags, labels = [], []
        for batch in batches:
            bags += [passages(t) for t in batch["text"]]
            labels += batch["_y"].tolist()
        yield pd.DataFrame({"model": [pickle.dumps(fit(bags, np.array(labels, dtype=float)))]})

    chosen = rows.orderBy("_h", "text").limit(FIT_DOCS).select("text", "_y").coalesce(1)
    found = chosen.mapInPandas(run, "model binary").collect()  # one row of a fixed size
    return pickle.loads(found[0]["model"]) if found else fit([], np.zeros(0))


def score(docs: DataFrame, model: dict, text: str = "text", out: str = "score") -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed size: DIMS x HIDDEN and smaller

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        w = shared.value
        for batch in batches:
            yield pd.Series([scored(w, passage_blocks(t)) for t in batch], dtype=float)

    return docs.withColumn(out, run(F.col(text)))


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    rows = score(docs.select("doc_id", "text"), train(docs, labels))
    return rows.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
