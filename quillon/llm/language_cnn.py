"""Language identification by a convolutional network over bytes, trained and applied in numpy.

Bytes are embedded, filters of several widths slide over a window of WINDOW bytes, each filter's largest answer counts, and
a softmax over the languages judges the window. A text's windows cover it whole, end to end; its probabilities are the means
of theirs, by bytes. The network is fitted in one task on bounded samples: at most FIT_LANG texts of a language, the
LANGUAGES most frequent ones, FIT_WINDOWS windows spread over each text; the driver gets the parameters alone.

Null texts and those without a letter are `und`, with score 0; without any labelled text all are. Texts of any length are
scored whole, some windows at a time. Rows without a language train nothing; null and repeated ids are rows like others;
equal texts get equal predictions. Columns named as the added ones (lang_pred, score) are replaced, all others stay.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_of_id, text_slices, utf8

WINDOW = 256
EMBED, WIDTHS, FILTERS = 8, (2, 3, 4), 16
WIDE = max(WIDTHS)
FIT_LANG, FIT_WINDOWS, LANGUAGES = 1000, 4, 256
PAD = 256  # the byte beyond a text's end, embedded as zeros
AT_ONCE = 16  # windows that one matrix product takes; so many stay in a core's cache
UNKNOWN = "und"


def windows(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows (bytes, PAD beyond a text), the text of each and its bytes."""
    sizes = np.diff(ends)
    each = -(-sizes // WINDOW)
    owner = np.repeat(np.arange(len(sizes)), each)
    start = ends[owner] + (np.arange(len(owner)) - (np.cumsum(each) - each)[owner]) * WINDOW
    length = np.minimum(ends[owner + 1] - start, WINDOW)
    at = start[:, None] + np.arange(WINDOW)
    out = np.full(at.shape, PAD, dtype=np.int16)
    inside = np.arange(WINDOW) < length[:, None]
    out[inside] = raw[at[inside]]
    return out, owner, length


def fresh(langs: list[str], seed: int = 3) -> dict:
    rng = np.random.default_rng(seed)
    w = {"E": rng.normal(0, 0.5, (PAD + 1, EMBED)), "o": np.zeros((len(WIDTHS) * FILTERS, len(langs))), "c": np.zeros(len(langs))}
    w["E"][PAD] = 0
    for width in WIDTHS:
        w[f"W{width}"], w[f"b{width}"] = rng.normal(0, (width * EMBED) ** -0.5, (width, EMBED, FILTERS)), np.zeros(FILTERS)
    w["o"] += rng.normal(0, 0.1, w["o"].shape)
    return {k: v.astype(np.float32) for k, v in w.items()} | {"langs": langs}


def _filters(w: dict) -> np.ndarray:
    """All filters as one matrix over WIDE embedded bytes; the narrow ones have zeros at the end."""
    out = np.zeros((WIDE, EMBED, len(WIDTHS) * FILTERS), dtype=np.float32)
    for i, width in enumerate(WIDTHS):
        out[:width, :, i * FILTERS : (i + 1) * FILTERS] = w[f"W{width}"]
    return out.reshape(WIDE * EMBED, -1)


def answers(w: dict, x: np.ndarray, filters: np.ndarray) -> np.ndarray:
    """Every filter at every place of every window."""
    e = np.zeros((len(x), WINDOW + WIDE - 1, EMBED), dtype=np.float32)
    e[:, :WINDOW] = w["E"][x]
    spans = np.lib.stride_tricks.as_strided(e, (len(x), WINDOW, WIDE * EMBED), e.strides)
    return (spans.reshape(-1, WIDE * EMBED) @ filters).reshape(len(x), WINDOW, -1)


def features(w: dict, top: np.ndarray) -> np.ndarray:
    return np.maximum(top + np.concatenate([w[f"b{k}"] for k in WIDTHS]), 0)


def softmax(w: dict, h: np.ndarray) -> np.ndarray:
    z = h @ w["o"] + w["c"]
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def gradients(w: dict, x: np.ndarray, y: np.ndarray) -> dict:
    """Of the mean cross entropy. Only the places that the pooling chose pass anything on."""
    y_all = answers(w, x, _filters(w))
    at = y_all.argmax(1)
    h = features(w, np.take_along_axis(y_all, at[:, None], 1)[:, 0])
    d = softmax(w, h)
    d[np.arange(len(x)), y] -= 1
    d /= len(x)
    g = {"o": h.T @ d, "c": d.sum(0), "E": np.zeros_like(w["E"])}
    dh = d @ w["o"].T * (h > 0)
    wide = np.full((len(x), WINDOW + WIDE - 1), PAD, dtype=np.int64)
    wide[:, :WINDOW] = x
    for i, width in enumerate(WIDTHS):
        own = slice(i * FILTERS, (i + 1) * FILTERS)
        read = wide[np.arange(len(x))[:, None, None], at[:, own, None] + np.arange(width)]  # window, filter, byte
        g[f"W{width}"] = np.einsum("nf,nfwe->wef", dh[:, own], w["E"][read], optimize=True)
        g[f"b{width}"] = dh[:, own].sum(0)
        back = np.einsum("nf,wef->nfwe", dh[:, own], w[f"W{width}"], optimize=True)
        np.add.at(g["E"], read.ravel(), back.reshape(-1, EMBED))
    g["E"][PAD] = 0
    return g


def fit(x: np.ndarray, y: np.ndarray, langs: list[str], epochs: int = 4, batch: int = 64, least: int = 600, rate: float = 4e-3, seed: int = 3) -> dict:
    """Adam, for `least` steps at least; the languages weigh alike, so each epoch draws as many windows of each."""
    w = fresh(langs, seed)
    rng = np.random.default_rng(seed)
    own = [np.flatnonzero(y == k) for k in range(len(langs))]
    most = max(map(len, own), default=0)
    names = [k for k in w if k != "langs"]
    m1, m2 = ({k: np.zeros_like(w[k]) for k in names} for _ in range(2))
    each = max(-(-most * len(langs) // batch), 1)
    epochs = max(epochs, -(-least // each))
    steps = epochs * each
    step = 0
    for _ in range(epochs if most else 0):
        drawn = rng.permutation(np.concatenate([np.resize(rng.permutation(rows), most) for rows in own]))
        for at in range(0, len(drawn), batch):
            part = drawn[at : at + batch]
            g = gradients(w, x[part], y[part])
            step += 1
            pace = rate * (1 - step / steps) + 1e-5
            for k in names:
                m1[k] = 0.9 * m1[k] + 0.1 * g[k]
                m2[k] = 0.999 * m2[k] + 0.001 * g[k] ** 2
                w[k] = w[k] - pace * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
    return w


def judged(w: dict, raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Probabilities of each text's languages; zeros for empty texts."""
    x, owner, length = windows(raw, ends)
    filters, out = _filters(w), np.zeros((len(ends) - 1, len(w["langs"])))
    for at in range(0, len(x), AT_ONCE):
        part = slice(at, at + AT_ONCE)
        np.add.at(out, owner[part], softmax(w, features(w, answers(w, x[part], filters).max(1))) * length[part, None])
    return out / np.maximum(np.diff(ends), 1)[:, None]


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def held_out() -> Column:
    return F.pmod(crc_of_id(), F.lit(3)) == 1


def train(docs: DataFrame, text: str = "text", lang: str = "lang") -> dict | None:
    """The network, fitted on a sample of docs; None without a labelled text. Texts are sampled by a hash, each language by its own rate."""
    rows = docs.select(F.col(text).alias("t"), F.col(lang).cast("string").alias("l")).where(F.col("l").isNotNull())
    counts = rows.groupBy("l").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "l").limit(LANGUAGES)
    counts = {r["l"]: r["n"] for r in counts.collect()}
    if not counts:
        return None
    shares = rows.sparkSession.createDataFrame([(k, min(1.0, 1.2 * FIT_LANG / n)) for k, n in counts.items()], "l string, share double")
    drawn = rows.join(F.broadcast(shares), "l").withColumn("h", F.xxhash64("t", F.lit(11)))
    drawn = drawn.where((F.pmod("h", F.lit(1_000_000)) < F.col("share") * 1_000_000) & has_letter(F.col("t")))
    size = F.octet_length("t")
    start = lambda i: F.floor(i * F.greatest(size - WINDOW, F.lit(0)) / max(FIT_WINDOWS - 1, 1)).cast("int")
    spread = F.transform(F.sequence(F.lit(0), F.lit(FIT_WINDOWS - 1)), lambda i: F.substring(F.col("t").cast("binary"), start(i) + 1, F.lit(WINDOW)))
    drawn = drawn.select("l", "h", F.array_distinct(spread).alias("w")).orderBy("h", "l").limit(2 * FIT_LANG * len(counts)).select("l", "w")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        samples: dict[str, list[bytes]] = {}
        taken: dict[str, int] = {}
        for batch in batches:
            for name, parts in zip(batch.column("l").to_pylist(), batch.column("w").to_pylist()):
                if taken.get(name, 0) < FIT_LANG:
                    taken[name] = taken.get(name, 0) + 1
                    samples.setdefault(name, []).extend(parts)
        if samples:
            langs = sorted(samples)
            x, owner, _ = windows(*utf8(pa.array([p for name in langs for p in samples[name]], pa.binary())))
            y = np.repeat(np.arange(len(langs)), [len(samples[name]) for name in langs])[owner]
            yield pa.RecordBatch.from_pydict({"model": pa.array([pickle.dumps(fit(x, y, langs))], pa.binary())})

    found = drawn.coalesce(1).mapInArrow(run, "model binary").collect()  # one row of a fixed size
    return pickle.loads(found[0]["model"]) if found else None


def identify(docs: DataFrame, model: dict | None, text: str = "text") -> DataFrame:
    """docs with lang_pred and score, the probability of that language."""
    rows = docs.drop(*[c for c in ("lang_pred", "score") if c != text])
    if model is None:
        return rows.withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0)})
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed size for a fixed number of languages

    @F.arrow_udf("struct<lang: string, score: double>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        w = shared.value
        for texts in batches:
            langs, scores = [], []
            for part in text_slices(iter([pa.RecordBatch.from_arrays([texts], ["text"])]), "text"):
                p = judged(w, *utf8(part.column("text")))
                langs += [w["langs"][k] for k in p.argmax(1)]
                scores.append(np.minimum(p.max(1), 1.0))
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(np.concatenate(scores) if scores else [], pa.float64())], ["lang", "score"])

    letter = has_letter(F.col(text))
    rows = rows.withColumn("_lang_cnn", run(F.when(letter, F.col(text)).otherwise(F.lit(""))))
    rows = rows.withColumns({"lang_pred": F.when(letter, F.col("_lang_cnn.lang")).otherwise(F.lit(UNKNOWN)), "score": F.when(letter, F.col("_lang_cnn.score")).otherwise(F.lit(0.0))})
    return rows.drop("_lang_cnn")


def language_report(docs: DataFrame) -> DataFrame:
    model = train(docs.where(~held_out()).select("text", "lang"))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
