"""Quality rules: robust multivariate outliers.

Each text gives a vector of transformed statistics. Per language and source a minimum-covariance-determinant estimate is
found by concentration steps from several deterministic starts (correlations of squashed values, of directions, and with
weights falling off from the middle): after START_STEPS steps the start with the least determinant goes on, until the
determinants fall no more. A step is one aggregation over all rows: each row's distance falls into a narrow bin, each bin
keeps its count, sums and products, and the bins nearest to the centre, up to SHARE of the group's rows (of the last bin the
fitting fraction), give the next mean and covariance. Covariances are regularised by a floor, as many texts have no symbols
and no repeats at all, and scaled to be consistent for normal rows. Texts whose squared Mahalanobis distance is over the
1 - TAIL quantile of chi-squared go.

Groups of few rows lean on the estimate over all rows. Null, empty and wordless texts have no words and fail the base
rule; null languages and sources are groups like others; repeated rows count as often as they stand and get one verdict.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, join_groups

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SYMBOL = re.compile(r"[#*$%&|<>]")
WINDOW = 8
DIMS = 5
SHARE = 0.75  # of each group's rows that the estimate concentrates on
START_STEPS, MOST_STEPS = 2, 12
SETTLED = 1e-3  # fall of the mean log determinant under which the steps end
LEAN = 40.0  # rows' worth of the overall estimate in each group's
FLOOR = (0.6, 0.15, 0.6, 0.06, 0.06)  # least standard deviation of each statistic
TAIL = 1e-6  # share of normal rows beyond the limit
BINS_A_DOUBLING = 8
_PAIRS = [(i, j) for i in range(DIMS) for j in range(i, DIMS)]


def chi2_cdf(x: float, dims: int) -> float:
    """Chi-squared distribution with an odd number of dimensions."""
    z, out, a = x / 2, math.erf(math.sqrt(x / 2)), 0.5
    while a < dims / 2:
        out -= z**a * math.exp(-z) / math.gamma(a + 1)
        a += 1
    return out


def chi2_quantile(p: float, dims: int) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, dims) < p else (lo, mid)
    return hi


def limit() -> float:
    return chi2_quantile(1 - TAIL, DIMS)


def consistency() -> float:
    """What the covariance of the nearest SHARE of normal rows must be multiplied by."""
    return SHARE / chi2_cdf(chi2_quantile(SHARE, DIMS), DIMS + 2)


def statistics(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    if not text:
        return 0, 0, 0, 0, 0
    words = _WORD.findall(text)
    n = len(words)
    seen: set[str] = set()
    dup = 0
    for line in text.split("\n"):
        if line in seen:
            dup += 1
        elif _WORD.search(line):
            seen.add(line)
    repeat = 0
    if n > WINDOW:
        ids: dict[str, int] = {}
        w = np.fromiter((ids.setdefault(x, len(ids)) for x in words), dtype=np.int64, count=n)
        # exact names of windows: double the span three times, each time renumbering pairs
        name = w
        for span in (1, 2, 4):
            pair = name[: len(name) - span] * (int(name.max()) + 1) + name[span:]
            name = np.unique(pair, return_inverse=True)[1]
        twice = (np.bincount(name)[name] > 1).astype(np.int64)
        cover = np.zeros(n + 1, dtype=np.int64)
        cover[: len(twice)] += twice
        cover[WINDOW : WINDOW + len(twice)] -= twice
        repeat = int((np.cumsum(cover)[:n] > 0).sum())
    return n, sum(map(len, words)), len(_SYMBOL.findall(text)), dup, repeat


def add_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    @F.pandas_udf("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long")
    def measured(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(*statistics(t), (t or "").count("\n") + 1) for t in batch]
            yield pd.DataFrame(rows, columns=["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"])

    return docs.withColumn("_st", measured(F.col(text)))


def _vector():
    s = lambda c: F.col(f"_st.{c}").cast("double")
    words = F.greatest(s("n_words"), F.lit(1.0))
    chars = F.greatest(s("word_chars"), F.lit(1.0))
    return F.array(F.log1p(words), F.log(chars / words), F.log1p(1000 * s("n_symbols") / chars), s("n_dup_lines") / s("n_lines"), s("n_repeat_words") / words)


def _full(flat) -> np.ndarray:
    out = np.zeros((DIMS, DIMS))
    out[np.triu_indices(DIMS)] = flat
    return out + np.triu(out, 1).T


def regularised(cov: np.ndarray) -> np.ndarray:
    return cov * consistency() + np.diag(np.square(FLOOR))


def _correlated(products: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """The covariance with these scales and the correlations of these products."""
    size = np.sqrt(np.maximum(np.diag(products), 1e-12))
    return products / np.outer(size, size) * np.outer(scale, scale)


def _typed(groups: DataFrame, keys: list[str]) -> str:
    return ", ".join(f"`{k}` {groups.schema[k].dataType.simpleString()}" for k in keys)


def starts(learn: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n and est: the (mean, cov) of each start, around the medians of a group's own rows."""
    quartiles = learn.groupBy(*keys).agg(*[F.percentile_approx(F.col("_x")[i], [0.25, 0.5, 0.75], 10_000).alias(f"_q{i}") for i in range(DIMS)])
    scale = [F.greatest((F.col(f"_q{i}")[2] - F.col(f"_q{i}")[0]) / 1.349, F.lit(FLOOR[i])) for i in range(DIMS)]
    quartiles = cut(quartiles.select(*keys, F.array(*[F.col(f"_q{i}")[1] for i in range(DIMS)]).alias("_mid"), F.array(*scale).alias("_scale")))
    rows = join_groups(learn.select(*keys, "_x"), quartiles, keys)
    rows = rows.select(*keys, "_mid", "_scale", F.array(*[(F.col("_x")[i] - F.col("_mid")[i]) / F.col("_scale")[i] for i in range(DIMS)]).alias("_z"))
    rows = rows.withColumn("_far", sum((F.col("_z")[i] * F.col("_z")[i] for i in range(DIMS)), F.lit(0.0)))
    z = [F.col("_z")[i] for i in range(DIMS)]
    squashed, near = [F.tanh(v) for v in z], 1 / (1 + F.col("_far") / DIMS)
    turned = [v / F.sqrt(F.greatest("_far", F.lit(1e-12))) for v in z]
    sums = [F.sum(a[i] * a[j]) for a in (squashed, turned) for i, j in _PAIRS] + [F.sum(near)]
    sums += [F.sum(near * v) for v in z] + [F.sum(near * z[i] * z[j]) for i, j in _PAIRS]
    found = rows.groupBy(*keys).agg(F.count(F.lit(1)).cast("double").alias("n"), F.first("_mid").alias("_mid"), F.first("_scale").alias("_scale"), F.array(*sums).alias("_s"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = len(_PAIRS)
        for batch in batches:
            made = []
            for mid, scale, s, n in zip(batch["_mid"], batch["_scale"], batch["_s"], batch["n"]):
                mid, scale, s = np.asarray(mid), np.asarray(scale), np.asarray(s)
                own = [(mid, _correlated(_full(s[k * p : (k + 1) * p]) / n, scale)) for k in range(2)]
                w, m = s[2 * p], s[2 * p + 1 : 2 * p + 1 + DIMS] / s[2 * p]
                own.append((mid + m * scale, (_full(s[2 * p + 1 + DIMS :]) / w - np.outer(m, m)) * np.outer(scale, scale)))
                made.append([{"mean": a.tolist(), "cov": b.ravel().tolist()} for a, b in own])
            yield batch[[*keys, "n"]].assign(est=made)

    return found.mapInPandas(run, f"{_typed(learn, keys)}, n double, est array<struct<mean: array<double>, cov: array<double>>>")


def overall(groups: DataFrame) -> tuple[np.ndarray, np.ndarray, float]:
    """Mean and covariance over all groups' first estimates, and the mean log determinant; one row."""
    m, c = F.col("est")[0]["mean"], F.col("est")[0]["cov"]
    sums = [F.sum("n"), F.sum(F.col("n") * F.col("log_det"))] + [F.sum(F.col("n") * m[i]) for i in range(DIMS)]
    sums += [F.sum(F.col("n") * (c[i * DIMS + j] + m[i] * m[j])) for i, j in _PAIRS]
    got = groups.agg(F.array(*sums).alias("s")).first()["s"]
    if not got or not got[0]:
        return np.zeros(DIMS), np.eye(DIMS), 0.0
    mean = np.array(got[2 : 2 + DIMS]) / got[0]
    return mean, _full(np.array(got[2 + DIMS :]) / got[0]) - np.outer(mean, mean), got[1] / got[0]


def _inverses(groups: DataFrame, keys: list[str], mean: np.ndarray, cov: np.ndarray) -> DataFrame:
    """keys and _p: centre and inverse of each estimate, leaning on the overall one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = []
            for n, est in zip(batch["n"], batch["est"]):
                own = n / (n + LEAN)
                made.append([
                    {"m": (own * np.asarray(e["mean"]) + (1 - own) * mean).tolist(), "i": np.linalg.inv(regularised(own * np.reshape(e["cov"], (DIMS, DIMS)) + (1 - own) * cov)).ravel().tolist()}
                    for e in est
                ])
            yield batch[keys].assign(_p=made)

    return groups.mapInPandas(run, f"{_typed(groups, keys)}, _p array<struct<m: array<double>, i: array<double>>>")


def _distance(p):
    diff = [F.col("_x")[i] - p["m"][i] for i in range(DIMS)]
    return sum((p["i"][i * DIMS + j] * diff[i] * diff[j] for i in range(DIMS) for j in range(DIMS)), F.lit(0.0))


def concentrated(frame: pd.DataFrame, best: bool) -> tuple[float, list[dict], float]:
    """A group's rows, its next estimates from its bins and the log determinant of the first; with best, only the one of least determinant."""
    out = []
    for _, bins in frame.sort_values("_bin").groupby("_start"):
        n = bins["_n"].to_numpy(dtype=float)
        before = np.cumsum(n) - n
        share = np.clip((SHARE * n.sum() - before) / n, 0, 1)
        w = (share * n).sum()
        mean = (share[:, None] * np.vstack(bins["_s"])).sum(0) / w
        cov = _full((share[:, None] * np.vstack(bins["_ss"])).sum(0) / w) - np.outer(mean, mean)
        out.append((np.linalg.slogdet(regularised(cov))[1], mean, cov, n.sum()))
    if best:
        out = [min(out, key=lambda e: e[0])]
    return out[0][3], [{"mean": m.tolist(), "cov": c.ravel().tolist()} for _, m, c, _ in out], float(out[0][0])


def step(learn: DataFrame, params: DataFrame, keys: list[str], best: bool) -> DataFrame:
    """keys, n, est and log_det after one concentration step of every estimate."""
    rows = join_groups(learn.select(*keys, "_x"), params, keys).select(*keys, "_x", F.posexplode("_p").alias("_start", "_e"))
    place = F.floor(F.log2(F.greatest(_distance(F.col("_e")), F.lit(1e-6))) * BINS_A_DOUBLING).cast("int")
    x = [F.col("_x")[i] for i in range(DIMS)]
    bins = rows.withColumn("_bin", F.least(place, F.lit(40 * BINS_A_DOUBLING))).groupBy(*keys, "_start", "_bin").agg(
        F.count(F.lit(1)).alias("_n"), F.array(*[F.sum(v) for v in x]).alias("_s"), F.array(*[F.sum(x[i] * x[j]) for i, j in _PAIRS]).alias("_ss")
    )

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        n, est, log_det = concentrated(frame, best)
        return frame[keys].iloc[:1].assign(n=n, est=[est], log_det=log_det)

    return cut(bins.groupBy(*keys).applyInPandas(run, f"{_typed(learn, keys)}, n double, est array<struct<mean: array<double>, cov: array<double>>>, log_det double"))


def judge(docs: DataFrame, text: str = "text", keys: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """docs without text, with _st (statistics), _d (squared distance), base_failed and kept."""
    keys = list(keys)
    rows = add_statistics(docs, text).drop(text).withColumn("_x", _vector())
    failed = (F.col("_st.n_words") < 20) | (100 * F.col("_st.n_repeat_words") > 30 * F.col("_st.n_words"))
    rows = cut(rows.withColumn("base_failed", failed))
    learn = rows.where("NOT base_failed")
    groups, last = cut(starts(learn, keys).withColumn("log_det", F.lit(0.0))), None
    for k in range(MOST_STEPS):
        mean, cov, log_det = overall(groups)
        if k > START_STEPS + 1 and last - log_det < SETTLED:
            break
        last = log_det
        groups = step(learn, _inverses(groups, keys, mean, cov), keys, best=k + 1 >= START_STEPS)
    mean, cov, _ = overall(groups)
    rows = join_groups(rows, _inverses(groups, keys, mean, cov), keys).withColumn("_d", _distance(F.col("_p")[0])).drop("_p", "_x")
    return rows.withColumn("kept", ~F.col("base_failed") & (F.coalesce("_d", F.lit(0.0)) <= limit()))


def rules_report(docs: DataFrame) -> DataFrame:
    out = judge(docs.select("doc_id", "text", "lang", "source"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return out.select("doc_id", *[F.col(f"_st.{n}").alias(n) for n in names], "base_failed", "kept", F.col("_d").alias("distance"))
