import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import zstandard

from quillon.llm import hmm
from pyspark.sql import functions as F


def test_every_pass_after_the_sample_covers_all_training_texts(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(f"{'ab'[i % 2]}{x}" for x in rng.integers(0, 30, 40))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    seen, one = [], hmm.full_pass

    def spy(codes, model, shares):
        out = one(codes, model, shares)
        seen.append((codes, model, shares, out))
        return out

    monkeypatch.setattr(hmm, "START_DOCS", 2)
    monkeypatch.setattr(hmm, "full_pass", spy)
    assert hmm.lm_report(docs).count() == 60
    assert len(seen) > 1
    codes, model, shares, _ = seen[0]
    seqs = [np.frombuffer(zstandard.decompress(r.v), dtype="<u2").astype(np.int64) for r in codes.collect()]
    assert len(seqs) == docs.where(~hmm.held_out()).count() > 2
    gains = []
    for _, _, _, (_, total) in seen:
        *counts, mine = hmm.expected(model, seqs)
        model = hmm.settle(*counts, shares)
        assert abs(mine - total) < 1e-6 * abs(total)
        gains.append(total)
    for k in ("pi", "A", "E"):
        assert np.allclose(model[k], seen[-1][3][0][k], atol=1e-9)
    assert len(seen) == hmm.FULL_STEPS or gains[-1] - gains[-2] < hmm.GAIN * sum(map(len, seqs))


def _plain(model, s):
    """Scaled forward and backward recursion, one token after the other."""
    k = len(model["pi"])
    alpha, scale = np.zeros((len(s), k)), np.zeros(len(s))
    for t, x in enumerate(s):
        a = (model["pi"] if t == 0 else alpha[t - 1] @ model["A"]) * model["E"][:, x]
        scale[t] = a.sum()
        alpha[t] = a / scale[t]
    beta, moves, emits = np.ones(k), np.zeros((k, k)), np.zeros_like(model["E"])
    for t in range(len(s) - 1, -1, -1):
        if t + 1 < len(s):
            ahead = model["E"][:, s[t + 1]] * beta / scale[t + 1]
            moves += model["A"] * np.outer(alpha[t], ahead)
            beta = model["A"] @ ahead
        emits[:, s[t]] += alpha[t] * beta
    return alpha[0] * beta, moves, emits, np.log(scale).sum()


@pytest.mark.parametrize("lengths", [(1,), (3, 256, 257), (1000, 5, 513, 256, 40)])
def test_counts_and_likelihoods_of_long_texts_are_exact(lengths):
    rng = np.random.default_rng(3)
    model = {"pi": rng.dirichlet(np.ones(3)), "A": rng.dirichlet(np.ones(3), 3), "E": rng.dirichlet(np.ones(7), 3)}
    seqs = [rng.integers(0, 7, n) for n in lengths]
    want = [_plain(model, s) for s in seqs]
    got = hmm.expected(model, seqs)
    for i in range(4):
        assert np.allclose(got[i], sum(w[i] for w in want), rtol=1e-9, atol=1e-9)
    assert np.allclose(hmm.forward(model, seqs), [w[3] / math.log(10) for w in want])


def test_tokens_are_words_and_ends():
    h, begin = hmm.tokens(pa.array(["One two\x0bone", None, " ", "É b"]))
    assert begin.tolist() == [0, 4, 5, 6, 9] and h[0] == h[2] != h[1] and (h[[3, 4, 5, 8]] == hmm.END).all()


@pytest.mark.parametrize("known", [3, 200_000])
def test_base_scores_against_brute_force(spark, monkeypatch, known):
    """With few known words most counts come by the join, else none does."""
    monkeypatch.setattr(hmm, "KNOWN_WORDS", known)
    rng = np.random.default_rng(9)
    rows = [(i, " ".join(f"W{x}" for x in rng.zipf(1.5, 30) % 50)) for i in range(40)] + [(40, None), (41, ""), (None, "w1 new"), (40, "w2 w2 other")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit(1))
    held = [r[0] for r in spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).select(hmm.held_out()).collect()]
    words = [[*re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()), None] for _, t in rows]
    count = Counter(w for ws, out in zip(words, held) if not out for w in ws)
    n, v = sum(count.values()), len(count)
    want = sorted((str(i), len(ws), sum(count[w] > 0 for w in ws), n, round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws), 6)) for (i, _), ws in zip(rows, words))
    got = sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in hmm.lm_report(docs).collect())
    assert got == want
