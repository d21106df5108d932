"""The classifier's forward pass, gradients and block-wise scores against plain loops."""

import random
import resource

import numpy as np

from quillon.llm import quality_classifier as Q


def plain_passages(text):
    raw = text.encode()
    out = []
    for at in range(0, len(raw), Q.PASSAGE):
        part = raw[at : at + Q.PASSAGE]
        row = np.zeros(Q.DIMS)
        for b in part:
            row[b] += 1 / len(part)
        for i in range(at, min(at + len(part), len(raw) - 1)):
            row[256 + ((raw[i] << 8 | raw[i + 1]) * 2654435761 % 2**32 >> 25)] += 1 / len(part)
        row[:-3] = np.sqrt(row[:-3])
        grams = {((raw[i] * 31 + raw[i + 1]) * 31 + raw[i + 2] * 7 + raw[i + 3]) % 65536 for i in range(at, min(at + len(part), len(raw) - 3))}
        row[-3:] = min(len(part) / Q.PASSAGE, 1), len(grams) / len(part), 0
        out.append(row)
    return np.array(out)


def plain_score(w, x):
    hs, logits = [], []
    for row in x:
        h = [np.tanh(sum((row[d] - w["mu"][d]) / w["sd"][d] * w["E"][d, k] for d in range(Q.DIMS)) + w["e"][k]) for k in range(Q.HIDDEN)]
        t = [np.tanh(sum(h[k] * w["V"][k, g] for k in range(Q.HIDDEN))) for g in range(Q.GATE)]
        s = [1 / (1 + np.exp(-sum(h[k] * w["U"][k, g] for k in range(Q.HIDDEN)))) for g in range(Q.GATE)]
        hs.append(h)
        logits.append(sum(w["a"][g] * t[g] * s[g] for g in range(Q.GATE)))
    a = np.exp(np.array(logits) - max(logits))
    a /= a.sum()
    return 1 / (1 + np.exp(-(sum(a[i] * np.dot(hs[i], w["o"]) for i in range(len(hs))) + w["b"][0])))


def model(seed=1):
    rng = np.random.default_rng(seed)
    w = Q.fit([Q.passages("abc def " * 30), Q.passages("zzz " * 300)], np.array([1.0, 0.0]), epochs=1)
    return {k: v + rng.normal(0, 0.3, v.shape) if k not in ("mu", "sd") else v for k, v in w.items()}


def texts():
    rng = random.Random(2)
    return ["a", "abc", "abcd", "ü" * 700] + ["".join(rng.choice("abc dé\n.") for _ in range(rng.randint(1, 3000))) for _ in range(6)]


def test_passages_and_scores_equal_plain_loops():
    w = model()
    for text in texts():
        x = Q.passages(text)
        assert np.allclose(x[:, : Q.DIMS - 2], plain_passages(text)[:, : Q.DIMS - 2], atol=1e-5)
        if len(text) > 3:
            assert np.allclose(x, plain_passages(text), atol=1e-5)
        assert abs(Q._forward(w, x)[-1][0] - plain_score(w, x)) < 1e-6


def test_blocks_give_the_same_passages_and_scores(monkeypatch):
    w = model()
    whole = [(Q.passages(t), Q._forward(w, Q.passages(t))[-1][0]) for t in texts()]
    monkeypatch.setattr(Q, "AT_ONCE", 2)
    for text, (x, p) in zip(texts(), whole):
        assert np.array_equal(Q.passages(text), x) and abs(Q.scored(w, Q.passage_blocks(text)) - p) < 1e-9
    assert 0 <= Q.scored(w, Q.passage_blocks(None)) <= 1


def test_gradients_equal_differences():
    bags, y = [Q.passages(t) for t in texts()[3:6]], np.array([1.0, 0.0, 1.0])
    seen = {}

    class Stop(Exception):
        pass

    def loss(w):
        return float(np.mean([-(t * np.log(p) + (1 - t) * np.log(1 - p)) for t, p in ((t, Q._forward(w, x)[-1][0]) for x, t in zip(bags, y))]))

    # Adam's first step moves every parameter against its gradient's sign
    before = Q.fit(bags, y, epochs=0)
    after = Q.fit(bags, y, epochs=1, rate=1e-3)
    rng = np.random.default_rng(0)
    for k in ("E", "V", "U", "a", "o", "b", "e"):
        for _ in range(5):
            at = tuple(rng.integers(0, n) for n in before[k].shape)
            up, down = ({**before, k: before[k].astype(float).copy()} for _ in range(2))
            up[k][at] += 1e-4
            down[k][at] -= 1e-4
            slope = (loss(up) - loss(down)) / 2e-4 + 1e-4 * before[k][at]
            if abs(slope) > 1e-4:
                seen[k] = seen.get(k, 0) + 1
                assert np.sign(after[k][at] - before[k][at]) == -np.sign(slope)
    assert seen


def test_a_text_of_100_mb_takes_little_memory():
    w, text = model(), "some words, and more of them. " * 3_500_000
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    assert 0 <= Q.scored(w, Q.passage_blocks(text)) <= 1
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 400_000  # KB, the text's own bytes among them
