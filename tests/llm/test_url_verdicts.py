"""Scores, threshold and verdicts of the URL filter against plain loops."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quillon.llm import url_filter as U


def plain_score(model, host, path):
    text = "^" * U.ORDER + re.sub(r"[^a-z0-9\-._~/%+=&:@!,;()]", "?", (host + path).lower()) + "$"
    ratios = []
    for at in range(U.ORDER, len(text)):
        gram = text[at - U.ORDER : at + 1]
        ratios.append(next((model[gram[-k:]] for k in range(U.ORDER + 1, 0, -1) if gram[-k:] in model), 0.0))
    return sum(ratios) / len(ratios)


def pages():
    rng = random.Random(3)
    host = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(2, 6))) + rng.choice([".com", ".org", ".example.com"])
    good = [f"http://{host()}/{rng.choice(['news', 'about', 'item'])}/{rng.randint(1, 99)}" for _ in range(150)]
    bad = [f"https://{'x' * rng.randint(1, 4)}{rng.randint(1, 99)}.net/{rng.choice(['es', 'fr'])}/win?id={rng.randint(1, 9)}" for _ in range(150)]
    open_ = [f"http://{'x' * 3}{i}.info/win{i}" for i in range(20)] + [f"http://abc{i}.info/news/{i}" for i in range(20)]
    return [*good, *bad, *open_, None, "", "no scheme", "ftp://Ünï.de/ß?x#y", "http://" + "a/" * 3000, good[0], good[0]]


@pytest.mark.parametrize("few", [200_000, 0])
def test_scores_and_verdicts(spark, monkeypatch, few):
    monkeypatch.setattr(U, "SMALL_GRAMS", few)
    rows = [(i if i % 50 else None, u) for i, u in enumerate(pages())]
    models, found = [], []
    make, calibrate = U.models, U.calibrated
    monkeypatch.setattr(U, "models", lambda labelled: models.append(make(labelled)) or models[-1])
    monkeypatch.setattr(U, "calibrated", lambda labelled: found.append(([tuple(r) for r in labelled.select("score", "a", "b").collect()], calibrate(labelled))) or found[-1][1])
    got = U.judge_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()
    assert len(got) == len(rows)
    model = {r.gram: r.ratio for r in models[0].collect()}
    labelled, at = found[-1]
    threshold = at["threshold"]

    def error(t):
        a, b = sum(n for _, n, _ in labelled), sum(n for _, _, n in labelled)
        return (sum(n for s, n, _ in labelled if s < t) / a + sum(n for s, _, n in labelled if s >= t) / b) / 2

    assert abs(error(threshold) - at["error"]) < 1e-9 and at["error"] <= min(error(k * U.STEP) for k in range(-1500, 1500)) + 1e-9
    for r in got:
        want = plain_score(model, r.host, r.path) if r.host + r.path else 0.0
        assert abs(r.score - want) < 1e-9
        ruled = {x[0]: x[1] for x in U.RULES}.get(r.rule)
        assert r.verdict == (ruled or ("allow" if r.score >= threshold else "block"))
    assert at["error"] < 0.1


def test_threshold_without_both_kinds(spark):
    rows = spark.createDataFrame([(0.5, 1, 0)], "score double, a long, b long")
    assert U.calibrated(rows)["threshold"] is None and U.calibrated(rows.where("false"))["threshold"] is None
    both = rows.unionByName(spark.createDataFrame([(-0.5, 0, 3)], "score double, a long, b long"))
    at = U.calibrated(both)
    assert abs(at["threshold"]) < 0.01 and at["error"] == 0
