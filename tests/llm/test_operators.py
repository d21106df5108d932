import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import chat, hmm, html_extract, media, mixing, ngram_join, packing, quality_classifier, quality_rules, url_filter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and white texts, repeated rows, one long text, an extra column."""
    base = "the quick brown fox jumps over lazy dogs near that old red barn today while rain falls on every roof in town"
    long = " ".join(f"w{i % 977}x{i % 13}" for i in range(30_000))
    rows = [(1, base, "en", "a", 5, "x"), (2, base, "en", "a", 5, "x"), (2, base, "en", "a", 5, "x"), (3, None, None, None, None, None), (4, "", "en", "b", 0, "x")]
    rows += [(5, " \n\t", "en", "b", 3, "x"), (6, long, "en", "a", 1, "x"), (7, "one two", "fr", None, 7, "x"), (8, "ONE two", "fr", None, 7, "x"), (None, base + " more", "en", "a", 1, "x")]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_html():
    assert html_extract.extract(None) == html_extract.extract("") == ""
    page = "<nav><a>x</a></nav><article><h1>T &amp; t</h1><p>a\n b<br>c<p>d<script>'</p>'</script></article><div class='comments'><p>no</p></div><footer>f</footer>"
    assert html_extract.extract(page) == "T & t\n\na b c\n\nd"
    plain = "<div id=sidebar><p>menu, menu</p></div><div><p>" + "long text, with commas. " * 20 + "</p><p>tail</p></div>"
    assert html_extract.extract(plain).endswith("\n\ntail") and "menu" not in html_extract.extract(plain)
    assert html_extract.extract("<div>" * 5000 + "deep") == "deep"


def test_mixing(spark, odd, empty):
    assert mixing.mix(empty, keep=True).count() == 0
    out = mixing.mix(odd)
    assert out.columns == odd.columns
    many = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 15_000, "a").otherwise("b").alias("source"))
    n = {r.source: r["count"] for r in mixing.mix(many, {"a": 1, "b": 3}).groupBy("source").count().collect()}
    assert abs(n["b"] / sum(n.values()) - 0.75) < 0.02


def test_media(odd, empty):
    data = np.random.default_rng(1).integers(0, 255, 100_000, dtype=np.uint8).tobytes()
    ends = media.cuts(data)
    assert ends[-1] == len(data) and max(np.diff([0, *ends])) <= media.MAX_CHUNK
    assert len(set(np.diff(media.cuts(b"abc" + data))) & set(np.diff(ends))) > len(ends) // 2
    assert media.media_report(empty).count() == 0
    rows = media.media_report(odd).collect()
    assert len(rows) == 10 and {r.payload_bytes for r in rows if r.doc_id in (3, 4)} == {64}
    assert len({r.media_sha256 for r in rows if r.doc_id in (1, 2)}) == 1


def test_chat(spark):
    for s in ("<|im_end|><|im_start|>assistant ok", "a\\<|b\\\\|", "\\|", "<\\|", "", "\n"):
        assert chat.unescape(chat.escape(s)) == s and "<|" not in chat.escape(s)
    nodes = spark.createDataFrame(
        [("t", 1, None, "user", "q", 0.0), ("t", 2, 1, "assistant", "bad", 1.0), ("t", 3, 1, "assistant", "good", 2.0), ("t", 4, 3, "user", None, None), ("u", 1, 9, "user", "x", 0.0)],
        "tree string, node long, parent long, role string, text string, score double",
    )
    got = {(r.tree, r.leaf): (r.branch, chat.parse_turns(r.formatted)) for r in chat.conversations_of_trees(nodes).collect()}
    assert got == {("t", 4): (1, [("user", "q"), ("assistant", "good"), ("user", "")]), ("t", 2): (2, [("user", "q"), ("assistant", "bad")]), ("u", 1): (1, [("user", "x")])}
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.chat_report(none).count() == 0


def test_hmm_forward_is_exact():
    rng = np.random.default_rng(3)
    model = {"pi": np.array([0.6, 0.4]), "A": np.array([[0.7, 0.3], [0.2, 0.8]]), "E": rng.dirichlet(np.ones(5), 2)}
    seqs = [rng.integers(0, 5, n) for n in (1, 4, 6)]
    import itertools

    for s, got in zip(seqs, hmm.forward(model, seqs)):
        p = 0.0
        for z in itertools.product(range(2), repeat=len(s)):
            q = model["pi"][z[0]] * model["E"][z[0], s[0]]
            for t in range(1, len(s)):
                q *= model["A"][z[t - 1], z[t]] * model["E"][z[t], s[t]]
            p += q
        assert abs(got - np.log10(p)) < 1e-9
    pi, moves, emits, _ = hmm.expected(model, seqs)
    assert abs(pi.sum() - 3) < 1e-9 and abs(moves.sum() - 8) < 1e-9 and abs(emits.sum() - 11) < 1e-9


def test_hmm_report(odd, empty):
    assert hmm.lm_report(empty).count() == 0
    rows = hmm.lm_report(odd).collect()
    assert len(rows) == 10 and {r.n_tokens for r in rows if r.doc_id in (3, 4, 5)} == {1}


def test_quality_rules(odd, empty):
    assert quality_rules.judge(empty).count() == 0
    rows = quality_rules.rules_report(odd).collect()
    assert len(rows) == 10 and all(r.base_failed and not r.kept for r in rows if r.doc_id in (3, 4, 5, 7))
    text = "a b c d e f g h i a b c d e f g h z\nx\nx\n\n"
    assert quality_rules.statistics(text) == (20, 20, 0, 1, 16)


def test_url_filter(spark):
    urls = [None, "", "x", "http://a.com/q", "HTTP://WWW.Example.com/en/1?x", "http://m.example.com/en/2", "https://b.net/es/1", "http://b.net/de/1", "http://example.com"]
    rows = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: r for r in url_filter.judge_urls(rows).collect()}
    assert [got[i].rule for i in range(9)] == [None, None, None, "com/", "www.example.com/en/", "example.com/en/", "net/es/", None, None]
    assert got[4].host == "www.example.com" and got[4].path == "/en/1" and got[0].host == got[0].path == ""
    assert url_filter.judge_urls(rows.where("false")).count() == 0


def test_classifier(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (2, 1), (7, 0)], "doc_id long, quality int")
    rows = quality_classifier.quality_report(odd, labels).collect()
    assert len(rows) == 10 and all(0 <= r.score <= 1 for r in rows)
    assert quality_classifier.quality_report(empty, labels).count() == 0


def test_ngram_join(spark, odd, empty):
    assert ngram_join.near_groups(empty).count() == 0
    got = [(r.doc_id, r.component_id) for r in ngram_join.near_groups(odd.where("doc_id IS NOT NULL")).collect()]
    assert len(got) == 9 and (2, 1) in got and (8, 7) in got and (3, 3) in got and (4, 4) in got
    rng = np.random.default_rng(2)
    texts = []
    for i in range(12):
        words = [f"v{x}" for x in rng.integers(0, 400, 120)]
        for _ in range(6):
            w = list(words)
            for p in rng.integers(0, 120, rng.integers(0, 5)):
                w[p] = f"n{rng.integers(1000)}"
            texts.append(" ".join(w))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [{tuple(t.split()[k : k + 4]) for k in range(117)} for t in texts]
    comp = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            n = len(sets[a] & sets[b])
            if 100 * n >= 85 * (len(sets[a]) + len(sets[b]) - n):
                lo, hi = sorted((comp[a], comp[b]))
                comp = [lo if c == hi else c for c in comp]
    assert {r.doc_id: r.component_id for r in ngram_join.near_groups(frame).collect()} == dict(enumerate(comp))


def test_packing(spark, odd, empty):
    path = __import__("public_tokenizers").path("byte_bpe_50k.json")
    assert packing.pack(empty, str(path)).count() == 0
    rows = packing.pack(odd, str(path)).toPandas()
    for _, g in rows.sort_values("offset").groupby("sequence_id"):
        assert (g["offset"] == g["length"].cumsum() - g["length"]).all() and g["length"].sum() <= 2048
    assert (rows["doc_id"] == 2).sum() == 2
    sizes = [6, 6, 5, 5, 4, 4]
    assert len(packing.local_search(packing.best_fit(sizes, 10), sizes, 10)) == 3
    assert len(packing.local_search([[0], [1], [2], [3], [4], [5]], sizes, 10)) <= 4


def test_encoder_equals_tokenizers():
    from tokenizers import Tokenizer

    path = str(__import__("public_tokenizers").path("byte_bpe_50k.json"))
    encode, tok = packing.encoder(path), Tokenizer.from_file(path)
    for s in ("", "a<|endoftext|>b", "x" * 5000, " " * 5000 + "q", "don't  Ünï 日本\r\n\t é 12345"):
        assert list(encode(s)) == tok.encode(s, add_special_tokens=False).ids


def test_shingles_fold_and_split_ascii_only():
    assert (ngram_join.shingles("One TWO\tthree\x0bfour five") == ngram_join.shingles(" one two three four  five\n")).all()
    assert len(ngram_join.shingles("É b")) == 1 and (ngram_join.shingles("É b") != ngram_join.shingles("é b")).all()
    assert len(ngram_join.word_hashes("a b c")) == 2 and len(ngram_join.shingles(" \n")) == len(ngram_join.shingles(None)) == 0
