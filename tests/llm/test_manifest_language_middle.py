"""Merkle manifest, language network and fill-in-middle against plain versions."""

import random
import re
import zlib
from hashlib import sha256

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillon.llm import fill_middle, language_cnn, merkle
from quillon.llm.common import utf8

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def H(*parts):
    return sha256("".join(parts).encode()).hexdigest()


# op11


def plain_leaf(row):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[0], row[3], row[2], row[4], row[1])))


def plain_tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][k : k + 16]) for k in range(0, len(levels[-1]), 16)])
    return levels


def plain_path(levels, at):
    out = []
    for level in levels[:-1]:
        run = at // 16 * 16
        out.append(("".join(level[run:at]), "".join(level[at + 1 : run + 16])))
        at //= 16
    return out


def plain_manifest(rows):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    by = {}
    for r in rows:
        by.setdefault(r[3], []).append((r[0] is not None, r[0] or 0, plain_leaf(r), r))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = [plain_tree([x[2] for x in sorted(by[s], key=lambda x: x[:3])]) for s in names]
    top = plain_tree([t[-1][0] for t in trees])
    out = []
    for k, s in enumerate(names):
        for at, (_, _, leaf, r) in enumerate(sorted(by[s], key=lambda x: x[:3])):
            path = plain_path(trees[k], at) + plain_path(top, k)
            bad = zlib.crc32(b"" if r[0] is None else str(r[0]).encode()) % 5 == 0 and r[1] is not None
            fold = plain_leaf((r[0], r[1].translate(low), *r[2:])) if bad else leaf
            for a, b in path:
                fold = H(a, fold, b)
            out.append((r[0], leaf, trees[k][-1][0], top[-1][0], H(*(a + b for a, b in path)), fold, fold == top[-1][0]))
    return out


def key(row):
    return tuple((v is not None, v) for v in row)


def check_manifest(spark, rows):
    got = [tuple(r) for r in merkle.merkle_report(spark.createDataFrame(rows, DOCS)).collect()]
    assert sorted(got, key=key) == sorted(plain_manifest(rows), key=key)
    return got


def test_manifest_of_awkward_rows(spark):
    rows = [(i, f"Text {i}", "en", f"s{i % 3}", i) for i in range(40)]
    rows += [(None, None, None, None, None), (None, "", None, None, 0), (7, "again", "fr", "s1", 1), (7, "again", "fr", "s1", 1), (7, "Other", None, "s1", None)]
    rows += [(100, "alone", "de", "lone", 5), (101, "É x" * 200_000, "de", "ünï", 6), (5, "ABC", "en", "", 3), (-12, "neg", "en", "s2", 1)]
    got = check_manifest(spark, rows)
    assert 0 < sum(not r[-1] for r in got) < len(got)


@pytest.mark.parametrize("n", [1, 16, 17, 257])
def test_manifest_of_one_source(spark, n):
    check_manifest(spark, [(i, f"T{i}", "en", "s", 2) for i in range(n)])


def test_manifest_over_several_blocks_and_many_sources(spark):
    rows = [(i, f"T{i % 50}", "en", "hot", 2) for i in range(3 * merkle.BLOCK + 33)] + [(i, "t", "en", f"s{i % 300}", 1) for i in range(900)]
    rows += [(8, "T8", "en", "hot", 2)] * 200  # equal rows take a place each
    check_manifest(spark, rows)


def test_manifest_without_broadcasts(spark, monkeypatch):
    monkeypatch.setattr(merkle, "SMALL_ROWS", 0)
    check_manifest(spark, [(i, f"Text {i}", "en", f"s{i % 5}" if i % 7 else None, i) for i in range(300)])


def test_manifest_of_no_rows_and_of_clashing_columns(spark):
    empty = spark.createDataFrame([], DOCS)
    assert merkle.merkle_report(empty).collect() == []
    docs = spark.createDataFrame([(1, "A", "en", "s", 1), (2, "B", "en", "s", 1)], DOCS).withColumns({"_pos": F.lit(9), "leaf": F.lit("x"), "root": F.lit("y")})
    out = merkle.manifest(docs)
    assert out.columns == ["doc_id", "source", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"] and all(r.verified for r in out.collect())


def test_manifest_equals_its_sql(spark, tmp_path):
    rows = [(i, f"Text {i}", "en", f"s{i % 3}" if i % 10 else None, i) for i in range(700)] + [(None, "Null", "en", "s1", 1), (900, None, None, "s0", None)]
    docs = spark.createDataFrame(rows, DOCS)
    docs.coalesce(1).write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/d/*.parquet'")
    assert sorted(con.execute(merkle.MERKLE_SQL).fetchall(), key=key) == sorted(map(tuple, merkle.merkle_report(docs).collect()), key=key)


# op12


def talk(rng, lang, n):
    words = {"aa": ["bata", "kado", "lumi"], "bb": ["thrzk", "strp", "vlk"], "cc": ["éàü", "öñé", "üüa"]}[lang]
    return " ".join(rng.choice(words) for _ in range(n))


def test_network_learns_and_holds_out(spark):
    rng = random.Random(4)
    rows = [(i, talk(rng, lang := rng.choice(["aa", "bb", "cc"]), rng.randint(3, 200)), lang) for i in range(240)]
    rows += [(1000, None, "aa"), (1001, "", "bb"), (1002, "123 ...", "cc"), (None, talk(rng, "bb", 30), None), (3, talk(rng, "cc", 10), "cc"), (2000, talk(rng, "aa", 100_000), "aa")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language_cnn.language_report(docs).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    said = {(r.doc_id, r.lang_pred) for r in got}
    assert {(1000, "und"), (1001, "und"), (1002, "und"), (None, "bb"), (2000, "aa")} <= said
    lang = {r[0]: r[2] for r in rows[:240]}
    held = [r for r in got if r.held_out and r.doc_id in lang]
    assert len(held) > 40 and np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.97
    for r in got:
        assert r.held_out == (zlib.crc32(b"" if r.doc_id is None else str(r.doc_id).encode()) % 3 == 1)
    # held-out labels, sources and ids play no part
    changed = docs.withColumn("lang", F.when(language_cnn.held_out(), F.lit("zz")).otherwise(F.col("lang")))
    assert sorted(map(str, language_cnn.language_report(changed).collect())) == sorted(map(str, got))


def test_network_without_labels_rows_or_with_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "abc", None, 0.5)], "doc_id long, text string, lang string, score double")
    assert [tuple(r) for r in language_cnn.identify(docs, language_cnn.train(docs)).select("lang_pred", "score").collect()] == [("und", 0.0)]
    one = docs.withColumn("lang", F.lit("xx"))
    out = language_cnn.identify(one, language_cnn.train(one))
    assert out.columns == ["doc_id", "text", "lang", "lang_pred", "score"] and out.first()["lang_pred"] == "xx"
    assert language_cnn.language_report(docs.where("false")).collect() == []


def plain_forward(w, window):
    """One window, filter by filter and place by place."""
    e = [w["E"][b].astype(float) for b in window] + [np.zeros(language_cnn.EMBED)] * (language_cnn.WIDE - 1)
    h = []
    for width in language_cnn.WIDTHS:
        for f in range(language_cnn.FILTERS):
            best = max(sum(float(e[t + j] @ w[f"W{width}"][j, :, f]) for j in range(width)) for t in range(language_cnn.WINDOW))
            h.append(max(best + float(w[f"b{width}"][f]), 0))
    z = np.exp(np.array(h) @ w["o"] + w["c"])
    return z / z.sum()


def small_model(seed=1):
    w = language_cnn.fresh(["x", "y", "z"], seed)
    rng = np.random.default_rng(seed)
    return w | {k: (v + rng.normal(0, 0.2, v.shape)).astype(np.float64) for k, v in w.items() if k not in ("langs", "E")} | {"E": w["E"].astype(np.float64)}


def test_forward_pass_equals_plain_loops():
    w, texts = small_model(), ["hello", "añb " * 150, "", "x" * 256]
    got = language_cnn.judged(w, *utf8(pa.array(texts)))
    for text, p in zip(texts, got):
        raw = text.encode()
        parts = [raw[k : k + 256] for k in range(0, len(raw), 256)]
        want = sum((plain_forward(w, [*part, *[256] * (256 - len(part))]) * len(part) for part in parts), np.zeros(3)) / max(len(raw), 1)
        assert np.allclose(p, want, atol=1e-5)


def test_gradients_equal_differences(monkeypatch):
    monkeypatch.setattr(language_cnn, "answers", lambda w, x, f: wide_answers(w, x, f))
    w = small_model(2)
    x, _, _ = language_cnn.windows(*utf8(pa.array(["some text here", "andere worte " * 30, "zz"])))
    y = np.arange(len(x)) % 3
    g = language_cnn.gradients(w, x, y)

    def loss(w):
        p = language_cnn.softmax(w, language_cnn.features(w, language_cnn.answers(w, x, language_cnn._filters(w).astype(float)).max(1)))
        return -np.log(p[np.arange(len(x)), y]).mean()

    rng = np.random.default_rng(0)
    for k in (n for n in w if n != "langs"):
        for _ in range(6):
            at = tuple(rng.integers(0, s) for s in w[k].shape)
            if k == "E":
                at = (int(rng.choice(x[x < 256])), at[1])
            up, down = ({**w, k: w[k].copy()} for _ in range(2))
            up[k][at] += 1e-5
            down[k][at] -= 1e-5
            assert abs((loss(up) - loss(down)) / 2e-5 - g[k][at]) < 1e-3


def wide_answers(w, x, _):
    """As answers, in double precision."""
    e = np.zeros((len(x), 256 + language_cnn.WIDE - 1, language_cnn.EMBED))
    e[:, :256] = w["E"][x]
    out = [sum(e[:, j : j + 256] @ w[f"W{width}"][j] for j in range(width)) for width in language_cnn.WIDTHS]
    return np.concatenate(out, axis=2)


# op13


def plain_middle(doc_id, text):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(c in text for c in ("<P>", "<S>", "<M>")):
        return len(units), "plain", None, None, text
    if h[3] % 100 < 50:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def texts_of_middle():
    rng = random.Random(9)
    out = [None, "", "\n", "\n\n", "a", "a\n", "\na", "é" * 300 + "\n" + "ü\n" * 300, "<", "<<P", "a<P", "<P\n>", "<P>", "x\n<M>y", "<<S>", "< P>", "🎵\r\nx y\n", "a\x00\nb"]
    out += ["".join(rng.choice(["\n", "a", "<", "P", "S", "M", ">", "ß", "\n\n"]) for _ in range(rng.randint(1, 900))) for _ in range(60)]
    out += ["".join(rng.choice(["\n", "ab", "<", "P", "ß", " word"]) for _ in range(rng.randint(1, 3000))) for _ in range(60)]
    out += ["x" * 255 + "<" + "P" + ">", "y" * 254 + "<S>" + "\n" * 600, "z" * 256 + "\n", "z" * 255 + "\n" + "z" * 256]
    return out


@pytest.mark.parametrize("chunk", [fill_middle.CHUNK, 700])
def test_middle_equals_plain_version(spark, chunk):
    rows = [(i if i % 9 else None, t, i) for i, t in enumerate(texts_of_middle())]
    rows += rows[20:60] + [(5000 + i, rows[-1][1], 0) for i in range(50)]  # repeated rows, copies under other ids
    docs = spark.createDataFrame(rows, "doc_id long, text string, form int")
    out = fill_middle.fill_middle(docs, chunk=chunk)
    assert out.columns == ["doc_id", "text", "n_units", "form", "prefix_chars", "middle_chars", "output"]
    got = out.withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    assert len(got) == len(rows)
    want = sorted((str(r[0]), *map(str, plain_middle(r[0], r[1]))) for r in rows)
    assert sorted((str(r.doc_id), *map(str, (r.n_units, r.form, r.prefix_chars, r.middle_chars, r.output))) for r in got) == want
    assert all(r.back == (r.text or "") for r in got)


def test_functions_compose_over_any_split():
    rng = random.Random(3)
    for text in texts_of_middle()[1:]:
        raw = text.encode()
        cuts = sorted(rng.randint(0, len(raw)) for _ in range(3))
        parts = [raw[a:b] for a, b in zip([0, *cuts], [*cuts, len(raw)])]
        scan = fill_middle.Scan(*utf8(pa.array(parts, pa.binary())))
        state, lines = fill_middle.composed(scan.state[scan.last], scan.lines[scan.last], np.arange(len(parts)))
        assert lines[-1, 0] == len(re.findall(r"[^\n]*\n|[^\n]+", text))
        assert (state[-1, 0] >= fill_middle.FOUND) == any(c in text for c in ("<P>", "<S>", "<M>"))


def test_middle_of_one_giant_text_and_of_none(spark):
    text = "".join(f"line {i} é\n" for i in range(120_000)) + "end"
    docs = spark.createDataFrame([(i, text) for i in range(6)] + [(99, "short\ntext\n")], "doc_id long, text string")
    got = {r.doc_id: tuple(r)[2:] for r in fill_middle.fill_middle(docs).collect()}
    assert got == {i: plain_middle(i, t) for i, t in [*((i, text) for i in range(6)), (99, "short\ntext\n")]}
    assert fill_middle.fim_report(docs.where("false")).collect() == []


def test_middle_equals_its_sql(spark, tmp_path):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts_of_middle()) if not t or "\x00" not in t], "doc_id long, text string")
    docs.coalesce(1).write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/d/*.parquet'")
    assert sorted(map(str, con.execute(fill_middle.FIM_SQL).fetchall())) == sorted(str(tuple(r)) for r in fill_middle.fim_report(docs).collect())


def test_rate_keeps_texts_plain(spark):
    docs = spark.createDataFrame([(i, "a\nb\n") for i in range(200)], "doc_id long, text string")
    forms = [r.form for r in fill_middle.fill_middle(docs, rate=50, spm=0).collect()]
    assert set(forms) == {"plain", "psm"} and 60 < forms.count("plain") < 140
