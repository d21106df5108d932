import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from quillon.llm import packing, quality_classifier

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_near_copies_at_five_words_and_0_8(spark):
    """One changed word of 50: 41 of 51 five-word shingles are shared (0.804), but 43 of 51 four-word ones (0.843 < 0.85)."""
    words = [f"w{i}" for i in range(50)]
    near = [*words[:25], "other", *words[26:]]
    rows = [(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(words[::-1]))]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], SCHEMA)
    assert {r.doc_id for r in corpus_pipeline.one_of_each_group(spark, docs, "").collect()} == {1, 3}


def test_one_row_of_each_group_whatever_the_ids(spark):
    words = lambda c: " ".join(f"{c}{i}" for i in range(60))
    a, c, d, e = map(words, "acde")
    rows = [(5, a), (None, a + " x"), (None, c), (None, c + " y"), (7, a), (7, d), (9, d + " e"), (None, e), (None, e), (3, ""), (None, ""), (None, None), (4, None)]
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in rows], SCHEMA)
    got = [(r.doc_id, r.text) for r in corpus_pipeline.one_of_each_group(spark, docs, "").collect()]
    (kept_c,) = [t for _, t in got if t and t.startswith("c0 ")]
    assert kept_c in (c, c + " y")
    assert sorted(map(str, got)) == sorted(map(str, [(5, a), (None, kept_c), (7, d), (None, e), (3, ""), (None, ""), (None, None), (4, None)]))


def test_pipeline_of_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_rows_get_their_own_verdicts(spark):
    """Rows that share an id, or have none, are kept or dropped each for itself."""
    good = [" ".join(f"word{(i * 7 + k * k) % 97}" for k in range(60)) for i in range(40)]
    rows = [(i, t, "en", "a", 1) for i, t in enumerate(good)] + [(0, "short", "en", "a", 1), (None, good[3] + " x", "en", "a", 1), (None, "too short", "en", "a", 1), (None, None, None, None, None)]
    got = [(r.doc_id, r.text) for r in corpus_pipeline.keep_by_rules(spark, spark.createDataFrame(rows, SCHEMA), "").collect()]
    assert sorted(t for _, t in got) == sorted([*good, good[3] + " x"])


def test_stages_against_a_plain_version(spark, tmp_path):
    """The whole pipeline on a small table: what each stage keeps, from its own input."""
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(300)]
    text = lambda: " ".join(rng.choice(words, int(rng.integers(40, 90))))
    rows = [(i, text(), "en", "ab"[i % 2], 1) for i in range(120)]
    rows += [(200 + i, "".join(map(chr, rng.integers(33, 64, 200))), "en", "a", 1) for i in range(60)]  # junk
    rows += [(300 + i, rows[i][1] + " end", "en", "b", 1) for i in range(20)]
    rows += [(500, None, None, None, None), (501, "", "en", "a", 0), (None, text(), "en", None, 1), (7, rows[7][1], "en", "b", 1)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("extra", F.lit(1))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i < 200)) for i, *_ in rows if i is not None and i < 300], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    at, d, seen = docs, str(tmp_path), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, at, d).write.parquet(str(tmp_path / f"s{k}"))
        at = spark.read.parquet(str(tmp_path / f"s{k}"))
        seen.append(at)
    kept = {(r.doc_id, r.text) for r in seen[0].collect()}
    model = quality_classifier.train(docs, spark.read.parquet(f"{d}/labels.parquet"))
    assert kept == {(r[0], r[1]) for r in rows if quality_classifier._forward(model, quality_classifier.passages(r[1]))[-1][0] >= 0.7}
    ruled = {(r.doc_id, r.text) for r in seen[1].collect()}
    assert ruled <= kept and {i for i, _ in kept if i is not None and i < 120} <= {i for i, _ in ruled}
    single = [(r.doc_id, r.text) for r in seen[2].collect()]
    assert len(single) == len(set(single)) and {i for i, _ in ruled} - {i for i, _ in single} == {300 + i for i in range(20)} & {i for i, _ in ruled}
    assert {(r.doc_id, r.text) for r in seen[3].collect()} <= set(single) and all(x.columns == corpus_pipeline.COLUMNS for x in seen[:4])
    pieces = seen[4].collect()
    assert len(pieces) == seen[3].count() and max(r.offset + r.length for r in pieces) <= packing.LENGTH
    assert corpus_pipeline.run(spark, d).count() == len(pieces)
