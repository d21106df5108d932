"""The corpus pipeline: classifier, quality rules, near duplicates, mixing, packing.

Each stage reads what its predecessor kept and wrote. Null texts count as empty; the stages keep the columns of documents
until the last, which returns packed pieces. Texts of any length go through whole; empty tables give empty stages, and
without labels every score is one half, so nothing passes. SQL can express the mixing alone, so there is none for the whole.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import shared_folder, table
from quillon.llm.mixing import mix
from quillon.llm.ngram_join import near_groups
from quillon.llm.packing import pack
from quillon.llm.quality_classifier import score, train
from quillon.llm.quality_rules import judge
from quillon.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 0.7 or more; it is fitted on the labelled rows among docs, outside the held-out fold."""
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs.select(*COLUMNS), model, out="_score").where("_score >= 0.7").select(*COLUMNS)


def keep_by_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep. A verdict depends on text, language and source, so rows are matched on these (the text by
    hash) as well as on the id: rows of one id, or without an id, get their own verdicts."""
    keys = ["doc_id", "_mark", "lang", "source"]
    docs = docs.select(*COLUMNS).withColumn("_mark", F.xxhash64("text"))
    kept = judge(docs.select("text", *keys)).where("kept").select(*[F.col(k).alias(f"_k{k}") for k in keys]).distinct()
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k{k}"))
    return docs.join(kept, same, "left_semi").select(*COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, 0.8) stays: the one with the smallest id, those without an id last,
    of one id the one whose text has the smallest hash, and of equal rows one. Groups are told by id and text, not by the id alone."""
    digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    docs = docs.select(*COLUMNS, F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), digest.alias("digest"), F.col("text").isNull().alias("null")).alias("_key"))
    groups = near_groups(docs.select("_key", "text"), key="_key", n=5, percent=80)
    same = lambda c: F.sha2(F.to_json(c).cast("binary"), 256)
    first = groups.where("_key <=> component_id").select(same(F.col("_key")).alias("_row")).distinct()
    return docs.withColumn("_row", same(F.col("_key"))).join(first, "_row", "left_semi").dropDuplicates(["_row"]).select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated towards equal roots of their sources' counts, in global hash order."""
    return mix(docs.select(*COLUMNS)).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences."""
    return pack(docs.select("doc_id", "text"), tokenizer_path())


STAGES = [
    ("quality classifier", keep_quality),
    ("quality rules", keep_by_rules),
    ("n-gram Jaccard join", one_of_each_group),
    ("mixing sources to target weights", mixed),
    ("best-fit packing", packed),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages one after the other; a stage's folder goes when the next one is written."""
    base = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, last = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        path = f"{base}/stage{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last:
            folder = spark._jvm.org.apache.hadoop.fs.Path(last)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
        last = path
    return docs
