"""Mixing sources to target weights by Poisson replication, with DataFrame functions only.

A source with share n_s of the documents and target weight w_s gets the mean repetition rate w_s * N / n_s. Each
document's uniform number comes from a hash of its id and the seed, and is inverted through the Poisson distribution;
the document is exploded by the count and all copies are dealt globally by a hash of id and copy: the hash is uniform, so its
first digits name the partition and nothing is sampled. A null source is a source of its own; empty tables give empty
results; rows that repeat an id repeat its draw, and rows without an id draw by their whole contents. Columns in the way
of the helper columns keep their values: helpers start with `_mx_`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SMALL_ROWS, join_groups

TWO52 = float(1 << 52)
SMALL_CELLS = 2_000_000  # numbers that the table of all sources' distributions may have to be broadcast


def uniform(key: Column, seed: int) -> Column:
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key)), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(TWO52)


def rates(docs: DataFrame, source: str = "source", weights: dict[str, float] | None = None, power: float = 0.5) -> DataFrame:
    """Mean repetition rate per source; without weights they go by n_s ** power."""
    n = docs.groupBy(F.col(source).alias("_mx_source")).agg(F.count(F.lit(1)).cast("double").alias("_mx_n"))
    if weights is None:
        weight = F.pow("_mx_n", F.lit(float(power)))
    else:
        weight = F.lit(0.0)
        for name, value in weights.items():
            weight = F.when(F.col("_mx_source") == name, float(value)).otherwise(weight)
    n = n.withColumn("_mx_w", weight)
    all_ = n.agg(F.sum("_mx_n").alias("_mx_all"), F.sum("_mx_w").alias("_mx_sum"))
    return n.join(F.broadcast(all_), how="cross").select(  # one row of totals
        "_mx_source", (F.col("_mx_w") / F.col("_mx_sum") * F.col("_mx_all") / F.col("_mx_n")).alias("_mx_rate")
    )


def poisson_cdf(rate: Column) -> Column:
    """P(X <= k) for k = 0 up to where the tail is below the resolution of the hash."""
    top = F.ceil(rate + 12 * F.sqrt(rate) + 40).cast("int")
    start = F.struct(F.lit(0.0).cast("double").alias("l"), F.array().cast("array<double>").alias("c"), F.lit(0.0).alias("s"))

    def step(acc: Column, k: Column) -> Column:
        logp = F.when(k == 0, -rate).otherwise(acc["l"] + F.log(rate) - F.log(k.cast("double")))
        total = acc["s"] + F.exp(logp)
        return F.struct(logp.alias("l"), F.concat(acc["c"], F.array(total)).alias("c"), total.alias("s"))

    return F.when(rate > 0, F.aggregate(F.sequence(F.lit(0), top), start, step, lambda a: a["c"])).otherwise(F.array(F.lit(1.0)))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, power: float = 0.5, seed: int = 42, source: str = "source", key: str = "doc_id", keep: bool = False) -> DataFrame:
    """Documents repeated to the target weights, in global hash order; with keep, columns copy, rate and shuffle_key."""
    rate = rates(docs, source, weights, power)
    cdf = rate.withColumn("_mx_cdf", poisson_cdf(F.col("_mx_rate")))
    cells = rate.agg(F.sum(F.col("_mx_rate") + 12 * F.sqrt("_mx_rate") + 40)).first()[0] or 0
    rows = join_groups(docs.withColumn("_mx_source", F.col(source)), cdf, ["_mx_source"], most=SMALL_ROWS if cells <= SMALL_CELLS else 0)
    name = F.coalesce(F.col(key).cast("string"), F.concat(F.lit("row/"), F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns]))))
    rows = rows.withColumn("_mx_u", uniform(name, seed))
    rows = rows.withColumn("_mx_k", F.size(F.filter("_mx_cdf", lambda c: c < F.col("_mx_u")))).where("_mx_k > 0")
    rows = rows.withColumn("_mx_copy", F.explode(F.sequence(F.lit(0), F.col("_mx_k") - 1)))
    rows = rows.withColumn("_mx_key", F.md5(F.concat(F.lit(f"{seed}/"), name, F.lit("/"), F.col("_mx_copy").cast("string"))))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = F.floor(F.conv(F.substring("_mx_key", 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32)) * parts).cast("int")
    rows = rows.repartitionById(parts, place).sortWithinPartitions("_mx_key")
    extra = [F.col("_mx_copy").alias("copy"), F.col("_mx_key").alias("shuffle_key")] if keep else []
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns], *extra)


MIX_SQL = """
WITH n AS (SELECT source, count(*)::DOUBLE AS n FROM documents GROUP BY source),
r AS (SELECT source, pow(n, 0.5) / sum(pow(n, 0.5)) OVER () * sum(n) OVER () / n AS rate FROM n),
p AS (SELECT source, k, sum(exp(-rate + k * ln(rate) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS c
      FROM (SELECT *, unnest(range(0, ceil(rate + 12 * sqrt(rate) + 40)::BIGINT + 1))::DOUBLE AS k FROM r)),
u AS (SELECT *, (('0x' || substr(md5('42:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT + 0.5) / 4503599627370496.0 AS u FROM documents),
k AS (SELECT u.doc_id, u.text, u.lang, u.source, u.n_chars, (SELECT count(*) FROM p WHERE p.source IS NOT DISTINCT FROM u.source AND p.c < u.u) AS k FROM u)
SELECT doc_id, text, lang, source, n_chars, copy::INTEGER AS copy,
       md5('42/' || coalesce(doc_id::VARCHAR, '') || '/' || copy::VARCHAR) AS shuffle_key
FROM (SELECT *, unnest(range(0, k)) AS copy FROM k WHERE k > 0)
"""
