"""URL filter by rules and by the ratio of two character language models, with DataFrame functions only.

Rules (host and its subdomains, path prefix; the longest wins) give verdicts and, through them, the accepted and
rejected URLs that train two smoothed variable-order Markov models. A URL without a rule is judged by the difference of
log-likelihoods per character against a threshold. Of the labelled URLs, one in CALIBRATE (by hash) trains no model but
sets the threshold: the one with the least error on them, the mean of the shares of accepted and rejected URLs it gets wrong.
Where these lack a kind, all labelled URLs do, and without URLs of both kinds the threshold is 0. Null URLs and those without
:// have empty host and path and score 0. A URL (host and path) is scored once, however many rows have it, and counts in
training as often as it stands; keys, null or repeated, play no part. URLs of any length are scored whole, a row for each
character; an empty table gives no rows; other columns of the table, whatever their names, are not looked at.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, join_counted

RULES = (
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
)
ORDER = 4  # characters of context at most
BETA = 2.0  # weight of the shorter context
CALIBRATE = 5
STEP = 0.005  # of the thresholds that are compared
ALPHABET = 70.0
SMALL_GRAMS = 200_000  # grams that may be broadcast; short strings and two numbers each


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def with_rule(df: DataFrame, rules=RULES) -> DataFrame:
    """Adds rule and ruled (its verdict) from columns host and path; the longest fitting rule wins."""
    rule, said = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, verdict in sorted(rules, key=lambda r: len(r[0])):  # the last that fits is the longest
        domain, slash, rest = text.partition("/")
        fits = ((F.col("host") == domain) | F.col("host").endswith("." + domain)) & F.col("path").startswith(slash + rest)
        rule, said = F.when(fits, text).otherwise(rule), F.when(fits, verdict).otherwise(said)
    return df.withColumn("rule", rule).withColumn("ruled", said)


def _grams(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row per character of column url: the longest gram (context and character) that ends there."""
    text = F.concat(F.lit("^" * ORDER), F.regexp_replace(F.lower("url"), r"[^a-z0-9\-._~/%+=&:@!,;()]", "?"), F.lit("$"))
    rows = df.select(*keys, text.alias("_t"))
    at = F.explode(F.sequence(F.lit(1), F.length("_t") - ORDER))
    return rows.select(*keys, "_t", at.alias("_at")).select(*keys, F.expr(f"substring(_t, _at, {ORDER + 1})").alias("gram"))


def models(labelled: DataFrame) -> DataFrame:
    """gram, ratio: log P(last character | context) accepted less rejected, for every seen gram of every order.

    labelled has url, how often it is accepted (a) and how often rejected (b).
    """
    top = _grams(labelled, ["a", "b"]).groupBy("gram").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    top = cut(top)
    made, shorter = [], None
    for k in range(ORDER + 1):
        grams = top.groupBy(F.expr(f"right(gram, {k + 1})").alias("gram")).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
        context = F.expr(f"left(gram, {k})")
        totals = grams.groupBy(context.alias("ctx")).agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))
        rows = grams.withColumn("ctx", context).join(totals, "ctx")
        if shorter is None:
            pa = pb = F.lit(1.0 / ALPHABET)
        else:
            rows = rows.withColumn("low", F.expr(f"right(gram, {k})")).join(
                shorter.select(F.col("gram").alias("low"), F.col("pa").alias("qa"), F.col("pb").alias("qb")), "low"
            )
            pa, pb = F.col("qa"), F.col("qb")
        rows = rows.select(
            "gram", "a", "b", ((F.col("a") + BETA * pa) / (F.col("ta") + BETA)).alias("pa"), ((F.col("b") + BETA * pb) / (F.col("tb") + BETA)).alias("pb")
        )
        shorter = cut(rows)
        made.append(shorter)
    return reduce(DataFrame.unionByName, made).select("gram", F.log(F.col("pa") / F.col("pb")).alias("ratio"))


def scored(rows: DataFrame, model: DataFrame, keys: list[str]) -> DataFrame:
    """keys and score: the mean ratio per character, each by its longest gram that the model has.

    Distinct grams find their ratio once; where those are too many to broadcast, heavy grams are still few and cheap.
    """
    grams = _grams(rows, keys)
    distinct = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    hits = [distinct]
    for k in range(ORDER + 1):
        part = model.where(F.length("gram") == k + 1).select(F.col("gram").alias(f"_g{k}"), F.col("ratio").alias(f"_r{k}"))
        hits.append(part)
    few = lambda k: F.broadcast(hits[k + 1]) if k <= 1 else hits[k + 1]  # noqa: E731  the alphabet's size, and its square
    found = reduce(lambda d, k: d.join(few(k), F.expr(f"right(gram, {k + 1})") == F.col(f"_g{k}"), "left"), range(ORDER + 1), distinct)
    best = F.coalesce(*[F.col(f"_r{k}") for k in range(ORDER, -1, -1)], F.lit(0.0))
    found = cut(found.select("gram", best.alias("ratio"), "n"))
    if found.count() <= SMALL_GRAMS:
        rows = grams.join(F.broadcast(found), "gram")
    else:
        rows = join_counted(grams, found, "gram", "n")  # a gram in every URL is no hot key
    return rows.groupBy(*keys).agg(F.avg("ratio").alias("score"))


def calibrated(labelled: DataFrame):
    """One row: threshold and error (null without URLs of both kinds). labelled: score, how often accepted (a) and rejected (b).

    Scores fall into bins of STEP, so few rows are compared, whatever the input. Of thresholds that are as good the middle counts.
    """
    bins = labelled.groupBy(F.floor(F.col("score") / STEP).alias("_bin")).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    bins = bins.unionByName(bins.select((F.min("_bin") - 1).alias("_bin"), F.lit(0).alias("a"), F.lit(0).alias("b")).where("_bin IS NOT NULL"))
    upto = Window.orderBy("_bin")  # as many rows as bins
    whole = Window.partitionBy(F.lit(1))
    wrong = bins.select("_bin", F.sum("a").over(upto).alias("_lost"), F.sum("b").over(upto).alias("_caught"), F.sum("a").over(whole).alias("_a"), F.sum("b").over(whole).alias("_b"), F.lead("_bin").over(upto).alias("_next"))
    error = (F.col("_lost") / F.nullif("_a", F.lit(0)) + (F.col("_b") - F.col("_caught")) / F.nullif("_b", F.lit(0))) / 2
    wrong = wrong.select(((F.col("_bin") + 1) * STEP).alias("_t"), (F.coalesce("_next", F.col("_bin") + 1) * STEP).alias("_to"), error.alias("error")).where("error IS NOT NULL")
    best = wrong.withColumn("_least", F.min("error").over(whole)).where("error = _least")
    return best.agg(((F.min("_t") + F.max("_to")) / 2).alias("threshold"), F.min("error").alias("error")).first()


def judge_urls(pages: DataFrame, rules=RULES, url: str = "url", key: str = "page_id") -> DataFrame:
    """key, host, path, rule, verdict, score for every row."""
    rows = with_rule(pages.select(F.col(key), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path")), rules)
    rows = rows.withColumn("url", F.concat("host", "path"))  # hosts have no slash, so host and path are told apart
    urls = rows.groupBy("url").agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.col("ruled") == "allow").alias("a"), F.count_if(F.col("ruled") == "block").alias("b"))
    urls = cut(urls.withColumn("held", F.pmod(F.xxhash64("url"), F.lit(CALIBRATE)) == 0))
    labelled = urls.where("a + b > 0")
    model = cut(models(labelled.where("NOT held")))
    score = cut(scored(urls.where("url <> ''").select("url"), model, ["url"]))
    urls = cut(urls.join(score, "url", "left").withColumn("score", F.coalesce("score", F.lit(0.0))))

    labelled = urls.where("a + b > 0")
    at = calibrated(labelled.where("held"))
    if at["threshold"] is None:
        at = calibrated(labelled)
    threshold = at["threshold"] or 0.0
    out = join_counted(rows, urls.select("url", "score", "_n"), "url", "_n")
    verdict = F.coalesce("ruled", F.when(F.col("score") >= threshold, "allow").otherwise("block"))
    return out.select(key, "host", "path", "rule", verdict.alias("verdict"), "score")
