"""URL filters: rules of hosts and paths first, boosted trees over lexical features for the rest.

The trees are Spark's own (GBTClassifier), fitted on labelled URLs; in the query those are the URLs that a
rule decides. Features are expressions over the URL alone, and statistics of its host's
suffixes over all URLs and over the labelled ones, kept in tables of a fixed number of
hash buckets.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: The contract's rules.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
#: Buckets of suffixes; folds of the labels, so that a training row's rates don't know its own label; weight of the overall rate in a suffix's rate; training rows; trees, their depth and rate.
BUCKETS, FOLDS, PRIOR, SAMPLE = 4096, 4, 20.0, 20_000
TREES, DEPTH, RATE = 20, 4, 0.2
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Host suffixes whose statistics are features: the last label, the last two, the whole host.
SUFFIXES = (1, 2, 99)
LEXICAL = [
    "length", "host_length", "path_length", "query_length", "longest_label", "labels", "depth", "parameters", "digits", "host_digits", "upper", "hyphens", "encoded", "entropy", "host_entropy", "fragment", "dotted_end",
]
FEATURES = [*LEXICAL, *(f"{what}_{n}" for n in SUFFIXES for what in ("common", "rate"))]


def host_of(url: Column) -> Column:
    """After the first :// up to a slash, question mark, hash or the end, A-Z lower-cased; else empty."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://([^/?#]*+)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to a question mark, hash or the end; else empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://[^/?#]*+([^?#]*+)", 1)


def ruled(host: Column, path: Column, rules=RULES) -> Column:
    """(rule, verdict) of the longest rule (host, then path) that fits, or null. A rule fits its host and all
    subdomains where the path starts with the rule's; of two equally long ones that with the longer
    host wins. Rules are part of the plan: some hundreds at most."""
    told = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), len(r[0]))):
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        told = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(told)
    return told


def entropy(text: Column) -> Column:
    """Bits a character; characters beyond ASCII count as one, so the alphabet is bounded."""
    plain = F.regexp_replace(text, r"[^\x00-\x7F]", "\u0080")

    def of(t: Column) -> Column:
        size = F.length(t)
        letters = F.array_distinct(F.split(t, ""))
        share = F.transform(letters, lambda c: (size - F.length(F.replace(t, c, F.lit("")))) / size)
        return F.aggregate(F.filter(share, lambda s: s > 0), F.lit(0.0), lambda a, s: a - s * F.log2(s))

    return F.when(F.length(text) > 0, F.get(F.transform(F.array(plain), of), F.lit(0))).otherwise(F.lit(0.0))


def lexical(urls: DataFrame) -> DataFrame:
    """urls (with _url, _host, _path and maybe more) with the lexical features, doubles."""
    url, host, path = F.col("_url"), F.col("_host"), F.col("_path")
    query = F.regexp_extract(url, r"(?s)\A[^?#]*+\?([^#]*+)", 1)
    size = F.greatest(F.length(url), F.lit(1))
    several = lambda t, pattern: F.regexp_count(t, F.lit(pattern))
    values = {
        "length": F.length(url), "host_length": F.length(host), "path_length": F.length(path), "query_length": F.length(query),
        "longest_label": F.coalesce(F.array_max(F.transform(F.split(host, r"\."), F.length)), F.lit(0)),
        "labels": several(host, r"[^.]++"), "depth": several(path, r"[^/]++"), "parameters": several(query, r"[^&]++"),
        "digits": several(url, "[0-9]") / size, "host_digits": several(host, "[0-9]"), "upper": several(url, "[A-Z]") / size, "hyphens": several(host, "-"), "encoded": several(url, "%[0-9A-Fa-f]{2}"),
        "entropy": entropy(url), "host_entropy": entropy(host), "fragment": F.contains(url, F.lit("#")).cast("int"), "dotted_end": path.rlike(r"\.[A-Za-z0-9]{1,5}\z").cast("int"),
    }
    return urls.select("*", *(values[name].cast("double").alias(name) for name in LEXICAL))


def buckets(host: Column, seed: int) -> Column:
    """Array of the buckets of the host's suffixes, one for each of SUFFIXES."""
    return F.array(*(F.pmod(F.xxhash64(F.lit(seed + n), F.substring_index(host, ".", -n)), F.lit(BUCKETS)).cast("int") + i * BUCKETS for i, n in enumerate(SUFFIXES)))


@dataclass
class UrlModel:
    """stats: (_bucket, common, rates), at most BUCKETS rows a suffix; rates leave out a fold each, the last
    none; trees: Spark's fitted model, or
    none where the labels are all alike (or none are there), which `verdict` then answers."""

    stats: DataFrame
    trees: Any
    verdict: str = "allow"


def _with_stats(urls: DataFrame, stats: DataFrame, fold: Column) -> DataFrame:
    """urls with the suffix features, rates without a fold: one join a suffix with a table of at most BUCKETS rows."""
    joined = urls.withColumns({"_at": buckets(F.col("_host"), 0), "_fold": fold})
    for i, s in enumerate(SUFFIXES):
        own = stats.where((F.col("_bucket") >= i * BUCKETS) & (F.col("_bucket") < (i + 1) * BUCKETS)).select(F.col("_bucket").alias(f"_b{s}"), F.col("common").alias(f"common_{s}"), F.col("rates").alias(f"_r{s}"))
        met = joined.withColumn(f"_b{s}", F.get("_at", F.lit(i))).join(F.broadcast(own), f"_b{s}", "left")
        joined = met.withColumn(f"rate_{s}", F.get(f"_r{s}", F.col("_fold"))).drop(f"_b{s}", f"_r{s}")
    return joined.drop("_at", "_fold").na.fill(0.0, [f"common_{s}" for s in SUFFIXES]).na.fill(0.5, [f"rate_{s}" for s in SUFFIXES])


def train(urls: DataFrame, labelled: DataFrame, sample: int = SAMPLE, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, seed: int = 7) -> UrlModel:
    """Fit on labelled URLs (_url, _host, _path, _label 1 for block). urls: all of them, for how common
    suffixes are.

    Statistics are over all rows; trees see at most `sample` distinct labelled URLs (a documented
    bound: those with the smallest hash), in one partition, so a rerun gives the same trees. The
    rate of a suffix is moved towards the overall one, as far as it has few labelled URLs; training
    rows have the rates of the other folds."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    bucket = F.explode(buckets(F.col("_host"), 0)).alias("_bucket")
    common_ = urls.select(bucket).groupBy("_bucket").agg(F.log2(F.count(F.lit(1)) + 1).alias("common"))
    known = common.stash(labelled.groupBy("_url", "_host", "_path").agg(F.max("_label").alias("_label")), "labelled")
    fold = F.pmod(F.xxhash64(F.lit("fold"), "_url"), F.lit(FOLDS)).cast("int")
    out = [F.col("_fold") != k for k in range(FOLDS)] + [F.lit(True)]
    counts = [f(F.when(o, x)).alias(f"{c}{k}") for k, o in enumerate(out) for c, f, x in (("y", F.sum, F.col("_label")), ("n", F.count, F.lit(1)))]
    per = known.select(bucket, "_label", fold.alias("_fold")).groupBy("_bucket").agg(*counts)
    sizes = known.agg(F.sum("_label").alias("y"), F.count(F.lit(1)).alias("n")).first()
    yes, n = sizes["y"] or 0, sizes["n"]
    overall = yes / n if n else 0.5
    rates = F.array(*((F.coalesce(f"y{k}", F.lit(0)) + PRIOR * overall) / (F.coalesce(f"n{k}", F.lit(0)) + PRIOR) for k in range(FOLDS + 1)))
    stats = common.stash(common_.join(per, "_bucket", "full").select("_bucket", F.coalesce("common", F.lit(0.0)).alias("common"), rates.alias("rates")), "suffixes")
    if yes in (0, n):
        return UrlModel(stats, None, "block" if yes else "allow")
    chosen = known.orderBy(F.xxhash64("_url"), "_url").limit(sample)
    rows = common.stash(_with_stats(lexical(chosen), stats, fold).select("_url", *FEATURES, F.col("_label").cast("double").alias("label")), "training")
    table = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows.coalesce(1).sortWithinPartitions("_url")).select("features", "label")
    fitted = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=rate, maxBins=32, seed=seed).fit(table)
    return UrlModel(stats, fitted)


def classify(urls: DataFrame, model: UrlModel) -> DataFrame:
    """urls (_url, _host, _path, more) with p_block, the trees' probability of block, by JVM code alone."""
    if model.trees is None:
        return urls.withColumn("p_block", F.lit(float(model.verdict == "block")))
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    ready = VectorAssembler(inputCols=FEATURES, outputCol="_features").transform(_with_stats(lexical(urls), model.stats, F.lit(FOLDS)))
    trees = model.trees.setFeaturesCol("_features").setProbabilityCol("_p").setRawPredictionCol("_raw").setPredictionCol("_prediction")
    return trees.transform(ready).withColumn("p_block", F.get(vector_to_array("_p"), F.lit(1))).drop("_features", "_p", "_raw", "_prediction", *FEATURES)


def split_url(pages: DataFrame, id_col: str, url_col: str) -> DataFrame:
    u = F.col(url_col)
    return pages.select(F.col(id_col).alias("_id"), F.coalesce(u, F.lit("")).alias("_url"), host_of(u).alias("_host"), path_of(u).alias("_path"))


def filter_urls(pages: DataFrame, labelled: DataFrame | None = None, rules=RULES, id_col: str = "page_id", url_col: str = "url", sample: int = SAMPLE) -> DataFrame:
    """Per row: id, host, path, rule string (null without one), verdict string (allow or block: the rule's,
    else the trees'), p_block double (null with a rule).

    labelled: (url, verdict) of other labelled URLs; without it, the URLs that a rule decides are the
    labelled ones. A null URL or one without :// has an empty host and path and no rule; very long
    ones are read whole; repeated rows and null ids give a row each and are alike, and count once
    as labels; of contrary labels of one URL block stands; other columns aren't read, whatever
    their names; without labels of both kinds the verdict is that of the one kind, or allow; an
    empty table gives none."""
    urls = split_url(pages, id_col, url_col).withColumn("_ruled", ruled(F.col("_host"), F.col("_path"), rules))
    if labelled is None:
        known = urls.where("_ruled IS NOT NULL").select("_url", "_host", "_path", (F.col("_ruled.verdict") == "block").cast("int").alias("_label"))
    else:
        known = labelled.where("url IS NOT NULL AND verdict IN ('allow', 'block')").select(F.col("url").alias("_url"), host_of(F.col("url")).alias("_host"), path_of(F.col("url")).alias("_path"), (F.col("verdict") == "block").cast("int").alias("_label"))
    model = train(urls, known, sample)
    open_ = classify(urls.where("_ruled IS NULL"), model).select("_id", "_host", "_path", F.lit(None).cast("string").alias("rule"), F.when(F.col("p_block") >= 0.5, "block").otherwise("allow").alias("verdict"), "p_block")
    done = urls.where("_ruled IS NOT NULL").select("_id", "_host", "_path", "_ruled.rule", "_ruled.verdict", F.lit(None).cast("double").alias("p_block"))
    return done.unionByName(open_).select(F.col("_id").alias(id_col), F.col("_host").alias("host"), F.col("_path").alias("path"), "rule", "verdict", "p_block")


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on all pages' URLs."""
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))
