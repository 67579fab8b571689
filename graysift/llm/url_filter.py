"""URL verdicts: rules first, gradient-boosted trees on lexical features for the rest."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graysift.llm.common import ascii_lower, materialize

#: (verdict, host and path). A host rule ends in "/".
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: Bound of the labelled sample that a fit reads.
MAX_LABELLED = 20_000
FEATURES = (
    "url_length", "host_length", "path_length", "host_labels", "depth", "digits", "entropy", "parameters", "hyphens", "fragment", "secure", "longest_part",
    "suffix_pages", "suffix_depth", "suffix_digits", "suffix_parameters",
)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    rest = F.when(F.locate("://", url) > 0, F.substring(url, F.locate("://", url) + 3, F.length(url)))
    host = F.coalesce(F.regexp_extract(rest, r"^[^/?#]*", 0), F.lit(""))
    path = F.coalesce(F.regexp_extract(F.regexp_replace(rest, r"^[^/?#]*", ""), r"^[^?#]*", 0), F.lit(""))
    return ascii_lower(host), path


def rule_column(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits the host (or a parent domain of it) and starts the path, else null."""
    found = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        domain, _, rest = rule.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith("/" + rest)
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def _entropy(text: Column) -> Column:
    n = F.length(text)
    share = lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n
    return F.aggregate(F.array_distinct(F.split(text, "")), F.lit(0.0), lambda a, c: a - F.when(c == "", 0.0).otherwise(share(c) * F.log2(share(c))))


def lexical(pages: DataFrame, rules=RULES) -> DataFrame:
    """pages with host, path, rule, rule_verdict, host_suffix and the features that need no corpus."""
    url = F.coalesce(F.col("url"), F.lit(""))
    host, path = split_url(F.col("url"))
    rows = pages.withColumn("host", host).withColumn("path", path).withColumn("rule", rule_column(F.col("host"), F.col("path"), rules))
    verdicts = reduce(lambda c, r: c.when(F.col("rule") == r[1], r[0]), rules[1:], F.when(F.col("rule") == rules[0][1], rules[0][0]))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    return rows.withColumns(
        {
            "rule_verdict": verdicts,
            "host_suffix": F.regexp_extract("host", r"[^.]*\.?[^.]*$", 0),
            "url_length": F.length(url).cast("double"),
            "host_length": F.length("host").cast("double"),
            "path_length": F.length("path").cast("double"),
            "host_labels": F.size(F.split("host", r"\.")).cast("double"),
            "depth": F.regexp_count("path", F.lit("/[^/]")).cast("double"),
            "digits": (F.regexp_count(url, F.lit("[0-9]")) / F.greatest(F.length(url), F.lit(1))).cast("double"),
            "entropy": F.when(F.length(url) > 0, _entropy(url)).otherwise(0.0),
            "parameters": F.regexp_count(query, F.lit("[^&]+")).cast("double"),
            "hyphens": F.regexp_count(url, F.lit("-")).cast("double"),
            "fragment": F.contains(url, F.lit("#")).cast("double"),
            "secure": F.startswith(F.lower(url), F.lit("https://")).cast("double"),
            "longest_part": F.array_max(F.transform(F.split("host", r"\."), lambda p: F.length(p))).cast("double"),
        }
    )


def suffix_statistics(rows: DataFrame) -> DataFrame:
    """For each host suffix: log of its pages, and the means of depth, digits and parameters of their urls. No verdict goes
    into them, so a suffix that no rule judges looks like those that the trees learn from."""
    means = [F.avg(c).alias(f"suffix_{c}") for c in ("depth", "digits", "parameters")]
    return rows.groupBy("host_suffix").agg(F.log1p(F.count(F.lit(1)).cast("double")).alias("suffix_pages"), *means)


def featured(pages: DataFrame, rules=RULES) -> DataFrame:
    """lexical(pages) with the suffix statistics and the vector of FEATURES.

    The statistics are written once (one row a suffix). Suffixes with over a thousandth of all rows, a thousand at most,
    are broadcast; the rows of the others are joined.
    """
    rows = lexical(pages, rules)
    held = materialize(suffix_statistics(rows), "url-suffixes")
    total = held.agg(F.sum(F.expm1("suffix_pages"))).first()[0] or 0
    is_large = F.expm1("suffix_pages") * 1000 > total
    large = F.broadcast(held.filter(is_large))
    hot = rows.join(large, "host_suffix")
    rest = rows.join(large.select("host_suffix"), "host_suffix", "left_anti").join(held.filter(~is_large), "host_suffix")
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(hot.unionByName(rest))


def train(rows: DataFrame, max_labelled: int = MAX_LABELLED, trees: int = 12, depth: int = 4, seed: int = 11) -> GBTClassificationModel | None:
    """Trees on at most ``max_labelled`` different urls with a rule's verdict, the first by hash of the url, weighed
    by their rows; None if the urls have fewer than two verdicts. rows: from featured()."""
    label = F.max(F.when(F.col("rule_verdict") == "block", 1.0).otherwise(0.0)).alias("label")
    sample = rows.filter("rule_verdict is not null").groupBy("url").agg(label, F.count(F.lit(1)).cast("double").alias("weight"), *[F.max(f).alias(f) for f in FEATURES])
    sample = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(sample).select("url", "label", "weight", "features")
    sample = materialize(sample.orderBy(F.xxhash64("url"), "url").limit(max_labelled), "url-sample")
    if sample.select("label").distinct().count() < 2:
        return None
    return GBTClassifier(maxIter=trees, maxDepth=depth, seed=seed, weightCol="weight").fit(sample)


def held_out(rows: DataFrame, folds: int = 5, **options) -> DataFrame:
    """What the trees say of labelled rows whose host suffix they did not learn from: label, block_score. One fit for each
    fold of suffixes; rows: from featured()."""
    fold = F.pmod(F.xxhash64("host_suffix"), F.lit(folds))
    label = F.when(F.col("rule_verdict") == "block", 1.0).otherwise(0.0).alias("label")
    judged, found = rows.filter("rule_verdict is not null"), []
    for k in range(folds):
        model = train(judged.filter(fold != k), **options)
        if model is not None:
            found.append(model.transform(judged.filter(fold == k)).select(label, vector_to_array("probability")[1].alias("block_score")))
    return reduce(DataFrame.union, found, rows.sparkSession.createDataFrame([], "label double, block_score double"))


def auc(scored: DataFrame) -> float | None:
    """The chance that a blocked url has a higher block_score than an allowed one, ties half; None without both. Scores are
    counted to three digits, so at most 1001 rows go to the driver."""
    counts = scored.groupBy(F.round("block_score", 3).alias("s")).agg(F.count_if(F.col("label") == 1).alias("b"), F.count_if(F.col("label") == 0).alias("a")).collect()
    below, wins = 0, 0.0
    for _, b, a in sorted(counts):
        wins += b * (below + a / 2)
        below += a
    blocked = sum(b for _, b, _ in counts)
    return wins / (blocked * below) if blocked and below else None


def trusted(rows: DataFrame, max_labelled: int = MAX_LABELLED, folds: int = 3, least: float = 0.5) -> bool:
    """Whether the trees tell urls apart on host suffixes that they did not learn from: the area under their curve is above
    least. Judged on the sample that they learn from (different urls, at most max_labelled); without two folds that
    hold both verdicts there is nothing to trust. rows: from featured()."""
    kinds = [F.first(c).alias(c) for c in ("rule_verdict", "host_suffix")]
    sample = rows.filter("rule_verdict is not null").groupBy("url").agg(*kinds, *[F.max(f).alias(f) for f in FEATURES])
    sample = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(sample)
    sample = materialize(sample.orderBy(F.xxhash64("url"), "url").limit(max_labelled), "url-folds")
    found = auc(held_out(sample, folds))
    return found is not None and found > least


def url_rules(pages: DataFrame, rules=RULES) -> DataFrame:
    """pages with host, path, rule and rule_verdict: what the rules alone say."""
    new = ["host", "path", "rule", "rule_verdict"]
    names = [c for c in pages.columns if c not in new]
    return lexical(pages.select(names), rules).select(*names, *new)


def url_verdicts(pages: DataFrame, rules=RULES, max_labelled: int = MAX_LABELLED, block_at: float = 0.5, always: bool = False) -> DataFrame:
    """pages with host, path, rule, verdict, block_score and verdict_by (rule, model or default).

    Rules label the urls they fit; the trees learn from these and judge the others, if they are trusted(): where they do no
    better than chance on host suffixes that were held out, what no rule fits is allowed by default, and block_score
    is there to look at. Null urls and urls
    without ``://`` have an empty host and path, fit no rule and are judged by the trees like others. Without
    two verdicts to learn from, urls that fit no rule are allowed. Rows that repeat a url get the same
    verdict. Very long urls are judged whole. Result columns replace columns of the same name, other columns pass
    through. An empty table gives an empty table. always: take the trees' word without that test.
    """
    new = ["host", "path", "rule", "verdict", "block_score", "verdict_by"]
    names = [c for c in pages.columns if c not in new]
    inner = {c: f"__{k}" for k, c in enumerate(names) if c != "url"}
    rows = featured(pages.select(names).withColumnsRenamed(inner), rules)
    model = train(rows, max_labelled)
    trust = model is not None and (always or trusted(rows, max_labelled))
    if model is None:
        scored = rows.withColumn("block_score", F.lit(0.0))
    else:
        scored = model.transform(rows).withColumn("block_score", vector_to_array("probability")[1])
    verdict = F.coalesce(F.col("rule_verdict"), F.when((F.col("block_score") >= block_at) & F.lit(trust), "block").otherwise("allow"))
    by = F.when(F.col("rule").isNotNull(), "rule").otherwise("model" if trust else "default")
    return scored.select(*[F.col(inner.get(c, c)).alias(c) for c in names], "host", "path", "rule", verdict.alias("verdict"), "block_score", by.alias("verdict_by"))
