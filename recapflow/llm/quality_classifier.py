"""Quality by a document classifier and the sites documents come from, joined by hierarchical empirical Bayes.

A logistic regression on text features gives each document its own evidence. Hosts and the paths below them get
posterior quality rates by grouped sums of that evidence: a path is shrunk towards its host, a host towards the whole
corpus, each with the strength that the spread between sites shows (method of moments), so sparse sites say little.
A document's probability is its evidence with the corpus rate replaced by the rate of its path without itself.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recapflow.llm import common, quality_rules

#: The regression is fitted on at most this many labelled documents, those of smallest id hash. Everything else,
#: including all site statistics, covers all documents.
MAX_LABELS = 50_000
KEEP_AT = 0.5
_EDGE = 1e-4


def _measures() -> dict[str, Column]:
    share = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    capped = lambda c, top: F.least(c, F.lit(top))
    return {
        "length": capped(F.log1p(F.col("n_words").cast("double")), 6.0),
        "short": F.when(F.col("n_words") < quality_rules.MIN_WORDS, 1.0).otherwise(0.0),
        "symbols": capped(share("n_symbols", "n_words"), 1.0),
        "punctuation": capped(share("__n_punct", "word_chars"), 0.5),
        "dup_lines": share("n_dup_lines", "__n_lines"),
        "repeats": share("n_repeat_words", "n_words"),
        "word_length": capped(F.abs(share("word_chars", "n_words") - 6.0), 6.0),
        "odd_words": share("__n_odd", "n_words"),
    }


def _logit(p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(_EDGE)), F.lit(1 - _EDGE))
    return F.log(q / (1 - q))


def _fit(measured: DataFrame, labels: DataFrame, id: str, label: str) -> tuple[Column, float]:
    """Log-odds of good quality as a column of the measures, and the smoothed share of good labels. Without labels of
    both kinds the evidence is the same for all documents."""
    truth = labels.where(F.col(label).isNotNull() & F.col(id).isNotNull()).groupBy(F.col(id).alias("id")).agg(F.avg(F.col(label).cast("double")).alias("y"))
    chosen = truth.orderBy(F.xxhash64("id"), "id").limit(MAX_LABELS)
    sample = common.settled(measured.join(F.broadcast(chosen), "id").withColumn("label", F.when(F.col("y") >= 0.5, 1.0).otherwise(0.0)))  # at most MAX_LABELS rows
    good, rows = sample.agg(F.coalesce(F.sum("label"), F.lit(0.0)), F.count("*")).first()
    share = (good + 1) / (rows + 2)
    if good in (0, rows):
        return _logit(F.lit(share)), share
    names = list(_measures())
    model = LogisticRegression(maxIter=50, regParam=1e-4).fit(VectorAssembler(inputCols=names, outputCol="features").transform(sample))
    odds = F.lit(float(model.intercept))
    for name, weight in zip(names, model.coefficients.toArray().tolist(), strict=True):
        odds = odds + F.lit(float(weight)) * F.col(name)
    return odds, share


def _strength(sites: DataFrame) -> float:
    """Pseudo-count of the prior, from sites (n, total, mean of the level above): with a spread between sites of tau^2
    beyond what their sizes explain, m (1 - m) / tau^2 - 1. One site, or no such spread, gives full shrinkage."""
    noise = F.col("up") * (1 - F.col("up"))
    x = sites.where("n > 0").agg(
        F.sum(F.col("n") * F.pow(F.col("total") / F.col("n") - F.col("up"), 2) - noise).alias("excess"), F.sum("n").alias("n"),
        F.sum(F.col("n") * noise).alias("noise"),
    ).first()
    if not x["n"] or not x["noise"] or x["excess"] is None or x["excess"] <= 0:
        return 1e6
    return min(1e6, max(1.0, x["noise"] / x["excess"] - 1))


def score(
    docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", host: str = "source", path: str = "lang", label: str = "quality",
) -> DataFrame:
    """One row per document: id, p_document (the text alone), p_site (its path without itself), p_quality and kept.

    ``labels`` holds id and a 0/1 label; NULL labels and labels of unknown ids are ignored, repeated ones averaged.
    NULL hosts and paths are sites of their own. NULL and empty texts are judged by their features like others. Rows
    that repeat an id are scored each. An empty table gives an empty table."""
    keep = [F.col(id).alias("id"), F.col(host).alias("host"), F.col(path).alias("path")]
    measured = common.settled(quality_rules.features(docs, keep, text).select("id", "host", "path", *[m.alias(n) for n, m in _measures().items()]))
    odds, share = _fit(measured, labels, id, label)
    own = measured.select("id", "host", "path", odds.alias("odds"))
    own = common.settled(own.withColumn("p", 1 / (1 + F.exp(-F.greatest(F.least("odds", F.lit(30.0)), F.lit(-30.0))))))
    paths = common.settled(own.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("total")))
    hosts = common.settled(paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("total").alias("total")))
    n, total = hosts.agg(F.sum("n"), F.sum("total")).first()
    base = (total or 0.0) / n if n else share
    pull = _strength(hosts.withColumn("up", F.lit(base)))
    rated = hosts.select("host", F.col("n").alias("host_n"), F.col("total").alias("host_total"), ((F.col("total") + pull * base) / (F.col("n") + pull)).alias("up"))
    same_host = paths["host"].eqNullSafe(rated["host"])
    sites = common.settled(paths.join(rated, same_host).select(paths["host"], "path", "n", "total", "host_n", "host_total", "up"))
    path_pull = _strength(sites)
    met = common.join_small(own, sites, ["host", "path"], sites.count(), F.xxhash64("id"))
    p = F.col("p")
    host_rate = (F.col("host_total") - p + pull * base) / (F.col("host_n") - 1 + pull)
    site = (F.col("total") - p + path_pull * host_rate) / (F.col("n") - 1 + path_pull)
    final = 1 / (1 + F.exp(-(_logit(p) + _logit(site) - _logit(F.lit(base)))))
    out = met.select(F.col("id").alias(id), F.round(p, 6).alias("p_document"), F.round(site, 6).alias("p_site"), final.alias("x"))
    return out.select(id, "p_document", "p_site", F.round("x", 6).alias("p_quality"), (F.col("x") >= KEEP_AT).alias("kept"))
