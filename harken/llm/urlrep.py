"""URL filters (operator 10): rules first, then an empirical-Bayes reputation of the host.

Labelled pages are counted by host, registered domain and public suffix. From the suffix down, each level's bad rate is
shrunk towards its parent's posterior mean by a beta-binomial prior whose strength is fitted to that level (method of
moments over the level's own counts). A host without labels is a new draw from its level's prior around its domain's, else its
suffix's, else the whole corpus's posterior: it takes their mean, and the variance of both. A page whose host's bad rate lies above the limit
with probability CONFIDENCE, by the quantile of the host's beta posterior, is blocked. The counts are aggregated before anything is shuffled
by host, and the page side of the join is one url column, so a host with a third of all pages is no hot key.

Edge cases: a null url, or one without ``://``, has an empty host and path, no rule, and the verdict allow; null labels are ignored; a page id
with several labels counts each of them; an empty table of labels leaves the flat prior, which blocks nothing; repeated urls are judged
alike, one by one; an empty table gives an empty table; columns other than id and url are not read. Of two rules of equal length that both
fit, the one that is later by code point wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, written

#: Labels that stand before a two-letter country suffix and belong to the suffix. A rule of thumb for the public
#: suffixes of two labels; suffixes of more labels, and those of private registries, count as domains.
SECOND_LEVEL = tuple("ac ad asn co com ed edu fin firm gen go gob gouv gov govt gv id idv ind inf info lg ltd me mil muni name ne net nhs nic nom or org pe plc police press pro pub re res sch school tm web".split())
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A page is blocked if its host's bad rate lies above LIMIT with probability CONFIDENCE.
LIMIT, CONFIDENCE = 0.5, 0.95
#: Places at which a posterior is integrated, and posteriors at once.
GRID, AT_ONCE = 2048, 1024


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    host: str
    path: str = "/"

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (
    UrlRule("block", "net"),
    UrlRule("allow", "example.net", "/en/"),
    UrlRule("block", "example.com", "/de/"),
    UrlRule("allow", "org", "/fr/"),
)


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def suffix_of(host: str) -> Column:
    """The last label, or the last two where the last but one belongs to a country's suffix."""
    labels = F.split(F.regexp_replace(F.col(host), r":\d*$", ""), r"\.")
    last, before = F.element_at(labels, -1), F.try_element_at(labels, F.lit(-2))
    return F.when((F.length(last) == 2) & before.isin(*SECOND_LEVEL) & (F.size(labels) > 2), F.concat_ws(".", before, last)).otherwise(last)


def domain_of(host: str, suffix: str) -> Column:
    """The suffix and one label more."""
    bare = F.regexp_replace(F.col(host), r":\d*$", "")
    n = F.size(F.split(F.col(suffix), r"\.")) + 1
    return F.array_join(F.slice(F.split(bare, r"\."), -F.least(n, F.size(F.split(bare, r"\."))), n), ".")


def rule_of(host: Column, path: Column, rules: tuple[UrlRule, ...] = RULES) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name, verdict = F.when(fits, F.lit(r.text)).otherwise(name), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return name, verdict


def _strength(counts: DataFrame) -> float:
    """The level's prior strength (pseudo-counts) by the method of moments, between 1 and 1000: one number.

    With children i of n_i labels and rate p_i around their parents' means m_i, the excess of sum n (p - m)^2 over the
    binomial expectation estimates the correlation rho of a beta-binomial, whose strength is 1 / rho - 1. Sums are of decimals, so that
    their order does not matter.
    """
    p, n, m = F.col("bad") / F.col("n"), F.col("n"), F.col("parent_mean")
    var = m * (1 - m)
    total = lambda x: F.sum(x.cast("decimal(30,12)")).cast("double")
    seen, binomial, slope = counts.agg(total(n * (p - m) * (p - m)), total(var), total(var * (n - 1))).first()
    rho = (seen - binomial) / slope if slope else 0.5
    return 1 / max(1 / 1001, min(0.5, rho)) - 1


def reputations(outcomes: DataFrame) -> tuple[DataFrame, dict[str, float], float]:
    """From rows (host, bad 0/1): one row (level, name, n_labels, alpha, beta) per host with labels, and per domain and suffix; each level's
    prior strength; the mean over all.

    A table in shared storage; only one number per level reaches the driver.
    """
    spark = outcomes.sparkSession
    labelled = outcomes.where(F.col("bad").isNotNull() & (F.col("host") != "")).groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum("bad").alias("bad"))
    labelled = labelled.withColumn("suffix", suffix_of("host")).withColumn("domain", domain_of("host", "suffix"))
    labelled = written(spark, labelled, "url-labels")
    n, bad = labelled.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("bad"), F.lit(0))).first()
    strengths, mean_of_all = {}, (bad + 1) / (n + 2)
    out, parents = None, None
    for level, up in (("suffix", None), ("domain", "suffix"), ("host", "domain")):
        counts = labelled.groupBy(level, *[up] * bool(up)).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
        counts = counts.join(parents, up) if up else counts.withColumn("parent_mean", F.lit(mean_of_all))
        s, mean = strengths.setdefault(level, _strength(counts)), F.col("parent_mean")
        alpha, beta = F.col("bad") + s * mean, F.col("n") - F.col("bad") + s * (1 - mean)
        rows = written(spark, counts.select(F.lit(level).alias("level"), F.col(level).alias("name"), F.col("n").alias("n_labels"), alpha.alias("alpha"), beta.alias("beta")), "url-reputation")
        parents = rows.select(F.col("name").alias(level), (F.col("alpha") / (F.col("alpha") + F.col("beta"))).alias("parent_mean"))
        out = rows if out is None else out.unionByName(rows)
    return out, strengths, mean_of_all


def beta_quantile(alpha: np.ndarray, beta: np.ndarray, q: float) -> np.ndarray:
    """The q-quantiles of beta distributions, by integrating their density over the logit, where it has no pole."""
    out = np.empty(len(alpha))
    u = np.linspace(-1, 1, GRID)
    for lo in range(0, len(alpha), AT_ONCE):
        a, b = alpha[lo : lo + AT_ONCE, None], beta[lo : lo + AT_ONCE, None]
        mid, spread = np.log(a / b), 8 * np.sqrt((a + b) / (a * b))
        x = mid + np.where(u < 0, u * (spread + 40 / a), u * (spread + 40 / b)) * np.abs(u)  # closer together around the mode
        density = a * x - (a + b) * np.logaddexp(0, x)
        density = np.exp(density - density.max(axis=1, keepdims=True))
        part = (density[:, 1:] + density[:, :-1]) / 2 * np.diff(x, axis=1)
        total = np.concatenate([np.zeros((len(a), 1)), np.cumsum(part, axis=1)], axis=1)
        total /= total[:, -1:]
        for i in range(len(a)):
            at = np.interp(q, total[i], x[i])
            out[lo + i] = np.exp(-np.logaddexp(0, -at))
    return out


def _after(mean: Column, spread: Column, strength: float) -> tuple[Column, Column]:
    """Alpha and beta of a new child: the mean of its parent, and the variance of the parent and of the level's prior around it.

    ``spread``: the parent's variance over mean (1 - mean), 1 / (alpha + beta + 1) of its posterior.
    """
    rho = spread + (1 - spread) / (strength + 1)
    return mean * (1 / rho - 1), (1 - mean) * (1 / rho - 1)


def host_bounds(hosts: DataFrame, outcomes: DataFrame, confidence: float = CONFIDENCE) -> DataFrame:
    """Per distinct host: alpha, beta and bad_rate_bound, the rate that its own lies above with the confidence."""
    spark = hosts.sparkSession
    bounded_batches(spark)
    df = hosts.select("host").distinct()
    df = df.withColumn("_suffix", suffix_of("host")).withColumn("_domain", domain_of("host", "_suffix"))
    rep, strengths, mean_of_all = reputations(outcomes)
    mean, spread = F.lit(mean_of_all), F.lit(0.0)
    for level, key in (("suffix", "_suffix"), ("domain", "_domain"), ("host", "host")):
        own = rep.where(F.col("level") == level).select(F.col("name").alias(key), F.col("alpha").alias("_alpha"), F.col("beta").alias("_beta"))
        alpha, beta = _after(mean, spread, strengths[level])
        df = df.join(own, key, "left").withColumns({"alpha": F.coalesce("_alpha", alpha), "beta": F.coalesce("_beta", beta)}).drop("_alpha", "_beta")
        mean, spread = F.col("alpha") / (F.col("alpha") + F.col("beta")), 1 / (F.col("alpha") + F.col("beta") + 1)

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low = beta_quantile(batch.column(1).to_numpy(), batch.column(2).to_numpy(), 1 - confidence)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(low)], ["host", "alpha", "beta", "bad_rate_bound"])

    bounds = df.select("host", "alpha", "beta").mapInArrow(bound, "host string, alpha double, beta double, bad_rate_bound double")
    return written(spark, bounds, "host-bounds")  # so that the join with all pages can split a hot host


def judge(pages: DataFrame, outcomes: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple[UrlRule, ...] = RULES, limit: float = LIMIT, confidence: float = CONFIDENCE) -> DataFrame:
    """One row per page: id, host, path, rule, verdict, bad_rate_bound. ``outcomes`` has (host, bad)."""
    df = pages.select(F.col(id_col).alias(id_col), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    df = df.join(host_bounds(df, outcomes, confidence).select("host", "bad_rate_bound"), "host", "left")
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    bad = (F.col("host") != "") & (F.col("bad_rate_bound") > limit)
    return df.select(id_col, "host", "path", name.alias("rule"), F.coalesce(verdict, F.when(bad, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), "bad_rate_bound")


def outcomes_from_labels(pages: DataFrame, labels: DataFrame, id_col: str = "page_id", label_col: str = "doc_id") -> DataFrame:
    """(host, bad) of the labelled pages: a page is bad if it is toxic or of low quality.

    A label belongs to the page whose id equals its ``label_col``. Where the labels are those of documents, as in the tables at hand, that is an
    assumption of the caller's, that page and document of one number are alike; a table of page labels has its own column.
    """
    bad = F.greatest(F.coalesce(F.col("toxic"), F.lit(0)), F.lit(1) - F.coalesce(F.col("quality"), F.lit(1)))
    marks = labels.where(F.col(label_col).isNotNull()).select(F.col(label_col).alias(id_col), bad.alias("bad"))
    return pages.select(id_col, host_of(F.col("url")).alias("host")).join(marks, id_col).select("host", "bad")
