"""URL filter by rules and, where no rule fits, by empirical-Bayes host reputation.

Labelled page outcomes are counted per host, registered domain and suffix.
A beta-binomial prior passes down: the suffix shrinks to the overall rate, the
domain to its suffix, the host to its domain. How strongly a level shrinks is
estimated from the spread of its rates (method of moments). A page is blocked
unless the lower posterior bound of its pages being good reaches the threshold.

Counting has map-side sums, so a hot host is a row like any other; pages meet
the host table in a join that adaptive execution can split, and carry no page
content.

Defined results: a url that is null or has no ``://`` has an empty host and
path, which fit no rule; an unlabelled host gets its domain's prior, an
unknown suffix the overall rate; without any labelled page the rate is one
half. Repeated rows give repeated results; a page labelled twice counts once,
by its worse label; very long urls are read whole; an empty table of pages
gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from innings.llm.tables import stored

#: Second-level labels that belong to the suffix (``example.co.uk``).
SECOND_LEVEL = ("co", "com", "org", "net", "ac", "gov", "edu")


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str


# The rules of the filter.
RULES = (
    Rule("com", "/", "allow"), Rule("example.com", "/en/", "block"), Rule("www.example.com", "/en/", "allow"),
    Rule("net", "/es/", "block"), Rule("net", "/fr/", "block"),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The longest fitting rule as ``struct(rule, verdict)``, or null."""
    ordered = sorted(rules, key=lambda r: (-len(r.host + r.path), r.host, r.path))
    fits = [F.when(((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path),
                   F.struct(F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("verdict"))) for r in ordered]
    none = F.lit(None).cast("struct<rule:string,verdict:string>")
    return F.coalesce(*fits, none)


def domain_of(host: Column, second_level: tuple[str, ...] = SECOND_LEVEL) -> tuple[Column, Column]:
    """Registered domain and public suffix, by labels counted from the end; a port or user is cut off.

    A suffix is one label, or two if the second is in ``second_level`` and the last one has two letters.
    """
    labels = F.split(F.regexp_replace(host, r"^.*@|:[0-9]*$", ""), r"\.")
    n = F.size(labels)
    two = (n > 2) & F.element_at(labels, F.greatest(-n, F.lit(-2))).isin(*second_level) & (
        F.length(F.element_at(labels, -1)) == 2)
    suffix_n = F.when(two, 2).otherwise(1)
    cut = lambda k: F.array_join(F.slice(labels, F.greatest(n - k + 1, F.lit(1)), k), ".")
    return cut(suffix_n + 1), cut(suffix_n)


def _shrunk(counts: DataFrame, level: str, parent: str | None) -> DataFrame:
    """``level, good, n, prior`` with the strength of the prior; ``counts`` has the parent's mean in ``up``."""
    # Moments: spread of the rates around the parent's, less what binomial noise alone gives.
    rate = F.col("good") / F.col("n")
    seen = counts.where("n > 0").agg(
        F.sum(F.col("n") * (rate - F.col("up")) * (rate - F.col("up"))).alias("spread"),
        F.sum(F.col("up") * (1 - F.col("up"))).alias("noise"),
        F.sum(F.col("n") * F.col("up") * (1 - F.col("up"))).alias("scale"),
    ).select(F.when((F.col("spread") > F.col("noise")) & (F.col("scale") > F.col("noise")),
                    F.greatest(F.lit(1.0), F.least(F.lit(1000.0), (F.col("scale") - F.col("noise"))
                                                   / (F.col("spread") - F.col("noise")) - 1)))
             .otherwise(1000.0).alias("strength"))
    keep = [c for c in (level, parent) if c]
    # One row, so the broadcast is bounded.
    return counts.join(F.broadcast(seen)).select(
        *keep, "good", "n", "up", "strength",
        ((F.col("good") + F.col("strength") * F.col("up")) / (F.col("n") + F.col("strength"))).alias("mean"))


def log_beta_inc(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function by its continued fraction."""
    from math import lgamma

    flip = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    gamma = np.vectorize(lgamma, otypes=[float])
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(gamma(p + q) - gamma(p) - gamma(q) + p * np.log(y) + q * np.log1p(-y)) / p
        c = np.ones_like(y)
        d = 1 / np.maximum(1 - (p + q) * y / (p + 1), 1e-300)
        h = d.copy()
        for m in range(1, 200):
            for num in (m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)),
                        -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))):
                d = 1 / np.where(np.abs(1 + num * d) < 1e-300, 1e-300, 1 + num * d)
                c = np.where(np.abs(1 + num / c) < 1e-300, 1e-300, 1 + num / c)
                h = h * d * c
    value = np.where(y <= 0, 0.0, front * h)
    return np.where(flip, 1 - value, value)


def beta_quantile(a: np.ndarray, b: np.ndarray, q: float, steps: int = 50) -> np.ndarray:
    low, high = np.zeros_like(a), np.ones_like(a)
    for _ in range(steps):
        mid = (low + high) / 2
        below = log_beta_inc(a, b, mid) < q
        low, high = np.where(below, mid, low), np.where(below, high, mid)
    return (low + high) / 2


def reputation(outcomes: DataFrame, hosts: DataFrame, level: float = 0.1,
               second_level: tuple[str, ...] = SECOND_LEVEL) -> DataFrame:
    """``host`` of every known host with ``n, good, mean, bound``: the posterior of its pages being good.

    ``outcomes``: host, good (0 or 1) of labelled pages. ``hosts``: all hosts to judge.
    """
    domain, suffix = domain_of(F.col("host"), second_level)
    counted = outcomes.groupBy("host").agg(F.sum("good").alias("good"), F.count("good").alias("n"))
    every = hosts.select("host").distinct().join(counted, "host", "left").select(
        "host", domain.alias("domain"), suffix.alias("suffix"),
        F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("n", F.lit(0)).alias("n"))
    # Written, a row per host: all levels and their moments read this table and not the pages.
    every = stored(every, "host-counts")
    sums = [F.sum("good").alias("good"), F.sum("n").alias("n")]
    domains = every.groupBy("domain", "suffix").agg(*sums)
    suffixes = domains.groupBy("suffix").agg(*sums)
    top = suffixes.agg(*sums).select(
        ((F.coalesce("good", F.lit(0)) + 1) / (F.coalesce("n", F.lit(0)) + 2)).alias("up"))
    domains = stored(domains, "domain-counts")
    by_suffix = stored(_shrunk(suffixes.join(F.broadcast(top)), "suffix", None), "suffix-rates")
    by_domain = _shrunk(domains.join(by_suffix.select("suffix", F.col("mean").alias("up")), "suffix"),
                        "domain", "suffix")
    by_domain = stored(by_domain, "domain-rates")
    by_host = _shrunk(every.join(by_domain.select("domain", "suffix", F.col("mean").alias("up")),
                                 ["domain", "suffix"]), "host", "domain")

    @F.pandas_udf("double")
    def lower(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(beta_quantile(a.to_numpy(float), b.to_numpy(float), level))

    alpha = F.col("good") + F.col("strength") * F.col("up")
    beta = F.col("n") - F.col("good") + F.col("strength") * (1 - F.col("up"))
    return by_host.select("host", "n", "good", "mean", lower(alpha, beta).alias("bound"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: tuple[Rule, ...] = RULES, threshold: float = 0.5,
          level: float = 0.1, second_level: tuple[str, ...] = SECOND_LEVEL) -> DataFrame:
    """``page_id, url`` to ``page_id, host, path, rule, verdict, bound, mean, labelled``.

    ``outcomes``: page_id, good (0 or 1). A rule decides where one fits; else
    a page is allowed if the lower posterior bound of its host reaches the threshold.
    """
    host, path = host_and_path(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    urls = urls.withColumn("fit", rule_of(F.col("host"), F.col("path"), rules))
    labelled = urls.join(outcomes.select("page_id", F.col("good").cast("long").alias("good")).where("good is not null")
                         .groupBy("page_id").agg(F.min("good").alias("good")), "page_id").select("host", "good")
    scores = stored(reputation(labelled, urls, level, second_level), "host-scores")
    return urls.join(scores, "host", "left").select(
        "page_id", "host", "path", F.col("fit.rule").alias("rule"),
        F.coalesce(F.col("fit.verdict"), F.when(F.col("bound") >= threshold, "allow").otherwise("block"))
        .alias("verdict"), F.round("bound", 9).alias("bound"), F.round("mean", 9).alias("mean"),
        F.col("n").alias("labelled"))
