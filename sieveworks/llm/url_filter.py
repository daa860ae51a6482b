"""URL filters: explicit host/path rules first, then empirical-Bayes host reputation.

Reputation.  Each labelled page is a Bernoulli outcome (bad or not).  Outcomes are counted per
host; counts roll up to the registered domain and to the suffix.  At each level a beta-binomial
model gives the spread of the children around their parent (moment estimate of the intra-class
correlation), and the child's rate is shrunk to the parent's posterior mean with that strength:
suffix to the overall rate, domain to its suffix, host to its domain.  A host without labelled pages
counts none and takes its domain's posterior.  A host is blocked when its posterior, a beta distribution of that
mean and variance, leaves a bad rate of ``max_bad`` or less a probability below ``doubt``: when the lower
posterior bound of that level exceeds ``max_bad``.

Defined results: a null url has an empty host and path, takes no rule and is judged like any host
(the empty one).  Repeated rows give repeated rows; labels that occur more than once count each
time; labels with a null outcome or page are ignored.  An empty pages table gives no rows, empty
labels block nothing.  Other columns, whatever they are called, are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .common import ascii_lower, let, written
from .quality_rules import log_gamma

#: Suffixes of two labels taken where no list is given; other names end in a suffix of one.
SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br", "co.nz", "co.in")


@dataclass(frozen=True)
class UrlRule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class Reputation:
    """``max_bad``: highest tolerated bad rate; ``doubt``: level of the lower posterior bound."""

    max_bad: float = 0.35
    doubt: float = 0.05
    min_rho: float = 1e-4
    max_rho: float = 0.5


def host_of(url: Column) -> Column:
    after = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return ascii_lower(after)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: list[UrlRule]) -> Column:
    """Name and verdict of the longest rule that fits (null if none; block wins a tie)."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.name), r.verdict == "block", r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def suffix_of(host: Column, listed: list[str]) -> Column:
    """Public suffix of a host without its port: the longest listed one that it ends in, else its last label."""
    bare = F.regexp_replace(host, ":[0-9]*$", "")
    known = F.array(*[F.lit(s) for s in sorted(listed)]).cast("array<string>")
    labels = F.split(bare, "[.]")
    endings = F.transform(labels, lambda _, i: F.array_join(F.slice(labels, i + 1, F.size(labels)), "."))
    return F.when(bare.rlike(r"^[0-9.]+$|^\["), F.lit("")).otherwise(F.coalesce(F.get(F.filter(endings, lambda e: F.array_contains(known, e)), F.lit(0)), F.element_at(labels, -1)))


def domain_of(host: Column, suffix: Column) -> Column:
    """The suffix and one label before it; an address or a bare suffix is its own domain."""
    bare = F.regexp_replace(host, ":[0-9]*$", "")
    labels = F.when(suffix == "", F.size(F.split(bare, "[.]"))).otherwise(F.size(F.split(suffix, "[.]")) + 1)
    parts = F.split(bare, "[.]")
    return let(parts, lambda p: F.array_join(F.slice(p, F.greatest(F.lit(1), F.size(p) - labels + 1), F.size(p)), "."))


def host_outcomes(pages: DataFrame, labels: DataFrame, suffixes: list[str]) -> DataFrame:
    """One row per host of a page: ``host, domain, suffix, n, k`` (labelled pages, bad ones; 0 without labels).

    ``pages(page_id, host)``, ``labels(page_id, bad boolean)``.
    """
    known = labels.where(F.col("bad").isNotNull() & F.col("page_id").isNotNull())
    joined = known.join(pages.where(F.col("page_id").isNotNull()), "page_id").select("host", "bad")
    every = joined.unionByName(pages.select("host", F.lit(None).cast("boolean").alias("bad")))
    counted = every.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum(F.col("bad").cast("long")), F.lit(0)).alias("k"))
    return counted.withColumn("suffix", suffix_of(F.col("host"), suffixes)).withColumn("domain", domain_of(F.col("host"), F.col("suffix")))


def beta_cdf(x: float, a: Column, b: Column) -> Column:
    """P(Beta(a, b) <= x) by the continued fraction, on the side where it converges; its terms grow with the
    square root of a + b, as they need to."""

    def fraction(s: Column) -> Column:
        def step(t: Column, m: Column) -> Column:
            even = m * (s["b"] - m) * s["x"] / ((s["a"] + 2 * m - 1) * (s["a"] + 2 * m))
            odd = -(s["a"] + m) * (s["a"] + s["b"] + m) * s["x"] / ((s["a"] + 2 * m) * (s["a"] + 2 * m + 1))

            def half(c: Column, d: Column, h: Column, term: Column):
                return let(F.struct((1 + term / c).alias("c"), (1 / (1 + term * d)).alias("d"), h.alias("h")), lambda v: F.struct(v["c"].alias("c"), v["d"].alias("d"), (v["h"] * v["c"] * v["d"]).alias("h")))

            return let(half(t["c"], t["d"], t["h"], even), lambda u: half(u["c"], u["d"], u["h"], odd))

        first = 1 / (1 - (s["a"] + s["b"]) * s["x"] / (s["a"] + 1))
        terms = F.sequence(F.lit(1), (100 + 5 * F.sqrt(s["a"] + s["b"])).cast("int"))
        run = F.aggregate(terms, F.struct(F.lit(1.0).alias("c"), first.alias("d"), first.alias("h")), step)
        front = log_gamma(s["a"] + s["b"]) - log_gamma(s["a"]) - log_gamma(s["b"]) + s["a"] * F.log(s["x"]) + s["b"] * F.log(1 - s["x"])
        return let(F.exp(front) * run["h"] / s["a"], lambda p: F.when(s["far"], 1 - p).otherwise(p))

    far = F.lit(x) > (a + 1) / (a + b + 2)
    sides = F.struct(far.alias("far"), F.when(far, b).otherwise(a).alias("a"), F.when(far, a).otherwise(b).alias("b"), F.when(far, F.lit(1 - x)).otherwise(F.lit(x)).alias("x"))
    return let(sides, fraction)


def _strength(children: DataFrame, mean: Column, how: Reputation) -> Column:
    """Beta-binomial precision of a level from the children's spread: an aggregate column."""
    n, k = F.col("n").cast("double"), F.col("k").cast("double")
    var = mean * (1 - mean)
    spread = F.sum((k - n * mean) * (k - n * mean)) - F.sum(n * var)
    scale = F.sum(n * (n - 1) * var)
    rho = F.least(F.lit(how.max_rho), F.greatest(F.lit(how.min_rho), F.when(scale > 0, spread / scale).otherwise(F.lit(how.min_rho))))
    return 1 / rho - 1


def host_reputation(hosts: DataFrame, how: Reputation = Reputation()) -> DataFrame:
    """``host, n, k, mean, doubt``: posterior mean of each host's bad rate, and the probability that it is ``max_bad`` or less.

    What has no labels takes its parent's posterior mean, and its variance is that of a child of the parent
    plus the parent's own; where there are no labels at all there is no evidence, and no rows.

    Each level's strength is one number; it reaches the driver as one row of an aggregate.
    """
    n, k = F.col("n").cast("double"), F.col("k").cast("double")
    total = hosts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("k"), F.lit(0)).alias("k")).first()
    hosts = hosts.where(F.lit(total["n"] > 0))
    rate = (total["k"] + 1) / (total["n"] + 2)

    def shrunk(counts: DataFrame, parent: Column, parent_var: Column) -> DataFrame:
        strength = counts.agg(_strength(counts, parent, how).alias("s")).first()["s"]
        strength = F.lit(float(strength) if strength is not None else 1 / how.min_rho - 1)
        mean, size = (k + strength * parent) / (n + strength), n + strength
        var = F.when(n > 0, mean * (1 - mean) / (size + 1)).otherwise((parent * (1 - parent) + strength * parent_var) / (strength + 1))
        return counts.withColumn("mean", mean).withColumn("var", var)

    roll = [F.sum("n").alias("n"), F.sum("k").alias("k")]
    handed = [F.col("mean").alias("parent"), F.col("var").alias("parent_var")]
    above = F.col("parent"), F.col("parent_var")
    suffixes = shrunk(hosts.groupBy("suffix").agg(*roll), F.lit(rate), F.lit(rate * (1 - rate) / (total["n"] + 3))).select("suffix", *handed)
    domains = shrunk(hosts.groupBy("domain", "suffix").agg(*roll).join(suffixes, "suffix"), *above).select("domain", *handed)
    out = shrunk(hosts.join(domains, "domain"), *above)
    size = F.col("mean") * (1 - F.col("mean")) / F.col("var") - 1
    return out.select("host", "n", "k", "mean", beta_cdf(how.max_bad, F.col("mean") * size, (1 - F.col("mean")) * size).alias("doubt"))


def filter_urls(pages: DataFrame, labels: DataFrame, rules: list[UrlRule], how: Reputation = Reputation(), suffixes: list[str] = list(SUFFIXES)) -> DataFrame:
    """``page_id, host, path, rule, verdict`` for each row of ``pages(page_id, url)``.

    ``labels(page_id, bad)`` are the outcomes, ``suffixes`` the public suffixes of more than one label, such
    as the lines of a published list; they are part of the plan, as they are of a fixed size whatever the pages.  Only blocked hosts are joined back; both sides of
    that join are plain shuffles, so a host with a third of all pages is split by AQE.
    """
    split = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    hosts = written(host_outcomes(split.select("page_id", "host"), labels, suffixes), "hosts")
    blocked = written(host_reputation(hosts, how).where(F.col("doubt") < how.doubt).select("host", F.lit(True).alias("_blocked")), "blocked-hosts")
    ruled = split.withColumn("_rule", rule_for(F.col("host"), F.col("path"), rules))
    judged = ruled.join(blocked, "host", "left")
    method = F.when(F.col("_blocked"), F.lit("block")).otherwise(F.lit("allow"))
    return judged.select("page_id", "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce(F.col("_rule.verdict"), method).alias("verdict"))
