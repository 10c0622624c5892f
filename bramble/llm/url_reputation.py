"""URL filters: rules first, then empirical-Bayes host reputation.

A rule names a host and the start of a path; it fits its host and all subdomains, and
the longest that fits wins. Where none fits, the host's labelled page outcomes decide.
Outcomes are good (1) or bad (0). Rates are shrunk level by level: a suffix towards the
whole, a registered domain towards its suffix, a host towards its domain. At each level
the prior is a beta distribution with the parent's posterior mean; its weight, one for
the level, comes from the overdispersion of the children around their parents (method
of moments of the beta-binomial). A host is blocked if the upper posterior bound,
mean + z standard deviations, of its share of good pages is below the limit; hosts
without outcomes get their domain's prior.

All steps are DataFrame operations. Pages of one host meet only in partial sums; the
host table joins back to the pages by an equi-join, whose large partitions adaptive
execution splits. A null url, or one without "://", has an empty host and path and is
judged as the host "". Null labels count as none, repeated pages each have their row,
urls of any length are split whole, and other columns are ignored. Label ids of any type
are compared as numbers; what is no number names no page. An empty input gives an empty
result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bramble.llm.common import ascii_lower, checkpoint

#: One-sided 95 % bound; below this share of good pages a host is blocked.
Z, LIMIT = 1.645, 0.5
#: Second-level suffixes under which names are registered; a default, for which a fuller list may be passed.
SECOND_LEVEL = ("ac.uk", "co.uk", "gov.uk", "org.uk", "co.jp", "ne.jp", "or.jp", "com.au", "net.au", "org.au", "co.nz", "com.br", "com.cn", "com.mx", "co.in", "co.kr", "co.za")


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(_after(url), r"^[^/?#]*", 0)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(F.regexp_extract(_after(url), r"^[^/?#]*([\s\S]*)$", 1), r"^[^?#]*", 0), F.lit(""))


def _after(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The (action, rule) that fits, as a struct, or null. rules: (action, "host/path"); the list is part of the plan."""
    out = F.lit(None).cast("struct<action:string,rule:string>")
    for action, rule in sorted(rules, key=lambda r: len(r[1])):  # the last set, the longest, is asked first
        name, slash, start = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit(f".{name}"))) & F.startswith(path, F.lit(slash + start))
        out = F.when(fits, F.struct(F.lit(action).alias("action"), F.lit(rule).alias("rule"))).otherwise(out)
    return out


def suffix_of(host: Column, seconds: tuple[str, ...] = SECOND_LEVEL) -> Column:
    """The public suffix; a host that is an address, or has one label, is its own."""
    bare = F.regexp_replace(host, r":\d*$", "")
    two = F.substring_index(bare, ".", -2)
    return F.when(bare.rlike(r"^[\d.]+$|^\["), bare).when(two.isin(*seconds), two).otherwise(F.substring_index(bare, ".", -1))


def domain_of(host: Column, suffix: Column, seconds: tuple[str, ...] = SECOND_LEVEL) -> Column:
    """The suffix and one label more, if there is one."""
    bare = F.regexp_replace(host, r":\d*$", "")
    return F.when(bare == suffix, bare).when(suffix.isin(*seconds), F.substring_index(bare, ".", -3)).otherwise(F.substring_index(bare, ".", -2))


def _weight(children: DataFrame) -> float:
    """The prior's weight in outcomes, from children with n, k and their parent's mean mu: Pearson's statistic of a beta-binomial has the expectation sum(1 + (n-1) rho)."""
    s, c, d = children.where("n > 0").agg(F.sum((F.col("k") - F.col("n") * F.col("mu")) ** 2 / (F.col("n") * F.col("mu") * (1 - F.col("mu")))), F.count("*"), F.sum(F.col("n") - 1)).first()
    rho = (s - c) / d if d else 0.5
    return 1 / min(max(rho, 0.001), 0.9) - 1


def reputations(outcomes: DataFrame, z: float = Z, seconds: tuple[str, ...] = SECOND_LEVEL) -> DataFrame:
    """outcomes(host, good): one row a page, good null where not labelled -> host, n, mean and upper of every host."""
    counts = outcomes.groupBy("host").agg(F.count("good").alias("n"), F.sum(F.coalesce("good", F.lit(0))).alias("k"))
    suffix = suffix_of(F.col("host"), seconds)
    hosts = checkpoint(counts.select("host", suffix.alias("suffix"), domain_of(F.col("host"), suffix, seconds).alias("domain"), "n", "k"))
    n, k = hosts.agg(F.sum("n"), F.sum("k")).first()
    top = ((k or 0) + 1) / ((n or 0) + 2)
    # sums of counts, not of rates: each parent's outcomes are its children's
    suffixes = hosts.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")).withColumn("mu", F.lit(float(top)))
    w = _weight(suffixes)
    suffixes = suffixes.select("suffix", ((F.col("k") + w * F.col("mu")) / (F.col("n") + w)).alias("mu"))
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")).join(suffixes, "suffix")
    w = _weight(domains)
    domains = domains.select("domain", "suffix", ((F.col("k") + w * F.col("mu")) / (F.col("n") + w)).alias("mu"))
    known = hosts.join(domains, ["domain", "suffix"])
    w = _weight(known)
    a, b = F.col("k") + w * F.col("mu"), F.col("n") - F.col("k") + w * (1 - F.col("mu"))
    mean = a / (a + b)
    return known.select("host", "n", mean.alias("mean"), (mean + z * F.sqrt(mean * (1 - mean) / (a + b + 1))).alias("upper"))


def filter_urls(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str]], z: float = Z, limit: float = LIMIT, seconds: tuple[str, ...] = SECOND_LEVEL) -> DataFrame:
    """page_id, host, path, rule, verdict and the host's figures of every page.

    A page's outcome is the quality label of the document its path names by the first
    number in it: labels(doc_id, quality), the largest where one id has several.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    split = pages.select("page_id", host.alias("host"), path.alias("path"))
    split = split.withColumn("named", F.expr("try_cast(nullif(regexp_extract(path, '([0-9]+)', 1), '') as bigint)"))
    good = labels.select(F.col("doc_id").cast("string").try_cast("long").alias("named"), F.col("quality").cast("int").alias("good")).where("named is not null and good is not null").groupBy("named").agg(F.max("good").alias("good"))
    hosts = reputations(split.join(good, "named", "left").select("host", "good"), z, seconds)
    rule = rule_of(F.col("host"), F.col("path"), rules)
    judged = split.drop("named").join(hosts, "host").withColumn("fit", rule)
    verdict = F.coalesce("fit.action", F.when(F.col("upper") < limit, "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"), F.col("n").alias("host_outcomes"), F.col("mean").alias("host_mean"), F.col("upper").alias("host_upper"))
