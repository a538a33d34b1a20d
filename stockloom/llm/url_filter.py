"""Url filter: fixed rules first, and empirical-Bayes reputation of hosts for all other pages.

Outcomes of labelled pages (bad or not) are counted by host. The share of bad pages of a host is
shrunk to that of its registered domain, which is shrunk to that of its suffix, which is shrunk to
that of all pages. At each level the strength of the prior is fitted by the moments of a
beta-binomial: the more the members of a level differ, the less they are pulled to its mean. A
page is blocked if the lower posterior bound of its host's share of bad pages reaches a limit.

Only DataFrame functions are used. Defined cases: a null url, or one without ``://``, has an empty
host and path; hosts without labels take their domain's posterior; no labels at all: all pages are
allowed; rows that repeat count as often as they occur; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from stockloom.llm.common import query, salted_join, stored, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PLACE = r"(?s)^.*?://([^/?#]*)([^?#]*)"

#: (verdict, rule): host up to the first slash, the rest is the start of the path.
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, PLACE, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PLACE, 2), F.lit(""))


def matched_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """(verdict, rule) of the longest rule that fits, null if none does. Of rules as long, the longer host wins."""
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    ranked = sorted(rules, key=lambda r: (len(r[1]), len(r[1].partition("/")[0]), r[1]))
    for verdict, rule in ranked:  # the longest is tried first, as it is wrapped last
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{rest}")
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(out)
    return out


def strength(groups: DataFrame, n: str, bad: str, mean: str) -> float:
    """Prior rows a level's mean is worth, by the moments of a beta-binomial about ``mean``.

    Under it, n (rate - mean)^2 is mean (1 - mean) (1 + (n - 1) / (strength + 1)) in expectation.
    """
    spread, m = F.col(mean) * (1 - F.col(mean)), F.col(n).cast("double")
    sums = groups.filter(F.col(n) > 0).agg(
        F.sum(m * F.pow(F.col(bad) / m - F.col(mean), F.lit(2.0)) - spread).alias("over"), F.sum((m - 1) * spread).alias("room")
    ).first()
    rho = (sums["over"] or 0.0) / sums["room"] if sums["room"] else 0.0
    rho = min(max(rho, 1e-4), 0.999)
    return 1 / rho - 1


def registered_domain(host: Column, double_suffixes: list[str]) -> tuple[Column, Column]:
    """(suffix, registered domain) of a host: the last label and the last two, one more for double suffixes."""
    two = F.substring_index(host, ".", -2)
    double = two.isin(double_suffixes) if double_suffixes else F.lit(False)
    return (
        F.when(double, two).otherwise(F.substring_index(host, ".", -1)),
        F.when(double, F.substring_index(host, ".", -3)).otherwise(two),
    )


def shrink(children: DataFrame, parents: DataFrame, key: str, mean: str) -> DataFrame:
    """Children with their parent's posterior mean and their own posterior (a, b) under it as prior."""
    joined = stored(salted_join(children, parents, [key], "members", ["name"], "left"), "reputation")
    m = strength(joined, "n", "bad", mean)
    a = F.col("bad") + F.lit(m) * F.col(mean)
    b = F.col("n") - F.col("bad") + F.lit(m) * (1 - F.col(mean))
    return joined.withColumns({"a": a, "b": b}).drop(mean)


def reputations(hosts: DataFrame, double_suffixes: list[str] | None = None) -> DataFrame:
    """Posterior (a, b) of the share of bad pages of every host.

    ``hosts``: host, pages, n (labelled pages) and bad (those found bad), one row per host.
    """
    suffix, domain = registered_domain(F.col("host"), double_suffixes or [])
    hosts = hosts.withColumns({"suffix": suffix, "domain": domain, "name": F.col("host")})
    domains = stored(
        hosts.groupBy("domain").agg(
            F.first("suffix").alias("suffix"), F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.count(F.lit(1)).alias("members")
        ).withColumn("name", F.col("domain")), "domains",
    )
    suffixes = stored(
        domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.count(F.lit(1)).alias("members")), "suffixes"
    )
    sums = suffixes.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    overall = (sums["bad"] or 0) / sums["n"] if sums["n"] else 0.0
    m = strength(suffixes.withColumn("mean", F.lit(overall)), "n", "bad", "mean")
    posterior = lambda df: df.withColumn("mean", F.col("a") / (F.col("a") + F.col("b")))
    suffix_means = suffixes.select("suffix", "members", ((F.col("bad") + F.lit(m * overall)) / (F.col("n") + F.lit(m))).alias("mean"))
    judged = shrink(domains.withColumnRenamed("members", "hosts"), suffix_means, "suffix", "mean")
    domain_means = stored(posterior(judged).select("domain", F.col("hosts").alias("members"), "mean"), "domain-means")
    return shrink(hosts, domain_means, "domain", "mean").select("host", "pages", "n", "bad", "a", "b")


def filter_urls(
    pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str]], limit: float = 0.5, z: float = 1.645,
    double_suffixes: list[str] | None = None,
) -> DataFrame:
    """A verdict for every row of ``pages`` (page_id, url).

    ``outcomes``: url and bad (0 or 1) of labelled pages. ``limit``: share of bad pages which the
    lower posterior bound, ``z`` deviations below the mean, must reach for a block.
    """
    placed = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    seen = placed.select("host", F.lit(1).alias("pages"), F.lit(0).alias("n"), F.lit(0).alias("bad"))
    told = outcomes.filter("bad is not null").select(host_of(F.col("url")).alias("host"), F.lit(0).alias("pages"), F.lit(1).alias("n"), F.col("bad").cast("int").alias("bad"))
    hosts = stored(seen.unionByName(told).groupBy("host").agg(*(F.sum(c).alias(c) for c in ("pages", "n", "bad"))), "hosts")
    total = F.col("a") + F.col("b")
    bound = F.col("a") / total - F.lit(z) * F.sqrt(F.col("a") * F.col("b") / (total * total * (total + 1)))
    bad = stored(reputations(hosts, double_suffixes).filter(bound >= limit).select("host", "pages", bound.alias("bad_share_bound")), "bad-hosts")
    rule = matched_rule(F.col("host"), F.col("path"), rules)
    return salted_join(placed, bad, ["host"], "pages", ["page_id"], "left").withColumn("_rule", rule).select(
        "page_id", "url", "host", "path", F.col("_rule.rule").alias("rule"),
        F.coalesce(F.col("_rule.verdict"), F.when(F.col("bad_share_bound").isNotNull(), "block").otherwise("allow")).alias("verdict"),
        "bad_share_bound",
    )


def labelled_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Pages whose url names a labelled document (``/lang/number``): bad if it is toxic or of low quality."""
    number = F.regexp_extract(path_of(F.col("url")), r"^/[a-z]+/(\d{1,18})(?:\D|$)", 1)
    named = pages.select("url", F.when(number != "", number.cast("long")).alias("doc_id")).filter("doc_id is not null")
    bad = F.max(((F.col("toxic") == 1) | (F.col("quality") == 0)).cast("int"))
    return named.join(labels.filter("doc_id is not null").groupBy("doc_id").agg(bad.alias("bad")), "doc_id").select("url", "bad")


@query("op7_url_filter")
def op7_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    return filter_urls(pages, labelled_outcomes(pages, table(spark, folder, "labels")), RULES).drop("url")
