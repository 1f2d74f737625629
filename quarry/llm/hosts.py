"""URL filter from empirical-Bayes host reputation with fixed rules above it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import sized, stored

#: (verdict, host, path): the longest rule that fits wins.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/"))

_URL = "(?s)^.*?://([^/?#]*)([^?#]*)"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    safe = F.coalesce(url, F.lit(""))
    host = F.translate(F.regexp_extract(safe, _URL, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(safe, _URL, 2)


def longest_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]], value) -> Column:
    """``value(rule)`` of the longest rule that fits (its host or a subdomain, its path a prefix); else null."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == rule[1]) | host.endswith("." + rule[1])) & path.startswith(rule[2])
        out = F.when(fits, F.lit(value(rule))).otherwise(out)
    return out


def _concentration(units: DataFrame) -> float:
    """Beta concentration by moments from ``units (n, k, prior)``: how alike the units of a parent are."""
    p = F.least(F.greatest("prior", F.lit(1e-6)), F.lit(1 - 1e-6))
    row = units.agg(F.sum((F.col("k") - F.col("n") * p) ** 2 / (p * (1 - p))).alias("q"), F.sum("n").alias("n"),
                    F.sum(F.col("n").cast("double") * (F.col("n") - 1)).alias("m")).first()
    rho = (row["q"] - row["n"]) / row["m"] if row["m"] else 0.0
    rho = min(max(rho, 1e-4), 0.999)
    return 1 / rho - 1


def host_reputation(outcomes: DataFrame) -> DataFrame:
    """Posterior bad rate per host from ``outcomes (host, bad)``, bad being 0 or 1.

    Returns one row per key: ``level`` (host, domain, suffix or all), ``key``,
    and the Beta parameters ``a, b`` that a host below that key has before its
    own outcomes (level host: after them). Suffix rates shrink to the overall
    rate, domains (last two labels) to their suffix, hosts to their domain;
    each level's concentration is estimated from all its units.
    """
    host = F.col("host")
    hosts = stored(outcomes.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum("bad").alias("k"))
                   .select("host", F.substring_index(host, ".", -2).alias("domain"),
                           F.substring_index(host, ".", -1).alias("suffix"), "n", "k"))
    domains = stored(hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")))
    suffixes = stored(domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")))
    total = suffixes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("k"), F.lit(0)).alias("k")).first()
    rate = (total["k"] + 1) / (total["n"] + 2)

    def shrunk(units: DataFrame) -> tuple[DataFrame, float]:
        c = _concentration(units) if total["n"] else 1.0
        return units.withColumn("a", F.col("k") + c * F.col("prior")).withColumn(
            "b", F.col("n") - F.col("k") + c * (1 - F.col("prior"))), c
    top, _ = shrunk(suffixes.withColumn("prior", F.lit(rate)))
    top = stored(top.withColumn("mean", F.expr("a / (a + b)")))
    mid, _ = shrunk(domains.join(sized(top.select("suffix", F.col("mean").alias("prior"))), "suffix"))
    mid = stored(mid.withColumn("mean", F.expr("a / (a + b)")))
    low, c = shrunk(hosts.join(sized(mid.select("domain", F.col("mean").alias("prior"))), "domain"))

    def prior_of(units: DataFrame, level: str) -> DataFrame:
        return units.select(F.lit(level).alias("level"), F.col(level).alias("key"), (F.col("mean") * c).alias("a"),
                            ((1 - F.col("mean")) * c).alias("b"))
    everything = hosts.sparkSession.range(1).select(F.lit("all").alias("level"), F.lit("").alias("key"),
                                                    F.lit(rate * c).alias("a"), F.lit((1 - rate) * c).alias("b"))
    return stored(low.select(F.lit("host").alias("level"), F.col("host").alias("key"), "a", "b")
                  .union(prior_of(mid, "domain")).union(prior_of(top, "suffix")).union(everything))


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES,
               max_bad: float = 0.5, z: float = 1.645, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``page_id, host, path, rule, verdict, bad_rate, bad_bound`` for every page.

    ``outcomes (page_id, bad)`` are labelled pages (1 bad, 0 good; repeated
    rows count each). The longest fitting rule decides; else a page is blocked
    when the lower posterior bound of its host's bad rate (mean less ``z``
    posterior deviations) exceeds ``max_bad``. A host without outcomes uses its
    domain, suffix or overall prior. Null urls and urls without ``://`` have
    empty host and path and share the empty host's reputation. Without
    outcomes nothing is blocked by the method. Repeated pages are judged one by
    one, an empty table gives no rows, other columns are ignored.
    """
    host, path = url_parts(F.col(url_col))
    parsed = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    known = outcomes.select(F.col("page_id").alias("_page"), F.col("bad").cast("bigint").alias("bad")).where("bad is not null")
    reputation = host_reputation(parsed.join(known, F.col("page_id") == F.col("_page")).select("host", "bad"))
    out = parsed
    for level, key in (("host", F.col("host")), ("domain", F.substring_index("host", ".", -2)),
                       ("suffix", F.substring_index("host", ".", -1)), ("all", F.lit(""))):
        part = stored(reputation.where(F.col("level") == level).select(
            F.col("key").alias(f"_{level}"), F.struct("a", "b").alias(f"_{level}_beta")))
        out = out.join(sized(part), key == F.col(f"_{level}"), "left")
    beta = F.coalesce("_host_beta", "_domain_beta", "_suffix_beta", "_all_beta")
    a, b = beta["a"], beta["b"]
    mean = a / (a + b)
    out = out.select("page_id", "host", "path", mean.alias("bad_rate"),
                     (mean - z * F.sqrt(mean * (1 - mean) / (a + b + 1))).alias("bad_bound"))
    by_rule = longest_rule(F.col("host"), F.col("path"), rules, lambda r: r[0])
    return out.select("page_id", "host", "path", longest_rule(F.col("host"), F.col("path"), rules, lambda r: r[1] + r[2]).alias("rule"),
                      F.coalesce(by_rule, F.when(F.col("bad_bound") > max_bad, "block").otherwise("allow")).alias("verdict"),
                      "bad_rate", "bad_bound")
