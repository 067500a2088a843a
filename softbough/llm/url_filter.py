"""URL filter: empirical-Bayes host reputation, in DataFrame functions only.

Labelled page outcomes (1: bad) are counted by host, registered domain and public suffix.
The suffix rate is shrunk to the overall rate, the domain rate to its suffix's posterior,
the host rate to its domain's posterior, each as a beta-binomial with the prior strength of that level.
A host is blocked if the lower bound of its posterior rate exceeds `times` the overall rate, so a few bad pages do not
condemn a host, and a host is judged by what is usual in the corpus. Explicit (host, path) rules come first: a rule fits its host and all subdomains
if the path starts with the rule's, and the longest wins.

Prior strengths are found by moments from all counts of a level, within 9 to 99 pages. The counts are
aggregated with map-side combine, so a host with a third of all pages is no hot key there; each
host's verdict is joined back to the pages by host.

Edge cases: a null url or one without :// has an empty host and path; such pages have no reputation and are allowed.
Outcomes of pages that do not exist, null outcomes and repeated ones (the largest counts) are allowed; without any
outcome nothing is blocked but by rules. An empty table gives no rows.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import store

RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Second-level names below which names are registered.
SECOND_LEVEL = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "co.nz", "com.br")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parse(pages: DataFrame, url: str = "url") -> DataFrame:
    """Adds host and path, and the host's registered domain and suffix."""
    rest = F.when(F.instr(url, "://") > 0, F.expr(f"substr(`{url}`, instr(`{url}`, '://') + 3)"))
    host = F.regexp_extract(F.coalesce(rest, F.lit("")), r"^([^/?#]*)", 1)
    path = F.regexp_extract(F.coalesce(rest, F.lit("")), r"^[^/?#]*(/[^?#]*)", 1)
    names = F.split("host", r"\.")
    two = F.array_join(F.slice(names, -2, 2), ".")
    out = pages.withColumn("host", F.translate(host, _UPPER, _LOWER)).withColumn("path", path)
    long_ = F.size(names) >= 2
    out = out.withColumn("suffix", F.when(long_ & two.isin(*SECOND_LEVEL), two).otherwise(F.element_at(names, -1)))
    width = F.size(F.split("suffix", r"\.")) + 1
    return out.withColumn("domain", F.when(F.size(names) >= width, F.array_join(F.slice(names, -width, width), ".")).otherwise(F.col("host")))


def rule_of(rules) -> tuple:
    """Columns: the longest rule that fits (host, path), and its verdict; the first of rules of equal length wins."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for host, path, says in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule = F.when(fits, F.lit(host + path)).otherwise(rule)
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def _strength(counts: DataFrame, prior: str) -> float:
    """A level's prior strength, one number: variance of rates about their prior means gives m(1-m)/v - 1."""
    # E[observed] = sum m(1-m) (1 + (n - 1) rho), solved for rho = 1 / (s + 1)
    expected = F.sum(F.expr(f"n * {prior} * (1 - {prior})"))
    observed = F.sum(F.expr(f"n * (bad / n - {prior}) * (bad / n - {prior})"))
    spread = F.sum(F.expr(f"{prior} * (1 - {prior})"))
    rho = F.least(F.greatest(F.try_divide(F.round(observed, 9) - F.round(spread, 9), F.round(expected, 9) - F.round(spread, 9)), F.lit(0.01)), F.lit(0.1))
    return counts.where("n > 0").agg(F.coalesce(F.round(1 / rho - 1, 6), F.lit(10.0)).alias("s")).first().s


def reputation(parsed: DataFrame, outcomes: DataFrame, z: float = 1.645) -> tuple[DataFrame, float]:
    """(host, n, bad, alpha, beta, rate, low): posterior bad rate of each host with its lower bound; and the overall rate.

    outcomes: (page_id, bad). The bound is normal: mean - z * sqrt(mean (1 - mean) / (alpha + beta + 1)). Four numbers reach the driver.
    """
    seen = outcomes.where("bad is not null and page_id is not null").groupBy("page_id").agg(F.max("bad").alias("bad"))
    all_hosts = parsed.select("page_id", "host", "domain", "suffix").join(seen, "page_id", "left")
    hosts = store(all_hosts.groupBy("host", "domain", "suffix").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).cast("long").alias("bad")), "hosts")
    domains = store(hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")), "domains")
    suffixes = store(domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")), "suffixes")
    m0 = suffixes.agg(F.round(F.coalesce(F.try_divide(F.sum("bad"), F.sum("n")), F.lit(0.0)), 9)).first()[0]
    suffixes = suffixes.withColumn("m0", F.lit(m0))

    def shrunk(counts, prior, name):
        s = _strength(counts, prior)
        return counts.withColumn(name, F.expr(f"round((bad + {s!r}D * {prior}) / (n + {s!r}D), 9)")), s

    suffixes, _ = shrunk(suffixes, "m0", "m1")
    domains, _ = shrunk(domains.join(suffixes.select("suffix", "m1"), "suffix"), "m1", "m2")
    hosts, s = shrunk(hosts.join(domains.select("domain", "suffix", "m2"), ["domain", "suffix"]), "m2", "rate")
    bound = f"round(rate - {z!r}D * sqrt(rate * (1 - rate) / (n + {s!r}D + 1)), 9)"
    return hosts.selectExpr("host", "n", "bad", f"bad + {s!r}D * m2 as alpha", f"n - bad + {s!r}D * (1 - m2) as beta", "rate", f"{bound} as low"), m0


def filter_urls(pages: DataFrame, outcomes: DataFrame, rules=RULES, times: float = 1.0, z: float = 1.645) -> DataFrame:
    """(page_id, host, path, rule, verdict, rate, low) for every page row."""
    parsed = parse(pages.select("page_id", "url"))
    known, overall = reputation(parsed, outcomes, z)
    rule, says = rule_of(rules)
    judged = parsed.join(known.select("host", "rate", "low"), "host", "left")
    method = F.when((F.col("host") != "") & (F.col("low") > times * overall), "block").otherwise("allow")
    return judged.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(says, method).alias("verdict"), "rate", "low")
