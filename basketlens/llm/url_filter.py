"""URL filters: stated rules, then empirical-Bayes reputation of hosts.

A rule (host and path prefix) judges the urls it fits. Every other url gets the verdict of its host, from outcomes
of labelled pages: a host's bad rate has a beta-binomial prior whose mean comes from the other pages of its registered
domain, theirs from the other pages of the suffix, and so on to all pages; each level's weight (in pages) is estimated
from how much the groups of that level differ. A host is blocked if the lower bound of its posterior reaches MAX_BAD.

The table of labels is about documents, so for pages the outcome is a rule on the page itself (page_outcomes);
`judge` takes any other table of outcomes.

Counts per host are combined before the shuffle; above hosts only sums are kept. Pages are joined with the blocked hosts alone,
both as tables, so a host with most of the pages can be split by adaptive execution.

Null or malformed urls have an empty host and path, fit no rule, and share the reputation of the empty host. Pages without html have
no outcome. Pages are judged row by row: repeated ones get the same verdict. Very long urls are nothing special. Empty tables give no rows.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basketlens.llm.tables import narrow, prepared, written

# The rules, verdict and host with path prefix.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
# Suffixes of more than one label; every other suffix is the last label.
SUFFIXES = ("ac.uk", "co.jp", "co.uk", "com.au", "com.br", "gov.uk", "org.uk")
# A host is blocked when its bad rate is at least MAX_BAD with probability LEVEL.
MAX_BAD = 0.5
LEVEL = 0.9
# A page is bad if its visible text has fewer words, or more signs for a hundred words.
MIN_WORDS = 50
MAX_SIGN_PERCENT = 10
_SIGNS = "[#*$%|]"
# Weight of a prior, in pages, where no two groups can be compared; and the least and largest spread of groups
# (the largest lets a prior weigh one page at least).
PRIOR_PAGES = 10.0
SPREAD = (1e-4, 0.5)
_UNSEEN = (
    r"(?is)<!--.*?(?:-->|\z)"
    r"|<(?:script|style|nav|header|footer|aside|form)\b.*?(?:</(?:script|style|nav|header|footer|aside|form)\s*>|\z)"
)


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without a ``://``."""
    rest = F.coalesce(F.get(F.split(url, "://", 2), F.lit(1)), F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> Column:
    """Struct of rule and verdict: the longest rule that fits (then the longest host, then in text order), else null."""
    by_length = sorted(rules, key=lambda r: (-len(r[1]), -r[1].find("/"), r[1]))
    out = None
    for verdict, rule in by_length:
        at = rule.index("/")
        fits = ((host == rule[:at]) | host.endswith("." + rule[:at])) & path.startswith(rule[at:])
        value = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def registered(host: Column, suffixes: tuple = SUFFIXES) -> tuple[Column, Column]:
    """Registered domain and suffix of a host, without user and port; an address is its own domain, with no suffix."""
    name = F.regexp_replace(F.regexp_replace(host, "^.*@", ""), r":[0-9]*$", "")
    address = name.rlike(r"^[0-9.]+$|^\[")
    long = F.lit(False)
    for s in suffixes:
        long = long | (name == s) | name.endswith("." + s)
    last = F.when(address, "").when(long, F.substring_index(name, ".", -2)).otherwise(F.substring_index(name, ".", -1))
    domain = (
        F.when(address, name).when(long, F.substring_index(name, ".", -3)).otherwise(F.substring_index(name, ".", -2))
    )
    return domain, last


def page_outcomes(pages: DataFrame) -> DataFrame:
    """page_id, url, bad (int; null without html): 1 if the visible text is too short or too full of signs.

    Comments, scripts, styles, menus, headers, footers, sidebars and forms are not counted; one that is
    not closed reaches to the page's end, so a page is read once whatever it holds.
    """
    own = narrow(pages, page_id="page_id", url="url", html="html")
    text = F.regexp_replace(F.regexp_replace("html", _UNSEEN, " "), r"(?s)<[^>]*(?:>|\z)", " ")
    own = own.select("page_id", "url", text.alias("text"))
    words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))
    signs = F.regexp_count("text", F.lit(_SIGNS))
    bad = (words < MIN_WORDS) | (100 * signs.cast("long") > MAX_SIGN_PERCENT * words.cast("long"))
    return own.select("page_id", "url", bad.cast("int").alias("bad"))


def _spread(groups: DataFrame, mean: Column) -> float:
    """How many pages the prior of these groups (k bad of n) weighs, by the method of moments.

    Around its parent's mean a group's k varies by n mean (1 - mean) (1 + (n - 1) spread).
    """
    own = F.col("n") * mean
    row = (
        groups.where("n > 0")
        .select(
            (F.pow(F.col("k") - own, 2) / F.col("n") - mean * (1 - mean)).alias("extra"),
            ((F.col("n") - 1) * mean * (1 - mean)).alias("room"),
        )
        .agg(F.sum("extra").alias("extra"), F.sum("room").alias("room"))
        .first()
    )
    if not row.room:
        return PRIOR_PAGES
    spread = min(max(row.extra / row.room, SPREAD[0]), SPREAD[1])
    return 1 / spread - 1


def host_reputation(outcomes: DataFrame) -> DataFrame:
    """outcomes (url, bad) -> host, domain, suffix, pages, bad_pages, mean, bound: one row per host, labelled or not.

    `mean` and `bound` are the posterior mean of the bad rate and a value it exceeds with probability LEVEL at
    least, whatever the posterior's form (Cantelli's inequality). A prior never counts the host's own pages.
    """
    host, _ = url_parts(F.col("url"))
    counted = outcomes.select(host.alias("host"), "bad").groupBy("host")
    counted = counted.agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("k"))
    domain, last = registered(F.col("host"))
    hosts = written(counted.select("host", domain.alias("domain"), last.alias("suffix"), "n", "k"), "hosts")
    total = hosts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("k"), F.lit(0)).alias("k")).first()

    def sums(frame: DataFrame, *keys: str) -> DataFrame:
        return written(frame.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("k").alias("k")), "groups")

    domains = sums(hosts, "domain", "suffix")
    suffixes = sums(domains, "suffix")
    above = suffixes.select("suffix", F.col("n").alias("sn"), F.col("k").alias("sk"))
    top = (total.k - F.col("k") + 0.5) / (total.n - F.col("n") + 1)
    weight = _spread(suffixes, top)
    by_suffix = (weight * top + F.col("sk") - F.col("k")) / (weight + F.col("sn") - F.col("n"))
    domains = written(domains.join(above, "suffix"), "domains")
    weight = _spread(domains, by_suffix)
    by_domain = (weight * by_suffix + F.col("dk") - F.col("k")) / (weight + F.col("dn") - F.col("n"))
    whole = domains.select("domain", "suffix", "sn", "sk", F.col("n").alias("dn"), F.col("k").alias("dk"))
    hosts = written(hosts.join(whole, ["domain", "suffix"]), "hosts")
    weight = _spread(hosts, by_domain)
    a = weight * by_domain + F.col("k")
    b = weight * (1 - by_domain) + F.col("n") - F.col("k")
    deviations = (LEVEL / (1 - LEVEL)) ** 0.5
    bound = a / (a + b) - deviations * F.sqrt(a * b / (a + b + 1)) / (a + b)
    return hosts.select(
        "host", "domain", "suffix", F.col("n").alias("pages"), F.col("k").alias("bad_pages"),
        (a / (a + b)).alias("mean"), bound.alias("bound"),
    )


def judge(pages: DataFrame, outcomes: DataFrame, rules: tuple = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict of every row of pages (page_id, url); outcomes has url and bad (0, 1 or null)."""
    reputation = host_reputation(outcomes)
    blocked = written(reputation.where(F.col("bound") >= MAX_BAD).select(F.col("host").alias("blocked")), "blocked")
    host, path = url_parts(F.col("url"))
    urls = narrow(pages, page_id="page_id", url="url").select("page_id", host.alias("host"), path.alias("path"))
    urls = urls.withColumn("found", rule_of(F.col("host"), F.col("path"), rules))
    # A host the rules judge altogether needs no look-up, but its rows still take part: the join is by host alone.
    joined = urls.join(blocked, F.col("host") == F.col("blocked"), "left")
    method = F.when(F.col("blocked").isNotNull(), "block").otherwise("allow")
    return joined.select(
        "page_id", "host", "path", F.col("found.rule").alias("rule"),
        F.coalesce("found.verdict", method).alias("verdict"),
    )


def url_filter(spark: SparkSession, pages: DataFrame) -> DataFrame:
    prepared(spark)
    return judge(pages, page_outcomes(pages))
