"""URL filter by rules and by empirical-Bayes host reputation.

Labelled page outcomes (good or bad) are counted by host, registered domain and suffix. Bad rates are shrunk downwards: the
suffix towards all pages, the domain towards its suffix, the host towards its domain, each time through a beta-binomial
prior whose strength comes from the spread of the true rates at that level: the spread of the observed rates less what
binomial noise adds (moments of the beta-binomial). A host is blocked when the lower bound of its posterior bad rate is
above a threshold. Rules come before the reputation.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corrolith.llm.common import UPPER, LOWER, written

#: Fixed values of the contract: (verdict, rule as host/path).
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))


#: Names under a country's domain that take registrations, as `co` in example.co.uk.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gen", "go", "gob", "gov", "gouv", "id", "info", "ltd", "me", "mil", "ne", "net", "nhs", "nom", "or", "org", "plc", "sch", "web")


@dataclass(frozen=True)
class Reputation:
    """deviations: how many posterior standard deviations the bound lies below the mean; threshold: bad rate above which a
    host is blocked; strongest: the largest prior strength in pages; second_level: names that form a suffix of two labels with
    a last label of two letters; suffixes: further suffixes of two labels, such as github.io."""

    deviations: float = 2.0
    threshold: float = 0.5
    strongest: float = 1000.0
    second_level: tuple[str, ...] = SECOND_LEVEL
    suffixes: tuple[str, ...] = ()


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _fits(rule: str) -> Column:
    host, _, path = rule.partition("/")
    return ((F.col("host") == host) | F.endswith("host", F.lit("." + host))) & F.startswith("path", F.lit("/" + path))


def rule_columns(rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule, null if none fits, and its verdict; of equally long rules the first stays."""
    order = sorted(rules, key=lambda r: -len(r[1]))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, r in reversed(order):
        rule, verdict = F.when(_fits(r), F.lit(r)).otherwise(rule), F.when(_fits(r), F.lit(v)).otherwise(verdict)
    return rule, verdict


def _name(host: Column) -> Column:
    """The host without user, port and a dot at its end."""
    return F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r"\.?(:[0-9]*)?$", "")


def _address(name: Column) -> Column:
    return name.rlike(r"^[0-9]+(\.[0-9]+){3}$") | name.startswith("[")


def suffix_of(host: Column, how: Reputation = Reputation()) -> Column:
    """The public suffix: the last label, or the last two where they are known to take registrations. An address is its own."""
    name = _name(host)
    two, one = F.substring_index(name, ".", -2), F.substring_index(name, ".", -1)
    double = one.rlike("^[a-z]{2}$") & F.substring_index(two, ".", 1).isin(*how.second_level) & (two != one)
    return F.when(_address(name), name).when((double | two.isin(*how.suffixes)) if how.suffixes else double, two).otherwise(one)


def domain_of(host: Column, how: Reputation = Reputation()) -> Column:
    """The registered domain: the suffix and the label before it, if there is one."""
    name, suffix = _name(host), suffix_of(host, how)
    return F.when(_address(name), name).when(F.instr(suffix, ".") > 0, F.substring_index(name, ".", -3)).otherwise(F.substring_index(name, ".", -2))


def _strength(level: DataFrame, how: Reputation) -> tuple[float, float]:
    """Mean bad rate and prior strength from counts (n, bad) by group. The weighted squares of the rates around their mean
    are, in the mean, m (1 - m) (groups - 1 + r (N - squares / N - groups + 1)) with r = 1 / (strength + 1)."""
    n, bad, squares, groups = level.agg(F.sum("n"), F.sum("bad"), F.sum(F.col("n").cast("double") * F.col("n")), F.count(F.lit(1))).first()
    if not n:
        return 0.0, how.strongest
    mean = bad / n
    around = F.col("bad") / F.col("n") - F.lit(mean)
    spread = level.agg(F.sum(F.col("n") * around * around)).first()[0]
    room = n - squares / n - (groups - 1)
    noise = mean * (1 - mean)
    r = (spread / noise - (groups - 1)) / room if noise > 0 and room > 0 else 0.0
    strength = 1 / r - 1 if r > 0 else how.strongest
    # rounded, so that the order in which sums are made can't move a verdict
    return mean, round(min(max(strength, 1.0), how.strongest), 3)


def host_reputation(outcomes: DataFrame, how: Reputation = Reputation(), hosts: DataFrame | None = None) -> DataFrame:
    """outcomes: host, n, bad (labelled pages and bad ones; several rows of a host add up). hosts: host, further hosts to list.
    One row per host: host, n, bad, mean, bound, blocked. A host without a label has n = 0 and the mean of its domain, else
    of its suffix, else of all pages; it does not enter the prior strengths. An empty host is treated like another. Rows
    with n = 0 or a null host are ignored; no outcomes at all block nothing."""
    counts = outcomes.filter("n > 0").select("host", "n", "bad")
    if hosts is not None:
        counts = counts.unionByName(hosts.select("host").distinct().withColumns({c: F.lit(0).cast(counts.schema[c].dataType) for c in ("n", "bad")}))
    hosts = written(counts.groupBy("host").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).withColumns({"domain": domain_of(F.col("host"), how), "suffix": suffix_of(F.col("host"), how)}), "url-hosts")
    domains = written(hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")), "url-domains")
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    (mean, strong_suffix), (_, strong_domain), (_, strong_host) = (_strength(level.filter("n > 0"), how) for level in (suffixes, domains, hosts))
    shrunk = lambda prior, m: (F.col("bad") + prior * F.lit(m)) / (F.col("n") + F.lit(m))
    suffixes = suffixes.select("suffix", shrunk(F.lit(mean), strong_suffix).alias("suffix_mean"))
    domains = domains.join(suffixes, "suffix").select("domain", shrunk(F.col("suffix_mean"), strong_domain).alias("domain_mean"))
    post = hosts.join(domains, "domain").withColumn("mean", shrunk(F.col("domain_mean"), strong_host))
    bound = F.col("mean") - F.lit(how.deviations) * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("n") + F.lit(strong_host) + 1))
    return post.withColumn("bound", bound).select("host", "n", "bad", "mean", "bound", (F.col("bound") > F.lit(how.threshold)).alias("blocked"))


def judge_urls(pages: DataFrame, outcomes: DataFrame, how: Reputation = Reputation(), rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per row of pages: page_id, host, path, rule, verdict.

    A null url, or one without ://, has an empty host and path and no rule; it is allowed unless the empty host itself is
    blocked. Hosts without labelled pages are judged by their domain, suffix or all pages. Repeated rows stay, an empty table gives
    none, and urls may be of any length. Other columns are not read, so they may have any names.
    """
    url = F.col(url_col).cast("string")
    rule, verdict = rule_columns(rules)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    blocked = host_reputation(outcomes, how, rows).filter("blocked").select("host", F.lit(True).alias("__blocked"))
    judged = rows.join(blocked, "host", "left").withColumns({"rule": rule, "__verdict": verdict})
    own = F.when(F.col("__blocked"), "block").otherwise("allow")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("__verdict", own).alias("verdict"))


def _key(text: Column) -> Column:
    """Digest of a text without its white space; null for a text of white space only."""
    bare = F.regexp_replace(text, r"[\x20\x09-\x0D\u00A0]+", "")
    return F.when(bare != "", F.unhex(F.sha2(bare, 256)))


def _visible(markup: Column) -> Column:
    """The text of markup: no comments, scripts, styles and tags, entities resolved."""
    text = F.regexp_replace(markup, r"(?si)<!--.*?-->|<(script|style)\b.*?</\1\s*>|<[^>]*>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def labelled_outcomes(pages: DataFrame, documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Outcomes of pages by host, from labels of the documents that they show: host, n, bad.

    A page shows a labelled document when the text of its article (else main, else body) is the whole text of the document,
    with or without a first heading before it, white space aside. A label is bad when quality is 0 or toxic is 1. Each page
    counts once; where labels of equal documents differ, it is bad by the share of bad ones. Pages and documents without
    text show nothing. Labels are counted by digest before pages meet them, so neither common texts nor a large host make
    more rows than there are texts.
    """
    bad = (F.coalesce(F.col("quality"), F.lit(1)) == 0) | (F.coalesce(F.col("toxic"), F.lit(0)) == 1)
    marks = labels.select("doc_id", bad.cast("long").alias("bad"))
    keys = documents.select("doc_id", _key(F.col("text")).alias("key")).filter("key is not null")
    known = keys.join(marks, "doc_id").groupBy("key").agg(F.count(F.lit(1)).alias("labels"), F.sum("bad").alias("bad"))
    inside = [F.nullif(F.regexp_extract("html", rf"(?si)<{name}\b[^>]*>(.*)</{name}\s*>", 1), F.lit("")) for name in ("article", "main", "body")]
    whole = F.coalesce(*inside, F.col("html"))
    later = F.regexp_replace(whole, r"(?si)^.*?<h1\b[^>]*>.*?</h1\s*>", "")
    shown = pages.filter("html is not null").select(host_of(F.col("url")).alias("host"), whole.alias("whole"), later.alias("later"))
    found = F.array_distinct(F.array(_key(_visible(F.col("whole"))), _key(_visible(F.col("later")))))
    shown = shown.select("host", found.alias("keys")).groupBy("host", "keys").agg(F.count(F.lit(1)).alias("pages")).select("host", "pages", F.explode("keys").alias("key")).filter("key is not null")
    # exact decimals, so that the order in which sums are made can't move a verdict
    share = (F.col("pages") * F.col("bad") / F.col("labels")).cast("decimal(28,9)")
    return shown.join(known, "key").groupBy("host").agg(F.sum("pages").alias("n"), F.sum(share).cast("double").alias("bad"))
