"""Empirical-Bayes host reputation.

Pages that a rule fits have an outcome: blocked or allowed. A host's share
of blocked pages is drawn towards that of its registered domain, which is
drawn towards that of its suffix, which is drawn towards the share of all.
Each step is a beta prior with the parent's posterior mean; how strongly it
draws is estimated from all groups of that level by their moments. Pages
without a rule are blocked if the lower bound of the host's posterior is
over ``threshold``, so a host of which little is known is judged by its
domain, and one of which much is known by its own pages.

Counting is one aggregation by host, pre-summed before the shuffle, so a host
with a third of all pages is a few rows. The levels above aggregate that
table; what the driver sees is five sums for each level. A null url or one
without ``://`` has an empty host and path; all of these are one host.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexprep.llm.arrow import free_name
from lexprep.llm.tables import quoted, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (Rule("net", "/", "block"), Rule("example.net", "/en/", "allow"), Rule("example.com", "/de/", "block"),
         Rule("org", "/fr/", "allow"))


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def url_host(url: Column) -> Column:
    """What stands between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(name, verdict) of the longest rule that fits, else null."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):  # the last that fits wins
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name, verdict = F.when(fits, F.lit(r.name)).otherwise(name), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return name, verdict


#: labels under which a top-level domain of two letters registers names (``co.uk``, ``com.br``): a short list, not the
#: public one, which is longer and changes
GENERIC = ("ac", "co", "com", "edu", "go", "gob", "gouv", "gov", "ne", "net", "or", "org")
_PORT = r":[0-9]*\z"
_NUMERIC = r"\A(?:[0-9.]+|\[.*)\z"
_TOP = rf"(?:(?:{'|'.join(GENERIC)})\.[a-z][a-z]|[^.]*)"
_SUFFIX = rf"(?:\A|\.)({_TOP})\z"
_DOMAIN = rf"(?:\A|\.)([^.]*\.{_TOP})\z"


def registered_domain(host: Column) -> Column:
    """The label before the suffix, and the suffix. A host of one label, one that is a suffix and a numeric one is its
    own domain; a port does not count."""
    bare = F.regexp_replace(host, _PORT, "")
    found = F.regexp_extract(bare, _DOMAIN, 1)
    return F.when(bare.rlike(_NUMERIC) | (found == ""), bare).otherwise(found)


def suffix(host: Column) -> Column:
    """The last label, or two where the last has two letters and the one before is of ``GENERIC``; a numeric host whole."""
    bare = F.regexp_replace(host, _PORT, "")
    return F.when(bare.rlike(_NUMERIC), bare).otherwise(F.regexp_extract(bare, _SUFFIX, 1))


def strength(groups: DataFrame, default: float = 2.0) -> tuple[float, float]:
    """(share, k): the share of bad outcomes and the weight, in outcomes, of a prior for groups (n, bad).

    Moments: if groups had one share, the squares of their distances would have a known sum; the excess gives k."""
    n, bad = F.col("n"), F.col("bad")
    r = groups.where(n > 0).agg(F.count(F.lit(1)).alias("m"), F.sum(n).alias("n"), F.sum(bad).alias("bad"),
                                F.sum(bad * bad / n).alias("sq"), F.sum(n * n).alias("nn")).first()
    if not r["n"]:
        return 0.5, default
    p = (r["bad"] + 0.5) / (r["n"] + 1.0)
    raw = r["bad"] / r["n"]
    between = r["sq"] - r["n"] * raw * raw
    room = r["n"] - r["nn"] / r["n"] - (r["m"] - 1)
    if room <= 0 or raw in (0.0, 1.0):
        return p, default
    g = (between / (raw * (1 - raw)) - (r["m"] - 1)) / room
    g = min(max(g, 0.01), 0.9)
    return p, 1 / g - 1


def host_reputation(outcomes: DataFrame, z: float = 1.64) -> DataFrame:
    """(host, share, bound): posterior mean of the share of bad outcomes and its lower bound, for every host.

    ``outcomes`` has host and bad (1, 0, or null where nothing is known)."""
    hosts = written(outcomes.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
                    .withColumns({"domain": registered_domain(F.col("host")), "suffix": suffix(F.col("host"))}), "hosts")
    sums = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    domains = written(hosts.groupBy("suffix", "domain").agg(*sums), "domains")
    suffixes = written(domains.groupBy("suffix").agg(*sums), "suffixes")
    share, k = strength(suffixes)
    n, bad = F.col("n"), F.col("bad")
    top = suffixes.select("suffix", ((bad + k * share) / (n + k)).alias("of_suffix"))
    _, k = strength(domains)
    mid = domains.join(top, "suffix").select("suffix", "domain", ((bad + F.lit(k) * F.col("of_suffix")) / (n + F.lit(k))).alias("of_domain"))
    mid = written(mid, "domain_shares")
    _, k = strength(hosts)
    a = bad + F.lit(k) * F.col("of_domain")
    b = n - bad + F.lit(k) * (1 - F.col("of_domain"))
    mean = a / (a + b)
    return written(hosts.join(mid, ["suffix", "domain"]).select(
        "host", mean.alias("share"), (mean - z * F.sqrt(mean * (1 - mean) / (a + b + 1))).alias("bound")), "reputation")


def judged(pages: DataFrame, url_col: str = "url", rules=RULES, threshold: float = 0.5, z: float = 1.64,
           name: str = "judged") -> DataFrame:
    """``pages`` and a struct ``name``: host, path, rule (or null), share, bound, verdict. If ``pages`` has a column of
    that name, underscores are put behind the struct's. Repeated rows count each time; an empty table gives an empty
    one; ties between rules of one length go to the first."""
    url, own = F.col(quoted(url_col)), [f"c{k}" for k in range(len(pages.columns))]
    rows = pages.select(*[F.col(quoted(c)).alias(k) for c, k in zip(pages.columns, own)], url_host(url).alias("host"), url_path(url).alias("path"))
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "fixed": verdict})
    bad = F.when(F.col("fixed") == "block", 1).when(F.col("fixed") == "allow", 0)
    known = host_reputation(rows.select("host", bad.alias("bad")), z)
    out = rows.join(known, "host", "left")
    by_host = F.when(F.col("bound") > threshold, "block").otherwise("allow")
    return out.select(*[F.col(k).alias(c) for c, k in zip(pages.columns, own)], F.struct(
        "host", "path", "rule", "share", "bound", F.coalesce("fixed", by_host).alias("verdict")).alias(free_name(pages, name)))


def keep_allowed(pages: DataFrame, url_col: str = "url", **options) -> DataFrame:
    """The pages that are not blocked, with the columns they came with."""
    name = free_name(pages, "judged")
    return judged(pages, url_col, name=name, **options).where(F.col(name)["verdict"] == "allow").drop(name)
