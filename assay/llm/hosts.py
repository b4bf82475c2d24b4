"""Judging urls by rules and by the reputation of their hosts.

Pages with a known outcome (bad or not) are counted by host. The share of bad pages is shrunk level
by level: all pages give the prior of a suffix, a suffix that of its registered domains, a domain
that of its hosts. Every prior is a beta distribution around the level above; how narrow it is, is
estimated from how much the units of the level really differ (method of moments over all of them).
A host is blocked when the lower bound of its posterior lies above the threshold: few bad pages, or
a bad neighbourhood with no pages of its own, are not enough.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.functions.hot import join_counted
from assay.llm.texts import named
from assay.session import cut_lineage

#: suffixes of two labels under which names are registered (a parameter; add those you meet)
SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "ne.jp",
            "or.jp", "co.kr", "com.br", "com.cn", "com.tw", "co.in", "co.za", "com.mx", "com.tr")
#: share of bad pages that a host must surely exceed, and standard deviations that count as surely
THRESHOLD, Z = 0.5, 1.645
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: narrowest and widest prior (correlation of two pages of a unit)
_LEAST, _MOST = 1e-4, 0.999


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lowered; null gives empty text."""
    return F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; null gives empty text."""
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def domain_columns(host: Column, suffixes: Sequence[str] = SUFFIXES) -> tuple[Column, Column]:
    """(registered domain, suffix) of a host, without user names and ports; addresses are their own."""
    bare = F.regexp_replace(host, r"^.*@|:[0-9]*$", "")
    last = F.substring_index(bare, ".", -1)
    two = F.substring_index(bare, ".", -2)
    suffix = F.when(two.isin(*suffixes), two).otherwise(last) if suffixes else last
    domain = F.when(suffix == two, F.substring_index(bare, ".", -3)).otherwise(two)
    address = bare.rlike(r"^([0-9.]+|\[.*\])$")
    return F.when(address, bare).otherwise(domain), F.when(address, bare).otherwise(suffix)


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls.

    A rule is (verdict, ``host/path``). It fits its host and all subdomains if the path starts with
    its own, slash included. Of equally long rules the one with the longer host counts, then a block.
    The rules travel in the plan: this is for lists that people write.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(set(rules), key=lambda r: (len(r[1]), r[1].find("/"), r[0] == "block", r[1])):
        name, slash, below = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + below)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def _correlation(units: DataFrame, mean: Column) -> float:
    """How alike the outcomes of one unit are beyond ``mean``, 0 to 1, from all units that have any.

    A unit of n outcomes with b bad ones has E (b - n p)^2 / (n p (1 - p)) = 1 + (n - 1) rho.
    """
    p = F.greatest(F.least(mean, F.lit(1 - 1e-6)), F.lit(1e-6))
    spread = (F.col("bad") - F.col("n") * p) ** 2 / (F.col("n") * p * (1 - p))
    row = units.where("n > 0").agg(F.sum(spread - 1).alias("over"), F.sum(F.col("n") - 1).alias("pairs")).first()
    if not row.pairs:
        return 0.5
    return min(_MOST, max(_LEAST, row.over / row.pairs))


def reputations(outcomes: DataFrame, hosts: DataFrame, suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """(host, pages, labelled, bad_share, bound) for each host of ``hosts`` (host, pages).

    ``outcomes`` has (host, n, bad): counted pages and bad ones. ``bad_share`` is the posterior mean,
    ``bound`` the mean less ``Z`` standard deviations. Hosts without outcomes have their domain's prior.
    """
    domain, suffix = domain_columns(F.col("host"), suffixes)
    counted = cut_lineage(hosts.join(outcomes, "host", "left").na.fill(0, ["n", "bad"])
                          .withColumns({"domain": domain, "suffix": suffix}))
    total = counted.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    top = ((total.bad or 0) + 0.5) / ((total.n or 0) + 1)

    def sums(rows: DataFrame, *by: str) -> DataFrame:
        return rows.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.count(F.lit(1)).alias("units"))

    domains = cut_lineage(sums(counted, "domain", "suffix"))
    above = sums(domains, "suffix")
    rho = _correlation(above, F.lit(top))
    k = (1 - rho) / rho
    priors = above.select("suffix", "units", ((F.col("bad") + k * top) / (F.col("n") + k)).alias("prior"))
    domains = cut_lineage(join_counted(domains, priors, ["suffix"], "units"))
    rho = _correlation(domains, F.col("prior"))
    k = (1 - rho) / rho
    priors = domains.select("domain", "suffix", "units", ((F.col("bad") + k * F.col("prior")) / (F.col("n") + k)).alias("prior"))
    counted = cut_lineage(join_counted(counted, priors, ["domain", "suffix"], "units"))
    rho = _correlation(counted, F.col("prior"))
    k = (1 - rho) / rho
    mean = (F.col("bad") + k * F.col("prior")) / (F.col("n") + k)
    bound = mean - Z * F.sqrt(mean * (1 - mean) / (F.col("n") + k + 1))
    return counted.select("host", "pages", F.col("n").alias("labelled"), mean.alias("bad_share"), bound.alias("bound"))


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str]], id_col: str = "page_id",
               url_col: str = "url", key: Column | None = None, threshold: float = THRESHOLD,
               suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, labelled, bad_share, bound.

    ``outcomes`` has (key, bad): a page's key (column ``key``, the page's id by default) and whether
    such pages are bad; null keys and values are left out, of repeated keys any bad one counts.
    A rule decides where one fits; else the host is blocked if its ``bound`` exceeds ``threshold``.
    A null url, or one without ``://``, has an empty host and path; all of these share one
    reputation. Repeated rows are judged alike, an empty table gives no rows, other columns are not
    read.
    """
    url = F.coalesce(named(url_col).cast("string"), F.lit(""))
    rows = pages.select(named(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"),
                        (named(id_col) if key is None else key).alias("key"))
    known = outcomes.where("key is not null and bad is not null").groupBy("key").agg(
        F.max(F.col("bad").cast("int")).alias("bad"))
    # pages of one host and key are one row before they meet the outcomes, so no key repeats within a host
    seen = cut_lineage(rows.groupBy("host", "key").agg(F.count(F.lit(1)).alias("pages")))
    counts = seen.join(known, "key").groupBy("host").agg(
        F.sum("pages").alias("n"), F.sum(F.col("pages") * F.col("bad")).alias("bad"))
    hosts = seen.groupBy("host").agg(F.sum("pages").alias("pages"))
    judged = join_counted(rows.drop("key"), reputations(counts, hosts, suffixes), ["host"], "pages")
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("bound") > threshold, "block").otherwise("allow")
    return judged.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"),
                         "labelled", "bad_share", "bound")
