"""URL filters: rules by host and path, and for the rest the reputation of the host.

A rule (verdict, host, path) fits its host and all subdomains when the URL's path starts with the rule's path; the longest
fitting rule decides. The pages that a rule decides are the labelled outcomes (1: blocked, 0: allowed); a
caller may pass other outcomes. They are counted by host, registered domain and suffix, and block rates
are shrunk level by level with beta-binomial priors: a suffix towards the rate of all other suffixes, a domain towards its
suffix without the domain, a host towards its domain without the host. A level's prior weight comes from
the data: the share of a rate's spread that counts alone do not explain (moments of the beta-binomial
distribution). A page is blocked when its host's block rate is above ``MOST`` with a margin: posterior mean less
``WIDTH`` standard deviations. A host without outcomes takes its domain's prior, a page is allowed when nothing is known.

The registered domain is the suffix and the label before it. A suffix is the last label, or the last two if a two-letter country
label follows one of ``SECOND`` (no suffix list is read). Port and user name do not count; a host that is an address
or a single label is its own domain.

All is DataFrame expressions. Outcomes shrink to one row a host before they move; pages meet their host's row in a salted
join, so a host with a third of all pages is spread over tasks. A null URL, or one without ``://``, has an empty host and
path, fits no rule and belongs to the empty host. Repeated rows count each time and come out each; an empty table gives
no rows. Of other columns none is read; long URLs are read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbline.operators.skew import salted_join
from kerbline.session import materialise

#: The rules of the page query (verdict, host, path).
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
#: Labels that form a suffix together with a country label after them.
SECOND = ["ac", "co", "com", "edu", "gov", "net", "org"]
MOST = 0.5
WIDTH = 1.645  # one-sided 95 % of a normal distribution
LEAST_SPREAD, MOST_SPREAD = 0.001, 0.9  # bounds of the share of spread: prior weights of 999 and of 0.11 outcomes
HOT = 20_000  # pages of a hash bucket of hosts from which it is spread
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)\A.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule as text (host and path), and its verdict; null where none fits. Of equal texts the first counts."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the longest is asked first
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        text, verdict = F.when(fits, F.lit(h + p)).otherwise(text), F.when(fits, F.lit(says)).otherwise(verdict)
    return text, verdict


def levels(host: Column) -> tuple[Column, Column]:
    """Registered domain and suffix."""
    bare = F.regexp_replace(F.regexp_replace(host, r"\A.*@", ""), r":[0-9]*\z", "")
    parts = F.split(F.regexp_replace(bare, r"\.+\z", ""), r"\.")
    n = F.size(parts)
    two = (F.length(F.element_at(parts, -1)) == 2) & (n > 1) & F.try_element_at(parts, F.lit(-2)).isin(SECOND)
    k = F.when(two, 2).otherwise(1)
    tail = lambda m: F.array_join(F.slice(parts, F.greatest(n - m + 1, F.lit(1)), m), ".")
    alone = bare.rlike(r"\A[0-9.]*\z|\A\[.*\z") | (n <= k)
    return F.when(alone, bare).otherwise(tail(k + 1)), F.when(alone, F.lit("")).otherwise(tail(k))


def _spread(df: DataFrame, n: str, s: str, rate: str) -> Column:
    """Share of the spread of rates that counts do not explain, over all rows, as a scalar."""
    nd, even = F.col(n).cast("double"), F.col(rate) * (1 - F.col(rate))
    over = F.sum((F.col(s) - nd * F.col(rate)) ** 2 - nd * even)
    share = F.least(F.lit(MOST_SPREAD), F.greatest(F.lit(LEAST_SPREAD), F.coalesce(F.try_divide(over, F.sum(nd * (nd - 1) * even)), F.lit(LEAST_SPREAD))))
    return df.agg(share.alias("share")).scalar()


def _weight(share: Column) -> Column:
    return (1 - share) / share


def host_rates(outcomes: DataFrame) -> DataFrame:
    """(host, a, b): the beta distribution of every host's block rate.

    ``outcomes``: host, n (labelled pages, may be 0), s (those blocked); one row a host.
    """
    domain, suffix = levels(F.col("host"))
    hosts = materialise(outcomes.select("host", domain.alias("domain"), suffix.alias("suffix"), "n", "s"), "hosts")
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("dn"), F.sum("s").alias("ds"))
    suffixes = domains.groupBy("suffix").agg(F.sum("dn").alias("sn"), F.sum("ds").alias("ss"))
    all_ = suffixes.agg(F.struct(F.coalesce(F.sum("sn"), F.lit(0)).alias("n"), F.coalesce(F.sum("ss"), F.lit(0)).alias("s")).alias("t")).scalar()
    rest = (all_.s - F.col("ss") + 1) / (all_.n - F.col("sn") + 2)  # of all other suffixes, one of each outcome added
    suffixes = materialise(suffixes.withColumn("rate", rest), "suffixes")
    w = _weight(_spread(suffixes, "sn", "ss", "rate"))
    under = domains.join(suffixes, "suffix").withColumn("rate", (F.col("ss") - F.col("ds") + w * F.col("rate")) / (F.col("sn") - F.col("dn") + w))
    under = materialise(under.select("domain", "suffix", "dn", "ds", "rate"), "domains")
    w = _weight(_spread(under, "dn", "ds", "rate"))
    own = hosts.join(under, ["domain", "suffix"]).withColumn("rate", (F.col("ds") - F.col("s") + w * F.col("rate")) / (F.col("dn") - F.col("n") + w))
    own = materialise(own.select("host", "n", "s", "rate"), "rates")
    w = _weight(_spread(own, "n", "s", "rate"))
    return own.select("host", (F.col("s") + w * F.col("rate")).alias("a"), (F.col("n") - F.col("s") + w * (1 - F.col("rate"))).alias("b"))


def bound(a: Column, b: Column) -> Column:
    """Posterior mean of a beta distribution less ``WIDTH`` standard deviations."""
    mean = a / (a + b)
    return mean - WIDTH * F.sqrt(mean * (1 - mean) / (a + b + 1))


def judge(df: DataFrame, url: str = "url", page_id: str = "page_id", rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, bound) for every page; ``bound`` is that of the host's block rate."""
    pages = df.select(F.col(page_id).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    text, says = rule_of(F.col("host"), F.col("path"), rules)
    pages = pages.withColumns({"rule": text, "says": says})
    outcomes = pages.groupBy("host").agg(F.count("says").alias("n"), F.count_if(F.col("says") == "block").alias("s"))
    known = materialise(host_rates(outcomes).select("host", bound(F.col("a"), F.col("b")).alias("bound")), "bounds")
    judged = salted_join(pages, known, ["host"], ["page_id", "path"], min_rows=HOT)
    verdict = F.coalesce("says", F.when(F.col("bound") > MOST, F.lit("block")).otherwise(F.lit("allow")))
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.round("bound", 6).alias("bound"))


#: The same verdicts in SQL (production parameters).
JUDGE_SQL = r"""
    with p as (
        select page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
            coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') as path
        from pages),
    rules(verdict, h, start) as (values ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
    hp as (select distinct host, path from p),
    fit as (
        select host, path, arg_max(h || start, length(h || start)) as rule, arg_max(verdict, length(h || start)) as says
        from hp join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, start) group by host, path),
    r as (select p.*, fit.rule, fit.says from p left join fit on fit.host = p.host and fit.path = p.path),
    o as (
        select host, count(says)::double as n, (count(*) filter (says = 'block'))::double as s,
            regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') as bare from r group by host),
    parts as (select *, string_split(regexp_replace(bare, '\.+$', ''), '.') as l from o),
    lv as (select *, len(l) as k, case when length(l[-1]) = 2 and len(l) > 1 and l[-2] in ('ac', 'co', 'com', 'edu', 'gov', 'net', 'org') then 2 else 1 end as m from parts),
    hosts as (
        select host, n, s, regexp_matches(bare, '^[0-9.]*$') or starts_with(bare, '[') or k <= m as alone,
            case when alone then bare else array_to_string(l[-(m + 1):], '.') end as domain, case when alone then '' else array_to_string(l[-m:], '.') end as suffix from lv),
    d as (select domain, suffix, sum(n) as dn, sum(s) as ds from hosts group by all),
    x as (select suffix, sum(dn) as sn, sum(ds) as ss from d group by all),
    xr as (select *, (sum(ss) over () - ss + 1) / (sum(sn) over () - sn + 2) as rate from x),
    xw as (select least(0.9, greatest(0.001, coalesce(sum((ss - sn * rate) ** 2 - sn * rate * (1 - rate)) / nullif(sum(sn * (sn - 1) * rate * (1 - rate)), 0), 0.001))) as c from xr),
    dr as (select domain, d.suffix, dn, ds, (ss - ds + (1 - c) / c * rate) / (sn - dn + (1 - c) / c) as rate from d join xr on xr.suffix = d.suffix, xw),
    dw as (select least(0.9, greatest(0.001, coalesce(sum((ds - dn * rate) ** 2 - dn * rate * (1 - rate)) / nullif(sum(dn * (dn - 1) * rate * (1 - rate)), 0), 0.001))) as c from dr),
    hr as (
        select host, n, s, (ds - s + (1 - c) / c * rate) / (dn - n + (1 - c) / c) as rate
        from hosts join dr on dr.domain = hosts.domain and dr.suffix = hosts.suffix, dw),
    hw as (select least(0.9, greatest(0.001, coalesce(sum((s - n * rate) ** 2 - n * rate * (1 - rate)) / nullif(sum(n * (n - 1) * rate * (1 - rate)), 0), 0.001))) as c from hr),
    post as (select host, s + (1 - c) / c * rate as a, n - s + (1 - c) / c * (1 - rate) as b from hr, hw),
    known as (select host, a / (a + b) - 1.645 * sqrt(a / (a + b) * (1 - a / (a + b)) / (a + b + 1)) as bound from post)
    select page_id, r.host, path, rule, coalesce(says, case when bound > 0.5 then 'block' else 'allow' end) as verdict, round(bound, 6) as bound
    from r join known on known.host = r.host"""
