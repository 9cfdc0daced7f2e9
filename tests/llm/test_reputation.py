"""URL verdicts against a plain program and by cases."""

import math
import re
from collections import Counter

import duckdb
import pytest

from kerbline.llm import reputation as R
from kerbline.llm.catalog import ORACLES, QUERIES

URLS = [
    None, "", "no scheme", "://", "http://", "HTTP://A.ORG/x", "http://example.org/es/1", "http://sub.Example.ORG/es/1", "http://notexample.org/es/1", "http://example.org/en/12", "http://example.org/en/2",
    "http://a.com/fr/1?x=://b.org/", "http://a.com/de/", "http://a.com/de", "http://com/fr/x", "http://xcom/fr/x", "http://org?q", "http://a.b.co.uk/1", "http://user@h.net:80/x#f?g", "http://10.0.0.1/de/", "http://[::1]/x",
    "http://a.net./x", "http://É.org/\n/x", "http://a.org/es/", "x://y://z.com/fr/", "http://example.org/" + "y" * 5000,
]


def split(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    return (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")


def level(host):
    bare = re.sub(r":[0-9]*\Z", "", re.sub(r"\A.*@", "", host))
    labels = bare.rstrip(".").split(".")
    k = 2 if len(labels) > 1 and len(labels[-1]) == 2 and labels[-2] in R.SECOND else 1
    if re.fullmatch(r"[0-9.]*", bare) or bare.startswith("[") or len(labels) <= k:
        return bare, ""
    return ".".join(labels[-k - 1 :]), ".".join(labels[-k:])


def weight(rows):
    over = sum((s - n * r) ** 2 - n * r * (1 - r) for n, s, r in rows)
    under = sum(n * (n - 1) * r * (1 - r) for n, s, r in rows)
    share = min(R.MOST_SPREAD, max(R.LEAST_SPREAD, over / under if under else R.LEAST_SPREAD))
    return (1 - share) / share


def plain(urls):
    pages = [split(u) for u in urls]
    found = []
    for host, path in pages:
        fit = [(len(h + p), h + p, v) for v, h, p in R.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        found.append(max(fit)[1:] if fit else (None, None))
    n, s = Counter(), Counter()
    for (host, _), (_, v) in zip(pages, found, strict=True):
        n[host] += v is not None
        s[host] += v == "block"
    dn, ds, sn, ss = Counter(), Counter(), Counter(), Counter()
    for host in n:
        d, x = level(host)
        dn[d, x] += n[host]
        ds[d, x] += s[host]
        sn[x] += n[host]
        ss[x] += s[host]
    rate = {x: (sum(ss.values()) - ss[x] + 1) / (sum(sn.values()) - sn[x] + 2) for x in sn}
    w = weight([(sn[x], ss[x], r) for x, r in rate.items()])
    mid = {k: (ss[k[1]] - ds[k] + w * rate[k[1]]) / (sn[k[1]] - dn[k] + w) for k in dn}
    w = weight([(dn[k], ds[k], r) for k, r in mid.items()])
    own = {h: (ds[level(h)] - s[h] + w * mid[level(h)]) / (dn[level(h)] - n[h] + w) for h in n}
    w = weight([(n[h], s[h], r) for h, r in own.items()])
    bound = {}
    for h, r in own.items():
        a, b = s[h] + w * r, n[h] - s[h] + w * (1 - r)
        m = a / (a + b)
        bound[h] = m - R.WIDTH * math.sqrt(m * (1 - m) / (a + b + 1))
    return [(str(i), h, p, rule, v or ("block" if bound[h] > R.MOST else "allow"), round(bound[h], 6)) for i, ((h, p), (rule, v)) in enumerate(zip(pages, found, strict=True))]


def got(df):
    return sorted([tuple(map(str, r[:3])) + tuple(r[3:]) for r in R.judge(df).collect()], key=lambda r: int(r[0]))


@pytest.mark.parametrize("hot", [20_000, 2])
def test_equal_to_a_plain_program(spark, monkeypatch, hot):
    monkeypatch.setattr(R, "HOT", hot)
    urls = [*URLS, *[f"http://bad.spam.com/{'de' if i % 9 else 'fr'}/{i}" for i in range(300)], *[f"http://h{i % 7}.example.org/{x}/1{i}" for i in range(60) for x in ("es", "en", "it")], *[f"http://q{i}.net/" for i in range(9)], "http://bad.spam.com/other", "http://new.spam.com/other"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").repartition(5)
    want = plain(urls)
    assert [r[:5] for r in got(df)] == [r[:5] for r in want]
    assert all(abs(a[5] - b[5]) <= 1.1e-6 for a, b in zip(got(df), want, strict=True))
    verdict = {u: r[4] for u, r in zip(urls, want, strict=True)}
    assert verdict["http://bad.spam.com/other"] == "block" and verdict["http://q3.net/"] == "allow"


def test_clashing_names_and_empty_table(spark):
    names = "page_id long, url string, host string, path string, rule string, verdict string, bound double, n long, s long, says string, _salt int, domain string, suffix string"
    rows = [(i % 20, u, *["?"] * 4, 0.0, 0, 0, "?", 0, "?", "?") for i, u in enumerate(URLS)] + [(None, "http://a.org/", *["?"] * 4, 0.0, 0, 0, "?", 0, "?", "?")] * 2
    out = R.judge(spark.createDataFrame(rows, names))
    assert out.count() == len(rows)
    assert R.judge(spark.createDataFrame([], names)).count() == 0


def test_no_python_in_the_plan_and_twin(spark):
    folder = "/root/testdata/sf0.001"
    df = QUERIES["op12_url_filter"](spark, folder)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{folder}/pages.parquet'")
    want = con.execute(f"select page_id, host, path, rule, verdict, bound from ({ORACLES['op12_url_filter']}) order by 1").fetchall()
    assert sorted(tuple(r) for r in df.collect()) == want
