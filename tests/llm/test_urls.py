import re

from rentalytics.llm.urls import SITE_RULES, WORDS, Index, Rule, judge, query, site_rule
from tests.llm.data import CLASHING

FIXED = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"),
         ("block", "com", "/de/"))


def by_hand(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for v, h, p in FIXED if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        _, rule, verdict = max(fits)
        return host, path, rule, verdict
    bad = any(w in WORDS for w in re.split(r"[^a-z0-9]+", host))
    return host, path, None, "block" if bad else "allow"


URLS = [
    None, "", "example.org/es/", "http://", "http://example.org", "http://example.org/", "http://EXAMPLE.org/es/1", "x://y.Example.Org/en/12?q",
    "http://notexample.org/es/", "http://a.com/fr/x", "http://a.com/FR/x", "http://com/de/", "http://acom/de/", "http://a.com/de",
    "http://cheap-pills.net/x", "http://b.net/pills", "http://a.org/x://b.com/de/", "http://a.net?x=http://b.org/", "http://a.com#/fr/",
    "ftp://user@example.org:80/es/", "http://example.org/en/1", "http://example.org/en/2", "http://pillscasino.net/", "http://é-spam.net/",
]


def test_against_brute_force(spark):
    rows = [(i, u) for i, u in enumerate(URLS)] * 2
    out = judge(spark.createDataFrame(rows, "page_id long, url string"), "url", query_rules()).collect()
    assert len(out) == 2 * len(URLS)
    for r in out:
        assert (r.host, r.path, r.rule, r.verdict) == by_hand(URLS[r.page_id]), URLS[r.page_id]


def query_rules():
    from rentalytics.llm.urls import WORD_RULES

    return (*SITE_RULES, *WORD_RULES)


def test_query(spark, sf_dir):
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    out = query(spark, sf_dir).collect()
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in out} == {i: by_hand(u) for i, u in pages.items()}


def test_query_equals_sql(spark, sf_dir):
    from rentalytics.llm.urls import SQL
    from tests.compare import connect, differences

    assert differences(query(spark, sf_dir), connect(sf_dir), SQL) == ""


def test_only_candidates_are_tried():
    index = Index([site_rule("block", f"site{i}.com/a/") for i in range(100)], {"com": 1000, "a": 500})
    assert all(len(v) == 1 for v in index.by_token.values()) and not index.always
    assert index.best("www.site7.com/a/b").text == "site7.com/a/"
    assert len(index._compiled) == 1


def test_rules_without_tokens_and_ties():
    rules = [Rule("*", "allow", r"\A", ()), Rule("ab", "block", "ab", ()), Rule("ac", "allow", "a", ())]
    assert Index(rules, {}).best("xab").text == "ab"
    assert Index(rules, {}).best("zzz").text == "*"


def test_awkward_rows(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, None), (None, "http://a.com/fr/"), (1, None)], "page_id long, url string")
    df = df.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASHING])
    out = judge(df, "url", SITE_RULES)
    rows = out.collect()
    assert len(rows) == 3 and {r.row for r in rows} == {"own row"}
    assert out.columns[-4:] == ["host", "path", "rule", "verdict"] and len(out.columns) == len(set(out.columns))
    assert judge(df.filter("false"), "url", SITE_RULES).count() == 0
