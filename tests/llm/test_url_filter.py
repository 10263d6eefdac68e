import re

from rarespark.llm.queries import URL_RULES
from rarespark.llm.url_filter import judge_urls

URLS = [
    "https://a.example.org/es/x", "http://EXAMPLE.org/en/1234?q=1", "http://example.org/en/2", "http://notexample.org/es/", "http://x.com/fr/",
    "http://x.com/de/1", "http://x.com", "ftp://m.spam.net/a/?utm_source=z&k=1#f", "https://spam.net/a?k=1", "http://spam.net:80/a.html?k=1",
    "http://spam.net/a?k=2", "no scheme", "", None, "://", "http://", "http://y.net?x#/z", "http://org/", "http://z.net/\n/é", "http://spam.net/a/?k=1",
]


def brute(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    best = None
    for verdict, rule in URL_RULES:
        site, _, start = rule.partition("/")
        if (host == site or host.endswith("." + site)) and path.startswith("/" + start) and (best is None or len(rule) > len(best[1])):
            best = (verdict, rule)
    return host, path, best


def test_against_brute_force(spark):
    rows = list(enumerate(URLS * 3))
    pages = spark.createDataFrame(rows, "page_id bigint, url string").selectExpr("*", "1 AS _block", "2 AS _url", "3 AS listed", "4 AS host")
    listed = spark.createDataFrame([("https://www.spam.net/a?k=1",), (None,), ("nonsense",)], "url string")
    got = {r.page_id: r for r in judge_urls(pages, URL_RULES, listed).collect()}
    assert len(got) == len(rows)
    hit = {"ftp://m.spam.net/a/?utm_source=z&k=1#f", "https://spam.net/a?k=1", "http://spam.net:80/a.html?k=1", "http://spam.net/a/?k=1"}
    for page_id, url in rows:
        host, path, best = brute(url)
        want = best or ("block" if url in hit else "allow", None)
        assert (got[page_id].host, got[page_id].path, got[page_id].verdict, got[page_id].rule) == (host, path, *want), url


def test_false_positives_of_the_filter_are_removed(spark, monkeypatch):
    from rarespark.llm import url_filter

    monkeypatch.setattr(url_filter, "MAX_BLOCKS", 1)
    monkeypatch.setattr(url_filter, "MIN_BLOCKS", 1)
    listed = spark.range(3000).selectExpr("concat('http://l.net/', id) AS url")
    pages = spark.range(6000).selectExpr("id AS page_id", "concat('http://l.net/', id) AS url")
    got = judge_urls(pages, [], listed)
    assert got.where("verdict = 'block'").count() == 3000 == got.where("verdict = 'block' AND page_id < 3000").count()


def test_empty_tables(spark):
    none = spark.createDataFrame([], "page_id bigint, url string")
    assert judge_urls(none, URL_RULES, none).count() == 0
    pages = spark.createDataFrame([(1, "http://a.net/")], none.schema)
    assert judge_urls(pages, [], none).first().verdict == "allow"


def test_query_finds_other_spellings_of_listed_urls(spark, tmp_path):
    """Pages of the query's list by digest of one spelling; their other spellings carry other digests."""
    from hashlib import md5

    from rarespark.llm.queries import op1_url_filter

    spelled = [[f"https://www.site{i}.net/a{i}/", f"http://site{i}.net/a{i}.html", f"http://m.site{i}.net:80/a{i}?utm_source=x"] for i in range(200)]
    rows = [(3 * i + k, url) for i, forms in enumerate(spelled) for k, url in enumerate(forms)]
    spark.createDataFrame(rows, "page_id bigint, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r.verdict for r in op1_url_filter(spark, str(tmp_path)).collect()}
    begins = lambda url: md5(url.encode()).hexdigest().startswith("0")
    want = {3 * i + k: "block" if any(map(begins, forms)) else "allow" for i, forms in enumerate(spelled) for k in range(3)}
    assert got == want
    blocked = [p for p, v in got.items() if v == "block"]
    listed = [p for p, u in rows if begins(u)]
    assert len(listed) < len(blocked) < len(rows) / 2
