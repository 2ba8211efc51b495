from data import table_of
from pyspark.sql import functions as F

from logsieve.llm import url_filter as uf

URLS = [
    (1, "http://a.example.com/en/1"), (2, "HTTP://WWW.Example.COM/en/x?y"), (3, "https://b.org/es/2#t"), (4, None), (5, "no scheme"),
    (6, "http://x.net/es/1"), (6, "http://x.net/es/1"), (7, "http://x.net/de/1"), (8, "http://example.com"), (9, ""),
    (10, "ftp://u@evil.org:80/p/?q"), (11, "http://www.evil.org:80/P"), (12, "x://y://z/w"), (None, "http://notcom/en/"),
    (13, "http://acom/"), (14, "http://evil.org/p"), (15, "http://evil.org/p//"),
]


def expected(url, listed):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = ""
    while host != rest and rest[len(host)] not in "/?#":
        host += rest[len(host)]
    path = rest[len(host):]
    for c in "?#":
        path = path.split(c)[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fit = [r for r in uf.RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    rule = max(fit, key=lambda r: len(r[0] + r[1]), default=None)
    name = (host[4:] if host.startswith("www.") else host) + path.rstrip("/")
    hit = None if rule else bool(name) and name in listed
    return host, path, rule and rule[0] + rule[1], rule[2] if rule else "block" if hit else "allow", hit


def test_hard_urls(spark):
    pages = spark.createDataFrame([(i, u, "z", "z") for i, u in URLS], "page_id long, url string, host string, __url string")
    names = ["evil.org/p", "evil.org/p", None, "", "y:", "y:/z", "other"]
    listed = spark.createDataFrame([(n,) for n in names], "u string")
    got = uf.url_filter(pages, listed).select("page_id", "host", "path", "rule", "verdict", "listed").collect()
    assert table_of(got) == table_of((i, *expected(u, set(names) - {None, ""})) for i, u in URLS)
    assert uf.url_filter(pages.limit(0), listed).collect() == []
    assert uf.url_filter(pages, listed.limit(0)).filter("listed").count() == 0


def test_filter_misses_nothing_and_rejects_most(spark):
    listed = spark.range(20_000).select(F.concat(F.lit("h.org/"), "id").alias("listed_url"))
    urls = spark.range(0, 40_000).select(F.concat(F.lit("h.org/"), "id").alias("__url"), "id")
    bits = uf.bits_for(20_000)
    judged = uf.possible_hits(urls, uf.bloom_filter(listed, bits), bits)
    assert judged.filter("id < 20000 AND NOT __maybe").count() == 0
    assert judged.filter("id >= 20000 AND __maybe").count() < 400
    assert uf.bloom_filter(listed, bits).count() <= 2**bits


def test_filter_grows_with_the_list(spark, monkeypatch):
    assert [uf.bits_for(n) for n in (0, 1, 12, 13, 25, 12 * 2**18, 12 * 2**18 + 1)] == [1, 1, 1, 1, 2, 18, 19]
    assert uf.bits_for(10**12) == uf.MOST_BITS
    # beyond the size that is broadcast: the same verdicts, and the filter is left to the planner
    pages = spark.createDataFrame([(i, u) for i, u in URLS], "page_id long, url string")
    listed = spark.createDataFrame([("evil.org/p",), ("y:/z",)], "u string")
    want = table_of(uf.url_filter(pages, listed).collect())
    monkeypatch.setattr(uf, "BROADCAST_BITS", 0)
    assert table_of(uf.url_filter(pages, listed).collect()) == want


def test_list_and_filter_decide_on_the_shared_tables(spark):
    """Some listed page and some page that the filter alone would list reach the join; pages under one canonical url
    are judged alike though only one of them holds the marks."""
    sf = "/root/testdata/sf0.01"
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    out = uf.op1_url_filter(spark, sf)
    assert out.filter("listed").count() > 0 and out.filter("NOT listed AND rule IS NULL").count() > 0
    twin = spark.createDataFrame([(10**6, "https://www.only.org/a/?x", ""), (10**6 + 1, "http://only.org/a", "### $$$ %%%"),
                                  (10**6 + 2, "http://only.org/b", "### $$$"), (10**6 + 3, "http://only.org/c", None)],
                                 "page_id long, url string, html string")
    verdicts = {r.page_id: r.verdict for r in uf.url_filter(twin, uf.listed_urls(twin)).collect()}
    assert verdicts == {10**6: "block", 10**6 + 1: "block", 10**6 + 2: "allow", 10**6 + 3: "allow"}
    assert pages.count() == out.count()


def test_hot_url_stays_exact(spark):
    hot = F.col("id") % 3 > 0
    pages = spark.range(5000).select(F.col("id").alias("page_id"), F.when(hot, "http://junk.example.org/x").otherwise(
        F.concat(F.lit("http://ok.org/"), "id")).alias("url"), F.when(hot, "a### b$$$ c%%%").otherwise("a### b").alias("html"))
    out = uf.url_filter(pages, uf.listed_urls(pages))
    assert {r.verdict: r["count"] for r in out.groupBy("verdict").count().collect()} == {"allow": 1667, "block": 3333}
