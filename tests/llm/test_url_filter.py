from folio.llm.url_filter import judge_urls, reputation

URLS = [
    (1, "https://WWW.Example.com/en/x?y#z", "www.example.com", "/en/x", "www.example.com/en/", "allow"),
    (2, "http://blog.example.com/en/", "blog.example.com", "/en/", "example.com/en/", "block"),
    (3, "http://a.com/", "a.com", "/", "com/", "allow"),
    (4, "http://a.com", "a.com", "", None, "allow"),
    (5, "http://x.net/es/1", "x.net", "/es/1", "net/es/", "block"),
    (6, "http://x.net/esx", "x.net", "/esx", None, "allow"),
    (7, "no scheme", "", "", None, "allow"),
    (8, None, "", "", None, "allow"),
    (None, "ftp://u@h:21?q", "u@h:21", "", None, "allow"),
    (9, "x://notcom/y", "notcom", "/y", None, "allow"),
    (10, "http://bad.org/1", "bad.org", "/1", None, "block"),
    (10, "http://bad.org/1", "bad.org", "/1", None, "block"),
    (11, "", "", "", None, "allow"),
    (12, "http://a://b/c?d://e", "a:", "//b/c", None, "allow"),
]


def test_rules_and_reputation(spark):
    pages = spark.createDataFrame([(u[0], u[1], 1) for u in URLS] + [(100 + i, f"http://bad.org/{i}", 1) for i in range(60)] + [(200 + i, f"http://h{i % 9}.fine.org/{i}", 1) for i in range(90)], "page_id long, url string, host long")
    outcomes = spark.createDataFrame([(100 + i, 1) for i in range(60)] + [(200 + i, int(i % 30 == 0)) for i in range(90)] + [(201, None)], "page_id long, bad int")
    got = judge_urls(pages, outcomes).collect()
    assert len(got) == len(URLS) + 150
    by = {r.page_id: r for r in got}
    for i, _, host, path, rule, verdict in URLS:
        assert (by[i].host, by[i].path, by[i].rule, by[i].verdict) == (host, path, rule, verdict), i
    assert all(by[200 + i].verdict == "allow" for i in range(90))


def test_shrinkage(spark):
    rows = [("a.x.org", 1)] * 2 + [("b.x.org", 0)] * 50 + [("c.y.org", 1)] * 40
    got = {r.host: r for r in reputation(spark.createDataFrame(rows, "host string, bad int")).collect()}
    assert 0 < got["a.x.org"].rate < 1 and not got["a.x.org"].blocked and got["c.y.org"].blocked and got["b.x.org"].rate < 0.3


def test_empty(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    outcomes = spark.createDataFrame([], "page_id long, bad int")
    assert judge_urls(pages, outcomes).count() == 0
    one = spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string")
    assert judge_urls(one, outcomes).collect()[0].verdict == "allow"


def test_hosts_without_labels(spark):
    """New hosts are judged by the domain, else by the suffix, else by the whole table."""
    seen = [(f"h{i % 20}.bad.org", 1) for i in range(200)] + [(f"h{i % 20}.good.org", 0) for i in range(200)] + [(f"d{i % 20}.zip", 1) for i in range(200)] + [(f"d{i % 20}.net", 0) for i in range(400)]
    new = {"new.bad.org": "block", "new.good.org": "allow", "new.zip": "block", "x.new.zip": "block", "new.net": "allow", "new.dev": "allow"}
    pages = [(i, f"http://{h}/") for i, (h, _) in enumerate(seen)] + [(10_000 + i, f"http://{h}/") for i, h in enumerate(new)]
    outcomes = spark.createDataFrame([(i, bad) for i, (_, bad) in enumerate(seen)], "page_id long, bad int")
    got = judge_urls(spark.createDataFrame(pages, "page_id long, url string"), outcomes).collect()
    assert len(got) == len(pages) and {r.host: r.verdict for r in got if r.page_id >= 10_000} == new


def test_ports_users_and_suffixes_of_two_labels(spark):
    """Owners under a shared suffix don't share a domain; ports and users don't make a suffix of their own."""
    seen = [(f"h{i % 20}.bad.co.uk", 1) for i in range(200)] + [(f"d{i % 40}.co.uk", 0) for i in range(400)]
    new = {"u@new.bad.co.uk:8080": "block", "new.bad.co.uk": "block", "good.co.uk:80": "allow", "other.good.co.uk": "allow"}
    pages = [(i, f"http://{h}/") for i, (h, _) in enumerate(seen)] + [(10_000 + i, f"http://{h}/") for i, h in enumerate(new)]
    outcomes = spark.createDataFrame([(i, bad) for i, (_, bad) in enumerate(seen)], "page_id long, bad int")
    got = judge_urls(spark.createDataFrame(pages, "page_id long, url string"), outcomes).collect()
    assert {r.host: r.verdict for r in got if r.page_id >= 10_000} == new
