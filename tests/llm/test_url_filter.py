from strandloom.llm import url_filter

CASES = [
    ("http://Example.ORG/es/1?x=/de/", "example.org", "/es/1", "example.org/es/", "block"), ("https://a.example.org/en/12#f", "a.example.org", "/en/12", "example.org/en/1", "block"),
    ("https://a.example.org/en/2", "a.example.org", "/en/2", "org/", "allow"), ("https://badexample.org/es/", "badexample.org", "/es/", "org/", "allow"),
    ("http://x.com/fr/porn", "x.com", "/fr/porn", "com/fr/", "allow"), ("http://x.com/de/", "x.com", "/de/", "com/de/", "block"), ("http://x.com/DE/", "x.com", "/DE/", None, "allow"),
    ("http://porn.net/", "porn.net", "/", None, "block"), ("http://pornography.net/", "pornography.net", "/", None, "allow"), ("http://x.net/casino", "x.net", "/casino", None, "allow"),
    ("http://x.net/casino-casino", "x.net", "/casino-casino", None, "allow"), ("http://x.net/casino/POKER", "x.net", "/casino/POKER", None, "block"), ("http://x.net/?porn", "x.net", "/", None, "allow"),
    ("http://x.net#porn", "x.net", "", None, "allow"), ("http://example.org", "example.org", "", None, "allow"), ("no scheme/porn", "", "", None, "allow"), (None, "", "", None, "allow"), ("", "", "", None, "allow"),
    ("://h/p", "h", "/p", None, "allow"), ("http://u:p@x.com:80/fr/", "u:p@x.com:80", "/fr/", None, "allow"), ("a://b://c/d", "b:", "//c/d", None, "allow"), ("http://x.net/\nporn", "x.net", "/\nporn", None, "block"),
    ("http://x.net/" + "a/" * 20_000 + "xxx", "x.net", "/" + "a/" * 20_000 + "xxx", None, "block"), ("http://éporn.net/", "éporn.net", "/", None, "block"),
]


def test_cases(spark):
    frame = spark.createDataFrame([(i, c[0], "x") for i, c in enumerate(CASES)] + [(None, "http://xxx.net", "x")], "page_id long, url string, verdict string")
    rows = {r["page_id"]: r for r in url_filter.filter_urls(frame).collect()}
    for i, (url, host, path, rule, verdict) in enumerate(CASES):
        r = rows[i]
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, verdict), url
    assert rows[None]["verdict"] == "block"
    assert url_filter.filter_urls(frame.limit(0)).count() == 0


def test_vocabulary_weights(spark):
    frame = spark.createDataFrame([(1, "http://a.net/one/two"), (2, "http://a.net/one"), (3, "http://a.net/three")], "page_id long, url string")
    rows = url_filter.filter_urls(frame, rules=(), vocabulary={"one": 2, "two": 1, "three": url_filter.STRICT}, soft_limit=3).collect()
    assert {r["page_id"]: r["verdict"] for r in rows} == {1: "block", 2: "allow", 3: "block"}
    assert all(r["verdict"] == "allow" for r in url_filter.filter_urls(frame, rules=(), vocabulary={}).collect())


def test_vocabulary_table(spark):
    terms = spark.createDataFrame([("Glücksspiel", 100), ("wette", 1), ("bonus", 1), ("bonus", None), (None, 5), ("", 9), ("wette", 0)], "term string, weight int")
    assert url_filter.read_vocabulary(terms) == {"glücksspiel": 100, "wette": 1, "bonus": 1}
    pages = spark.createDataFrame([(1, "http://a.net/wette/bonus"), (2, "http://a.net/wette"), (3, "http://a.net/glücksspiel"), (4, "http://a.net/wetter-bonus")], "page_id long, url string")
    found = {r["page_id"]: r["verdict"] for r in url_filter.filter_urls(pages, vocabulary=terms).collect()}
    assert found == {1: "block", 2: "allow", 3: "block", 4: "allow"}
