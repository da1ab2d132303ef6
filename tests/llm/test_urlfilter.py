import re

from edgeloom.llm.urlfilter import RULES, fit, judge, labelled_urls

URLS = [
    "https://A.Example.ORG/en/7", "http://example.org/en/1x?y=/es/", "http://m.example.org/es/3#f", "ftp://x.com/fr/", "x://com/de/9", "http://notexample.org/es/", "http://example.com/en/3", "http://www.news.example.net/en/2",
    "http://free-bets.example.net/en/2", "http://www.casino.example.com/de", "no scheme", "", None, "http://", "http://host", "http://host?q=http://z.org/", "a://b://c/d", "http://ÄB.example.net/é", "https://x.net/" + "p" * 30_000,
    "http://news.example.net/en/2\nhttp://x.org/",
]


def brute(url):
    host, path = "", ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"(?s)[^/?#]*", rest)[0]
        path = re.match(r"(?s)[^?#]*", rest[len(host):])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits, key=lambda r: len(r[0])) if fits else (None, None))


def test_rules_and_model(spark):
    pages = spark.createDataFrame([(i, u, "old") for i, u in enumerate(URLS + URLS[:2])], "page_id long, url string, verdict string")
    model = fit(labelled_urls(spark))
    out = {r.page_id: r for r in judge(pages, model).collect()}
    assert len(out) == len(URLS) + 2
    for i, url in enumerate(URLS + URLS[:2]):
        host, path, rule, verdict = brute(url)
        r = out[i]
        assert (r.host, r.path, r.rule) == (host, path, rule), url
        assert r.verdict == (verdict or ("block" if r.score >= 0.5 else "allow"))
    assert out[8].verdict == out[9].verdict == "block" and out[6].verdict == out[7].verdict == "allow"


def test_held_out_urls(spark):
    made = labelled_urls(spark).collect()
    model = fit(spark.createDataFrame([r for i, r in enumerate(made) if i % 5], "url string, verdict string"))
    test = spark.createDataFrame([(r.url, r.verdict) for r in made[::5]], "url string, truth string")
    out = judge(test, model, rules=()).collect()
    assert sum(r.verdict == r.truth for r in out) / len(out) > 0.9


def test_labels_of_one_kind_or_none(spark):
    pages = spark.createDataFrame([(1, "http://q.net/")], "page_id long, url string")
    none = spark.createDataFrame([], "url string, verdict string")
    assert judge(pages, fit(none)).first().verdict == "allow"
    assert judge(pages, fit(spark.createDataFrame([("http://z.net/", "block")], none.schema))).first().verdict == "block"
    assert judge(pages.where("false"), fit(none)).count() == 0
