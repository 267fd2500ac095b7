import re

from tilewright.llm.url_filters import judge, rules_frame

RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "", "block"), ("a.net", "/x", "allow"), ("net", "/tie", "allow"), ("net", "/tie", "block")]


def _brute(url):
    host = path = ""
    if url and "://" in url:
        host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1]).groups()
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(h + p), len(h), a == "block", h + p, a) for h, p, a in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, 0, None, "allow"))
    return host, path, best[3], best[4]


def test_verdicts_match_brute_force(spark):
    urls = [None, "", "nothing", "http://", "HTTP://WWW.Example.COM/en/7?x#y", "https://a.com/en/1", "x://com/en/", "http://b.a.net/x1", "http://net", "http://net/tie/1", "http://xnet/",
            "http://example.com:80/en/7", "http://u@example.com/en/", "a://b://c.com/en/", "http://..com/en/", "http://ex.com?en/", "ÀB://É.COM/en/ü"] * 2
    pages = spark.createDataFrame([(i, u, "old") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    out = judge(pages, rules_frame(spark, RULES)).collect()
    assert len(out) == len(urls)
    for r in out:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == _brute(r["url"]), r


def test_no_rules_and_no_pages(spark):
    pages = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    assert judge(pages, rules_frame(spark, [])).first()["verdict"] == "allow"
    assert judge(pages.where("page_id < 0"), rules_frame(spark, RULES)).count() == 0
