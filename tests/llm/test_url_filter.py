import pytest

from quillan.llm import url_filter

RULES = [("com", "/", "allow"), ("a.com", "/x", "block"), ("b.a.com", "/x/", "allow"), ("net", "", "block"), ("net", "", "allow"), (None, "/", "block")]
URLS = ["http://B.a.com/x/1?q#f", "https://a.com/xy", "https://a.com", "https://q.a.com/z", "net", None, "ftp://deep.net#top", "x://aa.com/x", "http://", "http://com/\nx?", "http://a.com/x"]


def brute(url):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        host = rest
        for c in "/?#":
            host = host.split(c)[0]
        path = rest[len(host):].split("?")[0].split("#")[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = None
    for h, p, v in RULES[:4]:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, v)
    return (host, path, best[0] if best else None, best[1] if best else "allow")


@pytest.mark.parametrize("most", [100_000, 0])
def test_against_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(url_filter, "BROADCAST_RULES", most)
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(URLS * 2)], "page_id long, url string, host string")
    got = {r["page_id"]: tuple(r)[1:] for r in url_filter.judge_urls(pages, rules).collect()}
    assert got == {i: brute(u) for i, u in enumerate(URLS * 2)}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    assert [tuple(r) for r in url_filter.judge_urls(pages, none).collect()] == [(1, "a.com", "/", None, "allow")]
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    assert url_filter.judge_urls(pages.limit(0), rules).count() == 0


def test_filter_has_no_false_negatives(spark):
    rules = spark.range(5000).selectExpr("concat('h', id, '.com') as r_host", "'/' as r_path")
    words = url_filter.build_filter(rules, 1 << 12)
    import numpy as np

    h = rules.selectExpr("xxhash64(r_host, r_path) a", "xxhash64(r_path, r_host) b").toPandas()
    assert len(words) * 64 <= 1 << 12
    assert url_filter.may_hold(words, h["a"].to_numpy(np.int64), h["b"].to_numpy(np.int64)).all()
