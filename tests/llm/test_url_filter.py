
import pytest

from larder.llm import url_filter as uf
from larder.llm.queries import URL_RULES


def plain(url, rules, listed, default="allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = url[url.index("://") + 3 :]
        end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
        path = rest[end:].split("#")[0].split("?")[0]
    best = None
    for h, p, v in rules:
        if host and (host == h or host.endswith("." + h)) and path.startswith(p):
            x = (len(h + p), h + p, v)
            best = max(best or x, x)
    if best:
        return host, path, best[1], best[2]
    return host, path, None, max([v for u, v in listed if host and plain(u, [], [])[:2] == (host, path)] or [default])


URLS = [
    None, "", "no scheme", "http://", "http:///x", "https://a.com", "https://A.COM/", "https://xcom/", "http://example.com/en/1?q#f", "http://www.example.com/en/", "http://Www.Example.com/EN/",
    "http://m.www.example.com/en/x", "ftp://b.net/es/", "http://b.net?/es/", "http://b.net#/es/", "http://net/fr/a", "x://y://z.net/es/", "http://a..com/", "http://ä.com/ö", "http://b.org/listed", "http://B.org/listed?x=1", "http://a.com/\nnew",
    "http://" + "a." * 5000 + "com/" + "x" * 20000,
]
LISTED = [("http://b.org/listed", "block"), ("https://a.com", "block"), ("nothing", "block"), (None, "block")]


@pytest.mark.parametrize("rules", [URL_RULES, [], URL_RULES + [("com", "", "block"), ("com", "/", "block")]])
def test_equals_trying_every_rule(spark, rules):
    pages = spark.createDataFrame([(i % 20, u, "x", 1) for i, u in enumerate(URLS + URLS[:3])], "page_id long, url string, host string, verdict int")
    got = uf.judge(pages, spark.createDataFrame(rules, "host string, path string, verdict string"), listed=spark.createDataFrame(LISTED, "url string, verdict string")).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str((i % 20, *plain(u, rules, LISTED))) for i, u in enumerate(URLS + URLS[:3]))


def test_filter_has_no_false_negatives_and_few_false_positives(spark):
    keys = spark.range(20_000).selectExpr("concat('k', id) AS key")
    n = uf.n_blocks_for(20_000)
    blocks = uf.bloom_blocks(keys, n)
    assert uf.passed(keys, blocks, n).count() == 20_000
    assert uf.passed(spark.range(20_000).selectExpr("concat('other', id) AS key"), blocks, n).count() < 200


def test_empty_table(spark):
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    assert uf.judge(spark.createDataFrame([], "page_id long, url string"), rules).count() == 0
