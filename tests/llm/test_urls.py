"""URL rules and the cascade against plain evaluation."""
import pytest
from pyspark.sql import functions as F

from lograil.llm import urls

URLS = [None, "", "no scheme", "http://", "HTTP://EXAMPLE.Net/en/x?y", "https://a.example.net/de", "ftp://b.NET", "http://c.net/", "x://notexample.net/en/",
        "http://example.com/de/1#z", "http://d.example.com/de", "http://fr.org/fr/", "http://e.org/fr", "a://b://c/d", "http://spam.example.org?/x", "http://h\n/x\ny", "http://\u00c4B.com/p"]


def plain(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[:min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [(len(h + p), h + p, v) for h, p, v in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule = max(fits, default=None)
    return host, path, rule and rule[1], rule[2] if rule else "block" if "spam" in host else "allow"


def test_rules_and_hosts(spark):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS)] + [(None, URLS[4], "y")], "page_id bigint, url string, host string")
    found = urls.judge(pages, F.col("host").contains("spam")).collect()
    assert len(found) == len(URLS) + 1
    for r in found:
        url = URLS[4 if r.page_id is None else r.page_id]
        assert (r.host, r.path, r.rule, r.verdict) == plain(url)


@pytest.mark.parametrize("share", [0, 2, 7, 1])
def test_cascade_is_exact_over_its_keys(spark, share):
    keys = spark.range(6000).select(F.concat(F.lit("host"), "id").alias("key"), (F.lit(share > 0) & (F.col("id") % max(share, 1) == 0)).alias("listed"))
    cascade = urls.Cascade(first=(3, 1), later=(2, 1))
    levels = cascade.build(keys)
    wrong = keys.where(urls.listed_by(levels, F.col("key")) != F.col("listed"))
    assert wrong.count() == 0 and (len(levels) > 2 or share in (0, 1))


def test_long_lists_are_joined_instead(spark):
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id bigint, url string")
    listed = F.col("host").contains("spam")
    small = urls.judge(pages, listed, cascade=urls.Cascade(most=64)).collect()
    assert sorted(map(tuple, small), key=str) == sorted(map(tuple, urls.judge(pages, listed).collect()), key=str)
    assert urls.judge(pages.limit(0), listed).count() == 0


def test_no_python_on_the_main_path(spark):
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id bigint, url string")
    plan = urls.judge(pages, F.col("host").contains("spam"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
