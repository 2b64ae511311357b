"""WARC round trips with record-like bytes in payloads, over whole files and over small blocks."""
import hashlib
import random
from uuid import uuid4

import pytest

from lograil.llm import warc
from lograil.session import shared_folder

FAKE = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:999>\r\nContent-Length: 4\r\n\r\nabcd\r\n\r\n"


def pages(n, seed=1):
    rng = random.Random(seed)
    kinds = [None, "", "x" * 900, "a" + FAKE + "b", FAKE, FAKE * 3, "WARC/1.1\r\n", "é" * 50 + "WARC/1.1\r\nfoo" * 90, "same" * 400, "\r\n\r\n",
             "b" * 1000, "b" * 999]
    urls = ["http://a b/\r\nX: y", None, "http://é/", "http://c/?q"]
    rows = [(i, rng.choice(urls), rng.choice(kinds)) for i in range(n)]
    return rows + [(None, None, "same" * 400), (3, "http://again/", "same" * 400)]


def expected(rows):
    last = {}
    for page_id, _, html in rows:
        if page_id is not None:
            last[html or ""] = max(last.get(html or "", page_id), page_id)
    out = []
    for page_id, url, html in rows:
        data = (html or "").encode()
        again = len(data) >= 1000 and page_id != last.get(html or "")
        target = None if url is None else url.replace(" ", "%20").replace("\r", "%0D").replace("\n", "%0A")
        out.append((page_id, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", last[html] if again else None, target))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [None, "3000"])
def test_round_trip(spark, block):
    rows = pages(60 if block else 200)
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(2)
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        if block:
            spark.conf.set("spark.sql.files.maxPartitionBytes", block)
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
        found = warc.round_trip(spark, df, f"{shared_folder(spark)}/warc-{uuid4().hex}").collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert sorted(map(tuple, found), key=str) == expected(rows)


def test_payloads_and_broken_chains(spark):
    path = f"{shared_folder(spark)}/warc-{uuid4().hex}"
    good = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:1>\r\nContent-Length: 11\r\n\r\nH: 1\r\n\r\nabc\r\n\r\n"
    bad = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 500\r\n\r\nH: 1\r\n\r\nabc\r\n\r\n"
    spark.createDataFrame([(good + good + bad + good,)], "record string").coalesce(1).write.option("lineSep", "\n\n").text(path)
    found = warc.read_warc(spark, path).collect()
    assert [bytes(r.payload) for r in found] == [b"abc", b"abc"]


def test_empty_table(spark):
    path = f"{shared_folder(spark)}/warc-{uuid4().hex}"
    assert warc.round_trip(spark, spark.createDataFrame([], "page_id bigint, url string, html string"), path).count() == 0
