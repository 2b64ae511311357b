"""Exact duplicates against grouping by text, with fingerprints that collide on purpose."""
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lograil.llm import exact
from lograil.llm.exact import Polynomial

TINY = Polynomial(primes=(7, 11), bases=(3, 5), chunk=4, huge=10)


def expected(rows):
    """(doc_id, text) -> sorted (doc_id, keep_id, size, sha), and how many rows stay."""
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(text or "", []).append(doc_id)
    out = []
    for doc_id, text in rows:
        ids = groups[text or ""]
        top = max((i for i in ids if i is not None), default=None)
        out.append((doc_id, top, len(ids), hashlib.sha256((text or "").encode()).hexdigest()))
    return sorted(out, key=str), len(groups)


@pytest.mark.parametrize("poly", [Polynomial(), TINY])
def test_equals_grouping_by_text(spark, poly):
    rng = random.Random(3)
    texts = [None, "", "a", "b", "ab" * 9, "é" * 30, "x" * 70_000] + ["".join(rng.choice("ab") for _ in range(5)) for _ in range(12)]
    rows = [(rng.choice([i, None]) if i % 9 == 0 else i, rng.choice(texts)) for i in range(150)] + [(5, "a"), (5, "a")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    found = exact.exact_duplicates(docs, poly).collect()
    wanted, groups = expected(rows)
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found], key=str) == wanted
    assert sum(r.kept for r in found) == groups
    assert all(r.doc_id == r.keep_id for r in found if r.kept)


def test_chunks_compose_in_any_order():
    poly, data = Polynomial(chunk=8), bytes(range(256)) * 3
    powers, parts, total = poly.powers(), [], [0, 0]
    for at in range(0, len(data), 8):
        part = np.frombuffer(data[at:at + 8], np.uint8)
        parts.append(poly.shifted(poly.of_chunk(part, powers), max(len(data) - at - 8, 0)))
    for value in reversed(parts):
        total = [(a + b) % p for a, b, p in zip(total, value, poly.primes)]
    assert tuple(total) == poly.of_text(data, powers) == Polynomial().of_text(data, Polynomial().powers())


def test_kept_documents_come_back_as_they_were(spark):
    rows = [(1, "a", 1), (2, "a", 2), (2, "a", 3), (None, "b", 4), (3, None, 5), (4, "", 6)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, kept int").withColumn("row", F.lit("r"))
    left = exact.keep_decided(docs, exact.exact_duplicates(docs))
    assert left.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in left.collect()), key=str)
    assert got == sorted([(2, "a"), (None, "b"), (4, "")], key=str)


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert exact.exact_duplicates(empty).count() == 0
    assert exact.keep_decided(empty, exact.exact_duplicates(empty)).count() == 0
