"""Compression classifier: whole results against a plain version, held-out accuracy, odd input."""
import math
import zlib

import numpy as np
import pytest
import zstandard

from lograil.llm import quality
from lograil.llm.common import table

FOLDER = "/root/testdata/sf0.01"
DOCS, LABELS = "doc_id bigint, text string", "doc_id bigint, quality int"


@pytest.fixture(scope="module")
def rows(spark):
    docs = [(r.doc_id, r.text) for r in table(spark, FOLDER, "documents").collect()]
    labels = [(r.doc_id, r.quality) for r in table(spark, FOLDER, "labels").collect()]
    return docs, labels


@pytest.fixture(scope="module")
def model(spark):
    return quality.fitted(table(spark, FOLDER, "documents"), table(spark, FOLDER, "labels"))[0]


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_held_out_accuracy(spark, rows, model):
    docs, labels = rows
    got = by_id(quality.classify(table(spark, FOLDER, "documents"), model))
    held = [(got[i], q) for i, q in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(r.held_out and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r, _ in held)
    good, bad = [r for r, q in held if q == 1], [r for r, q in held if q == 0]
    assert len(bad) > 5 and sum(r.predicted for r in good) >= 0.95 * len(good) and sum(1 - r.predicted for r in bad) >= 0.6 * len(bad)
    order = [(g.score > b.score) + (g.score == b.score) / 2 for g in good for b in bad]
    assert np.mean(order) > 0.85


def test_scores_by_plain_compression(spark, rows, model):
    """Every score of the table again, a text at a time, with zstandard used afresh; the stored differences are those."""
    docs, _ = rows
    packers = [zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False) for d in model.dictionaries]
    got = by_id(quality.classify(table(spark, FOLDER, "documents"), model))
    for doc_id, text in docs:
        data = text.encode()
        sizes = [sum(len(p.compress(data[i:i + 1024])) for i in range(0, len(data), 1024)) for p in packers]
        difference = (sizes[0] - sizes[1]) / len(data)
        assert math.isclose(got[doc_id].difference, difference, abs_tol=1e-12)
        assert math.isclose(got[doc_id].score, 1 / (1 + math.exp(-(model.curve.slope * difference + model.curve.offset))), rel_tol=1e-9)


def test_held_out_labels_and_other_columns_change_nothing(spark, rows, model):
    docs, labels = rows
    turned = [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q) for i, q in labels]
    clashing = spark.createDataFrame([(*d, "x", 1, 2, b"d", 0) for d in docs[::-1]], DOCS + ", lang string, quality int, good int, data binary, at int").repartition(5)
    again = quality.fitted(clashing, spark.createDataFrame([(*x, 1, "t") for x in turned], LABELS + ", toxic int, text string"))[0]
    assert again == model


def test_labels_repeated_contradictory_and_odd(spark, rows, model):
    docs, labels = rows
    more = labels + labels[:50] + [(None, 1), (None, 0), (10 ** 9, 0)]
    fresh = [i for i, _ in docs if i not in dict(labels)][:3]
    more += [(fresh[0], 0), (fresh[0], 1), (fresh[1], 2), (fresh[2], None)]
    assert quality.fitted(spark.createDataFrame(docs, DOCS), spark.createDataFrame(more, LABELS))[0] == model


def test_odd_rows_have_scores(spark, model):
    rows = [(1, None), (1, ""), (None, "Good words."), (2, "x " * 1_500_000), (2, "x " * 1_500_000), (3, "é" * 700)]
    got = quality.classify(spark.createDataFrame([(*r, 0.5) for r in rows], DOCS + ", score double"), model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    empty = [r for r in got if r.doc_id == 1]
    assert [r.difference for r in empty] == [0.0, 0.0] and all(r.predicted == (r.score >= 0.3) for r in empty)
    assert quality.classify(spark.createDataFrame([], DOCS), model).collect() == []


def test_few_or_no_labels(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(40)], DOCS)
    none = quality.quality_scores(docs, spark.createDataFrame([], LABELS)).collect()
    assert {r.score for r in none} == {0.5}
    one = quality.quality_scores(docs, spark.createDataFrame([(i, 1) for i in range(20)], LABELS)).collect()
    assert all(r.predicted == 1 for r in one)
    assert len(quality.quality_scores(docs, spark.createDataFrame([(i, i % 2) for i in range(20)], LABELS)).collect()) == 40


def test_curve_against_a_grid():
    """No curve near the fitted one is likelier."""
    rng = np.random.default_rng(1)
    x = np.linspace(-0.2, 0.3, 40)
    good = rng.binomial(50, 1 / (1 + np.exp(-(30 * x + 0.5))))
    curve = quality.calibrated(x, good.astype(float), 50.0 - good, 0.0)

    def likelihood(slope, offset):
        z = slope * x + offset
        return (good * z - 50 * np.logaddexp(0, z)).sum()

    best = likelihood(curve.slope, curve.offset)
    assert all(likelihood(a, b) <= best + 0.2 for a in np.linspace(10, 60, 60) for b in np.linspace(-2, 3, 60))
    assert 20 < curve.slope < 40
