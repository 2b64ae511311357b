"""Batched Viterbi against a plain one, and exact round trips."""
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lograil.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [None, "", " ", "  a", "a  b ", "▁x▁ y", "日本語 \U0001f600 é\x00\n\t", "x" * 3000, "The quick brown fox", "a" * 40 + " " + "▁" * 5]


@pytest.mark.parametrize("scores", ["rank", "file"])
def test_best_totals(scores):
    words, rng = pieces.Vocabulary(PATH, scores), random.Random(4)
    drawn = {pieces.MARK * rng.randint(0, 2) + "".join(rng.choice("theanré日अQ") for _ in range(rng.randint(1, 12))) for _ in range(1500)}
    words.ids_of(drawn)
    weight = dict(zip(words.ids.tolist(), words.weights.tolist())) | {i: words.fallback for i in words.bytes}
    for word in drawn:
        got, wanted = np.frombuffer(words.known[word], "<u4").tolist(), words._plainly(word)
        assert sum(map(weight.get, got)) == pytest.approx(sum(map(weight.get, wanted)), rel=1e-12)


def test_round_trips(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)) + [(None, "x")], "doc_id bigint, text string").withColumn("exact", F.lit(1)).repartition(3)
    rows = pieces.round_trips(docs, PATH).collect()
    assert len(rows) == len(TEXTS) + 1 and all(r.exact for r in rows)
    both = docs.select("text", pieces.encoded(F.col("text"), PATH).alias("ids")).withColumn("back", pieces.decoded(F.col("ids"), PATH)).collect()
    assert all((r.text or "") == r.back for r in both)
    assert pieces.round_trips(docs.limit(0), PATH).count() == 0


def test_joint_batches_change_nothing():
    a, b = pieces.Vocabulary(PATH), pieces.Vocabulary(PATH)
    texts = [t or "" for t in TEXTS]
    assert list(a.encode_all(texts, together=1)) == list(b.encode_all(texts))
