"""The language model: exact counts and base scores, a proper distribution, and seating odds."""
import math
import os
import zlib
from collections import Counter
from urllib.parse import unquote

import numpy as np
import pytest
from pyspark.sql import functions as F

from lograil.llm import pitman_yor as py

TEXTS = ["The cat sat on the mat", "the cat", None, "", "Été à la mer", "a\tb\nc\x0bd", "the the the the the", "A" * 5000, "cat sat on"] * 8


def tokens(text):
    return ("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")).encode().split() + [b""]


@pytest.fixture(scope="module")
def scored(spark):
    rows = list(enumerate(TEXTS)) + [(None, "the cat"), (3, "the cat")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("score", F.lit(1)).repartition(4)
    return rows, py.language_model_scores(docs).collect()


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def test_base_scores_and_counts(scored):
    rows, found = scored
    count = Counter(t for i, x in rows if not held(i) for t in tokens(x))
    n, v = sum(count.values()), len(count)
    base = lambda x: sum(math.log10((count[t] + 1) / (n + v + 1)) for t in tokens(x))
    wanted = sorted([(i, held(i), len(tokens(x)), sum(count[t] > 0 for t in tokens(x)), n, round(base(x), 6)) for i, x in rows], key=str)
    got = sorted([(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in found], key=str)
    assert got == wanted and all(math.isfinite(r.score) and r.score < 0 for r in found)
    train = [r for r in found if not r.held_out]
    assert sum(r.score for r in train) > sum(r.base_score for r in train)


def test_probabilities_add_up_to_one(spark):
    docs = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    seated, totals = py.seat(py.count(docs))
    rows = seated.collect()
    assert totals.types == len(rows) and totals.tokens == sum(len(tokens(t)) for t in TEXTS)
    counts, tables = np.array([r.counts for r in rows]), np.array([r.tables for r in rows])
    assert ((tables > 0) == (counts > 0)).all() and (tables <= counts).all()
    parent = np.array([r.parent for r in rows])
    p1 = py._parent(np.append(tables.sum(1), 0), np.append(parent, 0), totals, 1.0)
    assert p1.sum() == pytest.approx(1)
    for k in range(py.CLASSES):
        c, t = np.append(counts[:, k], 0), np.append(tables[:, k], 0)
        p = (c - totals.discount * t + (1 + totals.discount * totals.tables[k]) * p1) / (1 + totals.customers[k])
        assert p.sum() == pytest.approx(1) and (p > 0).all()


def test_odds_of_sitting_alone():
    """Against sequential seating in which only seatings with the wanted number of tables count."""
    rng, discount, c, want = np.random.default_rng(0), 0.6, 5, 3
    alone = total = 0
    for _ in range(30_000):
        sizes = []
        for n in range(c):
            u = rng.random() * (n + 1.0)
            for k, s in enumerate(sizes):
                u -= s - discount
                if u < 0:
                    sizes[k] += 1
                    break
            else:
                sizes.append(1)
        if len(sizes) == want:
            alone, total = alone + sizes.count(1), total + c
    assert py.alone(np.array([c]), np.array([want]), discount, 64)[0] == pytest.approx(alone / total, abs=0.02)
    big = py.alone(np.array([64, 65]), np.array([20, 20]), discount, 64)
    assert big[0] == pytest.approx(big[1], rel=0.1)
    assert py.alone(np.array([3, 900]), np.array([3, 900]), discount, 64).tolist() == [1, 1]


def test_sweeps_settle_where_sequential_seating_does():
    n, odds, discount = 4000, 2.0, 0.5
    keys = py.places(1, 0, np.zeros(n), np.arange(n))
    tables = py.sweep(keys, 0, np.full(n, 40), np.full(n, 40), np.full(n, odds), discount, py.Sampling())
    for k in range(1, 9):
        tables = py.sweep(keys, k, np.full(n, 40), tables, np.full(n, odds), discount, py.Sampling(moves=40))
    log = np.full(42, -np.inf)
    log[0] = 0
    for c in range(40):
        t = np.arange(42)
        with np.errstate(divide="ignore"):
            stay = log + np.log(np.maximum(c - discount * t, 0))
        log = np.logaddexp(stay, np.append(-np.inf, log[:-1] + math.log(odds)))
    p = np.exp(log - np.logaddexp.reduce(log))
    assert tables.mean() == pytest.approx((p * np.arange(42)).sum(), rel=0.05)


def test_empty_table(spark):
    assert py.language_model_scores(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_packed_seats_come_back():
    rng = np.random.default_rng(2)
    counts = rng.integers(0, 3, (50, py.CLASSES)) * rng.choice([1, 1, 1, 200, 10**12], (50, 1))
    counts[7] = 0
    tables = np.minimum(counts, 5)
    got = py._unpacked(py._packed(counts, tables, tables.sum(axis=1)))
    assert all(np.array_equal(a, b) for a, b in zip(got, (counts, tables, tables.sum(axis=1))))


def test_contexts_are_words_and_probabilities_add_up_to_one(spark):
    """'on' and 'in', 'x' and 'h' end alike: the class is the same, what follows is not."""
    texts = ["on monday x one", "in winter h two"] * 40 + TEXTS
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    pairs = Counter()
    for t in texts:
        pairs.update(zip([b"", *tokens(t)[:-1]], tokens(t)))
    words, counted = py.count_pairs(docs)
    name = {r.word: bytes(r.token) for r in words.collect()}
    assert {(name[r.prev], name[r.word]): r.customers for r in counted.collect()} == pairs
    seated, classes, totals, discount = py.seat_pairs(words, counted)
    rows = seated.collect()
    assert len(rows) == len(pairs) > py.CLASSES and all(1 <= r.tables <= r.customers for r in rows)
    got = py.score(spark.createDataFrame([(i, False, t) for i, t in enumerate([b"on monday", b"on winter", b"in winter", b"in monday"])],
                                         "doc_id bigint, held_out boolean, text binary"), seated, classes, totals, discount).collect()
    got = {r.doc_id: r.score for r in got}
    assert got[0] > got[1] + 0.5 and got[2] > got[3] + 0.5
    served = {r.word: r for r in classes.collect()}
    order = list(served)
    matrix = np.array([served[w].counts for w in order] + [[0] * py.CLASSES]), np.array([served[w].tables for w in order] + [[0.0] * py.CLASSES])
    p1 = py._parent(matrix[1].sum(1), np.array([served[w].parent for w in order] + [0.0]), totals, 1.0)
    below = (matrix[0] - totals.discount * matrix[1] + (1 + totals.discount * np.array(totals.tables)) * p1[:, None]) / (1 + np.array(totals.customers))
    assert below.sum(0) == pytest.approx(np.ones(py.CLASSES))
    probability = {}
    for u in (b"on", b"in", b"the", b""):
        k = py.number_of(u)
        own = {r.word: r for r in rows if r.prev == k}
        more, size = 1 + discount * sum(r.tables for r in own.values()), 1 + sum(r.customers for r in own.values())
        for w, p in zip([*order, None], below[:, k & 31]):
            c = (own[w].customers - discount * own[w].tables if w in own else 0) + more * p
            probability[u, name.get(w)] = c / size
        assert sum(p for (v, _), p in probability.items() if v == u) == pytest.approx(1)
    whole = math.log10(probability[b"", b"on"] * probability[b"on", b"monday"])
    assert got[0] - whole < 0 and got[0] - got[1] > math.log10(probability[b"on", b"monday"] / probability[b"on", b"winter"]) - 1
    empty = py.score(spark.createDataFrame([(0, False, b"")], "doc_id bigint, held_out boolean, text binary"), seated, classes, totals, discount).first()
    assert empty.score == pytest.approx(math.log10(probability[b"", b""]), abs=1e-5)


def test_two_passes_settle_before_the_averaged_one():
    sampling = py.Sampling()
    assert (sampling.rounds, sampling.sweeps, sampling.samples) == (2, 3, 3)


@pytest.mark.parametrize("trials", [1, 7, py.SINGLE, 60, 5000])
def test_successes_are_binomial(trials):
    keys = py.places(3, 1, np.full(20_000, 5), np.arange(20_000))
    got = py.successes(keys, 4, np.full(20_000, trials), np.full(20_000, 0.3))
    assert got.min() >= 0 and got.max() <= trials
    assert got.mean() == pytest.approx(0.3 * trials, rel=0.03) and got.var() == pytest.approx(0.21 * trials, rel=0.06)
    assert abs(np.corrcoef(got[:-1], got[1:])[0, 1]) < 0.03


def test_scores_do_not_depend_on_partitions(spark):
    """Rows dealt and shuffled in other ways give the same seating, so a repeated task does too."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    old, found = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for parts in (2, 4, 7):
            spark.conf.set("spark.sql.shuffle.partitions", str(parts))
            found.append({r.doc_id: r.score for r in py.language_model_scores(docs.repartition(parts)).collect()})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert len(found[0]) == 200 and found[0] == pytest.approx(found[1], rel=1e-6) and found[0] == pytest.approx(found[2], rel=1e-6)


def test_pairs_travel_and_lie_in_few_bytes(spark):
    """Two hashes and a number for a pair are 24 bytes; shuffled and stored like that they took more disk than allowed."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(F.col("text").cast("binary").alias("text"))
    texts = [r.text or b"" for r in docs.collect()]
    keys, lengths, words, numbers = py.numbered(py.pa.array(texts, py.pa.binary()))
    assert lengths.tolist() == [len(tokens(t.decode())) for t in texts]
    assert [words[k] for k in keys & 0xFFFFFFFF] == [t for x in texts for t in tokens(x.decode())]
    assert numbers.tolist() == sorted(map(py.number_of, words))
    keys = np.unique(keys)
    cells = [(at, py._listed(keys[at], numbers)) for _, at in py._cells(keys, numbers, 3)]
    assert sum(len(p) for _, parts in cells for p in parts) < 10 * len(keys)
    back = [(a[c], b[d]) for a, b, c, d in (py._unlisted(parts) for _, parts in cells)]
    assert all(np.array_equal(prev, numbers[keys[at] >> 32]) and np.array_equal(word, numbers[keys[at] & 0xFFFFFFFF]) for (at, _), (prev, word) in zip(cells, back))
    assert sorted(k for at, _ in cells for k in at.tolist()) == [*range(len(keys))]
    stored, pairs = py.count_pairs(docs)
    size = sum(os.path.getsize(unquote(f.removeprefix("file://"))) for f in pairs.inputFiles())
    assert size < 10 * pairs.count() + 20 * stored.count()
