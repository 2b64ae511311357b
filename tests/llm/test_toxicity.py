"""The classifier: held-out accuracy, whole texts, and inputs that never count."""
import random
import zlib
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from lograil.llm import toxicity as tox


def corpus(n=900, seed=1):
    rng = random.Random(seed)
    plain = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    rows = []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(rng.randint(5, 120))]
        bad = i % 5 == 0
        for _ in range(rng.randint(1, 3) if bad else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["idiot", "moron", "scum"]))
        rows.append((i, " ".join(words), rng.choice(["en", "de", None]), int(bad)))
    return rows


@pytest.fixture(scope="module")
def net():
    rows = [r for r in corpus() if zlib.crc32(str(r[0]).encode()) % 3 != 1]
    return tox.train([r[1] for r in rows], [r[3] for r in rows], [r[2] for r in rows], fit=tox.Fit(epochs=4))


def test_held_out_accuracy(spark, net):
    rows = corpus()
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id bigint, text string, lang string").repartition(3)
    truth = {r[0]: r[3] for r in rows}
    found = [r for r in tox.classify(docs, net).collect()]
    assert len(found) == len(rows) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in found)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in found)
    out = [r for r in found if r.held_out]
    assert sum(r.predicted == truth[r.doc_id] for r in out) / len(out) > 0.95


def test_score_is_of_the_text_alone_and_whole(spark, net):
    late = "la " * 40_000 + "idiot moron scum idiot moron"
    rows = [(1, late, "en"), (4, late, None), (None, None, None), (5, "", "x"), (5, "", "x"), (6, "%%%", "en")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumn("score", F.lit(2)).withColumn("source", F.lit("s"))
    found = tox.classify(docs, net).collect()
    scores = {}
    for r in found:
        scores.setdefault(r.doc_id, set()).add(r.score)
    assert len(found) == 6 and all(len(s) == 1 for s in scores.values())
    assert scores[1] == scores[4] and min(scores[1]) >= 0.7 and scores[None] == scores[5] == scores[6]
    clean = tox.clean(docs, net)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {None, 5, 6}
    words = tox._Words(net)
    assert tox._score(words, late) == pytest.approx(float(tox._sigmoid(tox._forward(net, tox.word_ids(late, net.fit.buckets))[0] + net.shift)), abs=1e-5)


def test_sample_is_bounded_and_reads_no_held_out_rows(spark):
    rows = corpus(300)
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows] + [(None, 1), (1, None)], "doc_id bigint, toxic int")
    got = tox.sample(docs, labels, tox.Fit(toxic=20, clean=30)).collect()
    assert len(got) == 50 and sum(r.toxic for r in got) == 20
    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 != 1 for r in got)


def test_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "a b", "en")], "doc_id bigint, text string, lang string")
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    net = tox.fitted(docs, none)
    assert [r.predicted for r in tox.classify(docs, net).collect()] == [0]
    assert tox.classify(docs.limit(0), net).count() == 0


def test_stage_uses_the_threshold_of_the_language(spark, net):
    docs = spark.createDataFrame([(1, "idiot moron scum", "en"), (2, "la le", "xx"), (3, "idiot moron scum", "yy"), (4, "la le", None)],
                                 "doc_id bigint, text string, lang string")
    own = replace(net, thresholds={"xx": 0.0, "yy": 1.1})
    kept = {r.doc_id for r in tox.clean(docs, own).collect()}
    assert kept == {3, 4} == {r.doc_id for r in tox.classify(docs, own).where("NOT flagged").collect()}


def test_rare_languages_are_sampled_and_calibrated(spark):
    rng = random.Random(3)
    rows = [(i, f"w{rng.randint(0, 50)} w{rng.randint(0, 50)}" + (" idiot scum" if bad else ""), "es" if i % 15 == 0 else "en", int(bad))
            for i in range(6000) for bad in [rng.random() < 0.5]]
    fit = tox.Fit(toxic=200, clean=200, epochs=1)
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id bigint, toxic int")
    got = tox.sample(docs, labels, fit).collect()
    assert len(got) == 400 and all(sum(r.lang == x and r.toxic == y for r in got) == 100 for x in ("en", "es") for y in (0, 1))
    usable = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 != 1]
    assert sum(r.stands for r in got) == pytest.approx(len(usable))
    assert set(tox.fitted(docs, labels, fit).thresholds) == {"en", "es"}


def plain_score(net, text):
    """One text by loops: every window of every filter, then the largest values."""
    ids = [tox.buckets_of(w, net.fit.buckets) for w in tox.WORD.findall(text.lower())]
    x = [net.embedding[a] + net.embedding[b] for a, b in ids]
    logit = net.bias
    for k, width in enumerate(tox.WIDTHS):
        for f in range(net.fit.filters):
            values = [net.biases[k][f] + sum(float(x[i + o] @ net.convolutions[k][o][:, f]) for o in range(width) if i + o < len(x)) for i in range(max(len(x), 1))]
            for place, value in enumerate(sorted(values, reverse=True)[:net.fit.pooled]):
                logit += max(value, 0) * net.weights[k][place][f]
    return 1 / (1 + np.exp(-(logit + net.shift)))


def test_scores_of_a_table_by_loops(spark, net):
    rows = [r[:3] for r in corpus(60, 9)] + [(70, "", "en"), (71, "idiot", None), (72, None, "de")]
    found = tox.classify(spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(3), net).collect()
    assert {r.doc_id: round(r.score, 4) for r in found} == {i: pytest.approx(plain_score(net, text or ""), abs=2e-4) for i, text, _ in rows}


def test_contradictory_and_repeated_labels_and_long_texts(spark):
    rows = [(i, "la " * 10 if i < 90 else "la " * 40_000, "en") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumn("toxic", F.lit(9))
    labels = [(i, i % 2) for i in range(100)] + [(i, 1 - i % 2) for i in range(0, 40)] + [(i, i % 2) for i in range(40, 60)] + [(70, 2)]
    got = tox.sample(docs, spark.createDataFrame(labels, "doc_id bigint, toxic int").withColumn("text", F.lit("x")), tox.Fit()).collect()
    assert sorted(r.doc_id for r in got) == [i for i in range(40, 90) if i != 70 and zlib.crc32(str(i).encode()) % 3 != 1]
    assert all(r.stands == 1 for r in got)


def test_threshold_rule():
    one = lambda *x: np.array(x, float)
    # Wherever toxic rows are apart, the threshold lies between; a single one below all clean rows marks none of them.
    assert 1 < tox._best_threshold(one(3, 2, 1, 0), one(1, 1, 0, 0), one(1, 1, 1, 1)) < 2
    assert tox._best_threshold(one(*range(50)), one(1, *[0] * 49), np.ones(50)) > 49
    assert tox._best_threshold(one(1, 1), one(0, 1), one(1, 1)) != 1


def test_rows_beyond_the_sample_teach(spark):
    """The sample holds none of the words that only long texts beyond its bound have; they are learned and calibrated."""
    rng = random.Random(5)
    rows = [(i, " ".join(f"w{rng.randint(0, 80)}" for _ in range(30)) + (" scum" if i % 4 == 0 else ""), "en", int(i % 4 == 0)) for i in range(900)]
    rows += [(i, "la " * 40 + ("moron " if i % 2 else "lo "), "de", i % 2) for i in range(900, 1800)]
    fit = tox.Fit(longest=100, toxic=60, clean=60, part=400)
    assert all((len(r[1]) > 100) for r in rows[900:])
    short = [(i, t[:90] if lang == "en" and not bad else ("scum " * 5 if lang == "en" else t), lang, bad) for i, t, lang, bad in rows]
    docs = spark.createDataFrame([r[:3] for r in short], "doc_id bigint, text string, lang string").repartition(3)
    labels = spark.createDataFrame([(r[0], r[3]) for r in short], "doc_id bigint, toxic int")
    assert {r.lang for r in tox.sample(docs, labels, fit).collect()} == {"en"}
    net = tox.fitted(docs, labels, fit)
    assert set(net.thresholds) == {"en", "de"}
    truth = {r[0]: r[3] for r in short}
    found = [r for r in tox.classify(docs, net).collect() if r.held_out and r.doc_id >= 900]
    assert sum(r.predicted == truth[r.doc_id] for r in found) / len(found) > 0.9
    again = tox.fitted(docs.repartition(5), labels, fit)
    assert np.array_equal(net.embedding, again.embedding) and net.shift == again.shift


def test_networks_learn_in_one_pass_what_they_learn_alone(spark):
    """One dealing of the rows serves all networks, with the parameters that a pass of its own gives to each."""
    rows, fit = corpus(120), tox.Fit(epochs=1, buckets=1 << 10)
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id bigint, toxic int")
    teach = tox.teaching(docs, labels, fit).cache()
    ids = [tox.word_ids(r[1], fit.buckets) for r in rows[:60]]
    begin = (*tox._network(ids, np.array([r[3] for r in rows[:60]], float), fit), tox._seen(fit, ids))
    together = tox._taught(teach, [(*begin, 0), (*begin, None)], 2)
    alone = [tox._taught(teach.where("fold <> 0"), [(*begin, None)], 2)[0], tox._taught(teach, [(*begin, None)], 2)[0]]
    for a, b in zip(together, alone):
        assert np.array_equal(a.embedding, b.embedding) and np.array_equal(tox._dense(a), tox._dense(b))
    assert not np.array_equal(together[0].embedding, together[1].embedding)


def test_labels_meet_the_texts_without_moving_them(spark):
    docs = spark.createDataFrame([r[:3] for r in corpus(50)], "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in corpus(50)], "doc_id bigint, toxic int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = tox.teaching(docs, labels, tox.Fit())._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan


def test_values_of_all_filters_come_from_one_product(net):
    rng = np.random.default_rng(4)
    for n in (0, 1, 2, 5, 300):
        ids = rng.integers(0, net.fit.buckets, (n, 2)) + [0, net.fit.buckets]
        x = tox._vectors(net, ids, max(tox.WIDTHS))
        got = tox._values(net, tox._matrix(net), x, max(n, 1)).reshape(len(tox.WIDTHS), net.fit.filters, -1)
        for k, width in enumerate(tox.WIDTHS):
            plain = sum(x[o:o + max(n, 1)] @ net.convolutions[k][o] for o in range(width))
            assert np.allclose(got[k].T, plain, atol=1e-5)
        held = got[0].copy()
        top, best = tox._pool(got[0], net.fit.pooled)
        assert np.array_equal(best, -np.sort(-held, axis=1).T[:net.fit.pooled]) and np.array_equal(np.take_along_axis(held.T, top, 0), best)
    assert tox.word_ids("a bc a", 1 << 10).tolist() == [list(tox.buckets_of(w, 1 << 10)) for w in ("a", "bc", "a")]
    assert tox.word_ids("a", 1 << 10).itemsize == 4
